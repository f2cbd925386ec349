"""Running maxima, sums and last values over buckets of an order, so that no task walks through all rows of a key.

A bucket holds the rows whose first order column lies in one interval of ``width``. Within it a window runs as usual; what the
buckets before leave behind is one row for each bucket, and only these rows of a key meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TOTAL = {"max": F.max, "sum": F.sum}
_JOIN = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def running(df: DataFrame, keys: list[str], order: list[str], width: int, values: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """``df`` with a column for each entry (name: kind, value, whether the row itself counts) over all rows up to it.

    Kinds are max and sum; nulls are passed over, and a running value without any is null. Rows of null ``order[0]`` come first, rows of
    equal order in any order. Null keys are a key.
    """
    at = df.withColumn("__b", F.call_function("div", F.col(order[0]), F.lit(width)))
    run = Window.partitionBy(*keys, "__b").orderBy(*order)
    own = [_TOTAL[k](v).over(run.rowsBetween(Window.unboundedPreceding, 0 if here else -1)).alias(f"__own_{n}") for n, (k, v, here) in values.items()]
    ends = at.groupBy(*keys, "__b").agg(*[_TOTAL[k](v).alias(f"__end_{n}") for n, (k, v, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"__key_{c}") for c in keys], F.col("__b").alias("__of"), *[_TOTAL[k](f"__end_{n}").over(before).alias(f"__in_{n}") for n, (k, _, _) in values.items()])
    same = F.col("__b").eqNullSafe(F.col("__of"))
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    both = at.select("*", *own).join(carried, same)
    return both.select(*df.columns, *[_JOIN[k](F.col(f"__own_{n}"), F.col(f"__in_{n}")).alias(n) for n, (k, _, _) in values.items()])
