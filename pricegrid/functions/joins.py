"""Joins that equality alone can't express, without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], forward: bool = False, tie: str | None = None, width: int | None = None) -> DataFrame:
    """Each left row with ``take`` of the last right row at or before it (forward: the first at or after it).

    Both sides have ``keys`` and ``at``; ``tie`` orders right rows of equal ``at``, of which backward takes the
    last and forward the first. The frame is walked through, never held: by key alone, or, with ``width``, within buckets of
    ``at``, which then is a whole number; a bucket's rows without a match of their own take what the bucket before (forward: behind)
    leaves, of which one row each meets in a task. Left rows without a match keep nulls; a right row whose
    taken columns are all null still counts as a match.
    """
    r = right.select(*keys, at, (F.col(tie) if tie else F.lit(0)).alias("__tie"), F.struct(*[F.col(c).alias(c) for c in take]).alias("__got"))
    l = left.select(*left.columns, F.lit(True).alias("__left"))
    both = l.unionByName(r, allowMissingColumns=True)
    side = F.col("__left").isNotNull()
    ordered = (F.desc(at), side.cast("int"), F.desc("__tie")) if forward else (F.col(at), side.cast("int"), F.col("__tie"))
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn("__got", F.last("__got", ignorenulls=True).over(w)).filter("__left")
    else:
        bucket = F.floor(F.col(at) / F.lit(width)).alias("__b")
        w = Window.partitionBy(*keys, "__b").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
        own = both.select("*", bucket).withColumn("__got", F.last("__got", ignorenulls=True).over(w)).filter("__left")
        pick = F.min_by if forward else F.max_by
        ends = r.select("*", bucket).groupBy(*keys, "__b").agg(pick("__got", F.struct(at, "__tie")).alias("__end"))
        # buckets of the left side alone have no row to leave, but a place in the order
        places = ends.unionByName(l.select(*keys, bucket).distinct(), allowMissingColumns=True).groupBy(*keys, "__b").agg(F.first("__end", ignorenulls=True).alias("__end"))
        before = Window.partitionBy(*keys).orderBy(F.desc("__b") if forward else F.col("__b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = places.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__b").alias("__of"), F.last("__end", ignorenulls=True).over(before).alias("__in"))
        same = F.col("__b").eqNullSafe(F.col("__of"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        got = own.join(carried, same).withColumn("__got", F.coalesce("__got", "__in"))
    return got.select(*left.columns, *[F.col(f"__got.{c}").alias(c) for c in take])


def forward_fill(df: DataFrame, keys: list[str], order: str, filled: dict[str, Column], width: int) -> DataFrame:
    """``df`` and, for each entry of ``filled``, its last value that isn't null at or before the row.

    Rows are walked through within buckets of ``width`` in ``order``, a whole number; a bucket's first rows take what the
    buckets before carried in, of which one row each meets in a task. ``df`` is read twice, so give a table that is written or cheap.
    """
    at = df.withColumn("__b", F.call_function("div", F.col(order), F.lit(width)))
    within = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = at.select("*", *[F.last(c, ignorenulls=True).over(within).alias(f"__own_{n}") for n, c in filled.items()])
    ends = at.groupBy(*keys, "__b").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"__end_{n}") for n, c in filled.items()])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__b").alias("__of"), *[F.last(f"__end_{n}", ignorenulls=True).over(before).alias(f"__in_{n}") for n in filled]
    )
    same = F.col("__b").eqNullSafe(F.col("__of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return own.join(carried, same).select(*df.columns, *[F.coalesce(f"__own_{n}", f"__in_{n}").alias(n) for n in filled])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, low: Column, high: Column, width: int) -> DataFrame:
    """Right rows with low <= right.at <= high of the left row, joined on buckets of ``width``.

    A left row goes to each bucket that its interval touches, so the join is an equi-join whose buckets stay
    small; choose ``width`` about as long as the intervals.
    """
    l = left.withColumn("__low", low).withColumn("__high", high)
    first, last = F.floor(F.col("__low") / F.lit(width)), F.floor(F.col("__high") / F.lit(width))
    l = l.filter("__low <= __high").withColumn("__bucket", F.explode(F.sequence(first, last)))
    r = right.withColumn("__bucket", F.floor(F.col(at) / F.lit(width)))
    joined = l.join(r, [*keys, "__bucket"])
    return joined.filter((F.col(at) >= F.col("__low")) & (F.col(at) <= F.col("__high"))).drop("__bucket", "__low", "__high")
