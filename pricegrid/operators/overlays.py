"""What a chart draws over its columns, and only where everything that it refers to is there.

A pattern refers to the transitions of all its pivots, a break to the transition that broke its line; references that don't resolve among
the transitions on the chart leave the overlay out (a relational division). A line reaches to the newest column only where its projection
is kept up to date, else it ends at its second anchor. Prices on a line between columns are rounded half to even.

Defined results: without references, prices or columns there is no overlay; an empty chart has none; repeated references count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scaled import divide_half_even

PROJECTED = ("active", "broken", "retesting")


def resolved(overlays: DataFrame, identity: list[str], refs: str, chart: DataFrame, keys: list[str], ref: str = "seq") -> DataFrame:
    """identity and columns (ascending) of the overlays whose ``refs`` all name a ``ref`` of ``chart`` (keys, ref, column_id)."""
    asked = overlays.filter(F.size(refs) > 0).select(*identity, F.explode(F.array_distinct(refs)).alias("__ref"), F.size(F.array_distinct(refs)).alias("__all"))
    known = chart.filter(F.col("column_id").isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(ref).alias("__is"), "column_id").dropDuplicates([*[f"__{k}" for k in keys], "__is"])
    same = F.col("__ref") == F.col("__is")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = asked.join(known, same).groupBy(*identity).agg(F.count("*").alias("__found"), F.max("__all").alias("__all"), F.array_sort(F.collect_set("column_id")).alias("columns"))
    return met.filter("__found = __all").drop("__found", "__all")


def projected(a_column: Column, a_price: Column, b_column: Column, b_price: Column, at: Column) -> Column:
    """The price of the line through two anchors at a column; null where they share one."""
    run, rise = b_column - a_column, b_price - a_price
    away = at - b_column
    ahead = divide_half_even(rise * away * F.when(run < 0, -1).otherwise(1), F.when(run != 0, F.abs(run)))
    return b_price + ahead


def line_overlays(lines: DataFrame, chart: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, from_column, from_price, to_column, to_price, projected, slope_milli: each line (a_column, a_price, b_column, b_price, state).

    ``slope_milli`` is the rise for each thousand columns, ``chart`` the columns on the chart.
    """
    newest = chart.groupBy(*keys).agg(F.max("column_id").alias("newest"))
    at = lines.join(newest, keys, "left").filter(F.col("a_price").isNotNull() & F.col("b_price").isNotNull() & F.col("a_column").isNotNull() & F.col("b_column").isNotNull())
    price = projected(F.col("a_column"), F.col("a_price"), F.col("b_column"), F.col("b_price"), F.col("newest"))
    current = F.coalesce((F.col("newest") >= F.col("b_column")) & price.isNotNull() & F.col("state").isin(*PROJECTED), F.lit(False))
    run = F.col("b_column") - F.col("a_column")
    slope = divide_half_even((F.col("b_price") - F.col("a_price")) * 1000 * F.when(run < 0, -1).otherwise(1), F.when(run != 0, F.abs(run)))
    return at.select(
        *keys, "line", F.col("a_column").alias("from_column"), F.col("a_price").alias("from_price"), F.when(current, F.col("newest")).otherwise(F.col("b_column")).alias("to_column"),
        F.when(current, price).otherwise(F.col("b_price")).alias("to_price"), current.alias("projected"), slope.alias("slope_milli"),
    )


def break_overlays(breaks: DataFrame, chart: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, column_id, price: breaks (line, break_column, break_seq) whose transition is on the chart, in the column that they name."""
    known = chart.select(*keys, F.col("seq").alias("break_seq"), "column_id", F.col("to_price").alias("price")).dropDuplicates([*keys, "break_seq"])
    return breaks.join(known, [*keys, "break_seq"]).filter((F.col("column_id") == F.col("break_column")) & F.col("price").isNotNull()).select(*keys, "line", "column_id", "price")
