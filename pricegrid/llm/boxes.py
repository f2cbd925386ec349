"""Groups and batches of bounded size, their boxes, and whether two boxes leave anything to score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal(sizes: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(unit, parts) of each cell: a large cell is a unit of several parts, small neighbouring ones are one unit of one part."""
    out, unit, held = {}, 0, 0
    for cell in sorted(sizes):
        if sizes[cell] > most:
            unit, held = unit + (held > 0), 0
            out[cell] = unit, -(-sizes[cell] // most)
            unit += 1
            continue
        if held + sizes[cell] > most:
            unit, held = unit + 1, 0
        out[cell] = unit, 1
        held += sizes[cell]
    return out


def dealt(rows: DataFrame, cells: dict[tuple[int, int], tuple[int, int]], pivots: int, unit: str, part: str, seed: int) -> DataFrame:
    """``rows`` (fam, p, row) with their unit and part, from a table with a row for each cell that goes along as a literal."""
    if not cells:
        return rows.withColumn(unit, F.lit(0)).withColumn(part, F.lit(0))
    entries = [e for (f, p), (u, n) in cells.items() for e in (F.lit(f * pivots + p), F.struct(F.lit(u).alias("u"), F.lit(n).alias("n")))]
    cell = F.create_map(*entries)[F.col("fam") * pivots + F.col("p")]
    return rows.withColumn(unit, cell["u"]).withColumn(part, F.pmod(F.xxhash64("row", F.lit(seed)), cell["n"]).cast("int"))


def boxes(rows: DataFrame, by: list[str], box: str) -> DataFrame:
    """``by`` and box: smallest and largest value of each dimension of ``v``, by an aggregate over (group, dimension), so that no
    group is gathered."""
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"))
    at = rows.select(*by, F.posexplode("v").alias("d", "x")).groupBy(*by, "d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("has"))
    # a vector that lacks a dimension has zero there
    edge = lambda c, f: F.when(F.col("has") < F.col("n"), f(F.col(c), F.lit(0).cast("long"))).otherwise(F.col(c)).cast("double").alias(c)
    sides = at.join(whole, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("d", edge("low", F.least), edge("high", F.greatest)))).alias(box))
    return whole.drop("n").join(sides, by, "left").withColumn(box, F.coalesce(box, F.array().cast("array<struct<d:int,low:double,high:double>>")))


def interval_meets(a: str, b: str, need: Column, cap: Column | None = None) -> Column:
    """Whether the products of rows in the boxes ``a`` and ``b`` can reach ``need`` and stay under ``cap``. The interval is widened by
    more than the rounding of its sums."""

    def total(f) -> Column:
        corners = lambda x, y: (x["low"] * y["low"], x["low"] * y["high"], x["high"] * y["low"], x["high"] * y["high"])
        terms = F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), F.lit(0.0)).otherwise(f(*corners(x, y))))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    slack = total(lambda *c: F.greatest(*map(F.abs, c))) * 1e-9
    near = total(F.greatest) + slack >= need.cast("double")
    return near if cap is None else near & (total(F.least) - slack <= cap.cast("double"))
