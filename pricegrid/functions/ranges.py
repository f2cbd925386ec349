"""Aggregates over intervals of positions without meeting every row of every interval.

Positions are cut into aligned blocks of 1, r, r^2, ... places, each summed up once. An interval is tiled by the largest blocks that fit, at most
2 (r - 1) of each size, so it meets some dozens of rows however long it is. The join is by key, size and block: a key that holds a third of
all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut

#: what sums up a block also sums up blocks
Parts = dict[str, tuple[Callable[[Column], Column], Column]]


def tiles(low: Column, high: Column, radix: int, sizes: int) -> Column:
    """array<struct<size, block>>: the aligned blocks of radix ** size places that tile low..high, ends included; empty if there is no place."""
    def span(a: Column, b: Column, size: int) -> Column:
        """Blocks a..b-1."""
        return F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(size).alias("size"), x.alias("block")))).otherwise(F.array().cast("array<struct<size:int,block:bigint>>"))

    whole = lambda c, n: F.call_function("div", c, F.lit(n))
    first = [whole(low + (radix**s - 1), radix**s) for s in range(sizes)]
    end = [whole(high + 1, radix**s) for s in range(sizes)]
    out = []
    for s in range(sizes):
        if s == sizes - 1:
            out.append(span(first[s], end[s], s))
            continue
        larger = first[s + 1] <= end[s + 1]
        head = span(first[s], F.when(larger, first[s + 1] * radix).otherwise(end[s]), s)
        out += [head, span(F.when(larger, end[s + 1] * radix).otherwise(end[s]), end[s], s)]
    return F.flatten(F.array(*out))


def range_aggregate(asked: DataFrame, rows: DataFrame, keys: list[str], position: str, low: Column, high: Column, parts: Parts, counts: Column | None = None, always: Parts | None = None, radix: int = 4, sizes: int = 6) -> DataFrame:
    """``asked`` and, for each entry of ``parts`` (name: aggregate, value), the aggregate over the rows whose position lies in low..high.

    Positions are whole numbers from 0; nulls and negative ones take no part, and an interval without a place or with a null end has nulls. The
    aggregates must be maxima, minima or sums. ``counts`` is a condition over columns of ``asked`` and parts: a block counts as a whole
    where it holds for the block's parts, and otherwise is opened, each of its places counting if it holds for that place alone; so it must be one
    that holds for a block only if it holds for each of its rows. ``always`` are parts over all rows, whatever ``counts`` says.
    ``keys`` are columns of both sides; rows of ``asked`` must differ from each other.
    """
    always = always or {}
    every = parts | always
    sized = rows.filter(F.col(position) >= 0).select(*keys, F.col(position).alias("__p"), *[v.alias(n) for n, (_, v) in every.items()])
    sized = sized.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(sizes - 1))))
    sized = sized.withColumn("block", F.call_function("div", F.col("__p"), F.pow(F.lit(radix), F.col("size")).cast("long")))
    blocks = sized.groupBy(*keys, "size", "block").agg(*[f(F.col(n)).alias(n) for n, (f, _) in every.items()])
    if counts is not None:  # blocks are met twice, whole and opened
        blocks = cut(blocks)
    ids = asked.columns
    tiled = asked.withColumn("__t", F.explode(tiles(F.when(low < 0, 0).otherwise(low), high, radix, sizes))).select(*ids, "__t.size", "__t.block")
    hit = tiled.join(blocks, [*keys, "size", "block"])
    fits = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    met = hit.select(*ids, *[F.when(fits, F.col(n)).alias(n) for n in parts], *always)
    if counts is not None:
        n = F.pow(F.lit(radix), F.col("size")).cast("long")
        inner = hit.filter(~fits & (F.col("size") > 0)).select(*ids, F.explode(F.sequence(F.col("block") * n, F.col("block") * n + n - 1)).alias("block"))
        single = blocks.filter("size = 0").drop("size", *always)
        met = met.unionByName(inner.join(single, [*keys, "block"]).filter(fits).select(*ids, *parts), allowMissingColumns=True)
    found = met.groupBy(*ids).agg(*[f(F.col(n)).alias(n) for n, (f, _) in every.items()])
    there = found.select(*[F.col(c).alias(f"__{c}") for c in ids], *every)
    same = F.lit(True)
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return asked.join(there, same, "left").select(*ids, *every)
