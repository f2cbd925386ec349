"""How alike names are: twice the letters in matching blocks over all letters of both (Ratcliff and Obershelp).

The longest common run of letters is a block, the earliest one if several are as long, and the pieces left and right of it are
treated alike. Pairs are formed where they share two letters in a row: if no block is longer than one letter, each two
blocks have another letter between them, so of L letters in both names no more than (L + 1) / 3 match on either side, and a
greater share can't come without such a pair of letters. Names of few letters, for which this says nothing, meet by single letters.

Defined results: null names take no part; two empty names are wholly alike; a name isn't compared with itself; repeated names count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching_letters(a: str, b: str) -> int:
    """Letters of ``a`` in matching blocks with ``b``."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    places: dict[str, list[int]] = {}
    for j, letter in enumerate(b):
        places.setdefault(letter, []).append(j)
    while todo:
        a_low, a_high, b_low, b_high = todo.pop()
        best, at_a, at_b, runs = 0, a_low, b_low, {}
        for i in range(a_low, a_high):
            now = {}
            for j in places.get(a[i], ()):
                if b_low <= j < b_high:
                    now[j] = k = runs.get(j - 1, 0) + 1
                    if k > best:
                        best, at_a, at_b = k, i - k + 1, j - k + 1
            runs = now
        if best:
            total += best
            todo += [(a_low, at_a, b_low, at_b), (at_a + best, a_high, at_b + best, b_high)]
    return total


def with_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` (columns ``a`` and ``b`` among others) with ``ratio`` (double); null where a name is null."""
    at_a, at_b = pairs.columns.index(a), pairs.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(at_a).to_pylist(), batch.column(at_b).to_pylist(), strict=True)
            ratio = [None if x is None or y is None else 2.0 * matching_letters(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], names=[*batch.schema.names, "ratio"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{ddl}, ratio double")


def similar_names(names: DataFrame, column: str, least: float = 0.8) -> DataFrame:
    """a, b, ratio: pairs of different names (a before b) whose ratio, taken from a to b, is at least ``least`` (above 2 / 3)."""
    if least <= 2 / 3:
        raise ValueError("only a ratio above 2 / 3 makes sure that two letters in a row are shared")
    own = names.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct()
    long_from = int(2 / (3 * least - 2)) + 1  # letters of both names from which a shared pair of letters is sure
    n = F.length("name")
    two = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(2))))
    one = F.array_distinct(F.split("name", ""))
    # a name of l letters is alike only to names of l * least / (2 - least) letters and more
    short = F.floor(n * (1 + least / (2 - least))) < long_from
    grams = own.select("name", F.explode(F.when(short, F.concat(one, two)).otherwise(two)).alias("gram"))
    few = own.select("name", F.explode(one).alias("gram")).filter(F.length("name") < long_from)
    every = grams.unionByName(few).distinct()
    a, b = every.select(F.col("name").alias("a"), "gram"), every.select(F.col("name").alias("b"), "gram")
    sizes = F.least(F.length("a"), F.length("b")) * 2 >= least * (F.length("a") + F.length("b"))
    met = a.join(b, "gram").filter((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()
    return with_ratio(met, "a", "b").filter(F.col("ratio") >= least)
