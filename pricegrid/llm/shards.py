"""Balanced contiguous shards: global prefix sums of byte sizes from per-partition totals, cut at equal targets.

Documents are range-partitioned and sorted by a hash of their text and then by id (only id, size and hashes
travel, never texts), so equal texts stand together. Every partition numbers its rows and sums its bytes locally;
the totals of the partitions, a number that the partition count fixes, give each partition its global offset. A
group of equal texts goes to the shard in which the middle of its byte range lies, as a whole; a group of more
than ``whole`` of a shard's target would unbalance shards, so its rows are placed one by one and it may lie in
successive shards. Shard sizes differ from the target by half a group (``whole`` / 2 of the target) at each end.

Defined results: a null or empty text has size 1 (no bytes, plus one) and checksum 0; all of them are one group;
rows with equal texts are ordered by id, null ids first; repeated rows are interchangeable; an empty table gives
an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number, and rows and bytes of the partition before each row."""
    from pyspark import TaskContext

    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:4], pa.array(np.full(len(size), part, np.int32)), pa.array(np.arange(rows, rows + len(size))), pa.array(total + ends - size)],
            names=["id", "size", "crc", "hash", "part", "row", "before"],
        )
        rows, total = rows + len(size), total + int(size.sum())


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole: float = 0.125) -> DataFrame:
    """``docs`` -> id, size long, text_crc32 long, shard int, slot long; one row for each input row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("tie"),
    )
    group = ["hash", "crc", "size"]
    order = [*group, "id", "tie"]
    placed = cut(
        sized.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(tidy(_local_sums), f"id {kind}, size long, crc long, hash long, part int, row long, before long")
    )

    totals = placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).orderBy("part").collect()
    rows, size, offsets = 0, 0, []
    for t in totals:
        offsets.append((t["part"], rows, size))
        rows, size = rows + t["rows"], size + t["bytes"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, rows_before long, bytes_before long"))  # one row for each partition

    at = placed.join(offset, "part").select("id", *group, (F.col("bytes_before") + F.col("before")).alias("start"), (F.col("rows_before") + F.col("row")).alias("at"))
    # most texts occur once: only groups of several rows, and of those the small ones, need a look at the group
    groups = at.groupBy(*group).agg(F.count("*").alias("n"), F.min("start").alias("first")).filter("n > 1")
    groups = cut(groups.filter(F.col("n") * F.col("size") * shards <= whole * size))
    known = at.join(groups, group, "left")

    begin, length = F.coalesce("first", "start"), F.coalesce(F.col("n") * F.col("size"), F.col("size"))
    twice_middle = (begin * 2 + length).cast("decimal(38,0)")
    shard = F.least(F.lit(shards - 1), F.floor(twice_middle * shards / (2 * max(1, size))).cast("int"))
    cut_rows = cut(known.select("id", "size", "crc", shard.alias("shard"), "at"))
    firsts = cut_rows.groupBy("shard").agg(F.min("at").alias("first_at"))
    return cut_rows.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("at") - F.col("first_at")).alias("slot"),
    )
