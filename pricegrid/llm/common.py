"""Helpers that the text operators share: table access, durable cuts of the lineage, Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    A folder of this machine is taken only where that setting is absent and tasks run in this process, as in tests.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the written table.

    Later jobs then neither repeat the work nor depend on shuffle files of a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64 with one entry more than rows); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def texts(batch: pa.RecordBatch, column: str, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in slices, so that few Python strings live at a time; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    for i in range(0, batch.num_rows, rows):
        yield i, [t or "" for t in col.slice(i, rows).to_pylist()]


_HASHES = float(1 << 53)


def below_share(hashed: Column, share: Column | float) -> Column:
    """Whether a 64-bit hash falls into the first ``share`` of all hashes; shares down to 2**-53 keep their size."""
    share = F.lit(share) if isinstance(share, float) else share
    return F.shiftrightunsigned(hashed, 11).cast("double") < share * _HASHES


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of about ``per_class`` different labelled texts of each label 0 and 1, and the number of labelled ids by label.

    Ids are taken by a hash, as large a share of each label as the size asks for, so that no label is ever lost;
    the picked labels are broadcast, about 2 * per_class rows, and no text is shuffled before. Where picked ids
    repeat with many texts, a second share by the texts' hashes brings the sample back to its size. Of equal texts
    with equal labels one counts. The sample is written once.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def share(sizes: dict[int, int]) -> Column:
        out = F.lit(0.0)
        for y, n in sizes.items():
            out = F.when(F.col("y") == y, F.lit(min(1.0, per_class / max(1, n)))).otherwise(out)
        return out

    picked = usable.filter(below_share(F.xxhash64("id"), share(counts)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    found = rows.join(F.broadcast(picked), "id").withColumn("h", F.xxhash64("text", F.lit(1)))  # picked: its size is bounded by per_class
    once = cut(found.groupBy("h", "y").agg(F.first("text").alias("text")))
    sizes = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if any(n > 2 * per_class for n in sizes.values()):
        once = once.filter(below_share(F.col("h"), share(sizes)))
    return once.select("text", "y"), counts


def release() -> None:
    """Gives the freed memory of this Python worker back to the system, as Spark keeps workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the worker's memory given back at the task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... instead of its names, which then can clash with nothing, and the names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method; the first column is the intercept and is not shrunk."""
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b
