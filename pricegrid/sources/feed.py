"""A recorded feed as a data source: range reads by sequence in parallel, filters pushed down, and a stream with sequences as offsets.

    register(spark)
    spark.read.format("pricegrid_feed").option("path", folder).option("start", 100).option("end", 900).load()
    spark.readStream.format("pricegrid_feed").option("path", folder).load()

The feed is a folder of Parquet files with event_type, event_id, ts, value and props, on a store that Arrow opens by its path.
Reading from ``start`` to ``end`` (both included, ``end`` may be left out) is what a source calls backfill; a batch read without them is the
whole feed. Each task reads one range of sequences and of each file only row groups whose statistics meet it.

Defined results: rows without a sequence are in no range and are left out; sequences that occur twice come twice; an empty folder gives no
rows; a range that ends before it starts is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "symbol string, sequence long, event_us long, value double, props string"


class FeedError(ValueError):
    """The feed was refused; the text is the code."""


@dataclass
class Range(InputPartition):
    low: int
    high: int


def _open(path: str) -> ds.Dataset:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_"))]
    return ds.dataset(sorted(found), filesystem=store, format="parquet") if found else ds.dataset(pa.table({c: pa.array([], t) for c, t in _RAW.items()}))


_RAW = {"event_type": pa.string(), "event_id": pa.int64(), "ts": pa.timestamp("us"), "value": pa.float64(), "props": pa.string()}


def _bounds(feed: ds.Dataset) -> tuple[int, int] | None:
    """The least and the greatest sequence, from the files' statistics where they have some."""
    low = high = None
    for fragment in feed.get_fragments():
        groups = fragment.row_groups if hasattr(fragment, "row_groups") else []
        known = [g.statistics.get("event_id") if g.statistics else None for g in groups]
        if known and all(known):
            pairs = [(k["min"], k["max"]) for k in known]
        else:
            column = fragment.to_table(columns=["event_id"]).column(0)
            both = pc.min_max(column).as_py()
            pairs = [(both["min"], both["max"])] if both["min"] is not None else []
        for a, b in pairs:
            low, high = (a, b) if low is None else (min(low, a), max(high, b))
    return None if low is None else (low, high)


def _read(path: str, part: Range, symbols: list[str] | None) -> Iterator[pa.RecordBatch]:
    wanted = (ds.field("event_id") >= part.low) & (ds.field("event_id") <= part.high)
    if symbols is not None:
        wanted &= ds.field("event_type").isin(pa.array(symbols, pa.string()))
    for batch in _open(path).to_batches(columns=list(_RAW), filter=wanted):
        if batch.num_rows:
            columns = [batch.column("event_type").cast(pa.string()), batch.column("event_id"), batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()), batch.column("value"), batch.column("props").cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def _split(low: int, high: int, parts: int) -> list[Range]:
    step = max(1, -(-(high - low + 1) // parts))
    return [Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pricegrid_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema: StructType) -> FeedStream:  # noqa: N802
        return FeedStream(dict(self.options))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.low = int(options["start"]) if "start" in options else None
        self.high = int(options["end"]) if "end" in options else None
        self.symbols: list[str] | None = None
        if self.low is not None and self.high is not None and self.high < self.low:
            raise FeedError("invalid_backfill_range")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds of the sequence and lists of symbols are taken over; all others stay with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("sequence",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    least = value + isinstance(f, GreaterThan)
                    self.low = least if self.low is None else max(self.low, least)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    most = value - isinstance(f, LessThan)
                    self.high = most if self.high is None else min(self.high, most)
            elif column == ("symbol",) and isinstance(f, (EqualTo, In)):
                listed = set(value) if isinstance(f, In) else {value}
                self.symbols = sorted(listed if self.symbols is None else listed & set(self.symbols))
            else:
                yield f

    def partitions(self) -> list[Range]:
        known = _bounds(_open(self.path))
        if known is None:
            return [Range(0, -1)]
        low = known[0] if self.low is None else max(known[0], self.low)
        high = known[1] if self.high is None else min(known[1], self.high)
        return _split(low, high, self.parts) or [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.symbols)


class FeedStream(DataSourceStreamReader):
    """Offsets are the last sequence that was read; a micro-batch is the range behind it, in parallel."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.start, self.most = int(options.get("start", 0)), int(options.get("max_per_batch", 0))
        self.at = self.start - 1

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {"sequence": self.start - 1}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        known = _bounds(_open(self.path))
        newest = max(self.at, known[1]) if known else self.at
        self.at = min(newest, self.at + self.most) if self.most else newest
        return {"sequence": self.at}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        self.at = max(self.at, end["sequence"])
        return _split(start["sequence"] + 1, end["sequence"], self.parts) or [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, None)

    def commit(self, end: dict[str, int]) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark offer it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def backfill(spark: SparkSession, path: str, start: int, end: int | None = None) -> DataFrame:
    """The feed's rows from ``start`` to ``end``, both included."""
    asked = spark.read.format("pricegrid_feed").option("path", path).option("start", start)
    return (asked if end is None else asked.option("end", end)).load()
