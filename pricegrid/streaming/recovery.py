"""Columns of a stream with recovery: keyed state in several variables, snapshots of it, and what makes a snapshot unusable.

A key's events are folded in the order of ``seq``, 1, 2, ...; what comes too early waits in the state store, not in memory, and
what comes again is left out. The state says through which event it goes, with that event's key and content hash, so
a snapshot is anchored to rows of the journal. The journal is the truth: a snapshot that fails any check is left aside, and its
keys are replayed from the beginning. Restarting from usable snapshots gives the rows that a replay gives.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.columns import TRANSITION, ColumnFold

FORMAT, VERSION = "pricegrid-columns", 1
COLUMN = "seed long, direction string, edge long, column_id int"
THROUGH = "seq long, event_key string, content_hash string, event_count long"
EVENT = "event_us long, price long, box long, event_key string, content_hash string"
#: The state of a key as a row, as snapshots keep it and a restart takes it.
STATE = f"symbol string, resolution string, {COLUMN}, {THROUGH}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = f"symbol string, resolution string, {TRANSITION}"


class Columns(StatefulProcessor):
    """One symbol and resolution: its column, the last event that went into it, and events that came before their turn."""

    def __init__(self, reversal: int) -> None:
        self.reversal = reversal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.column = handle.getValueState("column", COLUMN)
        self.through = handle.getValueState("through", THROUGH)
        self.pending = handle.getMapState("pending", "seq long", EVENT)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803
        s = initialState
        if s["seed"] is not None:
            self.column.update((s["seed"], s["direction"], s["edge"], s["column_id"]))
        self.through.update((s["seq"], s["event_key"], s["content_hash"], s["event_count"]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        made = Row(*[c.split()[0] for c in OUT.split(", ")])
        fold, last = ColumnFold(self.reversal), (0, None, None, 0)
        if self.through.exists():
            last = tuple(self.through.get())
        if self.column.exists():
            fold.seed, direction, fold.edge, fold.column = self.column.get()
            fold.direction = direction or None
        before = last
        for r in rows:
            if r.seq <= last[0]:
                continue
            if r.seq > last[0] + 1:
                self.pending.updateValue((r.seq,), (r.event_us, r.price, r.box, r.event_key, r.content_hash))
                continue
            now: tuple | None = (r.event_us, r.price, r.box, r.event_key, r.content_hash)
            while now is not None:
                seq = last[0] + 1
                for out in fold.step(seq, *now[:3]):
                    yield made(*key, *out)
                last = (seq, now[3], now[4], last[3] + 1)
                after = (seq + 1,)
                now = None
                if self.pending.exists() and self.pending.containsKey(after):
                    now = tuple(self.pending.getValue(after))
                    self.pending.removeKey(after)
        if last != before:
            self.through.update(last)
            if fold.seed is not None:
                self.column.update((fold.seed, fold.direction or "", fold.edge or 0, fold.column))

    def close(self) -> None:
        pass


def columns_of_stream(events: DataFrame, reversal: int = 3, start: DataFrame | None = None) -> DataFrame:
    """Transitions of ``events`` (symbol, resolution, seq, event_us, price, box, event_key, content_hash), streaming or not.

    ``start`` (columns of STATE) is where keys begin; the events behind it are the ones that count. The session needs the
    state store ``PROVIDER``.
    """
    initial = None if start is None else start.groupBy("symbol", "resolution")
    return events.groupBy("symbol", "resolution").transformWithState(Columns(reversal), OUT, "append", "none", initialState=initial)


def stored_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stopped stream as rows of STATE, read back from its state store. Keys of which nothing was folded are left out."""

    def variable(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("key.*", "value.*")

    through = variable("through")
    return through.join(variable("column"), ["symbol", "resolution"], "left").selectExpr(*[c.split()[0] for c in STATE.split(", ")])


def code_fingerprint() -> str:
    """Changes with the code that made a state: another version could have made another one."""
    here = Path(__file__).resolve()
    digest = hashlib.sha256(f"{FORMAT};{VERSION}".encode())
    for path in (here, here.parents[1] / "operators" / "columns.py"):
        digest.update(path.read_bytes())
    return digest.hexdigest()


def _name(symbol: str, resolution: str) -> Column:
    return F.concat_ws("/", symbol, resolution)


_HEADER = "format string, version int, environment string, stream string, fingerprint string, last_sequence long, last_event_key string, last_content_hash string, event_count long, blob_hash string, blob_size long"


def save_snapshots(states: DataFrame, path: str, environment: str) -> str:
    """Write a row (header, blob) for each key under ``path``, in a folder of its own that is named only when it is whole; returns it."""
    if not environment:
        raise ValueError("checkpoint_environment_required")
    blob = F.to_json(F.struct("symbol", "resolution", "seed", "direction", "edge", "column_id"))
    rows = states.withColumn("blob", blob.cast("binary"))
    header = F.struct(
        F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(environment).alias("environment"), _name("symbol", "resolution").alias("stream"), F.lit(code_fingerprint()).alias("fingerprint"),
        F.col("seq").alias("last_sequence"), F.col("event_key").alias("last_event_key"), F.col("content_hash").alias("last_content_hash"), "event_count",
        F.sha2("blob", 256).alias("blob_hash"), F.octet_length("blob").cast("long").alias("blob_size"),
    )
    folder = f"{path}/snapshots-{uuid.uuid4().hex}"
    rows.select(_name("symbol", "resolution").alias("stream"), F.to_json(header).alias("header"), "blob").write.parquet(folder)
    return folder


def checked_snapshots(snapshots: DataFrame, journal: DataFrame, environment: str) -> DataFrame:
    """stream, reason, and the columns of STATE: why each snapshot (stream, header, blob) is unusable, null where it can be trusted.

    ``journal`` has stream, sequence, event_key and content_hash. Checks go in a fixed order, and no state is parsed before its bytes
    fit the header.
    """
    told = snapshots.select("stream", "blob", F.from_json("header", _HEADER).alias("h"))
    fields = [f.split()[0] for f in _HEADER.split(", ")]
    whole = F.col("h").isNotNull()
    for f in fields:
        whole = whole & F.col(f"h.{f}").isNotNull()
    anchors = journal.select(F.col("stream").alias("of"), "sequence", F.col("event_key").alias("k"), F.col("content_hash").alias("c"))
    at = told.join(anchors, (F.col("stream") == F.col("of")) & (F.col("h.last_sequence") == F.col("sequence")), "left").drop("of", "sequence")
    # rows up to the snapshot's, counted before they are joined with anything that could repeat them
    ends = told.select(F.col("stream").alias("of"), F.col("h.last_sequence").alias("last")).distinct()
    counted = journal.select("stream", "sequence").join(ends, (F.col("stream") == F.col("of")) & (F.col("sequence") <= F.col("last"))).groupBy("of", "last").agg(F.count("*").alias("rows_through"))
    met = at.join(counted, (F.col("stream") == F.col("of")) & (F.col("h.last_sequence") == F.col("last")), "left")
    text = F.decode("blob", "UTF-8")
    state = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), f"symbol string, resolution string, {COLUMN}")
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    reason = (
        F.when(~whole, "header_corrupt").when(differs("h.format", F.lit(FORMAT)) | differs("h.version", F.lit(VERSION)), "schema_version_mismatch")
        .when(differs("h.environment", F.lit(environment)), "environment_mismatch").when(differs("h.stream", F.col("stream")), "stream_mismatch")
        .when(differs("h.fingerprint", F.lit(code_fingerprint())), "code_fingerprint_mismatch")
        .when((F.octet_length("blob") != F.col("h.blob_size")) | differs("h.blob_hash", F.sha2("blob", 256)), "blob_hash_mismatch")
        .when(differs("h.last_event_key", F.col("k")) | differs("h.last_content_hash", F.col("c")), "event_reference_invalid")
        .when(differs("h.event_count", F.col("rows_through")), "event_count_mismatch").when(F.col("s").isNull() | F.col("s.symbol").isNull(), "decode_failed")
    )
    through = [F.col("h.last_sequence").alias("seq"), F.col("h.last_event_key").alias("event_key"), F.col("h.last_content_hash").alias("content_hash"), F.col("h.event_count").alias("event_count")]
    parsed = met.withColumn("s", F.when(F.col("h.blob_hash") == F.sha2("blob", 256), state)).withColumn("reason", reason)
    return parsed.select("stream", "reason", *[F.when(F.col("reason").isNull(), F.col(f"s.{c.split()[0]}")).alias(c.split()[0]) for c in f"symbol string, resolution string, {COLUMN}".split(", ")], *through)


def recovered(events: DataFrame, checked: DataFrame, reversal: int = 3) -> DataFrame:
    """Transitions behind the snapshots: usable ones are taken up where they end, the keys of all others are replayed from the start."""
    start = checked.filter("reason is null").drop("stream", "reason").selectExpr(*[c.split()[0] for c in STATE.split(", ")])
    ends = start.select(F.col("symbol").alias("__s"), F.col("resolution").alias("__r"), F.col("seq").alias("__from"))
    left = events.join(ends, (F.col("symbol") == F.col("__s")) & (F.col("resolution") == F.col("__r")), "left").filter(F.col("seq") > F.coalesce("__from", F.lit(0))).select(events.columns)
    return columns_of_stream(left, reversal, start)
