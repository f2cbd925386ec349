"""An append-only journal of (stream, event_key, payload) in Parquet: write-once keys, content hashes, idempotent appends.

Rows are written to a folder of their own and count only once a commit names it. Commits are small files numbered 1, 2, ...; the
next one is put only if it is absent, so of two writers who read the same state one succeeds, and the other looks again at what
has come in between. Readers see whole commits. A row's sequence counts all rows of the journal in the order of
commits, and within one by stream and key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import cut, global_positions
from . import files

SCHEMA = "stream string, event_key string, content_hash string, payload string, batch long, sequence long"
TRIES = 20


class JournalConflict(ValueError):
    """A key was written before with another content, or the stream isn't as long as the writer expected."""


class JournalCorrupt(ValueError):
    """A payload no longer fits its hash."""


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("stream", "event_key", F.sha2("payload", 256).alias("content_hash"), "payload")


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits in their order, one for each append that wrote something."""
    found = [n for n in files.names(spark, f"{path}/log") if n.endswith(".json")]
    return [json.loads(files.read_text(spark, f"{path}/log/{n}")) for n in found]


def _rows(spark: SparkSession, path: str, known: list[dict]) -> DataFrame:
    if not known:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/data/{c['folder']}" for c in known])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows."""
    return _rows(spark, path, commits(spark, path))


def append(spark: SparkSession, path: str, rows: DataFrame, batch: int, expected_count: dict[str, int] | None = None) -> int:
    """Append the keys that are new; equal repetitions do nothing, a changed content raises. Returns how many were new.

    ``expected_count`` says how many rows the writer has seen of a stream; new rows of it are refused if there are others, whoever
    wrote them. Safe to repeat, as a streaming sink's foreachBatch must be: a batch that was written is found again by its keys.
    """
    path = files.qualified(spark, path)
    # one shuffle by key, written once: every later step reads it
    told = F.count("content_hash")
    differs = ~F.min("content_hash").eqNullSafe(F.max("content_hash")) | ((told > 0) & (told < F.count("*")))
    fresh = cut(_hashed(rows).groupBy("stream", "event_key").agg(F.min("content_hash").alias("content_hash"), F.first("payload").alias("payload"), differs.alias("differs")))
    if fresh.filter("differs").take(1):
        raise JournalConflict("event_identity_conflict")
    fresh = fresh.drop("differs")
    for _ in range(TRIES):
        known = commits(spark, path)
        stored = _rows(spark, path, known)
        met = cut(fresh.join(stored.select("stream", "event_key", F.col("content_hash").alias("known_hash")), ["stream", "event_key"], "left"))
        if met.filter("known_hash is not null and known_hash <> content_hash").take(1):
            raise JournalConflict("event_identity_conflict")
        new = met.filter("known_hash is null").drop("known_hash")
        if expected_count:
            touched = {r["stream"] for r in new.filter(F.col("stream").isin(list(expected_count))).select("stream").distinct().collect()}
            there = {r["stream"]: r["n"] for r in stored.filter(F.col("stream").isin(list(touched))).groupBy("stream").agg(F.count("*").alias("n")).collect()}
            if any(there.get(s, 0) != expected_count[s] for s in touched):
                raise JournalConflict("journal_concurrent_write")
        before = known[-1]["rows_through"] if known else 0
        folder = uuid.uuid4().hex
        placed = global_positions(new, ["stream", "event_key"])
        placed.select("stream", "event_key", "content_hash", "payload", F.lit(batch).cast("long").alias("batch"), (F.col("position") + before).cast("long").alias("sequence")).write.parquet(f"{path}/data/{folder}")
        n = spark.read.schema(SCHEMA).parquet(f"{path}/data/{folder}").count()
        if not n:
            return 0
        entry = {"folder": folder, "batch": batch, "rows": n, "rows_through": before + n}
        if files.put_if_absent(spark, f"{path}/log/{len(known) + 1:020d}.json", json.dumps(entry, sort_keys=True)):
            return n
    raise JournalConflict("journal_concurrent_write")


def corrupt(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose payload no longer fits their hash."""
    return read(spark, path).filter(~F.sha2("payload", 256).eqNullSafe(F.col("content_hash")))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """All rows, if every payload fits its hash."""
    if corrupt(spark, path).take(1):
        raise JournalCorrupt("journal_corrupt")
    return read(spark, path)


def row_identity(spark: SparkSession, path: str, stream: str, sequence: int) -> tuple[str, str] | None:
    """(event_key, content_hash) of one row, which anchors a snapshot."""
    r = read(spark, path).filter((F.col("stream") == stream) & (F.col("sequence") == sequence)).select("event_key", "content_hash").first()
    return (r[0], r[1]) if r else None


def count_through(spark: SparkSession, path: str, stream: str, sequence: int) -> int:
    return read(spark, path).filter((F.col("stream") == stream) & (F.col("sequence") <= sequence)).count()


def sequence_of(spark: SparkSession, path: str, stream: str, key: str) -> int | None:
    r = read(spark, path).filter((F.col("stream") == stream) & (F.col("event_key") == key)).select("sequence").first()
    return r[0] if r else None


def backup(spark: SparkSession, path: str, destination: str) -> int:
    """Copy what is committed now to a new journal; returns its rows."""
    path, destination = files.qualified(spark, path), files.qualified(spark, destination)
    if files.names(spark, destination):
        raise JournalConflict("backup_destination_exists")
    known = commits(spark, path)
    for k, entry in enumerate(known):
        _rows(spark, path, [entry]).write.parquet(f"{destination}/data/{entry['folder']}")
        files.put_if_absent(spark, f"{destination}/log/{k + 1:020d}.json", json.dumps(entry, sort_keys=True))
    return known[-1]["rows_through"] if known else 0
