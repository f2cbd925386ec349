"""Queries over written tables: content-verified datasets, bundles of runs, the append-only journal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.durable import shared_dir
from ..sources import datasets, journal
from ..sources.events import price_events, table
from .market import query
from .research import ORACLE_SQL, trades_over
from .spine_sql import EVENTS

_LEAF = "sha256('event_us=' || event_us || '|price=' || price || '|raw=' || raw || '|received_us=' || received_us || '|seq=' || seq || '|source_sequence=' || source_sequence || '|symbol=' || symbol)"
#: The manifest by DuckDB's own leaves, and the digest over it.
DATASET = (
    EVENTS
    + f""",
leaves AS (SELECT symbol, seq // 1048576 AS bucket, event_us, received_us, {_LEAF} AS leaf FROM ev),
nodes AS (
  SELECT symbol, bucket, substring(leaf, 1, 3) AS pre, count(*) AS n, sha256(string_agg(leaf, '' ORDER BY leaf)) AS node FROM leaves GROUP BY ALL),
parts AS (
  SELECT symbol, bucket, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(pre || ':' || node, '' ORDER BY pre || ':' || node)) AS digest FROM nodes GROUP BY ALL),
tops AS (SELECT sha256('bucket=' || bucket || '|digest=' || digest || '|rows=' || rows || '|symbol=' || symbol) AS leaf FROM parts),
tops2 AS (SELECT substring(leaf, 1, 3) AS pre, sha256(string_agg(leaf, '' ORDER BY leaf)) AS node FROM tops GROUP BY 1),
whole AS (SELECT 'dataset:' || sha256(string_agg(pre || ':' || node, '' ORDER BY pre || ':' || node)) AS dataset_id FROM tops2)"""
)


def _dataset(spark, sf_dir) -> datasets.Dataset:
    """All events; a walk that falls to zero or a clock that goes back is what the feed says, so the header counts it and no event is left out."""
    e = price_events(spark, sf_dir).select("symbol", "seq", "source_sequence", "event_us", "received_us", "raw", "price")
    return datasets.write_dataset(e, f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}", source="feed", units="price", quality="complete", keep_broken=True)


@query(f"WITH {DATASET} SELECT dataset_id, symbol, bucket, rows, digest, 'intact' AS status FROM parts, whole")
def dataset_store(spark, sf_dir):
    """All events as a content-verified dataset: written, read back, and every partition compared with its manifest."""
    made = _dataset(spark, sf_dir)
    status = datasets.dataset_status(spark, datasets.load_dataset(spark, made.path).path)
    return status.select(F.lit(made.dataset_id).alias("dataset_id"), "symbol", "bucket", "rows", "digest", "status")


TRADE = ("symbol", "seq", "decision_us", "side", "entry_us", "entry_price", "exit_us", "exit_price", "gross", "net")


def _sql_leaf(columns: tuple[str, ...]) -> str:
    """The canonical form in SQL, as ``canonical`` has it."""
    value = lambda c: f"coalesce(regexp_replace(CAST({c} AS VARCHAR), '([\\\\|=])', '\\\\\\1', 'g'), '\\N')"
    return " || '|' || ".join(f"'{c}=' || {value(c)}" for c in sorted(columns))


@query(
    f"""WITH {DATASET}, t AS ({ORACLE_SQL["backtest_trades"]}), l AS (SELECT sha256({_sql_leaf(TRADE)}) AS leaf FROM t),
    n AS (SELECT substring(leaf, 1, 6) AS pre, count(*) AS n, sha256(string_agg(leaf, '' ORDER BY leaf)) AS node FROM l GROUP BY 1),
    m AS (SELECT substring(pre, 1, 3) AS pre, sum(n) AS n, sha256(string_agg(pre || ':' || node, '' ORDER BY pre || ':' || node)) AS node FROM n GROUP BY 1),
    d AS (SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(pre || ':' || node, '' ORDER BY pre || ':' || node)) AS digest FROM m)
    SELECT 'backtest-' || sha256('{{"dataset":"' || dataset_id || '","definition":"momentum-5"}}') AS run_id, 'trades' AS table_name, rows, digest FROM d, whole"""
)
def run_bundle(spark, sf_dir):
    """A backtest over a dataset as a bundle named by that dataset and the definition: written once, read back and verified.

    A table without rows has neither a count nor a digest, as the sums of SQL over no rows.
    """
    made = _dataset(spark, sf_dir)
    root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    trades = trades_over(made.events).select(*TRADE)
    run = datasets.write_bundle(spark, root, "backtest", {"dataset": made.dataset_id, "definition": "momentum-5"}, {"trades": trades})
    run = datasets.load_bundle(spark, run.path)
    told = [(run.run_id, n, t["rows"] or None, t["digest"] if t["rows"] else None) for n, t in run.told.items()]  # one table, whose digest reading has just found again
    return spark.createDataFrame(told, "run_id string, table_name string, rows long, digest string")


@query(
    """WITH o AS (SELECT o_orderpriority AS stream, CAST(o_orderkey AS VARCHAR) AS event_key, o_orderkey % 3 AS batch, sha256(o_orderkey || ':' || CAST(round(o_totalprice) AS BIGINT)) AS content_hash FROM orders),
    p AS (SELECT *, row_number() OVER (ORDER BY batch, stream, event_key) AS sequence FROM o)
    SELECT stream, batch, count(*) AS rows, CAST(min(sequence) AS BIGINT) AS first_sequence, CAST(max(sequence) AS BIGINT) AS last_sequence, min(content_hash) AS least_hash, max(content_hash) AS greatest_hash, CAST(0 AS BIGINT) AS repeated
    FROM p GROUP BY stream, batch"""
)
def journal_append(spark, sf_dir):
    """All orders appended to a journal in three commits, each after stating how long it expects every stream to be; repeating them adds nothing."""
    path = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("stream"), F.col("o_orderkey").cast("string").alias("event_key"), F.concat(F.col("o_orderkey"), F.lit(":"), F.round("o_totalprice").cast("long")).alias("payload"), (F.col("o_orderkey") % 3).alias("b"))
    streams = [r["stream"] for r in rows.select("stream").distinct().collect()]  # five priorities
    for b in range(3):
        there = {r["stream"]: r["n"] for r in journal.read(spark, path).groupBy("stream").agg(F.count("*").alias("n")).collect()}
        journal.append(spark, path, rows.filter(F.col("b") == b).drop("b"), b, expected_count={s: there.get(s, 0) for s in streams})
    again = journal.append(spark, path, rows.drop("b"), 3)
    kept = journal.verified(spark, path)
    return kept.groupBy("stream", "batch").agg(
        F.count("*").alias("rows"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.min("content_hash").alias("least_hash"), F.max("content_hash").alias("greatest_hash")
    ).withColumn("repeated", F.lit(again).cast("long"))
