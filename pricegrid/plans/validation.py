"""Queries of validation windows, guards, comparisons, canonical texts and what is known last."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import global_positions
from ..operators import columns as C
from ..operators import hygiene as H
from ..operators import structure as S
from ..operators import validation as V
from ..sources.events import arrivals, price_events, quotes
from .market import ARRIVAL, KEY, ORACLE_SQL, QUERIES, moves, query
from .research import EXPERIENCES, experiences
from .spine_sql import ARRIVALS, EVENTS, MATRIX, PIVOTS, QUOTES, RESOLUTIONS, sql

LENGTH_US, GAP_US = 900_000_000, 600_000_000

WINDOWS = EXPERIENCES + f""",
wi AS (SELECT x.symbol, x.seq, e.event_us AS tm, e.seq AS es, CASE side WHEN 'long' THEN 1 ELSE -1 END * (e.price - x.reference) AS move, x.box, x.t0,
         e.event_us - coalesce(lag(e.event_us) OVER (PARTITION BY x.symbol, x.seq ORDER BY e.event_us, e.seq), x.t0) AS gap
       FROM xp x JOIN ev e ON e.symbol = x.symbol AND e.event_us > x.t0 AND e.event_us <= x.t0 + {LENGTH_US} AND e.received_us > x.t0 AND e.received_us <= x.t0 + {LENGTH_US}),
ws AS (SELECT symbol, seq, count(*) AS samples, max(gap) AS max_gap_us, max(move) AS best, min(move) AS worst, arg_max(move, (tm, es)) AS end_move,
         min(tm) FILTER (WHERE move <= -box) AS invalidated_us FROM wi GROUP BY ALL),
wu AS (SELECT wi.symbol, wi.seq, min(tm) FILTER (WHERE move = best AND move > 0) AS up_at, min(tm) FILTER (WHERE move = worst AND move < 0) AS down_at FROM wi JOIN ws USING (symbol, seq) GROUP BY ALL),
wr AS (SELECT x.symbol, x.seq, min(m.seq) AS reversal_seq FROM xp x JOIN moves m ON m.symbol = x.symbol AND m.resolution = 'medium' AND m.kind = 'reversal' AND m.seq > x.seq
         AND m.event_us BETWEEN x.t0 AND x.t0 + {LENGTH_US} AND m.direction = CASE x.side WHEN 'long' THEN 'O' ELSE 'X' END GROUP BY ALL),
wl AS (SELECT x.symbol, x.seq, x.side, CASE WHEN last_us <= t0 + {LENGTH_US} THEN 'CENSORED_END_OF_DATA' WHEN max_gap_us > {GAP_US} THEN 'CENSORED_GAP' WHEN samples IS NULL THEN 'NO_SAMPLES' ELSE 'COMPLETE' END AS status,
         coalesce(samples, 0) AS samples, max_gap_us, CASE WHEN samples > 0 THEN greatest(0, best) END AS mfe, CASE WHEN samples > 0 THEN greatest(0, -worst) END AS mae,
         CASE WHEN samples > 0 THEN greatest(0, best) // box END AS mfe_boxes, CASE WHEN samples > 0 THEN greatest(0, -worst) // box END AS mae_boxes,
         up_at - t0 AS mfe_after_us, down_at - t0 AS mae_after_us, end_move, invalidated_us - t0 AS invalidated_after_us, reversal_seq
       FROM xp x JOIN (SELECT symbol, max(event_us) AS last_us FROM ev GROUP BY symbol) USING (symbol) LEFT JOIN ws USING (symbol, seq) LEFT JOIN wu USING (symbol, seq) LEFT JOIN wr USING (symbol, seq))"""


def _labels(spark, sf_dir):
    m = moves(spark, sf_dir)
    turns = m.filter("resolution = 'medium' and kind = 'reversal'")
    return V.time_window_labels(experiences(spark, sf_dir), price_events(spark, sf_dir), turns, LENGTH_US, GAP_US)


@query(sql(WINDOWS, "SELECT * FROM wl"))
def time_window_labels(spark, sf_dir):
    """Outcomes of direction changes within a quarter of an hour, with censoring, invalidation, reversal and gaps."""
    return _labels(spark, sf_dir)


@query(sql(WINDOWS, "SELECT side, status, count(*) AS n, count(invalidated_after_us) AS invalidated, count(reversal_seq) AS reversed FROM wl GROUP BY ALL"))
def window_status_counts(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy("side", "status").agg(F.count("*").alias("n"), F.count("invalidated_after_us").alias("invalidated"), F.count("reversal_seq").alias("reversed"))


@query(
    sql(
        WINDOWS,
        f""", u AS (UNPIVOT (SELECT side, {', '.join(V.FIELDS)} FROM wl WHERE status = 'COMPLETE') ON {', '.join(V.FIELDS)} INTO NAME field VALUE v),
        r AS (SELECT *, row_number() OVER (PARTITION BY side, field ORDER BY v) AS i, count(*) OVER (PARTITION BY side, field) AS n FROM u)
        SELECT side, field, any_value(n) AS n, min(v) AS least, min(CASE WHEN i = ceil(n * 0.25) THEN v END) AS p25, min(CASE WHEN i = ceil(n * 0.5) THEN v END) AS median, min(CASE WHEN i = ceil(n * 0.75) THEN v END) AS p75,
          max(v) AS most, round(avg(v), 4) AS mean FROM r GROUP BY ALL""",
    )
)
def group_distributions(spark, sf_dir):
    """Ten fields of the complete windows: least, quartiles, largest and mean, by side."""
    return V.distributions(_labels(spark, sf_dir), ["side"])


@query(
    sql(
        EVENTS,
        """SELECT symbol, seq, CASE WHEN a IS NULL OR b IS NULL THEN 'evidence_missing' WHEN a > event_us THEN 'evidence_after_event' WHEN b > received_us THEN 'evidence_known_later' END AS violation
        FROM (SELECT *, lag(event_us) OVER w AS a, lag(received_us) OVER w AS b FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY seq))""",
    )
)
def look_ahead_guard(spark, sf_dir):
    """Whether the event before may serve as evidence at each event: it must have been known by then."""
    w = Window.partitionBy("symbol").orderBy("seq")
    e = price_events(spark, sf_dir)
    why = V.look_ahead(F.lag("event_us").over(w), F.lag("received_us").over(w), F.col("event_us"), F.col("received_us"))
    return e.select("symbol", "seq", why.alias("violation"))


@query(
    sql(
        ARRIVALS,
        """, a AS (SELECT symbol, source_sequence, event_us || '|' || received_us || '|' || price AS a FROM ev WHERE source_sequence % 101 <> 0),
        b AS (SELECT symbol, source_sequence, event_us || '|' || received_us || '|' || CASE WHEN source_sequence % 500 = 0 THEN price + 1 ELSE price END AS b FROM arr WHERE source_sequence % 103 <> 0 QUALIFY row_number() OVER (PARTITION BY identity_key ORDER BY arrival) = 1)
        SELECT symbol, count(*) FILTER (WHERE a = b) AS equal, count(*) FILTER (WHERE a <> b) AS different, count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only
        FROM a FULL JOIN b USING (symbol, source_sequence) GROUP BY symbol""",
    )
)
def stream_compare(spark, sf_dir):
    """The spine against the deduplicated arrivals, each with some rows missing and some prices changed."""
    e = price_events(spark, sf_dir).filter("source_sequence % 101 <> 0")
    r = H.first_of_identity(arrivals(spark, sf_dir), "identity_key", ["arrival"]).filter("source_sequence % 103 <> 0")
    r = r.withColumn("price", F.when(F.col("source_sequence") % 500 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return V.compare_streams(e, r, ["symbol", "source_sequence"], ["event_us", "received_us", "price"], "symbol")


@query(
    sql(
        EVENTS,
        """SELECT symbol, seq, CASE WHEN p < 0 THEN '-' ELSE '' END || (abs(p) // 1000) || CASE WHEN abs(p) % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(p) % 1000 AS VARCHAR), 3, '0'), '0') END AS price_text,
          strftime(make_timestamp(event_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(event_us % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS iso_text,
          strftime(make_timestamp(event_us), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(event_us % 1000000 AS VARCHAR), 6, '0') || 'Z' AS fixed_text FROM (SELECT *, price - 9990000 AS p FROM ev)""",
    )
)
def canonical_values(spark, sf_dir):
    """Prices (less 9,990) and times as canonical texts."""
    e = price_events(spark, sf_dir)
    return e.select("symbol", "seq", V.canonical_decimal(F.col("price") - 9_990_000).alias("price_text"), V.canonical_time(F.col("event_us"), False).alias("iso_text"), V.canonical_time(F.col("event_us"), True).alias("fixed_text"))


@query(sql(QUOTES, "SELECT symbol, seq, bid + ask AS twice_mid, ask - bid AS spread, received_us - event_us AS feed_age_us FROM q"))
def quote_context(spark, sf_dir):
    return quotes(spark, sf_dir).select("symbol", "seq", (F.col("bid") + F.col("ask")).alias("twice_mid"), (F.col("ask") - F.col("bid")).alias("spread"), (F.col("received_us") - F.col("event_us")).alias("feed_age_us"))


@query(sql(QUOTES, "SELECT symbol, seq, bid, ask, event_us FROM q WHERE bid > 0 AND ask >= bid QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1"))
def latest_quote(spark, sf_dir):
    """The last valid quote of each symbol."""
    valid = quotes(spark, sf_dir).filter("bid > 0 and ask >= bid")
    return valid.groupBy("symbol").agg(F.max_by(F.struct("seq", "bid", "ask", "event_us"), "seq").alias("q")).select("symbol", "q.*")


@query(sql(PIVOTS, """SELECT m.symbol, m.resolution, m.seq, last_value(CASE WHEN p.kind = 'low' THEN p.price END IGNORE NULLS) OVER w AS low, last_value(CASE WHEN p.kind = 'high' THEN p.price END IGNORE NULLS) OVER w AS high
        FROM moves m LEFT JOIN piv p ON p.symbol = m.symbol AND p.resolution = m.resolution AND p.confirmed_seq = m.seq WINDOW w AS (PARTITION BY m.symbol, m.resolution ORDER BY m.seq ROWS UNBOUNDED PRECEDING)"""))
def latest_pivots(spark, sf_dir):
    m = moves(spark, sf_dir)
    return V.latest_pivots(m, S.pivots(m, KEY), KEY)


@query(
    sql(
        ARRIVALS,
        """SELECT symbol, source_sequence, arrival, max(source_sequence) OVER w AS watermark, count(*) OVER w AS events FROM arr
        WINDOW w AS (PARTITION BY symbol ORDER BY arrival, source_sequence ROWS UNBOUNDED PRECEDING)""",
    )
)
def watermark(spark, sf_dir):
    """The largest sequence so far and the number of events, at each arrival."""
    w = Window.partitionBy("symbol").orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, 0)
    return arrivals(spark, sf_dir).select("symbol", "source_sequence", "arrival", F.max("source_sequence").over(w).alias("watermark"), F.count("*").over(w).alias("events"))


@query(sql(MATRIX, "SELECT symbol, max(seq) AS at_seq, arg_max(alignment, seq) AS alignment, arg_max(strength, seq) AS strength, arg_max(stale + warmup, seq) AS unavailable FROM mat GROUP BY symbol"))
def matrix_now(spark, sf_dir):
    """The snapshot at the watermark of each symbol."""
    m = C.matrix(price_events(spark, sf_dir), moves(spark, sf_dir), "symbol", list(RESOLUTIONS))
    return m.groupBy("symbol").agg(F.max("seq").alias("at_seq"), *[F.max_by(c, "seq").alias(n) for c, n in ((F.col("alignment"), "alignment"), (F.col("strength"), "strength"), (F.col("stale") + F.col("warmup"), "unavailable"))])


@query(sql(ARRIVALS, "SELECT symbol, identity_key, arrival, row_number() OVER (ORDER BY arrival, symbol, source_sequence) AS position FROM arr"))
def raw_scan(spark, sf_dir):
    """Every raw row, repetitions included, with its place in the order of arrival."""
    return global_positions(arrivals(spark, sf_dir).select("symbol", "identity_key", "arrival", "source_sequence"), ["arrival", "symbol", "source_sequence"]).drop("source_sequence")


@query(
    sql(
        EVENTS,
        """SELECT symbol, a * 1000 AS anchor, CAST(sum(c) OVER (PARTITION BY symbol ORDER BY a ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rows_through, last_sequence
        FROM (SELECT symbol, (source_sequence + 999) // 1000 AS a, count(*) AS c, max(source_sequence) AS last_sequence FROM ev GROUP BY ALL)""",
    )
)
def row_anchors(spark, sf_dir):
    """How many rows of a symbol stand at or before each thousandth sequence, and the last of them."""
    a = F.call_function("div", F.col("source_sequence") + 999, F.lit(1000))
    counted = price_events(spark, sf_dir).groupBy("symbol", a.alias("a")).agg(F.count("*").alias("c"), F.max("source_sequence").alias("last_sequence"))
    w = Window.partitionBy("symbol").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select("symbol", (F.col("a") * 1000).alias("anchor"), F.sum("c").over(w).alias("rows_through"), "last_sequence")
