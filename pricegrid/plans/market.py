"""Queries of the price pipeline: hygiene, box sizes, columns, matrix, structure, patterns, regime, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import global_positions
from ..operators import columns as C
from ..operators import hygiene as H
from ..operators import segments as G
from ..operators import structure as S
from ..sources.events import arrivals, price_events, quotes
from .spine_sql import ARRIVALS, EVENTS, MATRIX, MOVES, PIVOTS, QUOTES, RESOLUTIONS, REVERSAL, STRUCTURE, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows; whole numbers go out as longs."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


KEY = ["symbol", "resolution"]
ARRIVAL = ["arrival", "source_sequence"]


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.moves(price_events(spark, sf_dir), RESOLUTIONS, REVERSAL)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.stream_flags(arrivals(spark, sf_dir), ["symbol"], ARRIVAL)


# hygiene


@query(sql(EVENTS, "SELECT * FROM ev"))
def price_events_spine(spark, sf_dir):
    return price_events(spark, sf_dir)


@query(sql(EVENTS, "SELECT symbol, source_sequence, event_us, price, row_number() OVER (ORDER BY event_us, received_us, source_sequence) AS position FROM ev WHERE symbol IN ('click', 'view', 'purchase') QUALIFY position <= 500"))
def ordered_scan(spark, sf_dir):
    """The first page of the canonical replay order."""
    e = price_events(spark, sf_dir).filter(F.col("symbol").isin("click", "view", "purchase"))
    page = e.orderBy("event_us", "received_us", "source_sequence").limit(500)
    w = Window.orderBy("event_us", "received_us", "source_sequence")
    return page.select("symbol", "source_sequence", "event_us", "price", F.row_number().over(w).alias("position"))


@query(sql(EVENTS, "SELECT symbol, source_sequence, event_us, price, row_number() OVER (ORDER BY event_us, received_us, source_sequence) AS position FROM ev"))
def ordered_scan_all(spark, sf_dir):
    """Every event with its place in the canonical replay order."""
    e = global_positions(price_events(spark, sf_dir), ["event_us", "received_us", "source_sequence"])
    return e.select("symbol", "source_sequence", "event_us", "price", "position")


@query(sql(EVENTS, "SELECT symbol, source_sequence, event_us, raw FROM ev WHERE source_sequence BETWEEN 1000 AND 1999"))
def range_scan(spark, sf_dir):
    return price_events(spark, sf_dir).filter(F.col("source_sequence").between(1000, 1999)).select("symbol", "source_sequence", "event_us", "raw")


@query("SELECT event_type AS symbol, max(event_id) AS max_sequence FROM events GROUP BY ALL")
def max_sequence(spark, sf_dir):
    from ..sources.events import table

    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.max("event_id").alias("max_sequence"))


@query(
    sql(
        QUOTES,
        """SELECT symbol, source_sequence, s AS price_source, CASE s WHEN 'bid' THEN bid * 2 WHEN 'ask' THEN ask * 2 WHEN 'last' THEN last * 2 ELSE bid + ask END AS twice_price
        FROM q, (VALUES ('bid'), ('ask'), ('last'), ('mid')) t(s)""",
    )
)
def select_price(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumn("price_source", F.explode(F.array(*map(F.lit, ("bid", "ask", "last", "mid")))))
    return q.select("symbol", "source_sequence", "price_source", H.select_price(F.col("price_source"), F.col("bid"), F.col("ask"), F.col("last")).alias("twice_price"))


@query(
    sql(
        QUOTES,
        """SELECT symbol, source_sequence, CASE WHEN bid IS NULL OR ask IS NULL THEN 'missing_price' WHEN bid <= 0 OR ask <= 0 THEN 'nonpositive_price'
        WHEN ask < bid THEN 'crossed_market' END AS violation FROM q""",
    )
)
def tick_validation(spark, sf_dir):
    return quotes(spark, sf_dir).select("symbol", "source_sequence", H.tick_violation(F.col("bid"), F.col("ask")).alias("violation"))


@query(
    sql(
        EVENTS,
        """, g AS (SELECT symbol, (seq - 1) // 20 AS bar, arg_min(price, seq) AS open, max(price) AS hi, min(price) AS lo, arg_max(price, seq) AS close FROM ev GROUP BY ALL)
        SELECT symbol, bar, CASE WHEN least(open, high, low, close) <= 0 THEN 'nonpositive_price' WHEN low > least(open, close) OR high < greatest(open, close) THEN 'invalid_bar_range' END AS violation
        FROM (SELECT symbol, bar, open, close, CASE WHEN bar % 11 = 0 THEN lo ELSE hi END AS high, CASE WHEN bar % 13 = 0 THEN hi ELSE lo END AS low FROM g)""",
    )
)
def bar_validation(spark, sf_dir):
    """Bars of twenty events, some with their high or low exchanged."""
    e = price_events(spark, sf_dir).withColumn("bar", F.floor((F.col("seq") - 1) / 20))
    g = e.groupBy("symbol", "bar").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("hi"), F.min("price").alias("lo"), F.max_by("price", "seq").alias("close"))
    high = F.when(F.col("bar") % 11 == 0, F.col("lo")).otherwise(F.col("hi"))
    low = F.when(F.col("bar") % 13 == 0, F.col("hi")).otherwise(F.col("lo"))
    return g.select("symbol", "bar", H.bar_violation(F.col("open"), high, low, F.col("close")).alias("violation"))


@query(
    sql(
        QUOTES,
        """SELECT symbol, seq, event_us, bid, ask FROM (
          SELECT *, lag(bid) OVER w AS b, lag(ask) OVER w AS a, row_number() OVER w AS n FROM (SELECT symbol, seq, event_us // 60000000 * 60000000 AS event_us, received_us, bid // 1000 AS bid, ask // 1000 AS ask FROM q)
          WHERE event_us <= received_us WINDOW w AS (PARTITION BY symbol ORDER BY seq))
        WHERE n = 1 OR bid IS DISTINCT FROM b OR ask IS DISTINCT FROM a""",
    )
)
def changed_quotes(spark, sf_dir):
    """Quotes in whole units that differ from the one before."""
    q = quotes(spark, sf_dir).select(
        "symbol", "seq", (F.col("event_us") - F.col("event_us") % 60_000_000).alias("event_us"), "received_us",
        F.call_function("div", "bid", F.lit(1000)).alias("bid"), F.call_function("div", "ask", F.lit(1000)).alias("ask"),
    )
    kept = H.changed_only(q, ["symbol"], "seq", ["bid", "ask"], F.col("event_us") <= F.col("received_us"))
    return kept.select("symbol", "seq", "event_us", "bid", "ask")


@query(sql(ARRIVALS, "SELECT symbol, source_sequence, arrival, is_duplicate, is_out_of_order, is_gap, gap_from_sequence FROM flags"))
def stream_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("symbol", "source_sequence", "arrival", "is_duplicate", "is_out_of_order", "is_gap", "gap_from_sequence")


@query(sql(ARRIVALS, "SELECT identity_key, arg_min(arrival, arrival) AS arrival, arg_min(price, arrival) AS price FROM arr GROUP BY identity_key"))
def dedup_events(spark, sf_dir):
    return H.first_of_identity(arrivals(spark, sf_dir), "identity_key", ["arrival"]).select("identity_key", "arrival", "price")


@query(
    sql(
        ARRIVALS,
        "SELECT symbol, source_sequence, arrival, row_number() OVER (PARTITION BY symbol ORDER BY arrival, source_sequence) AS accepted FROM flags WHERE NOT is_duplicate AND (ht IS NULL OR event_us >= ht)",
    )
)
def late_drop(spark, sf_dir):
    return H.drop_late(arrivals(spark, sf_dir), ["symbol"], ARRIVAL, "event_us", "identity_key").select("symbol", "source_sequence", "arrival", "accepted")


@query(
    sql(
        ARRIVALS,
        """SELECT symbol, source_sequence, arrival, count(*) OVER w AS observed, CAST(sum(CAST(is_duplicate AS INT)) OVER w AS BIGINT) AS duplicates,
          CAST(sum(CAST(is_out_of_order AS INT)) OVER w AS BIGINT) AS out_of_order, CAST(sum(CAST(is_gap AS INT)) OVER w AS BIGINT) AS gaps,
          CAST(sum(CAST(coalesce(source_sequence <= hi, false) AND NOT is_out_of_order AND NOT is_duplicate AS INT)) OVER w AS BIGINT) AS backfills
        FROM flags WINDOW w AS (PARTITION BY symbol ORDER BY arrival, source_sequence ROWS UNBOUNDED PRECEDING)""",
    )
)
def quality_counters(spark, sf_dir):
    out = H.quality_counters(flagged(spark, sf_dir), ["symbol"], ARRIVAL)
    return out.select("symbol", "source_sequence", "arrival", "observed", "duplicates", "out_of_order", "gaps", "backfills")


QUALITY = """,
qs AS (
  SELECT symbol, seq, CASE WHEN NOT (hour(make_timestamp(event_us)) BETWEEN 1 AND 21) THEN 'market_closed' WHEN age < -5000000 THEN 'clock_skew' WHEN age > 10000000 THEN 'stale'
         WHEN (received_us - event_us) // 1000 > 250 THEN 'high_latency' ELSE 'live' END AS status
  FROM (SELECT *, (source_sequence % 40) * 500000 - 6000000 AS age FROM ev))"""


def _status(spark, sf_dir):
    e = price_events(spark, sf_dir)
    hour = F.call_function("div", F.col("event_us") % 86_400_000_000, F.lit(3_600_000_000))
    age = (F.col("source_sequence") % 40) * 500_000 - 6_000_000
    latency = F.call_function("div", F.col("received_us") - F.col("event_us"), F.lit(1000))
    return e.select("symbol", "seq", H.quality_status(age, latency, hour.between(1, 21), slow_ms=250).alias("status"))


@query(sql(ARRIVALS, "SELECT symbol, source_sequence, arrival, CASE WHEN max(CAST(is_gap AS INT)) OVER (PARTITION BY symbol ORDER BY arrival, source_sequence ROWS UNBOUNDED PRECEDING) = 1 THEN 'partial' ELSE 'complete' END AS completeness FROM flags"))
def quality_completeness(spark, sf_dir):
    """Whether a symbol's stream has had a gap up to each arrival."""
    return H.completeness(flagged(spark, sf_dir), ["symbol"], ARRIVAL).select("symbol", "source_sequence", "arrival", "completeness")


@query(sql(EVENTS + QUALITY, "SELECT * FROM qs"))
def quality_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query(
    sql(
        EVENTS + QUALITY,
        """SELECT symbol, seq, status, CAST(sum(CAST(status = 'disconnected' AND b IS DISTINCT FROM 'disconnected' AS INT)) OVER w AS BIGINT) AS disconnects,
          CAST(sum(CAST(coalesce(status = 'live' AND b = 'disconnected', false) AS INT)) OVER w AS BIGINT) AS reconnects,
          CAST(sum(CAST(status IN ('error', 'unavailable') AS INT)) OVER w AS BIGINT) AS rejections
        FROM (SELECT symbol, seq, status, lag(status) OVER (PARTITION BY symbol ORDER BY seq) AS b
              FROM (SELECT symbol, seq, CASE status WHEN 'stale' THEN 'disconnected' WHEN 'clock_skew' THEN 'error' ELSE status END AS status FROM qs))
        WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    )
)
def transport_edges(spark, sf_dir):
    s = F.col("status")
    states = _status(spark, sf_dir).withColumn("status", F.when(s == "stale", "disconnected").when(s == "clock_skew", "error").otherwise(s))
    return H.transport_edges(states, ["symbol"], "seq", "status")


@query(sql(EVENTS + QUALITY, "SELECT symbol, seq, status FROM qs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 240"))
def recent_quality(spark, sf_dir):
    """The last 240 states of each symbol (a bounded history is the feature)."""
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("seq")))
    return _status(spark, sf_dir).withColumn("nth", nth).filter("nth <= 240").drop("nth")


@query(
    sql(
        ARRIVALS,
        """SELECT symbol, source_sequence, arrival, CASE WHEN is_duplicate AND c = f THEN 'repeated' WHEN is_duplicate THEN 'event_identity_conflict' WHEN is_out_of_order THEN 'noncanonical_event'
          WHEN NOT price > 0 THEN 'nonpositive_price' WHEN received_us < event_us THEN 'received_before_event' ELSE 'accepted' END AS verdict
        FROM (SELECT *, first_value(c) OVER (PARTITION BY symbol, identity_key ORDER BY arrival, source_sequence) AS f
              FROM (SELECT *, CASE WHEN is_duplicate AND source_sequence % 2 = 0 THEN price + 1 ELSE price END AS c FROM flags))""",
    )
)
def admission(spark, sf_dir):
    """Every second repetition carries another price, which is a conflict."""
    a = arrivals(spark, sf_dir)
    again = F.row_number().over(Window.partitionBy("identity_key").orderBy("arrival")) > 1
    a = a.withColumn("content", F.when(again & (F.col("source_sequence") % 2 == 0), F.col("price") + 1).otherwise(F.col("price")))
    return H.admission(a, ["symbol"], ARRIVAL, "identity_key", "content").select("symbol", "source_sequence", "arrival", "verdict")


# boxes and columns


@query(
    sql(
        EVENTS,
        """, m AS (SELECT symbol, seq, price, abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY seq)) AS tr FROM ev),
        s AS (SELECT *, CASE WHEN seq > 14 THEN CAST(sum(tr) OVER (PARTITION BY symbol ORDER BY seq ROWS 13 PRECEDING) AS BIGINT) END AS total FROM m),
        r AS (SELECT *, CASE WHEN total > 0 THEN CAST(round_even(CAST(least(greatest(total, 1400), 700000) AS DOUBLE) / 14, 0) AS BIGINT) END AS own FROM s)
        SELECT symbol, seq, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING), 1000) AS box,
          CASE WHEN seq = 1 THEN 'warmup_missing_previous' WHEN seq <= 14 THEN 'warmup_insufficient_window' WHEN total = 0 THEN 'zero_volatility_hold_last' ELSE 'atr' END AS reason FROM r""",
    )
)
def atr_box(spark, sf_dir):
    return C.atr_box(price_events(spark, sf_dir), ["symbol"], "seq").select("symbol", "seq", "box", "reason")


@query(sql(MOVES, "SELECT symbol, resolution, seq, event_us, kind, column_id, direction, from_price, to_price, boxes, box FROM moves"))
def pnf_transitions(spark, sf_dir):
    """Every transition, with the events of a symbol folded in segments."""
    e = C.fan_out(price_events(spark, sf_dir), RESOLUTIONS).select(*KEY, "seq", "event_us", "price", "box")
    return G.transitions(e, KEY, REVERSAL).select(*KEY, "seq", "event_us", "kind", "column_id", "direction", "from_price", "to_price", "boxes", "box")


@query()
def pnf_adaptive_transitions(spark, sf_dir):
    """Columns with the box of the moment; a recursion over both, beyond the oracle's SQL, is tested on fixtures."""
    return C.transitions(C.atr_box(price_events(spark, sf_dir), ["symbol"], "seq"), ["symbol"], REVERSAL)


@query(
    sql(
        MOVES,
        """SELECT symbol, resolution, column_id, max(direction) AS direction,
          arg_min(CASE WHEN kind = 'seed' THEN from_price WHEN direction = 'X' THEN from_price + box ELSE from_price - box END, seq) AS open_price,
          arg_max(to_price, seq) AS close_price, CAST(sum(boxes) AS BIGINT) AS boxes, min(event_us) AS started_us, max(event_us) AS updated_us FROM moves GROUP BY ALL""",
    )
)
def pnf_columns(spark, sf_dir):
    return C.columns(moves(spark, sf_dir), KEY)


@query(
    sql(
        MOVES,
        """SELECT symbol, resolution, seq, i, column_id, direction, least(a, b) AS low, greatest(a, b) AS high, row_number() OVER (PARTITION BY symbol, resolution ORDER BY seq DESC, i DESC) AS age
        FROM (SELECT *, from_price + s * box * (i - 1) AS a, from_price + s * box * i AS b
              FROM (SELECT *, CASE direction WHEN 'X' THEN 1 ELSE -1 END AS s, unnest(range(1, boxes + 1)) AS i FROM moves)) QUALIFY age <= 3000""",
    )
)
def pnf_cells(spark, sf_dir):
    return C.cells(moves(spark, sf_dir), KEY)


@query(sql(MATRIX, "SELECT symbol, seq, bullish, bearish, stale, warmup, alignment, strength FROM mat"))
def matrix_snapshots(spark, sf_dir):
    return C.matrix(price_events(spark, sf_dir), moves(spark, sf_dir), "symbol", list(RESOLUTIONS))


@query(
    sql(
        MATRIX,
        """SELECT symbol, seq, bias, CASE WHEN (bias = 'BULLISH' AND action = 'BUY') OR (bias = 'BEARISH' AND action = 'SELL') THEN 'DIRECTION_CONFIRMED' WHEN bias IN ('MIXED', 'UNAVAILABLE') THEN 'UNAVAILABLE' ELSE 'DEVELOPING' END AS state
        FROM (SELECT *, CASE WHEN bullish + bearish = 0 THEN 'UNAVAILABLE' WHEN bullish = 3 THEN 'BULLISH' WHEN bearish = 3 THEN 'BEARISH' WHEN bullish > bearish THEN 'BULLISH_LEAN' WHEN bearish > bullish THEN 'BEARISH_LEAN' ELSE 'MIXED' END AS bias,
              CASE seq % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'WAIT' END AS action FROM mat)""",
    )
)
def decision_context(spark, sf_dir):
    m = C.matrix(price_events(spark, sf_dir), moves(spark, sf_dir), "symbol", list(RESOLUTIONS))
    bias = C.decision_bias(F.col("bullish"), F.col("bearish"), len(RESOLUTIONS))
    action = F.element_at(F.array(F.lit("BUY"), F.lit("SELL"), F.lit("WAIT")), (F.col("seq") % 3 + 1).cast("int"))
    return m.select("symbol", "seq", bias.alias("bias"), C.decision_state(bias, action).alias("state"))


# structure


@query(sql(PIVOTS, "SELECT symbol, resolution, seq, event_us, kind, price, column_id, confirmed_seq, confirmed_us FROM piv"))
def pivots(spark, sf_dir):
    return S.pivots(moves(spark, sf_dir), KEY)


LEVELS = """,
lev AS (
  SELECT p.symbol, p.resolution, p.seq AS pivot_seq, CASE p.kind WHEN 'low' THEN 'support' ELSE 'resistance' END AS side, p.price, p.confirmed_seq,
         (SELECT min(m.seq) FROM moves m WHERE m.symbol = p.symbol AND m.resolution = p.resolution AND m.seq > p.confirmed_seq
            AND CASE p.kind WHEN 'low' THEN m.to_price < p.price ELSE m.to_price > p.price END) AS invalidated_seq
  FROM piv p)"""


@query(sql(PIVOTS + LEVELS, "SELECT symbol, resolution, pivot_seq, side, price, confirmed_seq, CASE WHEN invalidated_seq IS NULL THEN 'confirmed' ELSE 'invalidated' END AS status, invalidated_seq FROM lev"))
def levels(spark, sf_dir):
    return S.levels(moves(spark, sf_dir), KEY)


@query(
    sql(
        PIVOTS + LEVELS,
        """SELECT m.symbol, m.seq, s.price AS support, r.price AS resistance FROM moves m
        LEFT JOIN LATERAL (SELECT price FROM lev l WHERE l.symbol = m.symbol AND l.resolution = m.resolution AND side = 'support' AND confirmed_seq <= m.seq AND (invalidated_seq IS NULL OR invalidated_seq > m.seq) ORDER BY confirmed_seq DESC LIMIT 1) s ON true
        LEFT JOIN LATERAL (SELECT price FROM lev l WHERE l.symbol = m.symbol AND l.resolution = m.resolution AND side = 'resistance' AND confirmed_seq <= m.seq AND (invalidated_seq IS NULL OR invalidated_seq > m.seq) ORDER BY confirmed_seq DESC LIMIT 1) r ON true
        WHERE m.resolution = 'slow'""",
    )
)
def active_levels_asof(spark, sf_dir):
    """The latest confirmed level of each side that still holds, at every transition of the slow resolution."""
    return S.active_levels(moves(spark, sf_dir).filter("resolution = 'slow'"), KEY).select("symbol", "seq", "support", "resistance")


_HOLDS = "(SELECT price FROM lev l WHERE l.symbol = m.symbol AND l.resolution = m.resolution AND side = '{}' AND confirmed_seq <= m.seq AND (invalidated_seq IS NULL OR invalidated_seq > m.seq) ORDER BY confirmed_seq DESC LIMIT 1)"


@query(sql(PIVOTS + LEVELS, f"SELECT m.symbol, m.resolution, m.seq, {_HOLDS.format('support')} AS support, {_HOLDS.format('resistance')} AS resistance FROM moves m"))
def active_levels_asof_all(spark, sf_dir):
    """The same at every transition of every resolution."""
    return S.active_levels(moves(spark, sf_dir), KEY)


@query(
    sql(
        PIVOTS + LEVELS,
        f"""SELECT symbol, resolution, seq, side, price, 'confirmed' AS status FROM (
          SELECT m.symbol, m.resolution, m.seq, 'support' AS side, {_HOLDS.format('support')} AS price FROM moves m UNION ALL SELECT m.symbol, m.resolution, m.seq, 'resistance', {_HOLDS.format('resistance')} FROM moves m) WHERE price IS NOT NULL
        UNION ALL SELECT symbol, resolution, seq, 'support', to_price, 'unavailable' FROM moves m
        WHERE NOT EXISTS (SELECT 1 FROM lev l WHERE l.symbol = m.symbol AND l.resolution = m.resolution AND l.confirmed_seq <= m.seq)""",
    )
)
def standing_levels(spark, sf_dir):
    """The levels of every transition, and a placeholder before there are any."""
    return S.standing_levels(moves(spark, sf_dir), KEY)


PATTERN = """,
w AS (
  SELECT symbol, resolution, seq, confirmed_seq, lead(confirmed_seq) OVER x AS expired_seq, kind AS kf, price AS f, lag(kind, 1) OVER x AS ke, lag(price, 1) OVER x AS e, lag(kind, 2) OVER x AS kd, lag(price, 2) OVER x AS d,
         lag(kind, 3) OVER x AS kc, lag(price, 3) OVER x AS c, lag(kind, 4) OVER x AS kb, lag(price, 4) OVER x AS b, lag(kind, 5) OVER x AS ka, lag(price, 5) OVER x AS a
  FROM piv WINDOW x AS (PARTITION BY symbol, resolution ORDER BY seq)),
k AS (SELECT *, coalesce(left(ka, 1), '-') || coalesce(left(kb, 1), '-') || coalesce(left(kc, 1), '-') || coalesce(left(kd, 1), '-') || coalesce(left(ke, 1), '-') || left(kf, 1) AS ks FROM w),
hs AS (SELECT *, ks = 'hlhlhl' AND c > greatest(a, e) + 2500 AND abs(a - e) <= 2500 AND f < least(b, d) AS is_hs, ks = 'lhlhlh' AND c < least(a, e) - 2500 AND abs(a - e) <= 2500 AND f > greatest(b, d) AS is_ihs FROM k),
pat AS (
  SELECT symbol, resolution, seq, confirmed_seq, 'double_bottom' AS name, 'bullish' AS direction, expired_seq FROM hs WHERE ks LIKE '___lhl' AND abs(d - f) <= 2500
  UNION ALL SELECT symbol, resolution, seq, confirmed_seq, 'double_top', 'bearish', expired_seq FROM hs WHERE ks LIKE '___hlh' AND abs(d - f) <= 2500
  UNION ALL SELECT symbol, resolution, seq, confirmed_seq, 'failed_breakout', 'bearish', expired_seq FROM hs WHERE ks LIKE '__hlhl' AND e > c AND f < d
  UNION ALL SELECT symbol, resolution, seq, confirmed_seq, 'failed_breakdown', 'bullish', expired_seq FROM hs WHERE ks LIKE '__lhlh' AND e < c AND f > d
  UNION ALL SELECT symbol, resolution, seq, confirmed_seq, 'head_and_shoulders', 'bearish', expired_seq FROM hs WHERE is_hs
  UNION ALL SELECT symbol, resolution, seq, confirmed_seq, 'inverse_head_and_shoulders', 'bullish', expired_seq FROM hs WHERE is_ihs
  UNION ALL SELECT symbol, resolution, seq, confirmed_seq, 'triangle_breakdown', 'bearish', expired_seq FROM hs WHERE ks = 'hlhlhl' AND NOT is_hs AND a > c AND c > e AND b < d AND f < b
  UNION ALL SELECT symbol, resolution, seq, confirmed_seq, 'triangle_breakout', 'bullish', expired_seq FROM hs WHERE ks = 'lhlhlh' AND NOT is_ihs AND a < c AND c < e AND b > d AND f > b)"""


@query(sql(PIVOTS + PATTERN, "SELECT * FROM pat"))
def pattern_lifecycle(spark, sf_dir):
    return S.patterns(S.pivots(moves(spark, sf_dir), KEY), KEY, 2_500)


@query(sql(PIVOTS + PATTERN, "SELECT symbol, resolution, name, count(*) AS n FROM pat GROUP BY ALL"))
def pattern_counts(spark, sf_dir):
    return S.patterns(S.pivots(moves(spark, sf_dir), KEY), KEY, 2_500).groupBy("symbol", "resolution", "name").agg(F.count("*").alias("n"))


REGIME = """,
rw AS (
  SELECT symbol, resolution, seq, row_number() OVER (PARTITION BY symbol, resolution ORDER BY seq) AS i, price - first_value(price) OVER w AS slope, max(price) OVER w - min(price) OVER w AS width, count(*) OVER w AS n
  FROM piv WINDOW w AS (PARTITION BY symbol, resolution ORDER BY seq ROWS 3 PRECEDING)),
lab AS (
  SELECT *, CASE WHEN n < 2 THEN 'unknown' WHEN width >= 90000 THEN 'high_volatility' WHEN abs(slope) >= 30000 THEN 'trend' ELSE 'range' END AS own FROM rw),
reg AS (
  SELECT symbol, resolution, i, seq, slope, width, own AS label, CASE WHEN n < 2 THEN 'warmup' END AS reason FROM lab WHERE i = 1
  UNION ALL
  SELECT symbol, resolution, i, seq, slope, width, CASE WHEN held THEN before ELSE own END,
    CASE WHEN held THEN 'hysteresis_hold' ELSE CASE own WHEN 'high_volatility' THEN 'volatility_width_threshold' WHEN 'trend' THEN 'trend_slope_threshold' ELSE 'range_compaction' END END
  FROM (SELECT l.*, r.label AS before, l.own <> r.label AND ((r.label = 'high_volatility' AND l.width >= 85000) OR (r.label = 'trend' AND l.own = 'range' AND abs(l.slope) >= 25000)) AS held
        FROM reg r JOIN lab l ON l.symbol = r.symbol AND l.resolution = r.resolution AND l.i = r.i + 1))"""


@query(sql(PIVOTS + REGIME, "SELECT symbol, resolution, seq, slope, width, label, reason FROM reg"))
def regime(spark, sf_dir):
    return S.regime(S.pivots(moves(spark, sf_dir), KEY), KEY)


@query()
def trendlines(spark, sf_dir):
    """The lines' lives feed back on which anchors may replace them; checked against a brute-force replay in the tests."""
    return S.trendlines(moves(spark, sf_dir), KEY)
