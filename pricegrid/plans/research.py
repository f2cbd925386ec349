"""Queries of what happened next: backtest, horizons, candles, labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import cut
from ..functions.joins import as_of
from ..operators import labels as B
from ..operators import outcomes as O
from ..operators.capture import observations as observe
from ..operators.segments import moves as fold_moves
from ..sources.events import price_events
from .market import KEY, ORACLE_SQL, QUERIES, moves, query
from .spine_sql import EVENTS, MOVES, RESOLUTIONS, REVERSAL, STRUCTURE, sql

ENTRY_US, EXIT_US, SIZE, COST = 2_000_000, 600_000_000, 2, 170
TOLERANCE = 2_500

SIGNALS = EVENTS + """,
sig AS (SELECT symbol, seq, event_us AS decision_us, CASE WHEN price > b THEN 'long' ELSE 'short' END AS side
        FROM (SELECT *, lag(price, 5) OVER (PARTITION BY symbol ORDER BY seq) AS b FROM ev) WHERE price <> b)"""
TRADES = SIGNALS + f""",
en AS (SELECT s.*, e.event_us AS entry_us, e.price AS entry_price FROM sig s ASOF LEFT JOIN ev e ON s.symbol = e.symbol AND e.event_us >= s.decision_us + {ENTRY_US}),
ex AS (SELECT s.*, e.event_us AS exit_us, e.price AS exit_price FROM en s ASOF LEFT JOIN ev e ON s.symbol = e.symbol AND e.event_us >= s.entry_us + {EXIT_US}),
tr AS (SELECT *, gross - {COST * SIZE} AS net FROM (SELECT *, CASE side WHEN 'long' THEN 1 ELSE -1 END * (exit_price - entry_price) * {SIZE} AS gross FROM ex))"""


def trades_over(e):
    """The trades of the baseline over events, whichever table they stand in."""
    return O.profit(O.fills(O.momentum(e, 5), e, ENTRY_US, EXIT_US), SIZE, COST)


def trades(spark, sf_dir):
    return trades_over(price_events(spark, sf_dir))


@query(sql(SIGNALS, "SELECT * FROM sig"))
def baseline_signals(spark, sf_dir):
    return O.momentum(price_events(spark, sf_dir), 5)


@query(sql(TRADES, "SELECT symbol, seq, decision_us, side, entry_us, entry_price, exit_us, exit_price, gross, net FROM tr"))
def backtest_trades(spark, sf_dir):
    return trades(spark, sf_dir)


METRICS = """SELECT symbol, count(net) AS trades, count(*) - count(net) AS unfilled, round(count(*) FILTER (WHERE net > 0) / nullif(count(net), 0), 9) AS win_rate, round(CAST(sum(net) AS DOUBLE) / nullif(count(net), 0), 6) AS expectancy,
          round(CAST(sum(net) FILTER (WHERE net > 0) AS DOUBLE) / nullif(CAST(sum(-net) FILTER (WHERE net < 0) AS DOUBLE), 0), 9) AS profit_factor,
          round(count(*) FILTER (WHERE net < 0) / nullif(count(net), 0), 9) AS false_entry_share, round(avg(entry_us - decision_us)) / 1000000 AS entry_delay_s FROM tr GROUP BY symbol"""


@query(
    sql(
        TRADES,
        METRICS,
    )
)
def backtest_metrics(spark, sf_dir):
    return O.backtest_metrics(trades(spark, sf_dir), ["symbol"])


@query(
    sql(
        TRADES,
        """SELECT symbol, max(greatest(0, peak) - equity) AS max_drawdown, arg_max(equity, seq) AS final_equity FROM (
          SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM (
            SELECT symbol, seq, CAST(sum(net) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equity FROM tr WHERE net IS NOT NULL)) GROUP BY symbol""",
    )
)
def drawdown(spark, sf_dir):
    return O.max_drawdown(trades(spark, sf_dir), ["symbol"], ["seq"])


@query(
    sql(
        EVENTS,
        """, runs(lookback) AS (VALUES (2), (5), (20)),
        s AS (SELECT lookback, price, CASE lookback WHEN 2 THEN lag(price, 2) OVER w WHEN 5 THEN lag(price, 5) OVER w ELSE lag(price, 20) OVER w END AS b
              FROM ev, runs WINDOW w AS (PARTITION BY lookback, symbol ORDER BY seq))
        SELECT CAST(lookback AS BIGINT) AS lookback, count(*) FILTER (WHERE price > b) AS longs, count(*) FILTER (WHERE price < b) AS shorts FROM s GROUP BY lookback""",
    )
)
def compare_runs(spark, sf_dir):
    """The same events under three lookbacks."""
    e = price_events(spark, sf_dir)
    runs = [O.momentum(e, n).groupBy("side").agg(F.count("*").alias("n")).withColumn("lookback", F.lit(n)) for n in (2, 5, 20)]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return every.groupBy("lookback").agg(F.sum(F.when(F.col("side") == "long", F.col("n"))).alias("longs"), F.sum(F.when(F.col("side") == "short", F.col("n"))).alias("shorts"))


# experiences: a change of direction of the medium resolution

EXPERIENCES = MOVES + """,
xp AS (SELECT symbol, seq, event_us AS t0, to_price AS reference, CASE direction WHEN 'X' THEN 'long' ELSE 'short' END AS side, box
       FROM (SELECT *, lag(direction) OVER (PARTITION BY symbol ORDER BY seq) AS d FROM moves WHERE resolution = 'medium') WHERE d IS DISTINCT FROM direction)"""


def experiences(spark, sf_dir):
    m = moves(spark, sf_dir).filter("resolution = 'medium'")
    changed = ~F.col("direction").eqNullSafe(F.lag("direction").over(Window.partitionBy("symbol").orderBy("seq")))
    side = F.when(F.col("direction") == "X", "long").otherwise("short")
    return m.withColumn("changed", changed).filter("changed").select("symbol", "seq", F.col("event_us").alias("t0"), F.col("to_price").alias("reference"), side.alias("side"), "box")


@query(sql(EXPERIENCES, "SELECT * FROM xp"))
def experience_changes(spark, sf_dir):
    return experiences(spark, sf_dir)


HORIZONS = EXPERIENCES + """,
hx AS (SELECT xp.*, CAST(m AS BIGINT) AS minutes, t0 + CAST(m AS BIGINT) * 60000000 AS due FROM xp, (VALUES (5), (15), (30), (60)) t(m)),
en AS (SELECT h.symbol, h.seq, h.minutes, e.event_us AS endpoint_us, e.price AS endpoint_price FROM hx h ASOF LEFT JOIN ev e ON e.symbol = h.symbol AND e.event_us >= h.due),
st AS (SELECT h.symbol, h.seq, h.minutes, count(e.price) AS samples, max(e.price) AS top, min(e.price) AS lo
       FROM hx h LEFT JOIN ev e ON e.symbol = h.symbol AND e.event_us > h.t0 AND e.event_us <= h.due AND e.received_us > h.t0 AND e.received_us <= h.due GROUP BY ALL),
ho AS (SELECT h.symbol, h.seq, h.minutes, endpoint_us, endpoint_price, CASE side WHEN 'long' THEN 1 ELSE -1 END * (endpoint_price - reference) AS directional_change, samples,
         CASE WHEN samples > 0 THEN greatest(0, top - reference) END AS up, CASE WHEN samples > 0 THEN greatest(0, reference - lo) END AS down, side
       FROM hx h JOIN en USING (symbol, seq, minutes) JOIN st USING (symbol, seq, minutes))"""


@query(
    sql(
        HORIZONS,
        "SELECT symbol, seq, minutes, endpoint_us, endpoint_price, directional_change, samples, up, down, CASE side WHEN 'long' THEN up ELSE down END AS mfe, CASE side WHEN 'long' THEN down ELSE up END AS mae FROM ho",
    )
)
def experience_outcomes(spark, sf_dir):
    return O.horizon_outcomes(experiences(spark, sf_dir), price_events(spark, sf_dir), [5, 15, 30, 60])


@query(
    sql(
        HORIZONS,
        """SELECT minutes, side, count(*) AS experiences, count(endpoint_us) AS completed, count(*) - count(endpoint_us) AS pending, count(*) FILTER (WHERE samples = 0) AS unsampled FROM ho GROUP BY ALL""",
    )
)
def experience_summary(spark, sf_dir):
    x = experiences(spark, sf_dir)
    h = O.horizon_outcomes(x, price_events(spark, sf_dir), [5, 15, 30, 60]).join(x.select("symbol", "seq", "side"), ["symbol", "seq"])
    return h.groupBy("minutes", "side").agg(
        F.count("*").alias("experiences"), F.count("endpoint_us").alias("completed"), F.count_if(F.col("endpoint_us").isNull()).alias("pending"), F.count_if(F.col("samples") == 0).alias("unsampled")
    )


@query(sql(EXPERIENCES, "SELECT symbol, seq, t0, side FROM xp ORDER BY t0 DESC, symbol, seq LIMIT 50 OFFSET 5"))
def experience_recent(spark, sf_dir):
    """A page of the newest (a page is the feature)."""
    return experiences(spark, sf_dir).orderBy(F.desc("t0"), "symbol", "seq").offset(5).limit(50).select("symbol", "seq", "t0", "side")


@query(
    sql(
        EXPERIENCES,
        """, nr AS (SELECT x.symbol, x.seq, x.reference AS r, x.box AS b, CASE side WHEN 'long' THEN 1 ELSE -1 END AS sg, e.seq AS es, e.event_us AS tm, e.price
          FROM xp x JOIN ev e ON e.symbol = x.symbol AND e.event_us > x.t0 AND e.event_us <= x.t0 + 3600000000 AND e.received_us > x.t0),
        nt AS (SELECT * FROM nr WHERE price BETWEEN r - b // 2 AND r + b // 2 QUALIFY row_number() OVER (PARTITION BY symbol, seq ORDER BY tm, es) = 1),
        af AS (SELECT nr.*, row_number() OVER (PARTITION BY nr.symbol, nr.seq ORDER BY nr.tm, nr.es) AS i FROM nr JOIN nt ON nr.symbol = nt.symbol AND nr.seq = nt.seq AND (nr.tm > nt.tm OR (nr.tm = nt.tm AND nr.es > nt.es))),
        hs AS (SELECT symbol, seq, min(CASE WHEN sg * (price - r) <= -b THEN i END) AS st, min(CASE WHEN sg * (price - r) >= b THEN i END) AS t1, min(CASE WHEN sg * (price - r) >= 2 * b THEN i END) AS t2 FROM af GROUP BY ALL),
        sx AS (SELECT symbol, seq, 'TP1' AS state, t1 AS i FROM hs WHERE st IS NULL OR t1 < st UNION ALL SELECT symbol, seq, 'TP2', t2 FROM hs WHERE st IS NULL OR t2 < st
          UNION ALL SELECT symbol, seq, 'INVALIDATED', st FROM hs WHERE t2 IS NULL OR st <= t2)
        SELECT symbol, seq, state, tm AS at_us, price FROM nt, (VALUES ('ENTRY_TRIGGERED'), ('ACTIVE')) v(state) UNION ALL SELECT symbol, seq, state, tm, price FROM sx JOIN af USING (symbol, seq, i)""",
    )
)
def experience_lifecycle(spark, sf_dir):
    """Entry, targets and invalidation of a plan of one box around each direction change."""
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    x, r, b = experiences(spark, sf_dir), F.col("reference"), F.col("box")
    plans = x.select(
        "symbol", "seq", "t0", "side", (r - F.call_function("div", b, F.lit(2))).alias("zone_low"), (r + F.call_function("div", b, F.lit(2))).alias("zone_high"),
        (r - sign * b).alias("stop"), (r + sign * b).alias("tp1"), (r + sign * 2 * b).alias("tp2"),
    )
    return O.lifecycles(plans, price_events(spark, sf_dir))


# half-hour candles


@query(
    sql(
        EVENTS,
        """SELECT symbol, event_us - event_us % 1800000000 AS bucket_us, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, count(*) AS samples,
          min(event_us) AS first_us, max(event_us) AS last_us, max(gap) AS max_gap_us
        FROM (SELECT *, event_us - lag(event_us) OVER (PARTITION BY symbol, event_us // 1800000000 ORDER BY seq) AS gap FROM ev) GROUP BY ALL""",
    )
)
def m30_candles(spark, sf_dir):
    return O.candles(price_events(spark, sf_dir), ["symbol"])


@query(
    sql(
        EVENTS,
        """, b AS (SELECT symbol, seq, event_us, lag(event_us) OVER (PARTITION BY symbol ORDER BY seq) AS bf FROM ev),
        c AS (SELECT *, (bf + 60000000) // 1800000000 * 1800000000 + 1800000000 AS f1, (event_us + 60000000) // 1800000000 * 1800000000 AS fn FROM b WHERE bf IS NOT NULL)
        SELECT symbol, seq, 'FROZEN' AS status, f1 AS target_us FROM c WHERE f1 <= fn AND bf >= f1 - 1800000000
        UNION ALL SELECT symbol, seq, 'SKIPPED', fn FROM c WHERE f1 <= fn AND (fn <> f1 OR bf < f1 - 1800000000)""",
    )
)
def freeze_crossings(spark, sf_dir):
    return O.freeze_crossings(price_events(spark, sf_dir), ["symbol"], 60_000_000)


@query(
    sql(
        EVENTS,
        """, b AS (SELECT symbol, seq, event_us, received_us, lag(event_us) OVER w AS bf, lag(price) OVER w AS reference, lag(received_us) OVER w AS known FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
        c AS (SELECT *, (bf + 60000000) // 1800000000 * 1800000000 + 1800000000 AS f1, (event_us + 60000000) // 1800000000 * 1800000000 AS fn FROM b WHERE bf IS NOT NULL),
        t AS (SELECT *, 'FROZEN' AS status, f1 AS target_us FROM c WHERE f1 <= fn AND bf >= f1 - 1800000000 UNION ALL SELECT *, 'SKIPPED', fn FROM c WHERE f1 <= fn AND (fn <> f1 OR bf < f1 - 1800000000)),
        cl AS (SELECT symbol, event_us // 1800000000 * 1800000000 AS bucket_us, arg_max(price, seq) AS close, max(received_us) AS known_us FROM ev GROUP BY ALL),
        h AS (SELECT t.symbol, t.seq, t.target_us, arg_min(close, bucket_us) AS oldest, count(*) AS history, bool_or(known_us > known) AS late_evidence
              FROM t JOIN cl ON cl.symbol = t.symbol AND cl.bucket_us >= t.target_us - 7200000000 AND cl.bucket_us < t.target_us - 1800000000 GROUP BY ALL),
        r AS (SELECT t.*, coalesce(history, 0) AS history, oldest, CASE WHEN status = 'SKIPPED' THEN 'discontinuous_feed' WHEN late_evidence THEN 'evidence_after_cutoff' END AS reason,
              sha256('symbol=' || t.symbol || '|target_us=' || t.target_us) AS candle_id FROM t LEFT JOIN h ON h.symbol = t.symbol AND h.seq = t.seq AND h.target_us = t.target_us)
        SELECT symbol, seq, status, target_us, target_us - 60000000 AS cutoff_us, bf AS snapshot_us, received_us AS prediction_us, reference, history, received_us > target_us AS late, greatest(0, received_us - target_us) AS freeze_lag_us,
          CASE WHEN reason IS NOT NULL OR oldest IS NULL THEN 'UNAVAILABLE' WHEN reference - oldest >= 3000 THEN 'BULLISH' WHEN reference - oldest <= -3000 THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias, reason, candle_id,
          sha256('lean-v1|' || candle_id) AS prediction_id FROM r""",
    )
)
def m30_predictions(spark, sf_dir):
    """What was said before each half-hour candle, and what it was said from."""
    return O.predictions(price_events(spark, sf_dir), ["symbol"], 60_000_000, O.lean(3_000), "lean-v1")


@query(
    sql(
        EVENTS,
        """, b AS (SELECT *, event_us - event_us % 1800000000 AS bucket_us, lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS lp FROM ev),
        c AS (SELECT symbol, bucket_us, first(lp ORDER BY seq) AS reference, arg_min(price, seq) AS open, arg_max(price, seq) AS close FROM b GROUP BY ALL),
        d AS (SELECT b.symbol, b.bucket_us, any_value(reference) AS reference, any_value(open) AS open, any_value(c.close) AS close, max(price - reference) AS up, min(price - reference) AS dn,
                min(CASE WHEN price - reference >= 3000 THEN seq END) AS us, min(CASE WHEN price - reference <= -3000 THEN seq END) AS ds
              FROM b JOIN c USING (symbol, bucket_us) WHERE reference IS NOT NULL GROUP BY ALL),
        t AS (SELECT symbol, bucket_us, arg_min(event_us, CASE WHEN price - reference = up THEN seq END) AS up_us, arg_min(event_us, CASE WHEN price - reference = dn THEN seq END) AS down_us FROM b JOIN d USING (symbol, bucket_us) GROUP BY ALL)
        SELECT symbol, bucket_us, reference, close - reference AS close_return, close - open AS body, open - reference AS drift, greatest(0, up) AS up, greatest(0, -dn) AS down,
          CASE WHEN up > 0 THEN up_us END AS up_us, CASE WHEN dn < 0 THEN down_us END AS down_us, CASE WHEN close - reference >= 3000 THEN 'UP' WHEN close - reference <= -3000 THEN 'DOWN' ELSE 'FLAT' END AS label,
          CASE WHEN us IS NULL AND ds IS NULL THEN 'NONE' WHEN ds IS NULL OR us < ds THEN 'UP' ELSE 'DOWN' END AS first_touch FROM d JOIN t USING (symbol, bucket_us)""",
    )
)
def m30_outcomes(spark, sf_dir):
    return O.candle_outcomes(price_events(spark, sf_dir), ["symbol"], 3_000)


# labels

LABELS = EXPERIENCES + """,
ins AS (SELECT x.symbol, x.seq, x.t0, e.seq AS at_seq, e.event_us, CASE side WHEN 'long' THEN 1 ELSE -1 END * (e.price - x.reference) AS move
        FROM xp x JOIN ev e ON e.symbol = x.symbol AND e.seq > x.seq AND e.seq <= x.seq + 20 AND e.event_us > x.t0 AND e.received_us > x.t0),
sta AS (SELECT symbol, seq, count(*) AS samples, max(move) AS best, min(move) AS worst, min(CASE WHEN move >= 15000 OR -move >= 10000 THEN at_seq END) AS barrier_seq,
          arg_max(event_us, (move, -at_seq)) AS best_us, arg_min(event_us, (move, at_seq)) AS worst_us FROM ins GROUP BY ALL),
lb AS (SELECT x.symbol, x.seq, x.side, CASE WHEN x.seq + 20 > n THEN 'CENSORED_END_OF_DATA' WHEN samples IS NULL THEN 'NO_SAMPLES' ELSE 'COMPLETE' END AS status, least(x.seq + 20, n) AS window_end,
         CASE WHEN samples > 0 THEN greatest(0, best) ELSE 0 END AS mfe, CASE WHEN samples > 0 THEN greatest(0, -worst) ELSE 0 END AS mae, CASE WHEN best > 0 THEN best_us - x.t0 END AS mfe_after_us, CASE WHEN worst < 0 THEN worst_us - x.t0 END AS mae_after_us,
         CASE WHEN samples > 0 THEN CASE WHEN s.barrier_seq IS NULL THEN 'none' WHEN i.move >= 15000 THEN 'favorable' ELSE 'adverse' END END AS first_barrier, s.barrier_seq,
         CASE WHEN i.move >= 15000 THEN i.move - 15000 ELSE -i.move - 10000 END AS overshoot
       FROM xp x JOIN (SELECT symbol, max(seq) AS n FROM ev GROUP BY symbol) USING (symbol) LEFT JOIN sta s ON s.symbol = x.symbol AND s.seq = x.seq LEFT JOIN ins i ON i.symbol = x.symbol AND i.seq = x.seq AND i.at_seq = s.barrier_seq)"""


def labels(spark, sf_dir):
    return O.event_window_labels(experiences(spark, sf_dir), price_events(spark, sf_dir), 20, 15_000, 10_000)


@query(sql(LABELS, "SELECT * FROM lb"))
def triple_barrier(spark, sf_dir):
    return labels(spark, sf_dir)


@query(
    sql(
        LABELS,
        """SELECT side, status, count(*) AS n, count(*) FILTER (WHERE first_barrier = 'favorable') AS favorable, count(*) FILTER (WHERE first_barrier = 'adverse') AS adverse, CAST(sum(mfe) AS BIGINT) AS mfe_sum, CAST(sum(mae) AS BIGINT) AS mae_sum FROM lb GROUP BY ALL""",
    )
)
def group_metrics(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("side", "status").agg(
        F.count("*").alias("n"), F.count_if(F.col("first_barrier") == "favorable").alias("favorable"), F.count_if(F.col("first_barrier") == "adverse").alias("adverse"), F.sum("mfe").alias("mfe_sum"), F.sum("mae").alias("mae_sum")
    )


@query(
    sql(
        LABELS,
        """, u AS (UNPIVOT (SELECT side, mfe, mae, overshoot FROM lb WHERE status = 'COMPLETE') ON mfe, mae, overshoot INTO NAME field VALUE v),
        r AS (SELECT *, row_number() OVER (PARTITION BY side, field ORDER BY v) AS i, count(*) OVER (PARTITION BY side, field) AS n FROM u)
        SELECT side, field, any_value(n) AS n, min(v) AS least, min(CASE WHEN i = ceil(n * 0.25) THEN v END) AS p25, min(CASE WHEN i = ceil(n * 0.5) THEN v END) AS median, min(CASE WHEN i = ceil(n * 0.75) THEN v END) AS p75, max(v) AS most FROM r GROUP BY ALL""",
    )
)
def nearest_rank(spark, sf_dir):
    done = labels(spark, sf_dir).filter("status = 'COMPLETE'").unpivot("side", ["mfe", "mae", "overshoot"], "field", "v")
    return O.nearest_ranks(done, ["side", "field"], "v", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@query(
    sql(
        LABELS,
        """, w AS (SELECT symbol, seq AS s, window_end AS e, row_number() OVER () AS id FROM lb),
        p AS (SELECT a.symbol, count(*) AS pairs FROM w a JOIN w b ON a.symbol = b.symbol AND a.id < b.id AND a.s <= b.e AND b.s <= a.e GROUP BY a.symbol),
        c AS (SELECT a.symbol, a.id, count(*) AS n FROM w a JOIN w b ON a.symbol = b.symbol AND b.s <= a.s AND b.e >= a.s GROUP BY ALL)
        SELECT symbol, coalesce(pairs, 0) AS pairs, max(n) AS most_open FROM c LEFT JOIN p USING (symbol) GROUP BY ALL""",
    )
)
def overlap_pairs(spark, sf_dir):
    return O.overlaps(labels(spark, sf_dir), ["symbol"], "seq", "window_end")


@query(
    sql(
        MOVES,
        """SELECT 'transition' AS subject, symbol, seq FROM moves WHERE resolution = 'fast' UNION ALL SELECT 'column', symbol, seq FROM moves WHERE resolution = 'slow' AND kind <> 'extension'
        UNION ALL SELECT 'every_100th', symbol, seq FROM ev WHERE seq % 100 = 0""",
    )
)
def observations(spark, sf_dir):
    """What a validation run looks at: new transitions, new columns, every hundredth event."""
    m = moves(spark, sf_dir)
    pick = [
        m.filter("resolution = 'fast'").select(F.lit("transition").alias("subject"), "symbol", "seq"),
        m.filter("resolution = 'slow' and kind <> 'extension'").select(F.lit("column").alias("subject"), "symbol", "seq"),
        price_events(spark, sf_dir).filter("seq % 100 = 0").select(F.lit("every_100th").alias("subject"), "symbol", "seq"),
    ]
    return pick[0].unionByName(pick[1]).unionByName(pick[2])


@query()
def observations_all(spark, sf_dir):
    """All nine kinds of observations, over every resolution; ``observations`` has three."""
    return observe(price_events(spark, sf_dir), RESOLUTIONS, REVERSAL, STRUCTURE, TOLERANCE)


AHEAD, MOST_GAP_US = (24, 240), 7_200_000_000


@query(
    sql(
        MOVES,
        f""",
        ob AS (SELECT m.symbol, m.resolution, m.seq, m.direction = 'X' AS up_side, e.event_us AS t0, e.price AS reference, a AS events_ahead
               FROM moves m JOIN ev e ON e.symbol = m.symbol AND e.seq = m.seq, (VALUES {", ".join(f"(CAST({n} AS BIGINT))" for n in AHEAD)}) v(a)),
        gp AS (SELECT *, coalesce(event_us - max(event_us) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {MOST_GAP_US}, false) AS gap, max(seq) OVER (PARTITION BY symbol) AS n FROM ev),
        win AS (SELECT o.symbol, o.resolution, o.seq, o.up_side, o.events_ahead, any_value(t0) AS t0, any_value(reference) AS reference, bool_or(gap) AS gap, count(*) FILTER (event_us > t0 AND received_us > t0) AS samples,
                  max(price) FILTER (event_us > t0 AND received_us > t0) AS top, min(price) FILTER (event_us > t0 AND received_us > t0) AS low,
                  arg_max(event_us, {{'p': price, 's': -g.seq}}) FILTER (event_us > t0 AND received_us > t0) AS top_us, arg_min(event_us, {{'p': price, 's': g.seq}}) FILTER (event_us > t0 AND received_us > t0) AS low_us,
                  arg_max(price, g.seq) FILTER (event_us > t0 AND received_us > t0) AS ended
                FROM ob o LEFT JOIN gp g ON g.symbol = o.symbol AND g.seq BETWEEN o.seq + 1 AND o.seq + o.events_ahead GROUP BY ALL),
        fin AS (SELECT w.*, z.n, greatest(0, top - reference) AS up, greatest(0, reference - low) AS down FROM win w JOIN (SELECT symbol, max(seq) AS n FROM ev GROUP BY symbol) z ON z.symbol = w.symbol)""",
        """SELECT symbol, resolution, seq, CASE WHEN up_side THEN 'long' ELSE 'short' END AS direction, events_ahead,
          CASE WHEN seq + events_ahead > n THEN 'CENSORED_END_OF_DATA' WHEN coalesce(gap, false) THEN 'CENSORED_GAP' WHEN samples = 0 THEN 'NO_SAMPLES' ELSE 'COMPLETE' END AS status, samples,
          CASE WHEN samples > 0 THEN up END AS up, CASE WHEN samples > 0 THEN down END AS down, CASE WHEN samples > 0 THEN CASE WHEN up_side THEN up ELSE down END END AS mfe, CASE WHEN samples > 0 THEN CASE WHEN up_side THEN down ELSE up END END AS mae,
          CASE WHEN samples > 0 THEN CASE WHEN up_side AND up > 0 THEN top_us - t0 WHEN NOT up_side AND down > 0 THEN low_us - t0 END END AS mfe_after_us,
          CASE WHEN samples > 0 THEN CASE WHEN up_side AND down > 0 THEN low_us - t0 WHEN NOT up_side AND up > 0 THEN top_us - t0 END END AS mae_after_us, CASE WHEN up_side THEN 1 ELSE -1 END * (ended - reference) AS end_change FROM fin""",
    )
)
def transition_labels(spark, sf_dir):
    """What the next 24 and 240 events bring, for every transition of every resolution."""
    side = F.when(F.col("direction") == "X", "long").otherwise("short")
    e = cut(price_events(spark, sf_dir).select("symbol", "seq", "event_us", "received_us", "price"))
    m = fold_moves(e, RESOLUTIONS, REVERSAL).select("symbol", "resolution", "seq", side.alias("direction"))
    return B.outcomes(m, e, AHEAD, MOST_GAP_US)


@query()
def observation_labels(spark, sf_dir):
    """The same for all nine kinds of observations."""
    e = cut(price_events(spark, sf_dir))
    return B.outcomes(B.directed(observe(e, RESOLUTIONS, REVERSAL, STRUCTURE, TOLERANCE)), e, AHEAD, MOST_GAP_US)


@query(sql(EVENTS, "SELECT a.symbol, a.seq, b.price AS reference FROM ev a ASOF LEFT JOIN (SELECT * FROM ev WHERE seq % 7 = 0) b ON a.symbol = b.symbol AND b.event_us <= a.event_us"))
def asof_reference(spark, sf_dir):
    """The last sampled price at or before each event."""
    e = price_events(spark, sf_dir)
    sampled = e.filter("seq % 7 = 0").select("symbol", "event_us", "seq", F.col("price").alias("reference"))
    return as_of(e.select("symbol", "seq", "event_us"), sampled, ["symbol"], "event_us", ["reference"], tie="seq", width=O.HALF_HOUR).select("symbol", "seq", "reference")


CUTS = 4  # the history of each symbol is cut at 1/4, 2/4 and 3/4


def differences(events, capture, cuts=CUTS, piece=1 << 16):
    """change, differences: observations up to each cut that later events, cut off or changed, make come or go.

    Every variant of a symbol is a symbol of its own, so that one run captures all of them. What it captures up to the cut is first summed
    up by pieces of ``piece`` events, their number and a hash of 64 bits each, with no shuffle of observations. Pieces whose sums differ from
    those of the whole history are then counted observation by observation.
    """
    e = cut(events)
    ends = [F.call_function("div", F.col("n") * k, F.lit(cuts)) for k in range(1, cuts)]
    places = e.groupBy("symbol").agg(F.max("seq").alias("n")).select("symbol", F.filter(F.array_distinct(F.array(*ends)), lambda c: c > 0).alias("cuts"))

    def changed(change):
        return F.transform("cuts", lambda c: F.struct(F.lit(change).alias("change"), c.alias("cut")))

    changes = ("prefix", "reflect", "flatten", "shock")
    whole = F.array(F.struct(F.lit("whole").alias("change"), F.lit(None).cast("long").alias("cut")))
    variant = F.concat_ws("|", "change", F.coalesce(F.col("cut").cast("string"), F.lit("-")), F.concat(F.lit("="), "of"))
    variants = cut(places.select(F.col("symbol").alias("of"), "cuts", F.explode(F.concat(whole, *map(changed, changes))).alias("v")).select("of", "cuts", "v.*").withColumn("variant", variant))

    later, change, p = F.coalesce(F.col("seq") > F.col("cut"), F.lit(False)), F.col("change"), F.col("price")
    price = F.when(~later, p).when(change == "reflect", 20_000_000 - p).when(change == "flatten", 10_000_000).when(change == "shock", p * 2).otherwise(p)
    every = e.join(F.broadcast(variants), F.col("symbol").eqNullSafe(F.col("of"))).filter(~(later & (change == "prefix")))
    found = capture(every.select(*[{"symbol": F.col("variant"), "price": price}.get(c, F.col(c)).alias(c) for c in events.columns]))

    # ``part``: how many cuts lie before the observation, so that pieces end at every cut
    of = variants.select(F.col("variant").alias("symbol"), F.coalesce(F.concat(F.lit("="), "of"), F.lit("")).alias("id"), "change", "cut", "cuts")
    part = sum((F.coalesce(F.get("cuts", F.lit(k)) < F.col("seq"), F.lit(False)).cast("int") for k in range(cuts - 1)), F.lit(0))
    met = found.join(F.broadcast(of), "symbol").filter("seq is not null and (cut is null or seq <= cut)").select("*", part.alias("part"), F.call_function("div", F.col("seq"), F.lit(piece)).alias("piece"))
    said = [x for c in ("subject", "resolution", "seq", "what") for x in (F.col(c).isNull(), F.col(c))]
    hashed = met.select("id", "change", "cut", "part", "piece", F.xxhash64(*said).alias("h"))
    halves = {"high": F.shiftright("h", 32), "low": F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))}  # of 32 bits, so that sums stay within a long
    key = ["id", "change", "cut", "part", "piece"]
    sums = cut(hashed.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(h).alias(n) for n, h in halves.items()]))
    at = of.filter("cut is not null").select("id", "change", "cut", "cuts")
    parts = sums.filter("change = 'whole'").drop("change", "cut").join(F.broadcast(at), "id").filter(F.get("cuts", F.col("part")) <= F.col("cut")).drop("cuts").withColumn("sign", F.lit(1))
    parts = parts.unionByName(sums.filter("change <> 'whole'").withColumn("sign", F.lit(-1)))
    totals = [F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n", *halves)]
    unequal = cut(parts.groupBy(*key).agg(*totals).filter("n <> 0 or high <> 0 or low <> 0").select(*key))
    names = e.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, changes))).alias("change"))
    if unequal.isEmpty():
        return names.select(F.lit(0).cast("long").alias("differences"), "change")
    row = ["subject", "resolution", "seq", "what"]
    both = met.filter("change = 'whole'").select("id", "part", "piece", *row).join(unequal, ["id", "part", "piece"]).withColumn("sign", F.lit(1))
    both = both.unionByName(met.filter("change <> 'whole'").select(*key, *row).join(unequal, key, "left_semi").withColumn("sign", F.lit(-1)))
    odd = both.groupBy("id", "change", "cut", *row).agg(F.abs(F.sum("sign")).alias("odd"))
    return names.join(odd.groupBy("change").agg(F.sum("odd").alias("differences")), "change", "left").select(F.coalesce("differences", F.lit(0)).alias("differences"), "change")


@query("SELECT 0 AS differences, 'prefix' AS change WHERE true UNION ALL SELECT 0, 'reflect' UNION ALL SELECT 0, 'flatten' UNION ALL SELECT 0, 'shock'")
def causal_invariance(spark, sf_dir):
    """Observations of all kinds up to each cut, with later events cut off or changed: nothing may differ."""
    return differences(price_events(spark, sf_dir), lambda e: observe(e, RESOLUTIONS, REVERSAL, STRUCTURE, TOLERANCE, with_regime=True))
