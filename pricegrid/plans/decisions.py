"""Queries of evidence, scores and signals, and what follows from them; SQL for the chain to the signals, replays in the tests for the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durable import cut
from ..operators import columns as C
from ..operators import composition as P
from ..operators import outcomes as O
from ..operators import signals as G
from ..operators import structure as S
from ..sources.events import price_events
from .market import KEY, LEVELS, PATTERN, REGIME, moves, query
from .research import COST, ENTRY_US, EXIT_US, METRICS, SIZE
from .spine_sql import MATRIX, MOVES, PIVOTS, RESOLUTIONS, STRUCTURE, sql

TOLERANCE = 2_500


def scored(spark, sf_dir):
    # six consumers: transitions are folded once and read from there
    m, e = cut(moves(spark, sf_dir)), price_events(spark, sf_dir)
    grid = C.matrix(e, m, "symbol", list(RESOLUTIONS))
    return cut(G.score(G.inputs(e, m, grid, list(RESOLUTIONS), STRUCTURE, TOLERANCE), TOLERANCE))  # several readers, and filters on it would be computed twice


_PICK = "(SELECT price FROM lev l WHERE l.symbol = m.symbol AND l.resolution = m.resolution AND side = '{}' AND confirmed_seq <= m.seq AND (invalidated_seq IS NULL OR invalidated_seq > m.seq) ORDER BY confirmed_seq DESC LIMIT 1)"
_SIDES = [("pnf_side", 20), ("structure_side", 25), ("sr_side", 20), ("matrix_side", 20), ("regime_side", 15)]
_POINTS = lambda side: " + ".join(f"CASE WHEN {c} = '{side}' THEN {n} ELSE 0 END" for c, n in _SIDES)
#: Evidence, points and actions of every event, from the transitions on; sco has a row for each event.
SCORED = (
    MATRIX
    + PIVOTS.removeprefix(MOVES)
    + LEVELS
    + PATTERN
    + REGIME
    + f""",
own AS (SELECT * FROM moves WHERE resolution = '{STRUCTURE}'),
lat AS (
  SELECT symbol, seq, arg_min({{'direction': direction, 'to_price': to_price, 'box': box, 'moved_seq': seq, 'moved_us': event_us}}, list_position({list(RESOLUTIONS)}, resolution)) AS m
  FROM moves GROUP BY symbol, seq),
pp AS (
  SELECT p.symbol, p.seq AS pivot_seq, p.confirmed_seq AS seq, {{'kind': p.kind, 'price': p.price, 'seq': p.seq}} AS p0, max(p.confirmed_us) OVER w AS told_us,
    lag({{'kind': p.kind, 'price': p.price, 'seq': p.seq}}, 1) OVER w AS p1, lag({{'kind': p.kind, 'price': p.price, 'seq': p.seq}}, 2) OVER w AS p2
  FROM piv p WHERE p.resolution = '{STRUCTURE}' WINDOW w AS (PARTITION BY p.symbol ORDER BY p.seq)),
np AS (
  SELECT symbol, seq, count(*) FILTER (WHERE direction = 'bullish') AS up, count(*) FILTER (WHERE direction = 'bearish') AS down FROM pat WHERE resolution = '{STRUCTURE}' GROUP BY symbol, seq),
kn AS (
  SELECT pp.symbol, pp.seq, {{'p0': p0, 'p1': p1, 'p2': p2, 'label': reg.label, 'up': coalesce(np.up, 0), 'down': coalesce(np.down, 0), 'told_us': told_us}} AS held
  FROM pp JOIN reg ON reg.symbol = pp.symbol AND reg.seq = pp.pivot_seq AND reg.resolution = '{STRUCTURE}' LEFT JOIN np ON np.symbol = pp.symbol AND np.seq = pp.pivot_seq),
acl AS (SELECT m.symbol, m.seq, {_PICK.format("support")} AS support, {_PICK.format("resistance")} AS resistance FROM own m),
inp AS (
  SELECT ev.symbol, ev.seq, ev.event_us, mat.alignment, last_value(lat.m IGNORE NULLS) OVER w AS m, last_value(kn.held IGNORE NULLS) OVER w AS h,
    last_value(CASE WHEN support IS NOT NULL OR resistance IS NOT NULL THEN {{'support': support, 'resistance': resistance}} END IGNORE NULLS) OVER w AS n
  FROM ev LEFT JOIN mat USING (symbol, seq) LEFT JOIN lat USING (symbol, seq) LEFT JOIN kn USING (symbol, seq) LEFT JOIN acl USING (symbol, seq)
  WINDOW w AS (PARTITION BY ev.symbol ORDER BY ev.seq ROWS UNBOUNDED PRECEDING)),
flat AS (
  SELECT symbol, seq, event_us, alignment, m.direction AS direction, m.to_price AS to_price, m.box AS box, m.moved_seq AS moved_seq, h.p0.kind AS k0, h.p0.price AS v0, h.p0.seq AS s0,
    h.p1.kind AS k1, h.p1.price AS v1, h.p2.kind AS k2, h.p2.price AS v2, h.label AS label, coalesce(h.up, 0) AS up, coalesce(h.down, 0) AS down, n.support AS support, n.resistance AS resistance,
    coalesce(greatest(h.told_us, m.moved_us) > event_us, false) AS later
  FROM inp),
sid AS (
  SELECT *, CASE direction WHEN 'X' THEN 'BUY' WHEN 'O' THEN 'SELL' END AS pnf_side,
    CASE WHEN k1 IS NULL THEN NULL
      WHEN k2 = 'low' AND k1 = 'high' AND k0 = 'low' AND (abs(v2 - v0) <= {TOLERANCE} OR v0 > v2) THEN 'BUY'
      WHEN k2 = 'high' AND k1 = 'low' AND k0 = 'high' AND (abs(v2 - v0) <= {TOLERANCE} OR v0 < v2) THEN 'SELL'
      WHEN k1 = 'low' AND k0 = 'high' AND v0 > v1 THEN 'BUY' WHEN k1 = 'high' AND k0 = 'low' AND v0 < v1 THEN 'SELL'
      WHEN k1 = 'low' AND k0 = 'low' AND v0 < v1 THEN 'SELL' WHEN k1 = 'high' AND k0 = 'high' AND v0 > v1 THEN 'BUY'
      WHEN k0 = 'high' THEN 'BUY' ELSE 'SELL' END AS structure_side,
    CASE WHEN to_price <= support THEN 'BUY' WHEN to_price >= resistance THEN 'SELL' WHEN direction = 'X' THEN 'BUY' WHEN direction = 'O' THEN 'SELL' END AS sr_side,
    CASE alignment WHEN 'aligned_bullish' THEN 'BUY' WHEN 'aligned_bearish' THEN 'SELL' END AS matrix_side,
    CASE WHEN label = 'trend' THEN CASE alignment WHEN 'aligned_bullish' THEN 'BUY' WHEN 'aligned_bearish' THEN 'SELL' END END AS regime_side
  FROM flat),
pts AS (SELECT *, {_POINTS("BUY")} AS b, {_POINTS("SELL")} AS s FROM sid),
pt2 AS (
  SELECT *, least(100, CASE WHEN b >= s THEN greatest(0, least(100, b + up * 10) - down * 15) ELSE b END) AS buy_points,
    least(100, CASE WHEN b < s THEN greatest(0, least(100, s + down * 10) - up * 15) ELSE s END) AS sell_points,
    s0 IS NOT NULL AND coalesce(alignment <> 'unavailable', false) AND coalesce(label <> 'unknown', false) AND NOT later AS known,
    coalesce(alignment = 'mixed', false) OR coalesce(label IN ('range', 'high_volatility'), false) AS forced
  FROM pts),
sco AS (
  SELECT *, CASE WHEN NOT known THEN 0 WHEN forced THEN least(gap, 49) ELSE gap END AS score,
    CASE WHEN NOT known OR forced OR gap < 65 THEN 'WAIT' WHEN buy_points > sell_points THEN 'BUY' ELSE 'SELL' END AS action
  FROM (SELECT *, abs(buy_points - sell_points) AS gap FROM pt2)),
zon AS (
  SELECT *, to_price - half AS low, to_price + half AS high,
    CASE action WHEN 'BUY' THEN coalesce(support, CASE 'low' WHEN k0 THEN v0 WHEN k1 THEN v1 WHEN k2 THEN v2 END)
                WHEN 'SELL' THEN coalesce(resistance, CASE 'high' WHEN k0 THEN v0 WHEN k1 THEN v1 WHEN k2 THEN v2 END) END AS at_stop
  FROM (SELECT *, box * 50 // 100 AS half FROM sco)),
sup AS (
  SELECT *, CASE WHEN own_risk > 0 THEN own_risk END AS risk, CASE action WHEN 'BUY' THEN 1 ELSE -1 END AS way
  FROM (SELECT *, CASE action WHEN 'BUY' THEN low - at_stop WHEN 'SELL' THEN at_stop - high END AS own_risk FROM zon))"""
)
ISSUED = (
    SCORED
    + """,
cld AS (
  SELECT symbol, seq, action, score, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i,
    concat_ws('|', pnf_side, structure_side, sr_side, matrix_side, regime_side, s0, moved_seq) AS refs
  FROM sup WHERE action <> 'WAIT' AND risk IS NOT NULL),
fol AS (
  SELECT symbol, i, seq, action, score, seq AS last, action AS la, refs AS lr, true AS issued FROM cld WHERE i = 1
  UNION ALL
  SELECT symbol, i, seq, action, score, CASE WHEN go THEN seq ELSE last END, CASE WHEN go THEN action ELSE la END, CASE WHEN go THEN refs ELSE lr END, go
  FROM (SELECT c.*, f.last, f.la, f.lr, NOT (c.seq - f.last <= 3 OR (c.seq - f.last <= 20 AND f.la = c.action AND f.lr = c.refs)) AS go
        FROM fol f JOIN cld c ON c.symbol = f.symbol AND c.i = f.i + 1)),
iss AS (SELECT *, lead(seq) OVER (PARTITION BY symbol ORDER BY seq) AS next FROM fol WHERE issued),
sig AS (
  SELECT symbol, seq, action, 'issued' AS status, seq AS at_seq, score FROM iss
  UNION ALL SELECT iss.symbol, seq, action, 'expired', seq + 21, score FROM iss JOIN (SELECT symbol, max(seq) AS n FROM ev GROUP BY symbol) z USING (symbol)
  WHERE seq + 21 <= z.n AND (next IS NULL OR next >= seq + 21))"""
)


@query(sql(SCORED, "SELECT symbol, seq, pnf_side, structure_side, sr_side, matrix_side, regime_side, buy_points, sell_points, score, action FROM sco"))
def signal_evidence(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "seq", "pnf_side", "structure_side", "sr_side", "matrix_side", "regime_side", "buy_points", "sell_points", "score", "action")


@query(
    sql(
        SCORED,
        """SELECT symbol, seq, action, score, CASE WHEN risk IS NOT NULL THEN low END AS zone_low, CASE WHEN risk IS NOT NULL THEN high END AS zone_high, CASE WHEN risk IS NOT NULL THEN at_stop END AS stop, risk,
          to_price + way * (risk * 150 // 100) AS tp1, to_price + way * (risk * 250 // 100) AS tp2 FROM sup""",
    )
)
def signal_setups(spark, sf_dir):
    s = G.setup(scored(spark, sf_dir))
    return s.select("symbol", "seq", "action", "score", "zone_low", "zone_high", "stop", "risk", "tp1", "tp2")


@query(sql(ISSUED, "SELECT symbol, seq, action, status, CAST(at_seq AS BIGINT) AS at_seq, score FROM sig"))
def signals(spark, sf_dir):
    return G.issue(scored(spark, sf_dir))


def signal_fills(spark, sf_dir):
    return O.profit(P.signal_trades(cut(signals(spark, sf_dir)), price_events(spark, sf_dir), ENTRY_US, EXIT_US), SIZE, COST)


SIGNAL_TRADES = (
    ISSUED
    + f""",
dec AS (SELECT sig.symbol, sig.seq, sig.score, CASE action WHEN 'BUY' THEN 'long' ELSE 'short' END AS side, ev.received_us AS decision_us FROM sig JOIN ev ON ev.symbol = sig.symbol AND ev.seq = sig.seq WHERE status = 'issued'),
ent AS (SELECT s.*, e.event_us AS entry_us, e.price AS entry_price FROM dec s ASOF LEFT JOIN ev e ON s.symbol = e.symbol AND e.event_us >= s.decision_us + {ENTRY_US}),
exi AS (SELECT s.*, e.event_us AS exit_us, e.price AS exit_price FROM ent s ASOF LEFT JOIN ev e ON s.symbol = e.symbol AND e.event_us >= s.entry_us + {EXIT_US}),
tr AS (SELECT *, gross - {COST * SIZE} AS net FROM (SELECT *, CASE side WHEN 'long' THEN 1 ELSE -1 END * (exit_price - entry_price) * {SIZE} AS gross FROM exi))"""
)


@query(sql(SIGNAL_TRADES, "SELECT symbol, seq, side, score, decision_us, entry_us, entry_price, exit_us, exit_price, gross, net FROM tr"))
def signal_trades(spark, sf_dir):
    """Backtest of the pipeline's own signals."""
    t = signal_fills(spark, sf_dir)
    return t.select("symbol", "seq", "side", "score", "decision_us", "entry_us", "entry_price", "exit_us", "exit_price", "gross", "net")


@query(sql(SIGNAL_TRADES, METRICS))
def signal_metrics(spark, sf_dir):
    return O.backtest_metrics(signal_fills(spark, sf_dir), ["symbol"])


@query()
def signal_experiences(spark, sf_dir):
    """Experiences by fingerprint of the decision, with the plan of its setup."""
    return P.experiences(scored(spark, sf_dir))


@query()
def experience_closing(spark, sf_dir):
    """Where each of these experiences stands at the end of the events."""
    return P.closing_states(cut(P.experiences(scored(spark, sf_dir))), price_events(spark, sf_dir))


@query()
def signal_horizons(spark, sf_dir):
    """Endpoints and excursions of the experiences that have a direction, at four horizons."""
    found = cut(P.experiences(scored(spark, sf_dir)).filter("side is not null"))
    return O.horizon_outcomes(found, price_events(spark, sf_dir), [5, 15, 30, 60])


@query()
def entry_readiness_all(spark, sf_dir):
    """Every decision against the trendlines of the structure's resolution."""
    m = cut(moves(spark, sf_dir).filter(F.col("resolution") == STRUCTURE))
    return P.entry_readiness(scored(spark, sf_dir), S.trendlines(m, KEY))
