"""Queries of ledgers, gates, reconciliation, deduplication, news and integrity over the orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import range_join
from ..functions.scaled import micros
from ..operators import gates as G
from ..operators import ledgers as L
from ..operators import lifecycle as P
from ..operators import structure as S
from ..operators.automata import EDGES, STATES
from ..sources.events import arrivals, price_events, table
from .market import KEY, moves, query
from .research import EXPERIENCES, experiences
from .spine_sql import ARRIVALS, EVENTS, PIVOTS, sql

# proposals: each order is a case; its key spreads it over the values of every input

HEALTH = ("HEALTHY", "HEALTHY", "HEALTHY", "HEALTHY", "HEALTHY", "HEALTHY", "HEALTHY", "UNKNOWN", "UNHEALTHY", "STALE", "UNSYNCHRONIZED")
PRIMES = (3, 5, 7, 11, 13, 17)


def _pick(n: int, values: tuple) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.call_function("div", F.col("k"), F.lit(n)) % len(values) + 1).cast("int"))


def _pick_sql(n: int, values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][k // {n} % {len(values)} + 1]"


MODES, READY, KINDS = ("SHADOW", "ASSISTED", "MANUAL", "AUTO", "MANUAL", "MANUAL"), ("READY", "NOT_READY", "READY"), ("OPEN", "REDUCE", "CLOSE", "MODIFY_PROTECTION")
CHANGES, RECON = ("TIGHTEN", "WIDEN", None), ("SYNCHRONIZED", "SYNCHRONIZED", "UNSYNCHRONIZED", "UNKNOWN")
AUTHORITY, TRANSMIT = ("AUTHORIZED", "AUTHORIZED", "DENIED"), ("TRANSMITTABLE", "TRANSMITTABLE", "NOT_TRANSMITTABLE", "NOT_APPLICABLE")
FIELDS = {
    **{a: (p, HEALTH) for a, p in zip(G.AXES, PRIMES, strict=True)}, "mode": (1, MODES), "readiness": (2, READY), "kind": (19, KINDS), "change": (23, CHANGES),
    "recon": (29, RECON), "authority": (31, AUTHORITY), "transmit": (37, TRANSMIT), "risk": (4, ("allow", "allow", "reject")), "position_ref": (41, ("p", None, "p")),
}
CASES = "cases AS (SELECT k, " + ", ".join(f"{_pick_sql(*v)} AS {n}" for n, v in FIELDS.items()) + ", k % 3 = 0 AS confirmed, k % 43 = 0 AS kill_switch FROM (SELECT o_orderkey AS k FROM orders))"


def cases(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return rows.select("k", *[_pick(*v).alias(n) for n, v in FIELDS.items()], (F.col("k") % 3 == 0).alias("confirmed"), (F.col("k") % 43 == 0).alias("kill_switch"))


def _rules_sql(rules: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, true) THEN '{r}' END" for r, c in rules) + "], lambda x: x IS NOT NULL), ',')"


AXES_SQL = [(a, f"{a} <> 'HEALTHY'") for a in G.AXES]
MODE_SQL = [("auto_mode_not_governed", "mode = 'AUTO'"), ("trading_mode_shadow_observes_only", "mode = 'SHADOW'"), ("assisted_confirmation_missing", "mode = 'ASSISTED' AND NOT confirmed")]


@query(sql(CASES, f"SELECT k, {_rules_sql(AXES_SQL)} AS degraded FROM cases"))
def health_axes(spark, sf_dir):
    return cases(spark, sf_dir).select("k", F.array_join(G.reasons(G.degraded()), ",").alias("degraded"))


@query(
    sql(
        CASES,
        f"SELECT k, {_rules_sql([*MODE_SQL, *[('health_degraded:' + a, c) for a, c in AXES_SQL], ('entry_not_ready', chr(114) + 'eadiness <> ' + chr(39) + 'READY' + chr(39)), ('risk_decision_not_allow', 'risk <> ' + chr(39) + 'allow' + chr(39))])} AS reasons FROM cases",
    )
)
def new_trade_authority(spark, sf_dir):
    return cases(spark, sf_dir).select("k", F.array_join(G.new_trade_reasons(), ",").alias("reasons"))


@query(
    sql(
        CASES,
        "SELECT k, kind, CASE WHEN broker = 'UNHEALTHY' THEN 'broker_unhealthy_fail_closed' WHEN kind IN ('REDUCE', 'CLOSE') OR ("
        + " AND ".join(f"{a} = 'HEALTHY'" for a in G.AXES)
        + ") THEN NULL WHEN change IS NULL THEN 'protection_change_unclassified' WHEN change = 'WIDEN' THEN 'degraded_blocks_exposure_increase' END AS reason FROM cases WHERE kind <> 'OPEN'",
    )
)
def position_authority(spark, sf_dir):
    c = cases(spark, sf_dir).filter("kind <> 'OPEN'")
    return c.select("k", "kind", G.existing_position_reason(F.col("kind"), F.col("change")).alias("reason"))


GUARD_SQL = [
    *MODE_SQL[:2], ("assisted_confirmation_missing", "mode = 'ASSISTED' AND kind = 'OPEN' AND NOT confirmed"), ("authority_denied", "authority <> 'AUTHORIZED'"),
    ("authority_not_transmittable", "authority = 'AUTHORIZED' AND transmit = 'NOT_TRANSMITTABLE'"), ("authority_not_applicable", "authority = 'AUTHORIZED' AND transmit NOT IN ('TRANSMITTABLE', 'NOT_TRANSMITTABLE')"),
    ("reconciliation_blocks_new_trade", "kind = 'OPEN' AND recon <> 'SYNCHRONIZED'"), ("kill_switch_armed", "kind = 'OPEN' AND kill_switch"), ("new_position_ref_missing", "kind = 'OPEN' AND position_ref IS NULL"),
    ("reconciliation_blocks_position_action", "kind <> 'OPEN' AND recon <> 'SYNCHRONIZED'"), ("protection_change_unclassified", "kind = 'MODIFY_PROTECTION' AND change IS NULL"),
    ("kill_switch_blocks_protection_widen", "kind = 'MODIFY_PROTECTION' AND coalesce(change = 'WIDEN', false) AND kill_switch"),
]


@query(sql(CASES, f"SELECT k, {_rules_sql(GUARD_SQL)} AS reasons FROM cases"))
def execution_guard(spark, sf_dir):
    return cases(spark, sf_dir).select("k", F.array_join(G.guard_reasons(F.col("kind"), F.col("change")), ",").alias("reasons"))


@query(
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN v <= 0 THEN 'volume_not_positive' WHEN v < 300 THEN 'volume_below_min' WHEN v > 4000 THEN 'volume_above_max' WHEN (v - 300) % 200 <> 0 THEN 'volume_off_step' END AS reason,
      CASE WHEN v <= 0 THEN 'volume_not_positive' WHEN v < 300 THEN 'volume_below_min' WHEN (v - 300) % 200 <> 0 THEN 'volume_off_step' END AS residual_reason, v // 200 * 200 AS stepped
    FROM (SELECT *, CAST(round(l_quantity * 100) AS BIGINT) AS v FROM lineitem)"""
)
def volume_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("v", F.round(F.col("l_quantity") * 100).cast("long"))
    v, lo, hi, st = F.col("v"), F.lit(300), F.lit(4000), F.lit(200)
    return li.select("l_orderkey", "l_linenumber", G.volume_violation(v, lo, hi, st).alias("reason"), G.volume_violation(v, lo, hi, st, residual=True).alias("residual_reason"), (F.call_function("div", v, st) * 200).alias("stepped"))


# positions: an order is a local position, its lines make the broker's view of it

POSITIONS = """
loc AS (SELECT 'L' || o_orderkey AS position_id, CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE 'I' || o_custkey % 40 END AS instrument, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side,
          CAST(round(o_totalprice) AS BIGINT) % 1000 AS quantity, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS stop, o_orderstatus = 'F' AS closed FROM orders),
bro AS (SELECT 'B' || o_orderkey AS broker_ref, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'L' || (o_orderkey - 1) ELSE 'L' || o_orderkey END AS local_ref, 'I' || o_custkey % 40 AS instrument,
          CASE WHEN (CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) % 2 = 0 THEN 'long' ELSE 'short' END AS side, CAST(round(o_totalprice) AS BIGINT) % 1000 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS quantity,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS stop, o_orderkey % 23 = 0 AS close_pending FROM orders WHERE o_orderkey % 9 <> 0)"""
FINDINGS = POSITIONS + """,
j AS (SELECT b.*, l.position_id, l.quantity AS lq, l.stop AS ls, coalesce(NOT l.closed AND l.instrument = b.instrument AND l.side = b.side, false) AS fits, CASE WHEN local_ref IS NOT NULL THEN count(*) OVER (PARTITION BY local_ref) END AS claims
      FROM bro b LEFT JOIN loc l ON l.position_id = b.local_ref),
p AS (SELECT *, fits AND row_number() OVER (PARTITION BY local_ref, fits ORDER BY broker_ref) = 1 AS paired FROM j),
f AS (
  SELECT broker_ref AS position_ref, 'BROKER_POSITION_LOCAL_MISSING' AS finding FROM p WHERE NOT paired
  UNION ALL SELECT position_id, 'CLOSE_PENDING_CONFIRMED' FROM p WHERE paired AND close_pending AND claims = 1
  UNION ALL SELECT position_id, 'QUANTITY_MISMATCH' FROM p WHERE paired AND NOT (close_pending AND claims = 1) AND quantity <> lq
  UNION ALL SELECT position_id, 'PROTECTION_MISMATCH' FROM p WHERE paired AND NOT (close_pending AND claims = 1) AND stop IS DISTINCT FROM ls
  UNION ALL SELECT position_id, 'MATCH' FROM p WHERE paired AND NOT (close_pending AND claims = 1) AND quantity = lq AND stop IS NOT DISTINCT FROM ls
  UNION ALL SELECT position_id, CASE WHEN instrument IS NOT NULL AND position_id NOT IN (SELECT local_ref FROM bro WHERE local_ref IS NOT NULL)
      AND NOT EXISTS (SELECT 1 FROM bro b WHERE b.local_ref IS NULL AND b.instrument = loc.instrument AND b.side = loc.side) THEN 'BROKER_FLAT_CONFIRMED' ELSE 'LOCAL_OPEN_BROKER_MISSING' END
    FROM loc WHERE NOT closed AND position_id NOT IN (SELECT position_id FROM p WHERE paired)),
rec AS (SELECT *, CASE WHEN finding = 'MATCH' THEN 'SYNCHRONIZED' WHEN finding = 'CLOSE_PENDING_CONFIRMED' THEN 'UNKNOWN' ELSE 'UNSYNCHRONIZED' END AS status FROM f)"""


def positions(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    quantity = F.round("o_totalprice").cast("long") % 1000
    instrument = F.concat(F.lit("I"), c % 40)

    def side(n):
        return F.when(n % 2 == 0, "long").otherwise("short")

    def ref(letter, n):
        return F.concat(F.lit(letter), n)

    local = o.select(
        ref("L", k).alias("position_id"), F.when(c % 19 != 0, instrument).alias("instrument"), side(k).alias("side"), quantity.alias("quantity"),
        F.when(k % 4 != 0, c).alias("stop"), (F.col("o_orderstatus") == "F").alias("closed"),
    )
    broker = o.filter(k % 9 != 0).select(
        ref("B", k).alias("broker_ref"), F.when(k % 31 == 0, F.lit(None).cast("string")).when(k % 37 == 0, ref("L", k - 1)).otherwise(ref("L", k)).alias("local_ref"), instrument.alias("instrument"),
        side(F.when(k % 41 == 0, k + 1).otherwise(k)).alias("side"), (quantity + F.when(k % 13 == 0, 1).otherwise(0)).alias("quantity"),
        F.when(k % 4 == 0, F.lit(None).cast("long")).when(k % 17 == 0, c + 1).otherwise(c).alias("stop"), (k % 23 == 0).alias("close_pending"),
    )
    return local, broker


@query(sql(FINDINGS, "SELECT * FROM rec"))
def reconcile(spark, sf_dir):
    return G.reconcile(*positions(spark, sf_dir))


@query(sql(FINDINGS, "SELECT left(position_ref, 1) AS side, count(*) AS records, CASE max(CASE status WHEN 'SYNCHRONIZED' THEN 0 WHEN 'UNSYNCHRONIZED' THEN 1 ELSE 2 END) WHEN 0 THEN 'SYNCHRONIZED' WHEN 1 THEN 'UNSYNCHRONIZED' ELSE 'UNKNOWN' END AS overall FROM rec GROUP BY ALL"))
def aggregate_reconciliation(spark, sf_dir):
    records = G.reconcile(*positions(spark, sf_dir)).withColumn("side", F.substring("position_ref", 1, 1))
    return G.worst_status(records, ["side"])


@query(sql(POSITIONS, "SELECT position_id, 'close-all:' || position_id AS request_id, 'exec:CLOSE:' || position_id AS idempotency_key FROM loc WHERE NOT closed AND instrument = 'I7' AND position_id NOT IN (SELECT local_ref FROM bro WHERE close_pending AND local_ref IS NOT NULL)"))
def close_all_plan(spark, sf_dir):
    """Close every open position of an instrument that isn't already closing."""
    local, broker = positions(spark, sf_dir)
    closing = broker.filter("close_pending and local_ref is not null").select(F.col("local_ref").alias("position_id"))
    due = local.filter("not closed and instrument = 'I7'").join(closing, "position_id", "left_anti")
    return due.select("position_id", F.concat(F.lit("close-all:"), "position_id").alias("request_id"), F.concat(F.lit("exec:CLOSE:"), "position_id").alias("idempotency_key"))


# deduplication events: the lines of an order

DEDUP = """
ev AS (SELECT 'exec:' || l_orderkey AS key, l_linenumber AS seq, CASE WHEN l_linenumber = 1 THEN 'claim' WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN 'abort' WHEN l_linenumber = 2 THEN 'attempt' WHEN l_linenumber = 3 THEN 'result' WHEN l_linenumber = 4 AND l_orderkey % 3 = 0 THEN 'release' WHEN l_linenumber = 5 THEN 'claim' ELSE 'note' END AS event,
         CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS generation, l_orderkey % 7 <> 0 AS clean FROM lineitem),
st AS (
  SELECT key, current AS generation, CASE WHEN bool_or(event = 'claim' AND generation > current) THEN 'CORRUPT_claim_beyond_generation' WHEN bool_or(event = 'result' AND generation < current AND NOT clean) THEN 'CORRUPT_released_generation_not_safe'
      WHEN NOT bool_or(event = 'claim' AND generation = current) THEN 'UNCLAIMED' WHEN bool_or(event = 'abort' AND generation = current) THEN 'ABORTED_NEVER_ATTEMPTED'
      WHEN bool_or(event = 'result' AND generation = current) THEN CASE WHEN bool_or(event = 'result' AND generation = current AND NOT clean) THEN 'RESULT_UNSAFE' ELSE 'RESULT_CLEAN_REJECTED' END
      WHEN bool_or(event = 'attempt' AND generation = current) THEN 'ATTEMPTED_NO_RESULT' ELSE 'CLAIMED_NOT_ATTEMPTED' END AS state
  FROM ev JOIN (SELECT key, count(*) FILTER (WHERE event = 'release') AS current FROM ev GROUP BY key) USING (key) GROUP BY key, current)"""


def dedup_events(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    event = (
        F.when(n == 1, "claim").when((k % 11 == 0) & (n == 2), "abort").when(n == 2, "attempt").when(n == 3, "result")
        .when((n == 4) & (k % 3 == 0), "release").when(n == 5, "claim").otherwise("note")
    )
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("exec:"), k).alias("key"), n.alias("seq"), event.alias("event"), F.when(n == 5, 1).otherwise(0).cast("long").alias("generation"), (k % 7 != 0).alias("clean"))


@query(sql(DEDUP, "SELECT * FROM st"))
def dedup_state(spark, sf_dir):
    return G.dedup_states(dedup_events(spark, sf_dir))


@query(sql(DEDUP, "SELECT key, state FROM st WHERE state IN ('ATTEMPTED_NO_RESULT', 'RESULT_UNSAFE', 'CLAIMED_NOT_ATTEMPTED') OR state LIKE 'CORRUPT%'"))
def unresolved_keys(spark, sf_dir):
    s = G.dedup_states(dedup_events(spark, sf_dir))
    return s.filter(F.col("state").isin("ATTEMPTED_NO_RESULT", "RESULT_UNSAFE", "CLAIMED_NOT_ATTEMPTED") | F.col("state").startswith("CORRUPT")).select("key", "state")


@query(
    "WITH t AS (SELECT o_orderkey AS k, " + _pick_sql(1, STATES).replace("k //", "o_orderkey //") + " AS a, " + _pick_sql(8, STATES).replace("k //", "o_orderkey //") + " AS b FROM orders) SELECT k, a || '->' || b IN ("
    + ", ".join(f"'{a}->{b}'" for a, bs in EDGES.items() for b in bs) + ") AS allowed FROM t"
)
def trade_state_edges(spark, sf_dir):
    edge = F.concat_ws("->", _pick(1, STATES), _pick(8, STATES))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return rows.select("k", edge.isin([f"{a}->{b}" for a, bs in EDGES.items() for b in bs]).alias("allowed"))


# news: every 50th event announces an item

NEWS = EVENTS + """,
nw AS (SELECT source_sequence AS id, event_us + 1800000000 AS at_us, ['LOW', 'MEDIUM', 'HIGH'][source_sequence // 50 % 3 + 1] AS impact, ['USD', 'EUR', 'JPY'][source_sequence // 50 % 3 + 1] AS currency, symbol FROM ev WHERE source_sequence % 50 = 0),
win AS (SELECT *, at_us - CASE impact WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 15 ELSE 30 END * CAST(60000000 AS BIGINT) AS start_us, at_us + CASE impact WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 15 ELSE 60 END * CAST(60000000 AS BIGINT) AS end_us FROM nw)"""


def news(spark, sf_dir):
    e = price_events(spark, sf_dir).filter("source_sequence % 50 = 0")
    nth = (F.call_function("div", F.col("source_sequence"), F.lit(50)) % 3 + 1).cast("int")
    return e.select(
        F.col("source_sequence").alias("id"), (F.col("event_us") + 1_800_000_000).alias("at"), F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), nth).alias("impact"),
        F.element_at(F.array(*map(F.lit, ("USD", "EUR", "JPY"))), nth).alias("currency"), "symbol",
    )


@query(sql(NEWS, "SELECT w.id, e.symbol, e.source_sequence FROM win w JOIN ev e ON e.symbol = w.symbol AND e.event_us BETWEEN w.start_us AND w.end_us"))
def news_blackout(spark, sf_dir):
    """Events that fall into a blackout of their symbol."""
    w = G.news_windows(news(spark, sf_dir), {"LOW": (0, 0), "MEDIUM": (15, 15), "HIGH": (30, 60)})
    e = price_events(spark, sf_dir).select("symbol", F.col("event_us").alias("seen_us"), "source_sequence")
    return range_join(w, e, ["symbol"], "seen_us", F.col("start_us"), F.col("end_us"), 5_400_000_000).select("id", "symbol", "source_sequence")


@query(sql(NEWS, "SELECT id, at_us, impact FROM nw WHERE at_us BETWEEN (SELECT min(at_us) FROM nw) AND (SELECT min(at_us) FROM nw) + 86400000000"))
def upcoming_news(spark, sf_dir):
    n = news(spark, sf_dir)
    first = n.agg(F.min("at").alias("now"))
    return n.join(F.broadcast(first), (F.col("at") >= F.col("now")) & (F.col("at") <= F.col("now") + 86_400_000_000)).select("id", F.col("at").alias("at_us"), "impact")  # one row is broadcast


@query(sql(NEWS, "SELECT id, CASE WHEN currency IN ('USD', 'EUR') AND symbol IN ('click', 'view') THEN 'currency_match,symbol_match' WHEN currency IN ('USD', 'EUR') THEN 'currency_match' WHEN symbol IN ('click', 'view') THEN 'symbol_match' ELSE 'no_watchlist_match' END AS reasons FROM nw"))
def news_relevance(spark, sf_dir):
    n = news(spark, sf_dir)
    return n.select("id", G.relevance(F.array("currency"), F.array("symbol"), ["USD", "EUR"], ["click", "view"]).alias("reasons"))


# ledgers


@query(
    sql(
        """f AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, CAST(l_quantity AS BIGINT) * CASE l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN -1 ELSE 1 END AS size, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_quantity >= 1),
        r AS (
          SELECT l_suppkey, n, size AS quantity, CAST(0 AS DOUBLE) + size * price AS cost, CAST(0 AS DOUBLE) AS realised FROM f WHERE n = 1
          UNION ALL
          SELECT l_suppkey, n, quantity + size, cost - gone + (size + side * gone_units) * price, realised + (side * gone_units * price - gone)
          FROM (SELECT *, CASE WHEN quantity = 0 THEN CAST(0 AS DOUBLE) ELSE cost * gone_units / abs(quantity) END AS gone
                FROM (SELECT r.l_suppkey, f.n, r.quantity, r.cost, r.realised, f.size, f.price, sign(r.quantity) AS side, least(abs(r.quantity), greatest(0, -sign(r.quantity) * f.size)) AS gone_units
                      FROM r JOIN f ON f.l_suppkey = r.l_suppkey AND f.n = r.n + 1)))""",
        "SELECT l_suppkey, n, quantity, round(CASE WHEN quantity = 0 THEN 0 ELSE cost / quantity END * 10000) / 10000 AS average, round(realised * 100) / 100 AS realised FROM r",
    )
)
def position_netting(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity >= 1")
    size = F.col("l_quantity").cast("long") * F.when(F.col("l_returnflag").isin("A", "R"), -1).otherwise(1)
    fills = li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", size.alias("size"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    out = L.net_positions(fills, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return out.select("l_suppkey", "n", "quantity", (F.round(F.col("average") * 10_000) / 10_000).alias("average"), (F.round(F.col("realised") * 100) / 100).alias("realised"))


_REASON = """CASE WHEN kill THEN 'kill_switch_active' WHEN NOT currency THEN 'currency_mismatch' WHEN NOT quality THEN 'quality_unavailable' WHEN NOT live THEN 'stale_or_missing_price'
  WHEN stop < 5000 THEN 'stop_distance_too_small' WHEN size <= 0 THEN 'size_quantized_to_zero' WHEN in_use + before + stop * size > 150000 THEN 'exposure_limit'
  WHEN -least(daily, 0) + before + in_use + stop * size > 200000 THEN 'daily_loss_limit' WHEN peak - equity > 180000 THEN 'drawdown_limit' ELSE 'allowed' END"""


@query(
    sql(
        EXPERIENCES,
        f""", p0 AS (SELECT symbol, seq, t0 // 86400000000 AS day, 1000000 - seq % 11 * 20000 AS equity, box AS stop, seq % 9 + 1 AS wanted, seq % 17 <> 0 AS live, seq % 29 = 0 AS kill,
          CASE WHEN seq % 3 = 0 THEN 60000 ELSE 0 END AS released, CASE WHEN seq % 3 = 0 THEN 15000 ELSE -10000 END AS pnl, seq % 5 * 5000 AS in_use, seq % 31 <> 0 AS currency, seq % 37 <> 0 AS quality FROM xp),
        pr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n, least(wanted, 50000 // stop) AS size, max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak,
          CAST(sum(pnl) OVER (PARTITION BY symbol, day ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS daily FROM p0),
        rk AS (
          SELECT symbol, n, seq, reason, size, stop, CASE WHEN reason = 'allowed' THEN stop * size ELSE 0 END AS reserved, daily FROM (SELECT *, {_REASON} AS reason FROM (SELECT *, CAST(0 AS BIGINT) AS before FROM pr WHERE n = 1))
          UNION ALL
          SELECT symbol, n, seq, reason, size, stop, before + CASE WHEN reason = 'allowed' THEN stop * size ELSE 0 END, daily FROM (SELECT *, {_REASON} AS reason
            FROM (SELECT pr.*, greatest(0, rk.reserved - pr.released) AS before FROM rk JOIN pr ON pr.symbol = rk.symbol AND pr.n = rk.n + 1)))""",
        "SELECT symbol, seq, reason, CASE WHEN reason = 'allowed' THEN size ELSE 0 END AS size, CASE WHEN reason = 'allowed' THEN stop * size ELSE 0 END AS reserved_risk, reserved AS reserved_total, daily AS daily_result FROM rk",
    )
)
def risk_decisions(spark, sf_dir):
    """Reservations feed back on later proposals."""
    x = experiences(spark, sf_dir)
    s = F.col("seq")
    proposals = x.select(
        "symbol", "seq", F.call_function("div", F.col("t0"), F.lit(86_400_000_000)).alias("day"), (F.lit(1_000_000) - s % 11 * 20_000).alias("equity"), "box", (s % 9 + 1).alias("wanted"),
        (s % 17 != 0).alias("live"), (s % 29 == 0).alias("kill"), F.when(s % 3 == 0, 60_000).otherwise(0).cast("long").alias("released"), F.when(s % 3 == 0, 15_000).otherwise(-10_000).cast("long").alias("pnl"),
        (s % 5 * 5_000).alias("in_use"), (s % 31 != 0).alias("currency"), (s % 37 != 0).alias("quality"),
    )
    limits = {"risk_per_trade": 50_000, "step": 1, "min_stop": 5_000, "exposure": 150_000, "daily_loss": 200_000, "drawdown": 180_000}
    return L.risk_decisions(proposals, "symbol", limits)


@query(sql("t AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(round(l_extendedprice * 100) AS BIGINT) * CASE l_returnflag WHEN 'N' THEN -1 ELSE 1 END AS cash FROM lineitem)", "SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(1000000 + sum(cash) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM t"))
def paper_balances(spark, sf_dir):
    cash = F.round(F.col("l_extendedprice") * 100).cast("long") * F.when(F.col("l_returnflag") == "N", -1).otherwise(1)
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").withColumn("cash", cash).select("l_suppkey", "l_orderkey", "l_linenumber", (F.sum("cash").over(w) + 1_000_000).alias("balance"))


# readiness, integrity


@query(
    sql(
        EXPERIENCES,
        "SELECT symbol, seq, CASE WHEN seq % 5 = 0 THEN 'NOT_READY' WHEN seq % 4 = 0 THEN 'DEVELOPING' WHEN seq % 3 = 0 THEN 'BLOCKED' ELSE 'READY' END AS readiness FROM xp",
    )
)
def entry_readiness(spark, sf_dir):
    s = F.col("seq")
    action = F.when(s % 5 == 0, "WAIT").when(F.col("side") == "long", "BUY").otherwise("SELL")
    line = F.when(s % 4 == 0, "retesting").when(s % 3 == 0, "broken").when(s % 2 == 0, "active")
    return experiences(spark, sf_dir).select("symbol", "seq", S.readiness(action, line).alias("readiness"))


@query(sql(EVENTS, "SELECT symbol, source_sequence, sha256('event_us=' || event_us || '|price=' || price || '|symbol=' || symbol) AS content_hash FROM ev"))
def content_hash(spark, sf_dir):
    return price_events(spark, sf_dir).select("symbol", "source_sequence", F.sha2(G.canonical("symbol", "event_us", "price"), 256).alias("content_hash"))


@query(
    """SELECT k, sha256('k=' || k || '|v=' || v) = stored AS intact FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS v, sha256('k=' || o_orderkey || '|v=' || (CAST(round(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 53 = 0 THEN 1 ELSE 0 END)) AS stored FROM orders)"""
)
def journal_verify(spark, sf_dir):
    """A journal whose hashes were stored; some payloads were changed since."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("v"))
    stored = o.withColumn("was", F.col("v") + F.when(F.col("k") % 53 == 0, 1).otherwise(0))
    hashed = F.sha2(F.concat(F.lit("k="), "k", F.lit("|v="), "was"), 256)
    return stored.select("k", (F.sha2(G.canonical("k", "v"), 256) == hashed).alias("intact"))


@query(
    sql(
        ARRIVALS,
        """SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE source_sequence <= s) AS sequence_not_rising, count(*) FILTER (WHERE event_us < t) AS time_falling,
          count(*) FILTER (WHERE received_us < event_us) AS known_before_event, count(*) FILTER (WHERE price <= 0) AS nonpositive_price, count(*) - count(DISTINCT source_sequence) AS repeated_identity
        FROM (SELECT *, lag(source_sequence) OVER w AS s, lag(event_us) OVER w AS t FROM arr WINDOW w AS (PARTITION BY symbol ORDER BY arrival)) GROUP BY symbol""",
    )
)
def dataset_verify(spark, sf_dir):
    """The feed in the order of arrival, with its repetitions and late events."""
    return G.dataset_violations(arrivals(spark, sf_dir).withColumn("seq", F.col("arrival")), ["symbol"])


@query(
    sql(
        PIVOTS
        + """, n AS (SELECT symbol, resolution, seq, kind, price, row_number() OVER (PARTITION BY symbol, resolution ORDER BY seq) AS i FROM piv WHERE resolution = 'slow'),
        c AS (SELECT symbol, i, seq, sha256('' || '|' || kind || ':' || price) AS chain FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.seq, sha256(c.chain || '|' || n.kind || ':' || n.price) FROM c JOIN n ON n.symbol = c.symbol AND n.i = c.i + 1)""",
        "SELECT symbol, arg_max(chain, i) AS chain, max(i) AS records FROM c GROUP BY symbol",
    )
)
def hash_chain(spark, sf_dir):
    """One hash over all records of a key, each over the one before."""
    from ..functions.folds import ordered_fold

    p = S.pivots(moves(spark, sf_dir).filter("resolution = 'slow'"), KEY).select("symbol", "seq", F.concat_ws(":", "kind", "price").alias("record"))
    return ordered_fold(p, ["symbol"], ["seq"], lambda *_: L.ChainFold(), "symbol string, chain string, records long")


@query(
    sql(
        PIVOTS
        + """, n AS (SELECT symbol, resolution, seq, kind, price, row_number() OVER (PARTITION BY symbol, resolution ORDER BY seq) AS i FROM piv),
        c AS (SELECT symbol, resolution, i, sha256('' || '|' || kind || ':' || price) AS chain FROM n WHERE i = 1
              UNION ALL SELECT n.symbol, n.resolution, n.i, sha256(c.chain || '|' || n.kind || ':' || n.price) FROM c JOIN n ON n.symbol = c.symbol AND n.resolution = c.resolution AND n.i = c.i + 1)""",
        "SELECT symbol, resolution, arg_max(chain, i) AS chain, max(i) AS records FROM c GROUP BY ALL",
    )
)
def hash_chain_all(spark, sf_dir):
    """One hash over all pivots of each symbol and resolution."""
    from ..functions.folds import ordered_fold

    p = S.pivots(moves(spark, sf_dir), KEY).select(*KEY, "seq", F.concat_ws(":", "kind", "price").alias("record"))
    return ordered_fold(p, KEY, ["seq"], lambda *_: L.ChainFold(), "symbol string, resolution string, chain string, records long")


@query("SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1800000000 * 1800000000 AS bucket_us FROM orders")
def bucket_start(spark, sf_dir):
    us = micros(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (us - F.pmod(us, F.lit(1_800_000_000))).alias("bucket_us"))


@query(
    """SELECT c_custkey, count(b) AS bindings, CASE count(b) WHEN 0 THEN 'binding_missing' WHEN 1 THEN 'resolved' ELSE 'binding_ambiguous' END AS resolution
    FROM customer LEFT JOIN (SELECT s_nationkey AS b, s_acctbal FROM supplier WHERE s_acctbal > 5000) ON b = c_nationkey GROUP BY c_custkey"""
)
def instrument_resolution(spark, sf_dir):
    """A customer stands for an instrument, suppliers of its nation with enough balance for its bindings."""
    bindings = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("bindings"))
    c = table(spark, sf_dir, "customer").join(bindings, "c_nationkey", "left").withColumn("bindings", F.coalesce("bindings", F.lit(0)))
    return c.select("c_custkey", "bindings", F.when(F.col("bindings") == 0, "binding_missing").when(F.col("bindings") == 1, "resolved").otherwise("binding_ambiguous").alias("resolution"))


@query("SELECT p_partkey, CASE WHEN length(s) <= 280 THEN s ELSE left(s, 277) || '...' END AS excerpt FROM (SELECT p_partkey, repeat(p_name || ' ', CAST(p_size AS INT)) AS s FROM part)")
def excerpts(spark, sf_dir):
    s = F.expr("repeat(concat(p_name, ' '), p_size)")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.length(s) <= 280, s).otherwise(F.concat(F.substring(s, 1, 277), F.lit("..."))).alias("excerpt"))


# positions under exit decisions, paper fills, lifecycles, freshness

EXITS = """
x AS (SELECT o_orderkey AS k, ['OPEN', 'MANAGING', 'EXIT_PENDING', 'OPEN'][o_orderkey % 4 + 1] AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, o_custkey % 10 + 1 AS quantity, CAST(1000 AS BIGINT) AS stop,
        ['HOLD', 'TIGHTEN', 'PARTIAL_CLOSE', 'CLOSE'][o_orderkey // 4 % 4 + 1] AS action, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 990 + o_orderkey % 20 END AS new_stop, o_orderkey % 6 + 1 AS reduce_by FROM orders),
y AS (SELECT *, CASE WHEN action = 'HOLD' THEN NULL WHEN action = 'TIGHTEN' AND state NOT IN ('OPEN', 'MANAGING') THEN 'tighten_requires_open_or_managing_position'
        WHEN action = 'TIGHTEN' AND NOT coalesce(CASE side WHEN 'long' THEN new_stop > stop ELSE new_stop < stop END, false) THEN 'protection_must_only_tighten'
        WHEN action = 'PARTIAL_CLOSE' AND quantity <= reduce_by THEN 'partial_close_must_leave_residual_quantity' WHEN action IN ('PARTIAL_CLOSE', 'CLOSE') AND state NOT IN ('OPEN', 'MANAGING') THEN 'transition_not_allowed' END AS reason FROM x)"""


@query(
    sql(
        EXITS,
        """SELECT k, CASE WHEN reason IS NULL AND action = 'PARTIAL_CLOSE' THEN 'MANAGING' WHEN reason IS NULL AND action = 'CLOSE' THEN 'EXIT_PENDING' ELSE state END AS state,
          CASE WHEN reason IS NULL AND action = 'PARTIAL_CLOSE' THEN quantity - reduce_by WHEN reason IS NULL AND action = 'CLOSE' THEN 0 ELSE quantity END AS quantity,
          CASE WHEN reason IS NULL AND action = 'TIGHTEN' THEN new_stop ELSE stop END AS stop, reason FROM y""",
    )
)
def exit_decisions(spark, sf_dir):
    k = F.col("o_orderkey")

    def pick(i, *values):
        return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))

    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), pick(k % 4, "OPEN", "MANAGING", "EXIT_PENDING", "OPEN").alias("state"), F.when(k % 2 == 0, "long").otherwise("short").alias("side"), (F.col("o_custkey") % 10 + 1).alias("quantity"),
        F.lit(1000).cast("long").alias("stop"), pick(F.call_function("div", k, F.lit(4)) % 4, "HOLD", "TIGHTEN", "PARTIAL_CLOSE", "CLOSE").alias("action"),
        F.when(k % 7 != 0, k % 20 + 990).alias("new_stop"), (k % 6 + 1).alias("reduce_by"),
    )
    return P.apply_exit(rows).select("k", "state", "quantity", "stop", "reason")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, p + CASE WHEN buys THEN 5 ELSE -5 END AS fill_price, q * 2 AS fee, CASE WHEN buys THEN -(p + 5) * q ELSE (p - 5) * q END - q * 2 AS cash FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'N' AS buys FROM lineitem)")
def paper_fills(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "N", "long").otherwise("short")
    fill = P.paper_fill(F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long"), side, 5, 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fill.alias("f")).select("l_orderkey", "l_linenumber", "l_partkey", "f.*")


@query("SELECT o_orderkey AS k, ['DISABLED', 'SHADOW', 'ACTIVE'][least(o_orderkey % 3, o_custkey % 3, o_orderkey // 3 % 3) + 1] AS lifecycle FROM orders")
def feature_lifecycle(spark, sf_dir):
    def level(i):
        return F.element_at(F.array(*map(F.lit, P.LIFECYCLE)), (i % 3 + 1).cast("int"))

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), P.effective_lifecycle(level(k), level(F.col("o_custkey")), level(F.call_function("div", k, F.lit(3)))).alias("lifecycle"))


@query(sql(EVENTS, "SELECT symbol, source_sequence, CASE WHEN a < -5000000 THEN 'clock_skew' WHEN a > 10000000 THEN 'stale' ELSE 'live' END AS freshness FROM (SELECT *, source_sequence % 50 * 500000 - 8000000 AS a FROM ev) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 240"))
def quote_freshness(spark, sf_dir):
    """The last 240 quotes of each symbol (a bounded history is the feature)."""
    age = F.col("source_sequence") % 50 * 500_000 - 8_000_000
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("seq")))
    return price_events(spark, sf_dir).withColumn("nth", nth).filter("nth <= 240").select("symbol", "source_sequence", P.quote_freshness(age).alias("freshness"))


@query(
    sql(
        CASES,
        """SELECT k, CASE WHEN recon = 'SYNCHRONIZED' AND k % 4 = 0 THEN 'NOT_NEEDED' WHEN k % 5 = 0 THEN 'WAIT_FOR_SNAPSHOT' WHEN k % 4 > 0 THEN 'RESOLVE_EXECUTIONS' WHEN recon = 'UNKNOWN' THEN 'REFUSED_UNKNOWN' ELSE 'RECONCILE' END AS action FROM cases""",
    )
)
def recovery_actions(spark, sf_dir):
    c = cases(spark, sf_dir)
    return c.select("k", P.recovery_action(F.col("recon"), F.col("k") % 4, F.col("k") % 5 != 0).alias("action"))


@query(sql(NEWS, "SELECT sha256('at=' || at_us || '|currency=' || currency || '|id=' || id || '|impact=' || impact) AS event_key, at_us AS at, symbol FROM nw"))
def news_scan(spark, sf_dir):
    """Normalised items with an identity that their content gives."""
    return news(spark, sf_dir).select(F.sha2(G.canonical("id", "at", "impact", "currency"), 256).alias("event_key"), "at", "symbol")


@query(
    """SELECT id, account, posted AS at, coalesce(w, false) AS relevant, CAST(coalesce(w, false) AS BIGINT) AS score, CASE WHEN w AND s THEN 'account_match,symbol_match' WHEN w THEN 'account_match' WHEN s THEN 'symbol_match' ELSE 'no_watchlist_match' END AS reasons,
      sha256('account=' || account || '|at=' || posted || '|id=' || id) AS post_key
    FROM (SELECT event_id AS id, user_id AS account, epoch_us(ts) AS posted, event_type IN ('click', 'view') AS s, c.w FROM events LEFT JOIN (SELECT c_custkey, true AS w FROM customer WHERE c_acctbal > 5000) c ON c_custkey = user_id)
    WHERE posted >= (SELECT max(epoch_us(ts)) - 864000000000 FROM events)"""
)
def social_scan(spark, sf_dir):
    """Events as posts of the last ten days before the newest one, against a watch-list of customers with a high balance."""
    posts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("account"), micros(F.col("ts")).alias("at"), F.col("event_type").alias("symbol"))
    watched = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("account"))
    since = posts.agg((F.max("at") - 864_000_000_000).alias("since"))
    out = G.recent_posts(posts, watched, since, ["click", "view"])
    return out.select("id", "account", "at", "relevant", "score", "reasons", F.sha2(G.canonical("id", "account", "at"), 256).alias("post_key"))


@query("SELECT p_partkey, p_brand = 'Brand#1' AS exact, levenshtein(p_name, 'spring part') AS distance FROM part QUALIFY row_number() OVER (ORDER BY (p_brand = 'Brand#1') DESC, levenshtein(p_name, 'spring part'), p_partkey) <= 20")
def similar_symbols(spark, sf_dir):
    """The twenty candidates most like a name (a report's limit): exact ones first, then by edit distance."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_brand") == "Brand#1").alias("exact"), F.levenshtein("p_name", F.lit("spring part")).cast("long").alias("distance"))
    return p.orderBy(F.desc("exact"), "distance", "p_partkey").limit(20)
