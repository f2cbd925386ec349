"""Queries of trades and positions: requests about a part, and execution results, in the order of shipping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import automata as A
from ..operators import contracts as K
from ..sources.events import table
from .market import query

ORDER = "l_shipdate, l_orderkey, l_linenumber"
_STATES = "[" + ", ".join(f"'{s}'" for s in A.STATES) + "]"
_EDGES = ", ".join(f"'{a}->{b}'" for a, bs in A.EDGES.items() for b in bs)


def requests(spark, sf_dir):
    """Every line item asks for the state that its discount (0 to 10 per cent) names; a part's requests are one trade."""
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")) - 1
    wanted = F.get(F.array(*map(F.lit, A.STATES)), F.round(F.col("l_discount") * 100).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_partkey", place.alias("place"), wanted.alias("requested"))


@query(
    f"""WITH RECURSIVE r AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER}) - 1 AS place, {_STATES}[CAST(round(l_discount * 100) AS INTEGER) + 1] AS requested FROM lineitem),
    w AS (
      SELECT l_partkey, CAST(-1 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS requested, CAST(NULL AS VARCHAR) AS before, 'SETUP' AS after, true AS accepted FROM r WHERE place = 0
      UNION ALL
      SELECT l_partkey, place, requested, before, CASE WHEN ok THEN requested ELSE before END, ok
      FROM (SELECT r.*, w.after AS before, coalesce(r.requested = w.after OR w.after || '->' || r.requested IN ({_EDGES}), false) AS ok FROM w JOIN r ON r.l_partkey = w.l_partkey AND r.place = w.place + 1))
    SELECT l_partkey, place, requested, before, after, accepted FROM w WHERE place >= 0"""
)
def trade_states(spark, sf_dir):
    """Every request, the state that it met and the state that it left."""
    return A.run_automaton(requests(spark, sf_dir), ["l_partkey"], "place", "requested")


_ACTION = {"R": "REDUCE", "A": "MODIFY_PROTECTION", "N": "CLOSE"}


@query(
    f"""WITH RECURSIVE r AS (
      SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER}) - 1 AS place, CAST(p_size AS BIGINT) AS opening, l_returnflag AS a, l_linestatus = 'F' AS filled, CAST(l_quantity AS BIGINT) AS q
      FROM lineitem JOIN part ON p_partkey = l_partkey),
    w AS (
      SELECT l_partkey, CAST(-1 AS BIGINT) AS place, '' AS outcome, 'OPEN' AS state, opening AS quantity FROM r WHERE place = 0
      UNION ALL
      SELECT l_partkey, place, outcome, CASE WHEN outcome <> 'applied' THEN state WHEN a = 'N' THEN 'CLOSED' ELSE 'MANAGING' END, CASE WHEN outcome <> 'applied' THEN quantity WHEN a = 'N' THEN 0 ELSE quantity - q END
      FROM (SELECT r.*, w.state, w.quantity, CASE WHEN w.state = 'CLOSED' THEN 'position_not_open_or_managing' WHEN a = 'A' OR NOT filled THEN 'unchanged'
              WHEN a = 'N' THEN CASE WHEN q = w.quantity THEN 'applied' ELSE 'close_fill_quantity_mismatch' END WHEN q >= w.quantity OR q <= 0 THEN 'reduce_fill_quantity_invalid' ELSE 'applied' END AS outcome
            FROM w JOIN r ON r.l_partkey = w.l_partkey AND r.place = w.place + 1))
    SELECT l_partkey, place, outcome, state, quantity FROM w WHERE place >= 0"""
)
def position_results(spark, sf_dir):
    """A position of each part's size, and what every execution result leaves of it."""
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")) - 1
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("opening"))
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    action = F.create_map(*[F.lit(v) for kv in _ACTION.items() for v in kv])[F.col("l_returnflag")]
    q = F.col("l_quantity").cast("long")
    rows = lines.select(
        "l_partkey", place.alias("place"), "opening", action.alias("action"), F.when(F.col("l_linestatus") == "F", "FILLED").otherwise("REJECTED").alias("status"),
        q.alias("requested"), F.when(F.col("l_linestatus") == "F", q).otherwise(0).alias("filled"), F.lit(None).cast("string").alias("code"),
    )
    return A.apply_results(rows, ["l_partkey"], "place")


@query(
    """WITH r AS (
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_returnflag = 'A' AS changes, l_quantity AS q, CASE WHEN l_linestatus = 'F' THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS status,
        round(l_quantity * round(l_discount * 100) / 10) AS filled, CASE WHEN l_tax > 0 THEN l_quantity - round(l_quantity * round(l_discount * 100) / 10) END AS remaining FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN changes THEN 'modify_protection_result_must_not_carry_quantity' WHEN q <= 0 THEN 'invalid_requested_quantity' WHEN filled > q THEN 'filled_quantity_exceeds_requested'
      WHEN remaining IS NULL THEN 'remaining_quantity_required_for_determinate_result' WHEN status = 'FILLED' AND remaining <> 0 THEN 'filled_result_requires_zero_remaining'
      WHEN status = 'PARTIALLY_FILLED' AND (filled <= 0 OR remaining <= 0) THEN 'partially_filled_requires_positive_fill_and_remaining' END AS code FROM r"""
)
def result_contracts(spark, sf_dir):
    """Every line item as an execution result, of which its discount says how much was filled; the first rule that it breaks."""
    q = F.col("l_quantity")
    filled = F.round(q * F.round(F.col("l_discount") * 100) / 10)
    action = F.create_map(*[F.lit(v) for kv in _ACTION.items() for v in kv])[F.col("l_returnflag")]
    r = F.struct(
        F.col("l_orderkey").cast("string").alias("result_id"), F.col("l_linenumber").cast("string").alias("request_ref"), F.lit(0).cast("long").alias("observed_us"), F.lit(None).cast("string").alias("position_ref"),
        action.alias("action"), F.when(F.col("l_linestatus") == "F", "FILLED").otherwise("PARTIALLY_FILLED").alias("status"), q.alias("requested"), filled.alias("filled"), F.when(F.col("l_tax") > 0, q - filled).alias("remaining"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", K.first_broken(K.result_rules(F.col("r"))).alias("code"))


@query(
    """WITH r AS (
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE l_returnflag WHEN 'R' THEN 'REDUCE' WHEN 'A' THEN 'MODIFY_PROTECTION' ELSE 'CLOSE' END AS action, l_linestatus = 'F' AS allowed, l_tax >= 0.07 AS told,
        CASE WHEN l_discount > 0.01 THEN CAST(p_size AS BIGINT) - l_quantity END AS q, CASE WHEN l_returnflag = 'A' AND l_discount > 0.01 THEN p_retailprice - 1000 END AS stop FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey, l_linenumber, CASE WHEN allowed AND told THEN 'allowed_decision_must_have_no_reason_codes' WHEN NOT allowed AND NOT told THEN 'denied_decision_requires_reason_codes'
      WHEN allowed AND action IN ('REDUCE', 'CLOSE') AND q IS NULL THEN 'allowed_reduce_or_close_requires_resulting_quantity' WHEN allowed AND action = 'MODIFY_PROTECTION' AND stop IS NULL THEN 'allowed_modify_protection_requires_resulting_protection'
      WHEN allowed AND q < 0 THEN 'invalid_resulting_quantity' WHEN allowed AND stop <= 0 THEN 'invalid_resulting_protection' WHEN NOT allowed AND (q IS NOT NULL OR stop IS NOT NULL) THEN 'denied_decision_must_not_carry_resulting_state' END AS code FROM r"""
)
def reduction_contracts(spark, sf_dir):
    """Every line item as a decision to reduce a position of its part's size; the first rule that it breaks."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"), "left")
    action = F.when(F.col("l_returnflag") == "R", "REDUCE").when(F.col("l_returnflag") == "A", "MODIFY_PROTECTION").otherwise("CLOSE")
    given = F.col("l_discount") > 0.01
    d = F.struct(
        F.col("l_orderkey").cast("string").alias("decision_id"), F.col("l_linenumber").cast("string").alias("proposal_id"), F.col("l_partkey").cast("string").alias("position_id"), action.alias("action"),
        (F.col("l_linestatus") == "F").alias("allowed"), F.when(F.col("l_tax") >= 0.07, F.array(F.lit("limit"))).alias("reason_codes"), F.when(given, F.col("p_size") - F.col("l_quantity")).alias("quantity"),
        F.when(given & (action == "MODIFY_PROTECTION"), F.col("p_retailprice") - 1000).alias("protection"),
    )
    return lines.select("l_orderkey", "l_linenumber", K.first_broken(K.reduction_decision_rules(d)).alias("code"))


@query(
    """SELECT event_id, CASE WHEN length(ref) > 256 THEN 'too_long' WHEN NOT regexp_full_match(ref, '[A-Za-z0-9._:/#|+-]+') THEN 'charset_invalid' WHEN contains(lower(ref), 'purchase') OR contains(lower(ref), 'login') THEN 'secret_like' END AS code
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'feed:' || event_type || ':sequence:' || event_id WHEN event_id % 3 = 1 THEN repeat(event_type || '/', CAST(event_id % 60 AS INTEGER)) ELSE props END AS ref FROM events)"""
)
def opaque_references(spark, sf_dir):
    """References of events (names, long paths, free text) and why they can't be opaque; two event types stand for words that tell a secret."""
    k, kind = F.col("event_id"), F.col("event_type")
    ref = F.when(k % 3 == 0, F.concat(F.lit("feed:"), kind, F.lit(":sequence:"), k)).when(k % 3 == 1, F.expr("repeat(concat(event_type, '/'), cast(event_id % 60 as int))")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", K.first_broken(K.reference_rules(ref, ("purchase", "login"))).alias("code"))
