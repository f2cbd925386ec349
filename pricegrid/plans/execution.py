"""Queries from an intent to its execution, over the orders tables: parts are instruments, nations brokers, line items intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scaled import micros
from ..operators import execution as E
from ..operators import gates as G
from ..sources.events import table
from .market import query
from .operations import FINDINGS, positions
from .spine_sql import sql

DAY = 86_400_000_000
AGE, LATE = 1_500 * DAY, 1_200 * DAY

# feeds: a supplier binds its parts at its nation's broker; some brokers, terminals and symbols are planted wrong by their keys

_FEEDS = r"""
brk AS (SELECT n_nationkey, n_name AS broker_id, r_name AS company FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 12 <> 7
        UNION ALL SELECT n_nationkey, n_name || ' 2', r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 12 = 5),
nb AS (SELECT n_nationkey, count(*) AS n, any_value(broker_id) AS broker_id, any_value(company) AS company FROM brk GROUP BY ALL),
bind AS (SELECT DISTINCT l_partkey, s_suppkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
bd AS (SELECT l_partkey, s_nationkey, count(*) AS n, any_value(s_suppkey) AS s FROM bind GROUP BY ALL),
req AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE WHEN l_linestatus = 'F' THEN s_nationkey ELSE c_nationkey END AS nk
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
said AS (SELECT req.*, p_size, p_brand, p_type, nb.broker_id, nb.company, bd.s, CASE
    WHEN nb.n IS NULL THEN 'broker_not_bound' WHEN nb.n > 1 THEN 'broker_ambiguous' WHEN nk % 11 = 3 THEN 'terminal_disconnected' WHEN nk % 13 = 4 THEN 'broker_identity_mismatch:company'
    WHEN bd.n IS NULL THEN 'broker_not_bound' WHEN bd.n > 1 THEN 'broker_ambiguous' WHEN p_partkey IS NULL THEN 'broker_not_bound'
    WHEN (req.l_partkey + s) % 17 = 0 THEN 'symbol_not_found' WHEN (req.l_partkey + s) % 19 = 0 THEN 'symbol_not_visible' WHEN (req.l_partkey + s) % 23 = 0 THEN 'instrument_metadata_mismatch:custom'
    WHEN (req.l_partkey + s) % 29 = 0 THEN 'instrument_metadata_mismatch:trade_contract_size' WHEN p_size % 2 = 0 AND (req.l_partkey + s) % 7 = 0 THEN 'instrument_metadata_mismatch:trade_tick_size' END AS m
  FROM req LEFT JOIN nb ON n_nationkey = nk LEFT JOIN bd ON bd.l_partkey = req.l_partkey AND s_nationkey = nk LEFT JOIN part ON p_partkey = req.l_partkey)"""


@query(
    sql(
        _FEEDS,
        """SELECT l_orderkey, l_linenumber, split_part(m, ':', 1) AS code, CASE WHEN m LIKE '%:%' THEN split_part(m, ':', 2) END AS detail,
        CASE WHEN m IS NULL THEN 'feed:' || sha256('broker_id=' || broker_id || '|company=' || company || '|currency_base=' || p_brand || '|currency_profit=' || p_type || '|digits=' || p_size % 5
          || '|instrument_id=' || l_partkey || '|symbol=S' || s || '.' || l_partkey || '|trade_contract_size=' || p_size || '|trade_tick_size=' || CASE WHEN p_size % 2 = 0 THEN 0 ELSE 5 END) END AS feed_id FROM said""",
    )
)
def feed_resolution(spark, sf_dir):
    """Every line item asks for its part at a broker: that of its supplier's nation if it is finished, else that of its customer's."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k, file = F.col("n_nationkey"), F.concat(F.lit("C:\\Terminals\\"), "n_name", F.lit("\\terminal64.exe"))
    brokers = nation.filter(k % 12 != 7).select(F.col("n_name").alias("broker_id"), file.alias("terminal_path"), F.col("r_name").alias("company"))
    twins = nation.filter(k % 12 == 5).select(F.concat("n_name", F.lit(" 2")).alias("broker_id"), F.upper(file).alias("terminal_path"), F.col("r_name").alias("company"))
    path = lambda name: F.concat(F.lit("c:/terminals//"), F.lower(name), F.lit("/TERMINAL64.exe"))
    terminals = nation.select(
        path(F.col("n_name")).alias("path"), (k % 11 != 3).alias("connected"), F.concat(F.lit("C:/TERMINALS/"), "n_name", F.lit("\\")).alias("seen_path"),
        F.when(k % 13 == 4, "another").otherwise(F.col("r_name")).alias("company"),
    )
    supplier, part = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem")
    names = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("broker_id"))
    pairs = lines.select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).distinct().join(supplier, "s_suppkey").join(names, "s_nationkey").join(part, F.col("p_partkey") == F.col("l_partkey"))
    symbol, tick = F.concat(F.lit("S"), "s_suppkey", F.lit("."), "l_partkey"), F.when(F.col("p_size") % 2 == 1, F.lit(5))
    bindings = pairs.select(F.col("l_partkey").alias("instrument_id"), "broker_id", symbol.alias("symbol"), (F.col("p_size") % 5).alias("digits"), tick.alias("trade_tick_size"))
    n = F.col("l_partkey") + F.col("s_suppkey")
    symbols = pairs.select(
        "broker_id", symbol.alias("symbol"), F.when(n % 17 != 0, symbol).alias("name"), (n % 19 != 0).alias("visible"), (n % 23 == 0).alias("custom"), F.col("p_brand").alias("currency_base"),
        F.col("p_type").alias("currency_profit"), (F.col("p_size") + F.when(n % 29 == 0, 1).otherwise(0)).alias("trade_contract_size"), (F.col("p_size") % 5).alias("digits"),
        F.when((F.col("p_size") % 2 == 0) & (n % 7 == 0), 1).otherwise(F.coalesce(tick, F.lit(0))).alias("trade_tick_size"),
    )
    instruments = part.select(F.col("p_partkey").alias("instrument_id"), F.col("p_brand").alias("currency_base"), F.col("p_type").alias("currency_profit"), F.col("p_size").alias("trade_contract_size"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    asked = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    asked = asked.withColumn("nk", F.when(F.col("l_linestatus") == "F", F.col("s_nationkey")).otherwise(F.col("c_nationkey"))).join(nation.select(F.col("n_nationkey").alias("nk"), "n_name"), "nk")
    asked = asked.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("instrument_id"), path(F.col("n_name")).alias("path"))
    return E.resolve_feeds(asked, brokers.unionByName(twins), terminals, bindings, instruments, symbols).select("l_orderkey", "l_linenumber", "code", "detail", "feed_id")


# intents: a line item's volume, its part's volume rules as its order saw them, the day of shipping as now

_INTENTS = f"""
it AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_shipdate, o_orderstatus, o_orderpriority, l_linestatus, CAST(round(l_discount * 100) AS INTEGER) AS d,
         CASE WHEN l_linenumber = 7 THEN 'MODIFY_PROTECTION' WHEN l_returnflag = 'N' THEN 'OPEN' WHEN l_returnflag = 'R' THEN 'REDUCE' ELSE 'CLOSE' END AS action,
         CASE WHEN l_tax > 0 THEN CAST(round(l_quantity * 100) AS BIGINT) END AS q, p_partkey AS known, CASE WHEN p_size % 2 = 0 THEN 100 ELSE 300 END AS anchor, CAST(p_size AS BIGINT) * 100 AS held,
         epoch_us(l_shipdate) - epoch_us(o_orderdate) AS age, l_extendedprice < 60000 AS allowed
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size < 50) ON p_partkey = l_partkey),
pf AS (SELECT *, [CASE WHEN known IS NULL THEN 'preflight_capabilities_missing' END, CASE WHEN known IS NOT NULL AND vol AND q IS NULL THEN 'preflight_quantity_missing' END,
    CASE WHEN known IS NOT NULL AND vol THEN CASE WHEN q < 300 THEN 'volume_below_min' WHEN q > 4000 THEN 'volume_above_max' WHEN (q - anchor) % 200 <> 0 THEN 'volume_not_multiple_of_step' END END,
    CASE WHEN known IS NOT NULL AND action = 'REDUCE' AND q IS NOT NULL AND NOT (q > 0 AND held - q > 0 AND held - q >= 300 AND (held - q - anchor) % 200 = 0) THEN 'preflight_reduce_residual_volume_invalid' END,
    CASE WHEN known IS NOT NULL AND age NOT BETWEEN 0 AND {AGE} THEN 'preflight_capabilities_stale' END, CASE WHEN action = 'MODIFY_PROTECTION' THEN 'preflight_stops_freeze_check_unavailable' END] AS facts
  FROM (SELECT *, action <> 'MODIFY_PROTECTION' AS vol FROM it))"""


def _intents(spark, sf_dir):
    """Intents with ``r``. What one table alone decides is worked out before tables meet, so that no rule repeats it."""
    long = lambda c: c.cast("long")
    action = F.when(F.col("l_linenumber") == 7, "MODIFY_PROTECTION").when(F.col("l_returnflag") == "N", "OPEN").when(F.col("l_returnflag") == "R", "REDUCE").otherwise("CLOSE")
    quantity = F.when(F.col("l_tax") > 0, long(F.round(F.col("l_quantity") * 100)))
    lines = table(spark, sf_dir, "lineitem").select("*", action.alias("action"), quantity.alias("quantity"), micros(F.col("l_shipdate")).alias("now_us"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", micros(F.col("o_orderdate")).alias("observed_us"))
    anchor, held = F.when(F.col("p_size") % 2 == 0, long(F.lit(100))), long(F.col("p_size")) * 100
    parts = table(spark, sf_dir, "part").filter("p_size < 50").select("p_partkey", anchor.alias("volume_anchor"), held.alias("position_quantity"))
    rows = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("p_partkey") == F.col("l_partkey"), "left")
    r = F.struct(
        "action", "quantity", F.col("l_partkey").alias("instrument_id"), F.col("p_partkey").alias("known_instrument"), long(F.lit(300)).alias("volume_min"), long(F.lit(4000)).alias("volume_max"),
        long(F.lit(200)).alias("volume_step"), "volume_anchor", "position_quantity", "now_us", "observed_us",
    )
    return rows.withColumn("r", r)


@query(
    sql(
        _INTENTS,
        "SELECT l_orderkey, l_linenumber, action, array_to_string(list_filter(list_append(facts, CASE WHEN action = 'OPEN' THEN 'preflight_policy_evaluation_unavailable' ELSE 'preflight_policy_undecided' END), lambda x: x IS NOT NULL), ',') AS reasons FROM pf",
    )
)
def preflight_decisions(spark, sf_dir):
    """Every reason against every intent; without a policy that has been decided none is allowed."""
    rules = E.preflight_rules(F.col("r"), AGE)
    return _intents(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("r.action").alias("action"), F.array_join(E.all_broken(rules), ",").alias("reasons"))


_CLAIMS = f""",
w AS (SELECT *, list_append(facts, CASE WHEN NOT allowed THEN CASE WHEN action = 'OPEN' THEN 'preflight_policy_evaluation_unavailable' ELSE 'preflight_policy_undecided' END END) AS checks FROM pf),
c AS (SELECT *, 'exec:' || action || ':' || l_partkey AS key, {{'s': l_shipdate, 'o': l_orderkey, 'n': l_linenumber}} AS place,
    CASE WHEN age > {LATE} THEN 'ABORTED_NEVER_ATTEMPTED' WHEN d = 10 THEN 'CLAIMED_NOT_ATTEMPTED' WHEN d IN (8, 9) THEN 'ATTEMPTED_NO_RESULT' WHEN l_linestatus = 'O' THEN 'RELEASED' ELSE 'RESULT_UNSAFE' END AS state,
    CASE WHEN o_orderstatus = 'P' THEN 1 WHEN action = 'OPEN' AND q IS NULL THEN 2 WHEN action = 'OPEN' AND o_orderpriority = '5-LOW' THEN 3 WHEN action = 'OPEN' AND l_suppkey % 43 = 0 THEN 4
         WHEN len(list_filter(checks, lambda x: x IS NOT NULL)) > 0 THEN 5 END AS own FROM w)"""


@query(
    sql(
        _INTENTS,
        _CLAIMS,
        f"""SELECT l_orderkey, l_linenumber, trace, status, codes, coalesce(status IN ('SUBMIT_RAISED', 'RESULT_PERSIST_FAILED'), false) AS pending FROM (
          SELECT *, CASE WHEN stop IS NOT NULL THEN array_to_string(['1', '2', '2b', '3', '4'][1:stop], ',') ELSE '1,2,2b,3,4,' || CASE WHEN status IN ('ABORTED', 'MARKER_FAILED') THEN '5,6' WHEN status = 'SUBMIT_RAISED' THEN '5,6,7' WHEN status = 'RESULT_PERSIST_FAILED' THEN '5,6,7,8' ELSE '5,6,7,8,9' END END AS trace
          FROM (
            SELECT *, CASE WHEN stop IS NOT NULL THEN 'DENIED' WHEN age > {LATE} THEN 'ABORTED' WHEN d = 10 THEN 'MARKER_FAILED' WHEN d = 9 THEN 'SUBMIT_RAISED' WHEN d = 8 THEN 'RESULT_PERSIST_FAILED' ELSE 'COMPLETED' END AS status,
              CASE WHEN own = 1 THEN 'reconciliation_not_synchronized' WHEN taken THEN CASE WHEN ends = 'RELEASED' THEN 'dedup_same_key_retry_not_supported' ELSE 'dedup_key_not_unclaimed:' || ends END
                WHEN own = 2 THEN 'quantity_payload_missing' WHEN own = 3 THEN 'authority_denied' WHEN own = 4 THEN 'kill_switch_armed' WHEN own = 5 THEN array_to_string(list_filter(checks, lambda x: x IS NOT NULL), ',')
                WHEN age > {LATE} THEN 'last_look_evidence_stale' WHEN d = 10 THEN 'attempt_marker_not_durable' WHEN d = 9 THEN 'adapter_submit_raised' WHEN d = 8 THEN 'result_persist_failed' ELSE '' END AS codes
            FROM (
              SELECT c.*, f.ends, place > f.earliest AS taken, CASE WHEN own = 1 OR place > f.earliest THEN 1 ELSE own END AS stop
              FROM c LEFT JOIN (SELECT key, min(place) AS earliest, arg_min(state, place) AS ends FROM c WHERE own IS NULL GROUP BY key) f ON f.key = c.key)))""",
    )
)
def execution_trace(spark, sf_dir):
    """The steps that every intent goes through and where it stops; an action on a part has one key, claimed once."""
    r, d = F.col("r"), F.round(F.col("l_discount") * 100).cast("int")
    opens = r["action"] == "OPEN"
    before = [
        ("1", [("reconciliation_not_synchronized", F.col("o_orderstatus") == "P")]), ("2", [("quantity_payload_missing", opens & r["quantity"].isNull())]),
        ("2b", [("authority_denied", opens & (F.col("o_orderpriority") == "5-LOW"))]), ("3", [("kill_switch_armed", opens & (F.col("l_suppkey") % 43 == 0))]),
        ("4", E.preflight_rules(r, AGE, F.col("l_extendedprice") < 60000)),
    ]
    rows = _intents(spark, sf_dir).withColumn("key", F.concat(F.lit("exec:"), r["action"], F.lit(":"), "l_partkey"))
    late = [("last_look_evidence_stale", r["now_us"] - r["observed_us"] > LATE)]
    out = E.execution_trace(rows, "key", ["l_shipdate", "l_orderkey", "l_linenumber"], before, late, d != 10, d != 9, d != 8, F.col("l_linestatus") == "O")
    return out.select("l_orderkey", "l_linenumber", "trace", "status", F.array_join("codes", ",").alias("codes"), "pending")


_PLANS = (
    FINDINGS
    + """,
ps AS (SELECT o_custkey AS run, 'L' || o_orderkey AS position_ref, CASE o_orderstatus WHEN 'O' THEN 'EMERGENCY' WHEN 'F' THEN 'CLOSED' ELSE 'MANAGING' END AS state FROM orders),
rr AS (SELECT o_custkey AS run, rec.* FROM rec JOIN orders ON o_orderkey = CAST(substr(position_ref, 2) AS BIGINT)),
mine AS (SELECT run, position_ref, count(DISTINCT finding) AS kinds, bool_and(finding IN ('MATCH', 'CLOSE_PENDING_CONFIRMED', 'BROKER_FLAT_CONFIRMED')) AS clear, min(finding) AS finding, count(*) FILTER (status <> 'SYNCHRONIZED') AS bad FROM rr GROUP BY ALL),
allr AS (SELECT run, sum(bad) AS bad FROM mine GROUP BY ALL),
tg AS (SELECT ps.*, CASE WHEN state = 'EMERGENCY' AND run % 10 <> 9 AND clear AND kinds = 1 AND allr.bad = mine.bad THEN CASE finding WHEN 'MATCH' THEN CASE WHEN quantity > 0 THEN 'MANAGING' END WHEN 'CLOSE_PENDING_CONFIRMED' THEN 'EXIT_PENDING' ELSE 'CLOSED' END END AS target
       FROM ps JOIN loc ON position_id = position_ref LEFT JOIN mine USING (run, position_ref) LEFT JOIN allr USING (run))"""
)


@query(
    sql(
        _PLANS,
        "SELECT run, position_ref, target, CASE WHEN target IS NULL THEN 'REFUSED' ELSE 'DENIED' END AS outcome, CASE WHEN state <> 'EMERGENCY' THEN 'position_not_emergency' WHEN target IS NULL THEN 'evidence_not_verified' ELSE 'recovery_authorization_not_resolved' END AS reason FROM tg",
    )
)
def recovery_plans(spark, sf_dir):
    """A customer's reconciliation is a run; its open orders are positions in emergency."""
    local, broker = positions(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "EMERGENCY").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("MANAGING")
    held = local.select(F.col("position_id").alias("position_ref"), "quantity")
    at = orders.select(F.concat(F.lit("L"), "o_orderkey").alias("position_ref"), F.col("o_custkey").alias("run"), state.alias("state")).join(held, "position_ref")
    owner = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("run"))
    records = G.reconcile(local, broker).withColumn("k", F.substring("position_ref", 2, 20).cast("long")).join(owner, "k").join(held, "position_ref", "left")
    records = records.select(
        "run", "position_ref", "finding", "status", F.lit(0).cast("long").alias("observed_us"), F.col("quantity").alias("local_quantity"), F.when(F.col("finding") == "MATCH", F.col("quantity")).alias("broker_quantity"),
        (F.col("run") % 10 != 9).alias("complete"),
    )
    return E.recovery_plans(at, records)
