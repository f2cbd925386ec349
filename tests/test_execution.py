"""Execution by hand-made cases, plain replays and odd rows."""

import random

from pyspark.sql import functions as F

from pricegrid.operators import execution as E

WIN = r"C:\T\Acme\terminal64.exe"


def resolve(spark, requests, brokers=None, terminals=None, bindings=None, symbols=None):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return E.resolve_feeds(
        frame(requests, "k int, instrument_id string, path string"),
        frame([("acme", WIN, "Acme")] if brokers is None else brokers, "broker_id string, terminal_path string, company string"),
        frame([("c:/t//ACME/terminal64.exe", True, "c:/t/acme/", "Acme")] if terminals is None else terminals, "path string, connected boolean, seen_path string, company string"),
        frame([("i", "acme", "EURUSD", 5, None)] if bindings is None else bindings, "instrument_id string, broker_id string, symbol string, digits int, trade_tick_size int"),
        frame([("i", "EUR", "USD", 100)], "instrument_id string, currency_base string, currency_profit string, trade_contract_size int"),
        frame([("acme", "EURUSD", "EURUSD", True, False, "EUR", "USD", 100, 5, 0)] if symbols is None else symbols,
              "broker_id string, symbol string, name string, visible boolean, custom boolean, currency_base string, currency_profit string, trade_contract_size int, digits int, trade_tick_size int"),
    )


PATH = "c:/t//ACME/terminal64.exe"


def codes(df):
    return {r.k: (r.code, r.detail) for r in df.collect()}


def test_feed_resolved_by_equality_alone(spark):
    rows = resolve(spark, [(1, "i", PATH), (2, "j", PATH), (3, "i", "c:/elsewhere.exe"), (4, None, PATH), (5, " ", PATH), (6, "i", PATH)]).collect()
    by = {r.k: r for r in rows}
    assert len(rows) == 6 and by[1].code is None and by[1].feed_id == by[6].feed_id and by[1].feed_id.startswith("feed:")
    assert [by[k].code for k in (2, 3, 4, 5)] == ["broker_not_bound", "broker_not_bound", "not_configured", "not_configured"]


def test_paths_are_made_alike_once_each_not_for_every_pair(spark):
    rows = resolve(spark, [(1, "i", PATH), (2, "j", PATH), (3, "i", " "), (4, " ", "c:/elsewhere.exe"), (5, "i", None)])
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("regexp_replace" in at for at in plan) and not [at for at in plan if "regexp_replace" in at and "instrument_id" in at]
    assert codes(rows) == {1: (None, None), 2: ("broker_not_bound", None), 3: ("not_configured", None), 4: ("not_configured", None), 5: ("not_configured", None)}


def test_feed_refused(spark):
    one = [(1, "i", PATH)]
    said = lambda **kw: codes(resolve(spark, one, **kw))[1]
    good = ("acme", "EURUSD", "EURUSD", True, False, "EUR", "USD", 100, 5, 0)
    place = "broker_id symbol name visible custom currency_base currency_profit trade_contract_size digits trade_tick_size".split()
    seen = lambda **kw: said(symbols=[tuple(kw.get(n, v) for n, v in zip(place, good, strict=True))])
    assert said(brokers=[("acme", WIN, "Acme"), ("acme 2", WIN.lower(), "Acme")]) == ("broker_ambiguous", None)
    assert said(terminals=[]) == ("terminal_disconnected", None)
    assert said(terminals=[(PATH, True, r"c:\t\other", "Acme")]) == ("broker_identity_mismatch", "terminal_path")
    assert said(terminals=[(PATH, True, r"c:\t\acme", None)]) == ("broker_identity_mismatch", "company")
    assert said(bindings=[("i", "acme", "A", 5, None), ("i", "acme", "B", 5, None)]) == ("broker_ambiguous", None)
    assert said(symbols=[]) == seen(name="EURUSDm") == ("symbol_not_found", None) and seen(visible=None) == ("symbol_not_visible", None)
    for column in E.METADATA:
        assert seen(**{column: None}) == ("instrument_metadata_mismatch", column)
    assert seen(custom=None) == ("instrument_metadata_mismatch", "custom")


def test_empty_feeds(spark):
    assert resolve(spark, []).collect() == [] and codes(resolve(spark, [(1, "i", PATH)], brokers=[], bindings=[], symbols=[])) == {1: ("broker_not_bound", None)}


FIELDS = "action string, quantity long, instrument_id string, known_instrument string, volume_min long, volume_max long, volume_step long, volume_anchor long, position_quantity long, now_us long, observed_us long"
GOOD = dict(action="REDUCE", quantity=300, instrument_id="i", known_instrument="i", volume_min=100, volume_max=1000, volume_step=100, volume_anchor=None, position_quantity=500, now_us=10, observed_us=5)


def reasons(spark, bound=100, allowed=None, **kw):
    df = spark.createDataFrame([tuple((GOOD | kw).values())], FIELDS)
    r = F.struct(*df.columns)
    policy = None if allowed is None else F.lit(allowed)
    return df.select(E.all_broken(E.preflight_rules(r, bound, policy)).alias("c")).first().c


def test_preflight(spark):
    assert reasons(spark) == ["preflight_policy_undecided"] and reasons(spark, allowed=True) == []
    assert reasons(spark, action="OPEN") == ["preflight_policy_evaluation_unavailable"]
    say = lambda **kw: reasons(spark, allowed=True, **kw)
    assert say(known_instrument=None, now_us=None) == ["preflight_clock_requires_timezone", "preflight_capabilities_missing"]
    assert say(known_instrument="j") == ["preflight_instrument_mismatch"] and say(quantity=None) == ["preflight_quantity_missing"]
    assert say(action="CLOSE", quantity=50) == ["volume_below_min"] and say(action="CLOSE", quantity=1100) == ["volume_above_max"]
    assert say(action="CLOSE", quantity=350) == ["volume_not_multiple_of_step"] and say(action="CLOSE", quantity=350, volume_anchor=50) == []
    for kw in (dict(position_quantity=None), dict(position_quantity=300), dict(position_quantity=350), dict(position_quantity=550), dict(position_quantity=200)):
        assert say(**kw) == ["preflight_reduce_residual_volume_invalid"]
    assert say(now_us=None, observed_us=None) == ["preflight_clock_requires_timezone"]
    assert say(bound=None) == say(bound=-1) == ["preflight_capabilities_freshness_bound_missing"]
    assert say(now_us=4) == say(now_us=106) == ["preflight_capabilities_stale"]
    assert say(action="MODIFY_PROTECTION", quantity=None) == ["preflight_stops_freeze_check_unavailable"]


def replay(intents):
    """One after the other, with a store of keys."""
    store, out = {}, {}
    for k, key, n, one, two, late, marked, sent, kept, clean in sorted(intents, key=lambda r: r[2]):
        if one:
            out[k] = ("1", "DENIED", ["one"])
        elif key is None:
            out[k] = ("1", "DENIED", ["missing_idempotency_key"])
        elif key in store:
            out[k] = ("1", "DENIED", ["dedup_same_key_retry_not_supported" if store[key] == "RELEASED" else f"dedup_key_not_unclaimed:{store[key]}"])
        elif two:
            out[k] = ("1,2", "DENIED", ["two"])
        elif late:
            store[key], out[k] = "ABORTED_NEVER_ATTEMPTED", ("1,2,5,6", "ABORTED", ["late"])
        elif not marked:
            store[key], out[k] = "CLAIMED_NOT_ATTEMPTED", ("1,2,5,6", "MARKER_FAILED", ["attempt_marker_not_durable"])
        elif not sent:
            store[key], out[k] = "ATTEMPTED_NO_RESULT", ("1,2,5,6,7", "SUBMIT_RAISED", ["adapter_submit_raised"])
        elif not kept:
            store[key], out[k] = "ATTEMPTED_NO_RESULT", ("1,2,5,6,7,8", "RESULT_PERSIST_FAILED", ["result_persist_failed"])
        else:
            store[key], out[k] = "RELEASED" if clean else "RESULT_UNSAFE", ("1,2,5,6,7,8,9", "COMPLETED", [])
    return out


def test_trace_equals_a_replay(spark):
    rng = random.Random(5)
    coin = lambda p: None if rng.random() < 0.05 else rng.random() < p
    rows = [(k, rng.choice([None, "hot", "hot", *map(str, range(150))]), n, coin(0.1), coin(0.4), coin(0.2), coin(0.8), coin(0.8), coin(0.8), coin(0.5)) for k, n in enumerate(rng.sample(range(9999), 600))]
    schema = "k int, key string, n int, one boolean, two boolean, late boolean, marked boolean, sent boolean, kept boolean, clean boolean"
    c = F.col
    run = lambda rs: E.execution_trace(
        spark.createDataFrame(rs, schema), "key", ["n"], [("1", [("one", c("one"))]), ("2", [("two", c("two"))])], [("late", c("late"))], c("marked"), c("sent"), c("kept"), c("clean")
    )
    got = {r.k: (r.trace, r.status, r.codes) for r in run(rows).collect()}
    assert got == replay(rows) and len({v[1] for v in got.values()}) == 6
    assert run([]).collect() == []


def test_rules_of_a_trace_stay_in_generated_code_and_may_be_many(spark):
    many = [(f"r{i}", F.col("k") % 70 == i) for i in range(66)] + [("r3", F.col("k") == 3)]
    rows = spark.range(70).select(F.col("id").alias("k"), F.lit("x").alias("key"))
    yes = F.lit(True)
    out = E.execution_trace(rows, "key", ["k"], [("1", []), ("2", many)], [("late", F.col("k") == 69), ("late too", F.col("k") >= 66)], yes, yes, yes, yes)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.trace, r.status, r.codes) for r in out.collect()}
    assert all(got[k] == ("1,2", "DENIED", [f"r{k}"]) for k in range(66)) and got[66] == ("1,2,5,6", "ABORTED", ["late too"])
    assert all(got[k] == ("1", "DENIED", ["dedup_key_not_unclaimed:ABORTED_NEVER_ATTEMPTED"]) for k in (67, 68, 69))


def plans(spark, cases):
    """Every case (records, state, quantity) as a run of its own."""
    held = spark.createDataFrame([(i, "p", state, quantity) for i, (_, state, quantity) in enumerate(cases)], "run int, position_ref string, state string, quantity long")
    recs = spark.createDataFrame(
        [(i, *r) for i, (records, _, _) in enumerate(cases) for r in records],
        "run int, position_ref string, finding string, status string, observed_us long, local_quantity long, broker_quantity long, complete boolean",
    )
    return [(r.target, r.outcome, r.reason) for r in E.recovery_plans(held, recs).orderBy("run").collect()]


def test_recovery_plans(spark):
    match = ("p", "MATCH", "SYNCHRONIZED", 1, 5, 5, True)
    other = ("q", "MATCH", "SYNCHRONIZED", 1, 9, 9, True)
    refused = lambda why: (None, "REFUSED", why)
    denied = lambda to: (to, "DENIED", "recovery_authorization_not_resolved")
    case = lambda records, want, state="EMERGENCY", quantity=5: ((records, state, quantity), want)
    closed, stale, unsure = refused("position_not_emergency"), refused("evidence_stale_vs_position"), refused("evidence_not_verified")
    cases = [
        case([match, other], denied("MANAGING")),
        case([("p", "CLOSE_PENDING_CONFIRMED", "UNKNOWN", 1, 5, None, True), other], denied("EXIT_PENDING")),
        case([("p", "BROKER_FLAT_CONFIRMED", "UNSYNCHRONIZED", 1, None, None, True)], denied("CLOSED")),
        case([match], closed, state="OPEN"), case([match], closed, state=None), case([match], stale, quantity=6), case([match, other[:3] + (2,) + other[4:]], stale),
        case([], unsure), case([other], unsure), case([match[:6] + (False,)], unsure), case([match[:6] + (None,)], unsure),
        case([match, ("p", "QUANTITY_MISMATCH", "UNSYNCHRONIZED", 1, 5, 6, True)], unsure), case([match, ("p", "CLOSE_PENDING_CONFIRMED", "UNKNOWN", 1, 5, None, True)], unsure),
        case([match, ("q", "MATCH", "UNKNOWN", 1, 9, 9, True)], unsure), case([("p", "MATCH", "SYNCHRONIZED", 1, 5, 4, True)], unsure),
        case([("p", "MATCH", "SYNCHRONIZED", 1, 0, 0, True)], unsure, quantity=0),
    ]
    assert plans(spark, [c for c, _ in cases]) == [want for _, want in cases]
    assert plans(spark, []) == []
