"""Trades and positions against plain loops: long keys in many levels of segments, every state, every refusal."""

import random

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import automata as A
from pricegrid.plans.catalog import QUERIES


def replay(asked, state="SETUP"):
    out = []
    for r in asked:
        ok = r in A.STATES and (r == state or r in A.EDGES.get(state, ()))
        out.append((state, r if ok else state, ok))
        state = out[-1][1]
    return out


@pytest.mark.parametrize("segment", [2, 5, 64])
def test_long_keys_fold_in_segments(spark, segment):
    rng = random.Random(segment)
    ring = {"A": ("B",), "B": ("C",), "C": ("A", "D"), "D": ("A",)}  # never final, so every request may count
    asked = {"hot": [rng.choice("ABCDx") for _ in range(700)], "one": ["B"], None: [None, "B", "C", "D"]}
    rows = [(k, i, r) for k, v in asked.items() for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, place long, requested string").repartition(4)
    got = {(r.k, r.place): (r.before, r.after, r.accepted) for r in A.run_automaton(df, ["k"], "place", "requested", ("A", "B", "C", "D"), ring, "A", segment).collect()}
    want = {}
    for k, v in asked.items():
        state = "A"
        for i, r in enumerate(v):
            ok = r == state or r in ring[state]
            want[k, i] = (state, r if ok else state, ok)
            state = want[k, i][1]
    assert got == want


def test_every_state_is_reached(spark):
    rng = random.Random(1)
    asked = {k: [rng.choice([*A.STATES, "?"]) for _ in range(40)] for k in range(300)}
    df = spark.createDataFrame([(k, i, r) for k, v in asked.items() for i, r in enumerate(v)], "k long, place long, requested string")
    got = {(r.k, r.place): (r.before, r.after, r.accepted) for r in A.run_automaton(df, ["k"], "place", "requested").collect()}
    assert got == {(k, i): x for k, v in asked.items() for i, x in enumerate(replay(v))}
    assert {x[1] for x in got.values()} == set(A.STATES)
    assert A.run_automaton(df.limit(0), ["k"], "place", "requested").count() == 0


def test_states_of_the_query(spark):
    out = QUERIES["trade_states"](spark, "/root/testdata/sf0.01")
    assert {r.after for r in out.select("after").distinct().collect()} == set(A.STATES)


def test_results_of_a_position(spark):
    steps = [  # action, status, requested, filled, code -> outcome, state, quantity
        (("REDUCE", "FILLED", 3, 3, None), ("applied", "MANAGING", 7)), (("REDUCE", "REJECTED", 3, 0, None), ("unchanged", "MANAGING", 7)), (("MODIFY_PROTECTION", "FILLED", 0, 0, None), ("unchanged", "MANAGING", 7)),
        (("REDUCE", "FILLED", 7, 7, None), ("reduce_fill_quantity_invalid", "MANAGING", 7)), (("REDUCE", "FILLED", 0, None, None), ("reduce_fill_quantity_invalid", "MANAGING", 7)),
        (("CLOSE", "FILLED", 6, 6, None), ("close_fill_quantity_mismatch", "MANAGING", 7)), (("CLOSE", "FILLED", 7, 6, None), ("close_fill_quantity_mismatch", "MANAGING", 7)),
        (("REDUCE", "FILLED", 1, 1, "request_side_mismatch"), ("request_side_mismatch", "MANAGING", 7)), (("CLOSE", "FILLED", 7, 7, None), ("applied", "CLOSED", 0)),
        (("REDUCE", "FILLED", 1, 1, None), ("position_not_open_or_managing", "CLOSED", 0)),
    ]
    schema = "p string, n long, opening long, action string, status string, requested long, filled long, code string"
    df = spark.createDataFrame([("x", i, 10, *s) for i, (s, _) in enumerate(steps)] + [(None, 0, 5, "CLOSE", "FILLED", 5, 5, None)], schema)
    got = {(r.p, r.n): (r.outcome, r.state, r.quantity) for r in A.apply_results(df, ["p"], "n").collect()}
    assert got == {("x", i): w for i, (_, w) in enumerate(steps)} | {(None, 0): ("applied", "CLOSED", 0)}


def test_why_a_result_is_refused(spark):
    ok = {"position": {"position_id": "p", "side": "long"}, "request": {"request_id": "q", "action": "REDUCE", "position_ref": "p", "side": "long", "quantity": 2},
          "result": {"action": "REDUCE", "request_ref": "q", "position_ref": "p", "requested": 2}}
    broken = {
        "result_action_required": ("result", "action", None), "open_result_not_applicable": ("request", "action", "OPEN"), "result_action_mismatch": ("result", "action", "CLOSE"),
        "result_request_mismatch": ("result", "request_ref", "z"), "request_position_mismatch": ("request", "position_ref", "z"), "result_position_mismatch": ("result", "position_ref", "z"),
        "request_side_mismatch": ("request", "side", "short"), "result_requested_quantity_mismatch": ("result", "requested", 3),
    }
    schema = ("position struct<position_id:string,side:string>, request struct<request_id:string,action:string,position_ref:string,side:string,quantity:long>, "
              "result struct<action:string,request_ref:string,position_ref:string,requested:long>")  # fmt: skip
    rows = [ok] + [{**ok, part: {**ok[part], field: value}} for part, field, value in broken.values()]
    rows.append({**ok, "result": {**ok["result"], "position_ref": None}, "request": {**ok["request"], "quantity": None}})
    got = [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(A.result_code()).collect()]
    assert got == [None, *broken, None]
    opening = spark.createDataFrame([(1, [2], 3), (None, [2], 3), (1, [], 3), (1, None, 3), (1, [2], 0)], "s long, t array<long>, q long").coalesce(1)
    assert [r[0] for r in opening.select(A.opening_code(F.col("s"), F.col("t"), F.col("q"))).collect()] == [
        None, "signal_decision_missing_invalidation_price", "signal_decision_missing_targets", "signal_decision_missing_targets", "invalid_opening_quantity"]
