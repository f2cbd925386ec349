"""One row for each rule that it alone breaks."""

from pyspark.sql import functions as F

from pricegrid.operators import contracts as K

NAN = float("nan")


def codes(spark, good, broken, schema, rules):
    rows = [(i, {**good, **change}) for i, (_, change) in enumerate(broken)]
    df = spark.createDataFrame(rows, f"i int, r struct<{schema}>").coalesce(1)
    got = {r.i: r.code for r in df.select("i", K.first_broken(rules(F.col("r"))).alias("code")).collect()}
    assert [got[i] for i in range(len(broken))] == [c for c, _ in broken]


def test_requests(spark):
    schema = "request_id:string,idempotency_key:string,intent_proposal_id:string,origin_ref:string,instrument_id:string,created_us:long,action:string,quantity:double,position_ref:string,new_position_ref:string,protected:boolean"
    good = dict(request_id="r", idempotency_key="i", intent_proposal_id="p", origin_ref="o", instrument_id="x", created_us=1, action="REDUCE", quantity=1.0, position_ref="q", new_position_ref=None, protected=None)
    opened = {"action": "OPEN", "position_ref": None}
    changed = {"action": "MODIFY_PROTECTION", "quantity": None, "protected": True}
    codes(spark, good, [
        (None, {}), (None, opened), (None, opened | {"new_position_ref": "n"}), (None, changed), (None, {"action": "CLOSE", "quantity": None}),
        *[(f"missing_{c}", {c: v}) for c, v in (("request_id", " "), ("idempotency_key", None), ("intent_proposal_id", ""), ("origin_ref", None), ("instrument_id", ""))],
        ("created_at_requires_timezone", {"created_us": None}), ("invalid_quantity", {"quantity": NAN}), ("blank_position_ref", {"position_ref": " "}), ("blank_new_position_ref", opened | {"new_position_ref": ""}),
        ("new_position_ref_only_allowed_for_open", {"new_position_ref": "n"}), ("open_must_not_reference_position", {"action": "OPEN"}), ("open_requires_positive_quantity", opened | {"quantity": 0.0}),
        ("reduce_requires_position_ref", {"position_ref": None}), ("reduce_requires_positive_quantity", {"quantity": None}), ("close_requires_position_ref", {"action": "CLOSE", "position_ref": None}),
        ("close_quantity_must_be_positive_or_absent", {"action": "CLOSE", "quantity": -1.0}), ("modify_protection_requires_position_ref", changed | {"position_ref": None}),
        ("modify_protection_must_not_carry_quantity", changed | {"quantity": 1.0}), ("modify_protection_requires_protection_payload", changed | {"protected": None}), ("unknown_execution_action", {"action": "SELL"}),
    ], schema, K.request_rules)


def test_results(spark):
    schema = "result_id:string,request_ref:string,observed_us:long,position_ref:string,action:string,status:string,requested:double,filled:double,remaining:double"
    good = dict(result_id="r", request_ref="q", observed_us=1, position_ref=None, action=None, status="FILLED", requested=2.0, filled=2.0, remaining=0.0)
    changed = {"action": "MODIFY_PROTECTION", "status": "ACCEPTED", "requested": None, "filled": 0.0, "remaining": None}
    codes(spark, good, [
        (None, {}), (None, changed), (None, {"status": "UNKNOWN", "remaining": None}), ("missing_execution_result_identity", {"request_ref": ""}), ("observed_at_requires_timezone", {"observed_us": None}),
        ("blank_position_ref", {"position_ref": ""}), ("invalid_filled_quantity", {"filled": NAN}), ("modify_protection_result_must_not_carry_quantity", changed | {"requested": 1.0}),
        ("modify_protection_result_must_have_zero_fill", changed | {"filled": 1.0}), ("modify_protection_result_must_not_carry_remaining", changed | {"remaining": 1.0}),
        ("modify_protection_result_status_invalid", changed | {"status": "FILLED"}), ("invalid_requested_quantity", {"requested": 0.0}), ("filled_quantity_exceeds_requested", {"filled": 3.0}),
        ("unknown_result_must_not_assert_remaining_quantity", {"status": "UNKNOWN"}), ("remaining_quantity_required_for_determinate_result", {"remaining": None}),
        ("remaining_quantity_inconsistent_with_fill", {"remaining": 1.0}), ("rejected_result_must_have_zero_fill", {"status": "REJECTED"}), ("filled_result_requires_zero_remaining", {"filled": 1.0, "remaining": 1.0}),
        ("partially_filled_requires_positive_fill_and_remaining", {"status": "PARTIALLY_FILLED"}), ("accepted_result_must_not_assert_fill_yet", {"status": "ACCEPTED"}),
    ], schema, K.result_rules)
    rows = [("REJECTED", 0.0), ("REJECTED", 1.0), ("UNKNOWN", 0.0), ("FILLED", 2.0), ("ACCEPTED", 0.0), (None, None)]
    df = spark.createDataFrame([({"status": s, "filled": f},) for s, f in rows], "r struct<status:string,filled:double>").coalesce(1)
    assert [x[0] for x in df.select(K.safe_to_retry(F.col("r"))).collect()] == [True, False, False, False, False, False]


def test_risk_inputs(spark):
    schema = ("proposal_id:string,account_id:string,status:string,side:string,symbol:string,price_symbol:string,decision_us:long,confirmation_us:long,occurrence_us:long,account_us:long,price_us:long,"
              "equity:double,balance:double,size:double,stop_distance:double,exposure:double,price:double")  # fmt: skip
    good = dict(proposal_id="p", account_id="a", status="active", side="long", symbol="s", price_symbol="s", decision_us=100, confirmation_us=90, occurrence_us=80, account_us=95, price_us=100,
                equity=1.0, balance=1.0, size=1.0, stop_distance=1.0, exposure=0.0, price=None)
    broken = [
        (None, {}), ("timezone_required", {"price_us": None}), ("missing_identity", {"proposal_id": ""}), ("account_mismatch", {"account_id": "b"}), ("invalid_signal", {"status": "expired"}), ("invalid_signal", {"confirmation_us": 101}),
        ("symbol_mismatch", {"price_symbol": "t"}), ("invalid_account_or_size", {"balance": NAN}), ("invalid_account_or_size", {"size": 0.0}), ("invalid_exposure", {"exposure": -1.0}), ("invalid_price", {"price": float("inf")}),
        ("stale_or_future_input", {"account_us": 101}), ("stale_or_future_input", {"price_us": 89}),
    ]
    codes(spark, good, broken, schema, lambda r: K.risk_input_rules(r, F.lit("a"), 10, F.lit("1970-01-01")))
    codes(spark, good, [("out_of_order_day", {})], schema, lambda r: K.risk_input_rules(r, F.lit(None).cast("string"), 10, F.lit("1970-01-02")))
    df = spark.createDataFrame([({**good, "symbol": "z", "price": -1.0},)], f"r struct<{schema}>")
    assert df.select(K.all_broken(K.risk_input_rules(F.col("r"), F.lit("a"), 10, F.lit(None).cast("string")))).first()[0] == ["symbol_mismatch", "invalid_price"]


def test_risk_reduction(spark):
    schema = "proposal_id:string,position_id:string,kind:string,origin_position_id:string,exposure:double"
    good = dict(proposal_id="p", position_id="x", kind="REDUCE", origin_position_id="x", exposure=0.0)
    codes(spark, good, [
        (None, {}), ("missing_risk_reduction_identity", {"position_id": " "}), ("risk_reduction_requires_risk_reducing_kind", {"kind": "OPEN"}), ("risk_reduction_requires_risk_reducing_kind", {"kind": None}),
        ("risk_reduction_requires_position_origin", {"origin_position_id": None}), ("risk_reduction_position_id_mismatch", {"origin_position_id": "y"}), ("invalid_current_exposure", {"exposure": NAN}), ("invalid_current_exposure", {"exposure": -1.0}),
    ], schema, K.reduction_proposal_rules)
    schema = "decision_id:string,proposal_id:string,position_id:string,action:string,allowed:boolean,reason_codes:array<string>,quantity:double,protection:double"
    good = dict(decision_id="d", proposal_id="p", position_id="x", action="CLOSE", allowed=True, reason_codes=[], quantity=0.0, protection=None)
    denied = dict(allowed=False, reason_codes=["limit"], quantity=None)
    codes(spark, good, [
        (None, {}), (None, denied), ("missing_risk_reduction_decision_identity", {"decision_id": None}), ("risk_reduction_decision_requires_risk_reducing_action", {"action": "OPEN"}),
        ("allowed_decision_must_have_no_reason_codes", {"reason_codes": ["limit"]}), ("denied_decision_requires_reason_codes", denied | {"reason_codes": None}), ("denied_decision_requires_reason_codes", denied | {"reason_codes": []}),
        ("allowed_reduce_or_close_requires_resulting_quantity", {"quantity": None}), ("allowed_modify_protection_requires_resulting_protection", {"action": "MODIFY_PROTECTION"}), (None, {"action": "MODIFY_PROTECTION", "protection": 1.0}),
        ("invalid_resulting_quantity", {"quantity": -1.0}), ("invalid_resulting_protection", {"action": "MODIFY_PROTECTION", "protection": 0.0}), ("denied_decision_must_not_carry_resulting_state", denied | {"protection": 1.0}),
    ], schema, K.reduction_decision_rules)


def test_references(spark):
    refs = {"exec:OPEN:1": None, "a" * 257: "too_long", "a" * 256: None, "": "charset_invalid", "a b": "charset_invalid", "a\n": "charset_invalid", "my-ToKen-1": "secret_like", None: "charset_invalid"}
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    got = df.select("r", K.first_broken(K.reference_rules(F.col("r"))).alias("c")).collect()
    assert {x.r: x.c for x in got} == refs
    given = {"sha256:" + "0f" * 32: True, "sha256:" + "0F" * 32: False, "sha256:" + "0f" * 31: False, "sha256:" + "0f" * 32 + "\n": False, " sha256:" + "0f" * 32: False, None: False}
    df = spark.createDataFrame([(r,) for r in given], "r string")
    assert {x.r: x.c for x in df.select("r", K.is_evidence(F.col("r")).alias("c")).collect()} == given
