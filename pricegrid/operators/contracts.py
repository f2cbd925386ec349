"""What requests, results and risk proposals must fulfil before anything is done with them, each rule with its code.

A rule is a code and the condition that breaks it; the first broken rule of a row is told, and rules are expressions over the row alone.
Quantities and prices are doubles here, so that what isn't finite can be told; times are microseconds, and null where no zone was given.

Defined results: null conditions don't break a rule unless the rule is about absence; a row that breaks none has a null code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, Column]]


def first_broken(rules: Rules) -> Column:
    out = F.lit(None).cast("string")
    if rules:
        out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for code, broken in rules[1:]:
        out = out.when(F.coalesce(broken, F.lit(False)), code)
    return out


def all_broken(rules: Rules) -> Column:
    """Every broken rule's code, in the order of the rules, once each. No function over elements is in it, so the rules stay in generated code."""
    return F.array_except(F.array(*[F.when(F.coalesce(b, F.lit(False)), c) for c, b in rules]).cast("array<string>"), F.array(F.lit(None).cast("string")))


BITS = 62


def broken_bits(rules: Rules) -> list[Column]:
    """Which rules are broken, a bit each, in whole numbers of ``BITS`` rules: evaluated once, and small to shuffle."""
    out = []
    for k in range(0, len(rules), BITS):
        one = F.lit(0).cast("long")
        for i, (_, b) in enumerate(rules[k : k + BITS]):
            one = one + F.when(F.coalesce(b, F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        out.append(one)
    return out


def by_bits(rules: Rules, bits: list[Column]) -> Rules:
    """``rules`` told by what ``broken_bits`` said about them."""
    return [(c, bits[k // BITS].bitwiseAND(F.lit(1 << k % BITS).cast("long")) != 0) for k, (c, _) in enumerate(rules)]


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def endless(c: Column) -> Column:
    """Not a finite number."""
    return F.isnan(c) | (F.abs(c) == float("inf"))


def request_rules(r: Column) -> Rules:
    """``r``: struct of request_id, idempotency_key, intent_proposal_id, origin_ref, instrument_id, created_us, action, quantity, position_ref,
    new_position_ref, protected (whether there is a protection)."""
    action, q = r["action"], r["quantity"]
    given = lambda c: c.isNotNull() & (F.trim(c) == "")
    none_or_less = q.isNull() | (q <= 0)
    rules: Rules = [(f"missing_{c}", blank(r[c])) for c in ("request_id", "idempotency_key", "intent_proposal_id", "origin_ref", "instrument_id")]
    rules += [
        ("created_at_requires_timezone", r["created_us"].isNull()), ("invalid_quantity", endless(q)), ("blank_position_ref", given(r["position_ref"])),
        ("blank_new_position_ref", given(r["new_position_ref"])), ("new_position_ref_only_allowed_for_open", (action != "OPEN") & r["new_position_ref"].isNotNull()),
        ("open_must_not_reference_position", (action == "OPEN") & r["position_ref"].isNotNull()), ("open_requires_positive_quantity", (action == "OPEN") & none_or_less),
    ]
    rules += [(f"{a.lower()}_requires_position_ref", (action == a) & r["position_ref"].isNull()) for a in ("REDUCE", "CLOSE", "MODIFY_PROTECTION")]
    return rules + [
        ("reduce_requires_positive_quantity", (action == "REDUCE") & none_or_less), ("close_quantity_must_be_positive_or_absent", (action == "CLOSE") & (q <= 0)),
        ("modify_protection_must_not_carry_quantity", (action == "MODIFY_PROTECTION") & q.isNotNull()),
        ("modify_protection_requires_protection_payload", (action == "MODIFY_PROTECTION") & ~F.coalesce(r["protected"], F.lit(False))),
        ("unknown_execution_action", action.isNull() | ~action.isin("OPEN", "REDUCE", "CLOSE", "MODIFY_PROTECTION")),
    ]


def result_rules(r: Column) -> Rules:
    """``r``: struct of result_id, request_ref, observed_us, position_ref, action, status, requested, filled, remaining."""
    status, asked, filled, left = (r[c] for c in ("status", "requested", "filled", "remaining"))
    changes = F.coalesce(r["action"] == "MODIFY_PROTECTION", F.lit(False))
    known = ~changes & (status != "UNKNOWN")
    return [
        ("missing_execution_result_identity", blank(r["result_id"]) | blank(r["request_ref"])), ("observed_at_requires_timezone", r["observed_us"].isNull()),
        ("blank_position_ref", r["position_ref"].isNotNull() & (F.trim(r["position_ref"]) == "")), ("invalid_filled_quantity", filled.isNull() | endless(filled) | (filled < 0)),
        ("modify_protection_result_must_not_carry_quantity", changes & asked.isNotNull()), ("modify_protection_result_must_have_zero_fill", changes & (filled != 0)),
        ("modify_protection_result_must_not_carry_remaining", changes & left.isNotNull()), ("modify_protection_result_status_invalid", changes & ~status.isin("ACCEPTED", "REJECTED", "UNKNOWN")),
        ("invalid_requested_quantity", ~changes & (asked.isNull() | endless(asked) | (asked <= 0))), ("filled_quantity_exceeds_requested", ~changes & (filled > asked)),
        ("unknown_result_must_not_assert_remaining_quantity", ~changes & (status == "UNKNOWN") & left.isNotNull()), ("remaining_quantity_required_for_determinate_result", known & left.isNull()),
        ("remaining_quantity_inconsistent_with_fill", known & (left != asked - filled)), ("rejected_result_must_have_zero_fill", known & (status == "REJECTED") & (filled != 0)),
        ("filled_result_requires_zero_remaining", known & (status == "FILLED") & (left != 0)),
        ("partially_filled_requires_positive_fill_and_remaining", known & (status == "PARTIALLY_FILLED") & ((filled <= 0) | (left <= 0))),
        ("accepted_result_must_not_assert_fill_yet", known & (status == "ACCEPTED") & (filled != 0)),
    ]


def safe_to_retry(r: Column) -> Column:
    """Only what was rejected without any fill may be tried again without looking first."""
    return F.coalesce((r["status"] == "REJECTED") & (r["filled"] == 0), F.lit(False))


def risk_input_rules(p: Column, account: Column, max_age_us: int, day: Column) -> Rules:
    """``p``: struct of proposal_id, account_id, status, side, symbol, price_symbol, decision_us, confirmation_us, occurrence_us, account_us, price_us,
    equity, balance, size, stop_distance, exposure, price. ``account``: the one that the engine is bound to, null before the first;
    ``day``: the trading day in hand as yyyy-mm-dd, null before the first."""
    late = lambda seen: (p["decision_us"] - p[seen]).between(0, max_age_us)
    unfit = F.lit(False)
    for c in ("equity", "balance", "size", "stop_distance"):
        unfit = unfit | p[c].isNull() | endless(p[c]) | (p[c] <= 0)
    timeless = F.lit(False)
    for c in ("decision_us", "confirmation_us", "occurrence_us", "account_us", "price_us"):
        timeless = timeless | p[c].isNull()
    ordered = (p["occurrence_us"] <= p["confirmation_us"]) & (p["confirmation_us"] <= p["decision_us"])
    return [
        ("timezone_required", timeless), ("missing_identity", blank(p["proposal_id"]) | blank(p["account_id"])), ("account_mismatch", account != p["account_id"]),
        ("invalid_signal", ~F.coalesce((p["status"] == "active") & p["side"].isin("long", "short") & ordered, F.lit(False))), ("symbol_mismatch", ~p["symbol"].eqNullSafe(p["price_symbol"])),
        ("invalid_account_or_size", unfit), ("invalid_exposure", p["exposure"].isNull() | endless(p["exposure"]) | (p["exposure"] < 0)), ("invalid_price", endless(p["price"]) | (p["price"] <= 0)),
        ("stale_or_future_input", ~(late("account_us") & late("price_us"))), ("out_of_order_day", F.date_format(F.timestamp_micros(p["decision_us"]), "yyyy-MM-dd") < day),
    ]


# Fixed values
LONGEST_REFERENCE = 256
REFERENCE = r"^[A-Za-z0-9._:/#|+-]+$"
EVIDENCE = r"^sha256:[0-9a-f]{64}$"
REDUCING = ("REDUCE", "CLOSE", "MODIFY_PROTECTION")
SECRET_WORDS = (
    "password", "passwd", "secret", "token", "bearer", "apikey", "api_key", "api-key", "authorization", "credential", "privatekey", "private_key", "private-key", "-----begin",
)


def reference_rules(c: Column, telling: tuple[str, ...] = SECRET_WORDS) -> Rules:
    """What an opaque reference may not be: too long, of other letters, or with one of the words ``telling`` a secret; null is of other letters."""
    low = F.lower(c)
    tells = F.lit(False)
    for word in telling:
        tells = tells | low.contains(word)
    return [("too_long", F.length(c) > LONGEST_REFERENCE), ("charset_invalid", ~F.coalesce(c.rlike(REFERENCE) & ~c.contains("\n"), F.lit(False))), ("secret_like", tells)]


def is_evidence(c: Column) -> Column:
    """sha256: and 64 lower-case hexadecimal digits, nothing else."""
    return F.coalesce(c.rlike(EVIDENCE) & (F.length(c) == 71), F.lit(False))


def reduction_proposal_rules(p: Column) -> Rules:
    """``p``: struct of proposal_id, position_id, kind, origin_position_id (null: not from a position), exposure."""
    return [
        ("missing_risk_reduction_identity", blank(p["proposal_id"]) | blank(p["position_id"])), ("risk_reduction_requires_risk_reducing_kind", ~F.coalesce(p["kind"].isin(*REDUCING), F.lit(False))),
        ("risk_reduction_requires_position_origin", p["origin_position_id"].isNull()), ("risk_reduction_position_id_mismatch", p["origin_position_id"] != p["position_id"]),
        ("invalid_current_exposure", p["exposure"].isNull() | endless(p["exposure"]) | (p["exposure"] < 0)),
    ]


def reduction_decision_rules(d: Column) -> Rules:
    """``d``: struct of decision_id, proposal_id, position_id, action, allowed, reason_codes (array), quantity, protection: what is left of the position."""
    allowed, q, stop = F.coalesce(d["allowed"], F.lit(False)), d["quantity"], d["protection"]
    told = F.coalesce(F.size(d["reason_codes"]) > 0, F.lit(False))
    return [
        ("missing_risk_reduction_decision_identity", blank(d["decision_id"]) | blank(d["proposal_id"]) | blank(d["position_id"])),
        ("risk_reduction_decision_requires_risk_reducing_action", ~F.coalesce(d["action"].isin(*REDUCING), F.lit(False))),
        ("allowed_decision_must_have_no_reason_codes", allowed & told), ("denied_decision_requires_reason_codes", ~allowed & ~told),
        ("allowed_reduce_or_close_requires_resulting_quantity", allowed & d["action"].isin("REDUCE", "CLOSE") & q.isNull()),
        ("allowed_modify_protection_requires_resulting_protection", allowed & (d["action"] == "MODIFY_PROTECTION") & stop.isNull()),
        ("invalid_resulting_quantity", allowed & (endless(q) | (q < 0))), ("invalid_resulting_protection", allowed & (endless(stop) | (stop <= 0))),
        ("denied_decision_must_not_carry_resulting_state", ~allowed & (q.isNotNull() | stop.isNotNull())),
    ]
