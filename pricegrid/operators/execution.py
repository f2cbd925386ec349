"""From an intent to its execution: instruments resolved, preflight, the steps with their trace, plans for positions in emergency.

Everything is a join on keys or an expression over the row. What depends on earlier intents (whose key was claimed before) comes from one
aggregate for each key, so a key with very many intents is summed up before it is shuffled. Times are microseconds, volumes whole numbers
of the finest unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import BITS, Rules, all_broken, blank, broken_bits, by_bits, first_broken
from .gates import canonical

# Fixed values
VOLUMED = ("OPEN", "REDUCE", "CLOSE")
CONFIRMING = ("MATCH", "CLOSE_PENDING_CONFIRMED", "BROKER_FLAT_CONFIRMED")
METADATA = ("currency_base", "currency_profit", "trade_contract_size", "digits", "trade_tick_size")


def normal_path(path: Column) -> Column:
    """A Windows path in lower case, with single backslashes and none at the end; dots are left as they are."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(path, "/", "\\")), r"\\+", r"\\"), r"\\$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(normal_path(path), r"\\[^\\]*$", "")


def resolve_feeds(requests: DataFrame, brokers: DataFrame, terminals: DataFrame, bindings: DataFrame, instruments: DataFrame, symbols: DataFrame) -> DataFrame:
    """``requests`` (instrument_id, path, more) with the code that stops the resolution, its detail, or the feed's id.

    ``brokers``: broker_id, terminal_path, company. ``terminals``: path, connected, seen_path, company. ``bindings``: instrument_id, broker_id,
    symbol, digits, trade_tick_size. ``instruments``: instrument_id, currency_base, currency_profit, trade_contract_size. ``symbols``: broker_id,
    symbol (the name asked for), name, visible, custom and the metadata. Exactly one broker, binding and instrument must fit; there is no
    likeness, prefix or first choice. Each different pair of instrument and path is resolved once. A blank or null request is not
    configured; terminals and symbols are unique by their keys, and of repeated ones any is taken.
    """
    def one(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.any_value(F.struct(*rest)).alias(name))

    def count(name: str) -> Rules:
        n = F.coalesce(F.col(f"n_{name}"), F.lit(0))
        return [("broker_not_bound", n == 0), ("broker_ambiguous", n > 1)]

    differs = lambda a, b: a.isNull() | F.coalesce(a != b, F.lit(True))
    # what a path says is told once for each different path, however many instruments are asked for there
    terminal, broker = F.col("terminal"), F.col("broker")
    paths = requests.select("path").filter("path is not null").distinct().withColumn("at", normal_path(F.col("path")))
    paths = paths.join(one(brokers.withColumn("at", normal_path(F.col("terminal_path"))), ["at"], "broker"), "at", "left").join(one(terminals, ["path"], "terminal"), "path", "left")
    refused = first_broken([
        ("not_configured", blank(F.col("path"))), *count("broker"), ("terminal_disconnected", ~F.coalesce(terminal["connected"], F.lit(False))),
        ("broker_identity_mismatch:terminal_path", differs(normal_path(terminal["seen_path"]), folder(broker["terminal_path"]))), ("broker_identity_mismatch:company", differs(terminal["company"], broker["company"])),
    ])
    routes = paths.select("path", refused.alias("refused"), F.when(F.col("n_broker") == 1, broker["broker_id"]).alias("broker_id"), broker["company"].alias("company"))

    pairs = requests.select("instrument_id", "path").filter("instrument_id is not null and path is not null").distinct()
    rows = pairs.join(routes, "path")
    rows = rows.join(one(bindings, ["instrument_id", "broker_id"], "binding"), ["instrument_id", "broker_id"], "left")
    rows = rows.join(one(instruments, ["instrument_id"], "instrument"), "instrument_id", "left")
    rows = rows.withColumn("symbol", F.when(F.col("n_binding") == 1, F.col("binding.symbol"))).join(one(symbols, ["broker_id", "symbol"], "seen"), ["broker_id", "symbol"], "left")
    seen = F.col("seen")
    declared = {c: F.col(f"instrument.{c}") for c in METADATA[:3]} | {"digits": F.col("binding.digits"), "trade_tick_size": F.coalesce(F.col("binding.trade_tick_size"), F.lit(0))}
    rules: Rules = [
        ("not_configured", blank(F.col("instrument_id"))), *count("binding"), *count("instrument"),
        ("symbol_not_found", differs(seen["name"], F.col("symbol"))), ("symbol_not_visible", ~F.coalesce(seen["visible"], F.lit(False))),
        ("instrument_metadata_mismatch:custom", F.coalesce(seen["custom"], F.lit(True))), *[(f"instrument_metadata_mismatch:{c}", differs(seen[c], d)) for c, d in declared.items()],
    ]
    blank_first = F.when(blank(F.col("instrument_id")), "not_configured")
    found = rows.select("instrument_id", "path", F.coalesce(blank_first, F.col("refused"), first_broken(rules)).alias("said"), "broker_id", "company", "symbol", *[d.alias(c) for c, d in declared.items()])
    identity = F.concat(F.lit("feed:"), F.sha2(canonical("instrument_id", "broker_id", "company", "symbol", *METADATA), 256))
    told = found.select("instrument_id", "path", "said", F.when(F.col("said").isNull(), identity).alias("feed_id"))
    absent = F.col("instrument_id").isNull() | F.col("path").isNull()
    said = F.split("said", ":")
    return requests.join(told, ["instrument_id", "path"], "left").select(
        *requests.columns, F.when(absent, "not_configured").otherwise(F.get(said, F.lit(0))).alias("code"), F.get(said, F.lit(1)).alias("detail"), "feed_id"
    )


def preflight_rules(r: Column, max_age_us: int | None, policy: Column | None = None) -> Rules:
    """Why an intent may not go on, all reasons in a fixed order (``all_broken``).

    ``r``: struct of action, quantity, instrument_id, known_instrument (null without capabilities), volume_min, volume_max, volume_step,
    volume_anchor (null: the grid starts at volume_min), position_quantity, now_us, observed_us (null where no zone was given).
    Without ``policy`` nothing is ever allowed, as no policy has been decided; with it, what it holds for passes that rule.
    """
    action, q, known = r["action"], r["quantity"], r["known_instrument"].isNotNull()
    least, most = r["volume_min"], r["volume_max"]
    volumed = known & action.isin(*VOLUMED) & q.isNotNull()
    on_grid = lambda v: F.coalesce((v - F.coalesce(r["volume_anchor"], least)) % r["volume_step"] == 0, F.lit(False))
    rest = r["position_quantity"] - q
    leaves = F.coalesce((q > 0) & (rest > 0) & (rest >= least), F.lit(False)) & on_grid(rest)
    age = r["now_us"] - r["observed_us"]
    bounded = max_age_us is not None and max_age_us >= 0
    undecided = F.lit(True) if policy is None else ~F.coalesce(policy, F.lit(False))
    reducing = action != "OPEN"
    return [
        ("preflight_clock_requires_timezone", r["now_us"].isNull()), ("preflight_capabilities_missing", ~known),
        ("preflight_instrument_mismatch", known & ~r["instrument_id"].eqNullSafe(r["known_instrument"])), ("preflight_quantity_missing", known & action.isin(*VOLUMED) & q.isNull()),
        ("volume_below_min", volumed & (q < least)), ("volume_above_max", volumed & (q >= least) & (q > most)),
        ("volume_not_multiple_of_step", volumed & ~(F.coalesce((q < least) | (q > most), F.lit(False)) | on_grid(q))),
        ("preflight_reduce_residual_volume_invalid", volumed & (action == "REDUCE") & ~leaves), ("preflight_clock_requires_timezone", known & r["observed_us"].isNull()),
        ("preflight_capabilities_freshness_bound_missing", known & F.lit(not bounded)), ("preflight_capabilities_stale", known & ~age.between(0, max_age_us if bounded else 1 << 62)),
        ("preflight_stops_freeze_check_unavailable", action == "MODIFY_PROTECTION"), ("preflight_policy_undecided", reducing & undecided), ("preflight_policy_evaluation_unavailable", ~F.coalesce(reducing, F.lit(False)) & undecided),
    ]


def execution_trace(intents: DataFrame, key: str, order: list[str], before: list[tuple[str, Rules]], last_look: Rules, marked: Column, sent: Column, kept: Column, clean: Column) -> DataFrame:
    """``intents`` with trace (the steps entered), status, codes, and pending: whether the outcome must be looked up first.

    ``before``: the steps up to the claim, each with its rules. Step 5 claims ``key`` for the first intent in ``order`` that gets there;
    an intent behind it finds the key taken (or released after a clean rejection, which isn't tried again) and stops at step 1, behind
    that step's own rules. Then ``last_look`` (6) aborts, a marker that isn't durable (``marked``) stops before anything is sent, ``sent`` (7) says
    that the adapter answered, ``kept`` (8) that the answer is durable, ``clean`` that it was a rejection without a fill. Null conditions of
    ``marked``, ``sent``, ``kept`` and ``clean`` count as false. ``order`` must tell the intents of a key apart; null keys are refused as no key.
    """
    names = [n for n, _ in before]
    yes = lambda c: F.coalesce(c, F.lit(False))
    every = [rule for _, rules in before for rule in rules] + last_look
    bits = broken_bits(every)
    judged = intents.select(
        *[F.col(c) for c in intents.columns], *[b.alias(f"__bits_{i}") for i, b in enumerate(bits)], F.struct(*order).alias("__at"),
        yes(marked).alias("__marked"), yes(sent).alias("__sent"), yes(kept).alias("__kept"), yes(clean).alias("__clean"),
    )
    of = [i for i, (_, rules) in enumerate(before) for _ in rules] + [None] * len(last_look)

    def mask(step: int | None, chunk: int) -> Column:
        """The bits of that step's rules, of the last look's for None."""
        return F.lit(sum(1 << i for i, s in enumerate(of[chunk * BITS : (chunk + 1) * BITS]) if s == step)).cast("long")

    def met_at(step: int | None) -> Column:
        return reduce(Column.__or__, [F.col(f"__bits_{i}").bitwiseAND(mask(step, i)) != 0 for i in range(len(bits))], F.lit(False))

    own = F.lit(None).cast("int")
    for i in reversed(range(len(names))):
        own = F.when(met_at(i), F.lit(i)).otherwise(own)
    judged = judged.withColumn("__own", own)
    state = (
        F.when(met_at(None), "ABORTED_NEVER_ATTEMPTED").when(~F.col("__marked"), "CLAIMED_NOT_ATTEMPTED").when(~F.col("__sent") | ~F.col("__kept"), "ATTEMPTED_NO_RESULT")
        .when(F.col("__clean"), "RELEASED").otherwise("RESULT_UNSAFE")
    )
    # those that claim nothing are summed up under the null key, which no filter drops: pushed down, it would repeat every rule in one condition
    claims = F.col("__own").isNull() & F.col(key).isNotNull()
    claimed = judged.select(F.when(claims, F.col(key)).alias("__key"), F.when(claims, F.struct("__at", state.alias("state"))).alias("__claim"))
    first = claimed.groupBy("__key").agg(F.min("__claim").alias("__first"))
    met = judged.join(first, F.col(key).eqNullSafe(F.col("__key")), "left")
    taken = F.when(F.col(key).isNull(), "missing_idempotency_key").when(
        F.col("__at") > F.col("__first.__at"),
        F.when(F.col("__first.state") == "RELEASED", "dedup_same_key_retry_not_supported").otherwise(F.concat(F.lit("dedup_key_not_unclaimed:"), F.col("__first.state"))),
    )
    met = met.withColumn("__taken", F.when(~F.coalesce(F.col("__own") == 0, F.lit(False)), taken)).withColumn("__stop", F.when(F.col("__taken").isNotNull(), F.lit(0)).otherwise(F.col("__own")))
    denied, late = F.col("__stop").isNotNull(), met_at(None)
    # of an intent that stops the rules of that step are told, of one that goes on those of the last look
    for c in range(len(bits)):
        told = mask(None, c)
        for i in range(len(names)):
            told = F.when(F.col("__own") == i, mask(i, c)).otherwise(told)
        met = met.withColumn(f"__said_{c}", F.col(f"__bits_{c}").bitwiseAND(told))
    why = all_broken(by_bits(every, [F.col(f"__said_{c}") for c in range(len(bits))]))
    unmarked, unsent, unkept = ~F.col("__marked"), ~F.col("__sent"), ~F.col("__kept")
    status = (
        F.when(denied, "DENIED").when(late, "ABORTED").when(unmarked, "MARKER_FAILED").when(unsent, "SUBMIT_RAISED").when(unkept, "RESULT_PERSIST_FAILED").otherwise("COMPLETED")
    )
    none = F.array().cast("array<string>")
    codes = (
        F.when(F.col("__taken").isNotNull(), F.array("__taken")).when(denied | late, why).when(unmarked, F.array(F.lit("attempt_marker_not_durable"))).when(unsent, F.array(F.lit("adapter_submit_raised")))
        .when(unkept, F.array(F.lit("result_persist_failed"))).otherwise(none)
    )
    steps = [*names, "5", "6", "7", "8", "9"]
    traces = F.array(*[F.lit(",".join(steps[: i + 1])) for i in range(len(steps))])
    reached = (
        F.when(denied, F.col("__stop") + 1).when(late | unmarked, F.lit(len(names) + 2)).when(unsent, F.lit(len(names) + 3)).when(unkept, F.lit(len(names) + 4)).otherwise(F.lit(len(names) + 5))
    )
    return met.select(*intents.columns, F.get(traces, reached - 1).alias("trace"), status.alias("status"), codes.alias("codes"), status.isin("SUBMIT_RAISED", "RESULT_PERSIST_FAILED").alias("pending"))


def recovery_plans(positions: DataFrame, records: DataFrame) -> DataFrame:
    """run, position_ref, target, outcome, reason: where a position in emergency could go, by the evidence of its run; nothing is ever applied.

    ``positions``: run, position_ref, state, quantity. ``records``: run, position_ref, finding, status, observed_us, local_quantity, broker_quantity;
    ``complete`` tells whether the run's snapshot was. A target needs one observation time in the run, confirming findings alone and one of them
    for the position, and every other record of the run in order. Runs are summed up by position first, then whole, so that
    a hot run is one row for each position before it meets in one place. A position without records is refused.
    """
    confirms = F.col("finding").isin(*CONFIRMING)
    disordered = F.coalesce(F.col("status") != "SYNCHRONIZED", F.lit(True))
    mine = records.groupBy("run", "position_ref").agg(
        F.min(F.when(confirms, F.col("finding"))).alias("finding"), F.max(F.when(confirms, F.col("finding"))).alias("another"), F.count_if(~F.coalesce(confirms, F.lit(False))).alias("against"),
        F.count_if(disordered).alias("disordered"), F.max_by("local_quantity", F.when(confirms, F.lit(1))).alias("local_quantity"), F.max_by("broker_quantity", F.when(confirms, F.lit(1))).alias("broker_quantity"),
        F.min("local_quantity").alias("low"), F.max("local_quantity").alias("high"), F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"),
        F.count_if(F.col("observed_us").isNull()).alias("timeless"), F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"),
    )
    whole = mine.groupBy("run").agg(
        F.sum("disordered").alias("all_disordered"), F.min("first_us").alias("first"), F.max("last_us").alias("last"), F.sum("timeless").alias("timeless"), F.bool_and("complete").alias("complete")
    )
    facts = positions.join(mine.drop("first_us", "last_us", "timeless", "complete"), ["run", "position_ref"], "left").join(whole, "run", "left")
    one_time = F.coalesce((F.col("first") == F.col("last")) & (F.col("timeless") == 0), F.lit(False))
    stale = F.col("first").isNotNull() & (~one_time | F.coalesce((F.col("low") != F.col("quantity")) | (F.col("high") != F.col("quantity")), F.lit(False)))
    matched = F.coalesce((F.col("local_quantity") == F.col("broker_quantity")) & (F.col("local_quantity") > 0), F.lit(False))
    proven = F.coalesce(F.col("complete") & one_time & (F.col("finding") == F.col("another")) & (F.col("against") == 0) & (F.col("all_disordered") == F.col("disordered")), F.lit(False))
    target = F.when(~proven, None).when(F.col("finding") == "MATCH", F.when(matched, "MANAGING")).when(F.col("finding") == "CLOSE_PENDING_CONFIRMED", "EXIT_PENDING").otherwise("CLOSED")
    emergency = F.coalesce(F.col("state") == "EMERGENCY", F.lit(False))
    target = F.when(emergency & ~stale, target)
    reason = F.when(~emergency, "position_not_emergency").when(stale, "evidence_stale_vs_position").when(target.isNull(), "evidence_not_verified").otherwise("recovery_authorization_not_resolved")
    return facts.select("run", "position_ref", target.alias("target"), F.when(target.isNull(), "REFUSED").otherwise("DENIED").alias("outcome"), reason.alias("reason"))
