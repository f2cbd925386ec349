"""Decision tables: gates with ordered reason codes, reconciliation, deduplication, plans, news, integrity.

A gate is a list of (reason, condition); what holds is filtered inside one expression, so a gate costs a
projection and no shuffle. Conditions that are null count as holding: a gate fails closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AXES = ("market_data", "broker", "account", "capabilities", "reconciliation", "journal")


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The reason codes whose condition holds or is unknown, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), r) for r, c in rules]), lambda x: x.isNotNull())


def degraded(prefix: str = "") -> list[tuple[str, Column]]:
    """One rule for each axis that isn't HEALTHY."""
    return [(f"{prefix}{a}", F.col(a) != "HEALTHY") for a in AXES]


def mode_rules(opens: Column | None = None) -> list[tuple[str, Column]]:
    opens = F.lit(True) if opens is None else opens
    return [
        ("auto_mode_not_governed", F.col("mode") == "AUTO"),
        ("trading_mode_shadow_observes_only", F.col("mode") == "SHADOW"),
        ("assisted_confirmation_missing", (F.col("mode") == "ASSISTED") & opens & ~F.col("confirmed")),
    ]


def new_trade_reasons() -> Column:
    """Why a new trade is denied; empty if it is allowed."""
    return reasons([*mode_rules(), *degraded("health_degraded:"), ("entry_not_ready", F.col("readiness") != "READY"), ("risk_decision_not_allow", F.col("risk") != "allow")])


def existing_position_reason(kind: Column, change: Column) -> Column:
    """Why an action on a position is denied, or null."""
    healthy = F.lit(True)
    for a in AXES:
        healthy = healthy & (F.col(a) == "HEALTHY")
    return (
        F.when(F.col("broker") == "UNHEALTHY", "broker_unhealthy_fail_closed")
        .when(healthy | kind.isin("REDUCE", "CLOSE"), F.lit(None).cast("string"))
        .when(change.isNull(), "protection_change_unclassified")
        .when(change == "WIDEN", "degraded_blocks_exposure_increase")
    )


def guard_reasons(kind: Column, change: Column) -> Column:
    """Why the execution guard denies, all reasons in fixed order."""
    opens, state = kind == "OPEN", F.col("recon")
    rules = [
        *mode_rules(opens),
        ("authority_denied", F.col("authority") != "AUTHORIZED"),
        ("authority_not_transmittable", (F.col("authority") == "AUTHORIZED") & (F.col("transmit") == "NOT_TRANSMITTABLE")),
        ("authority_not_applicable", (F.col("authority") == "AUTHORIZED") & ~F.col("transmit").isin("TRANSMITTABLE", "NOT_TRANSMITTABLE")),
        ("reconciliation_blocks_new_trade", opens & (state != "SYNCHRONIZED")),
        ("kill_switch_armed", opens & F.col("kill_switch")),
        ("new_position_ref_missing", opens & F.col("position_ref").isNull()),
        ("reconciliation_blocks_position_action", ~opens & (state != "SYNCHRONIZED")),
        ("protection_change_unclassified", (kind == "MODIFY_PROTECTION") & ~F.coalesce(change.isin("TIGHTEN", "WIDEN"), F.lit(False))),
        ("kill_switch_blocks_protection_widen", (kind == "MODIFY_PROTECTION") & F.coalesce(change == "WIDEN", F.lit(False)) & F.col("kill_switch")),
    ]
    return reasons(rules)


def volume_violation(volume: Column, least: Column, most: Column, step: Column, residual: bool = False) -> Column:
    """Why a volume (a whole number of the finest unit) is refused, or null; the grid starts at ``least``."""
    v = F.when(volume <= 0, "volume_not_positive").when(volume < least, "volume_below_min")
    v = v if residual else v.when(volume > most, "volume_above_max")
    return v.when((volume - least) % step != 0, "volume_off_step")


def reconcile(local: DataFrame, broker: DataFrame) -> DataFrame:
    """position_ref, finding, status: every local position against the broker's, and the other way round.

    ``local``: position_id, instrument, side, quantity, stop, closed. ``broker``: broker_ref, local_ref,
    instrument, side, quantity, stop, close_pending. Of several claims on a position, the first by broker_ref
    is paired. Equi-joins on the claimed id; no position meets all others.
    """
    b = broker.withColumn("claims", F.when(F.col("local_ref").isNotNull(), F.count("*").over(Window.partitionBy("local_ref"))))
    l = local.select("position_id", *[F.col(c).alias(f"l_{c}") for c in ("instrument", "side", "quantity", "stop", "closed")])
    joined = b.join(l, b["local_ref"] == l["position_id"], "left")
    fits = F.coalesce(~F.col("l_closed") & (F.col("l_instrument") == F.col("instrument")) & (F.col("l_side") == F.col("side")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("local_ref", "fits").orderBy("broker_ref"))
    paired = joined.withColumn("fits", fits).withColumn("paired", F.col("fits") & (nth == 1))
    kinds = (
        F.when(~F.col("paired"), F.array(F.lit("BROKER_POSITION_LOCAL_MISSING")))
        .when(F.col("close_pending") & (F.col("claims") == 1), F.array(F.lit("CLOSE_PENDING_CONFIRMED")))
        .otherwise(
            F.filter(
                F.array(F.when(F.col("quantity") != F.col("l_quantity"), "QUANTITY_MISMATCH"), F.when(~F.col("stop").eqNullSafe(F.col("l_stop")), "PROTECTION_MISMATCH")),
                lambda x: x.isNotNull(),
            )
        )
    )
    kinds = F.when(F.size(kinds) == 0, F.array(F.lit("MATCH"))).otherwise(kinds)
    from_broker = paired.select(F.when(F.col("paired"), F.col("position_id")).otherwise(F.col("broker_ref")).alias("position_ref"), F.explode(kinds).alias("finding"))

    met = paired.filter("paired").select("position_id")
    claimed = broker.filter("local_ref is not null").select(F.col("local_ref").alias("position_id")).distinct().withColumn("claimed", F.lit(True))
    orphan = broker.filter("local_ref is null").select("instrument", "side").distinct().withColumn("orphan", F.lit(True))
    alone = local.filter("not closed").join(met, "position_id", "left_anti").join(claimed, "position_id", "left").join(orphan, ["instrument", "side"], "left")
    flat = F.col("claimed").isNull() & F.col("orphan").isNull() & F.col("instrument").isNotNull()
    from_local = alone.select(F.col("position_id").alias("position_ref"), F.when(flat, "BROKER_FLAT_CONFIRMED").otherwise("LOCAL_OPEN_BROKER_MISSING").alias("finding"))
    every = from_broker.unionByName(from_local)
    status = F.when(F.col("finding") == "MATCH", "SYNCHRONIZED").when(F.col("finding").isin("EXECUTION_RESULT_UNKNOWN", "RESTART_RECOVERY_PENDING", "CLOSE_PENDING_CONFIRMED"), "UNKNOWN").otherwise("UNSYNCHRONIZED")
    return every.withColumn("status", status)


def worst_status(records: DataFrame, keys: list[str]) -> DataFrame:
    """UNKNOWN before UNSYNCHRONIZED before SYNCHRONIZED."""
    rank = F.when(F.col("status") == "SYNCHRONIZED", 0).when(F.col("status") == "UNSYNCHRONIZED", 1).otherwise(2)
    worst = records.groupBy(*keys).agg(F.max(rank).alias("rank"), F.count("*").alias("records"))
    return worst.select(*keys, "records", F.element_at(F.array(F.lit("SYNCHRONIZED"), F.lit("UNSYNCHRONIZED"), F.lit("UNKNOWN")), F.col("rank") + 1).alias("overall"))


def dedup_states(events: DataFrame) -> DataFrame:
    """State of each key from its events (key, seq, event, generation, clean): current generation, and corruption if any."""
    def has(kind: str, more: Column | None = None) -> Column:
        hit = (F.col("event") == kind) & (F.col("generation") == F.col("current"))
        return F.coalesce(F.bool_or(hit if more is None else hit & more), F.lit(False))

    releases = events.groupBy("key").agg(F.count_if(F.col("event") == "release").alias("current"))
    rows = events.join(releases, "key")
    by_key = rows.groupBy("key", "current").agg(
        has("claim").alias("claimed"), has("abort").alias("aborted"), has("attempt").alias("attempted"), has("result").alias("answered"), has("result", ~F.col("clean")).alias("unsafe"),
        F.bool_or((F.col("event") == "result") & (F.col("generation") < F.col("current")) & ~F.col("clean")).alias("unsafe_before"),
        F.bool_or((F.col("event") == "claim") & (F.col("generation") > F.col("current"))).alias("beyond"),
    )
    state = (
        F.when(F.col("beyond"), "CORRUPT_claim_beyond_generation").when(F.col("unsafe_before"), "CORRUPT_released_generation_not_safe")
        .when(~F.col("claimed"), "UNCLAIMED").when(F.col("aborted"), "ABORTED_NEVER_ATTEMPTED")
        .when(F.col("answered") & ~F.col("unsafe"), "RESULT_CLEAN_REJECTED").when(F.col("answered"), "RESULT_UNSAFE")
        .when(F.col("attempted"), "ATTEMPTED_NO_RESULT").otherwise("CLAIMED_NOT_ATTEMPTED")
    )
    return by_key.select("key", F.col("current").alias("generation"), state.alias("state"))


def news_windows(news: DataFrame, minutes: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds the blackout window of each item by its impact: (minutes before, minutes after)."""
    before, after = F.lit(None).cast("long"), F.lit(None).cast("long")
    for impact, (b, a) in minutes.items():
        before = F.when(F.col("impact") == impact, F.lit(b).cast("long")).otherwise(before)
        after = F.when(F.col("impact") == impact, F.lit(a).cast("long")).otherwise(after)
    return news.withColumn("start_us", F.col("at") - before * 60_000_000).withColumn("end_us", F.col("at") + after * 60_000_000)


def relevance(currencies: Column, symbols: Column, watched_currencies: list[str], watched_symbols: list[str]) -> Column:
    """Reason codes of a watch-list match."""
    c = F.size(F.array_intersect(currencies, F.array(*map(F.lit, watched_currencies)))) > 0
    s = F.size(F.array_intersect(symbols, F.array(*map(F.lit, watched_symbols)))) > 0
    return F.when(c & s, "currency_match,symbol_match").when(c, "currency_match").when(s, "symbol_match").otherwise("no_watchlist_match")


def recent_posts(posts: DataFrame, watched: DataFrame, since: DataFrame, watched_symbols: list[str]) -> DataFrame:
    """``posts`` (account, at, symbol, more) at or after ``since`` (one row: since) with relevant, score (1 or 0) and reasons.

    ``watched``: account, with any repetitions; a post is relevant only by its account, and an empty list makes nothing relevant. Null accounts
    and symbols match nothing, posts without a time aren't recent; without a row of ``since`` nothing is.
    """
    listed = watched.select("account").filter("account is not null").distinct().withColumn("relevant", F.lit(True))
    late = posts.join(F.broadcast(since.select("since")), F.col("at") >= F.col("since")).drop("since")  # one row is broadcast
    told = late.join(listed, "account", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    known = F.coalesce(F.col("symbol").isin(*watched_symbols), F.lit(False))
    reason = F.when(F.col("relevant") & known, "account_match,symbol_match").when(F.col("relevant"), "account_match").when(known, "symbol_match").otherwise("no_watchlist_match")
    return told.select(*posts.columns, "relevant", F.col("relevant").cast("long").alias("score"), reason.alias("reasons"))


def canonical(*columns: str) -> Column:
    """Our canonical form of a row: name=value pairs in the order of names.

    A backslash stands before each \\, | and = of a value, and null is \\N, so that different rows have different forms.
    """
    def value(c: str) -> Column:
        text = F.col(c).cast("string")
        for sign in ("\\", "|", "="):  # the backslash first; plain replacement costs next to nothing where there is none
            text = F.replace(text, F.lit(sign), F.lit(f"\\{sign}"))
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), value(c)) for c in sorted(columns)])


def dataset_violations(events: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows break each rule of a dataset: unique identity, rising sequence, times that don't fall, knowledge after event."""
    w = Window.partitionBy(*keys).orderBy("seq")
    copies = events.groupBy(*keys, "source_sequence").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.sum(F.col("c") - 1).alias("repeated_identity"))
    seen = events.withColumn("s", F.lag("source_sequence").over(w)).withColumn("t", F.lag("event_us").over(w))
    checks = seen.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col("source_sequence") <= F.col("s")).alias("sequence_not_rising"), F.count_if(F.col("event_us") < F.col("t")).alias("time_falling"),
        F.count_if(F.col("received_us") < F.col("event_us")).alias("known_before_event"), F.count_if(F.col("price") <= 0).alias("nonpositive_price"),
    )
    return checks.join(copies, keys)
