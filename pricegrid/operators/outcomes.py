"""What happened next: fills, backtest figures, horizons, candles, labels and their distributions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.joins import as_of, range_join
from .gates import canonical

SECOND = 1_000_000
HALF_HOUR = 1_800 * SECOND


def momentum(events: DataFrame, lookback: int) -> DataFrame:
    """A long (short) signal where the price is above (below) that of ``lookback`` rows before."""
    before = F.lag("price", lookback).over(Window.partitionBy("symbol").orderBy("seq"))
    side = F.when(F.col("price") > before, "long").when(F.col("price") < before, "short")
    return events.withColumn("side", side).filter(F.col("side").isNotNull()).select("symbol", "seq", F.col("event_us").alias("decision_us"), "side")


def fills(signals: DataFrame, events: DataFrame, entry_delay_us: int, exit_delay_us: int) -> DataFrame:
    """Entry at the first event at or after the decision plus delay, exit at the first at or after the entry plus delay."""
    prices = events.select("symbol", F.col("event_us").alias("at"), "price", "seq")
    asked = signals.withColumn("at", F.col("decision_us") + entry_delay_us)
    entered = as_of(asked, prices.withColumn("found_us", F.col("at")), ["symbol"], "at", ["found_us", "price"], forward=True, tie="seq", width=HALF_HOUR)
    entered = entered.withColumnRenamed("found_us", "entry_us").withColumnRenamed("price", "entry_price").withColumn("at", F.col("entry_us") + exit_delay_us)
    # an unfilled entry has no time to look from; it must not meet rows of null time
    left = as_of(entered.filter("entry_us is not null"), prices.withColumn("found_us", F.col("at")), ["symbol"], "at", ["found_us", "price"], forward=True, tie="seq", width=HALF_HOUR)
    left = left.withColumnRenamed("found_us", "exit_us").withColumnRenamed("price", "exit_price")
    none = entered.filter("entry_us is null").withColumn("exit_us", F.lit(None).cast("long")).withColumn("exit_price", F.lit(None).cast("long"))
    return left.unionByName(none).drop("at")


def profit(trades: DataFrame, size: int, cost: int) -> DataFrame:
    """Adds gross and net; ``cost`` (spread, commission and slippage) is paid once for each unit."""
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    gross = sign * (F.col("exit_price") - F.col("entry_price")) * size
    return trades.withColumn("gross", gross).withColumn("net", gross - cost * size)


def backtest_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates and factors over filled trades, and how many stayed unfilled."""
    net, filled = F.col("net"), F.col("net").isNotNull()
    n = F.count_if(filled)
    lost = F.sum(F.when(net < 0, -net))
    return trades.groupBy(*keys).agg(
        n.alias("trades"),
        F.count_if(~filled).alias("unfilled"),
        F.round(F.count_if(net > 0) / F.when(n > 0, n), 9).alias("win_rate"),
        F.round(F.sum(net) / F.when(n > 0, n), 6).alias("expectancy"),
        F.round(F.sum(F.when(net > 0, net)) / F.when(lost > 0, lost), 9).alias("profit_factor"),
        F.round(F.count_if(net < 0) / F.when(n > 0, n), 9).alias("false_entry_share"),
        (F.round(F.avg(F.col("entry_us") - F.col("decision_us"))) / SECOND).alias("entry_delay_s"),
    )


def max_drawdown(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The deepest fall of the running net below its running peak, which starts at zero."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    equity = trades.filter("net is not null").withColumn("equity", F.sum("net").over(w))
    peaked = equity.withColumn("peak", F.greatest(F.lit(0), F.max("equity").over(w)))
    return peaked.groupBy(*keys).agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.max_by("equity", F.struct(*order)).alias("final_equity"))


def horizon_outcomes(experiences: DataFrame, events: DataFrame, minutes: list[int]) -> DataFrame:
    """For each experience (symbol, seq, t0, reference, side) and horizon: endpoint and excursions within it.

    A sample counts if both its clocks are after t0 and not after the due time; the endpoint is the first
    event at or after it whose knowledge time is after t0. Each sample meets its experience once, for all horizons.
    """
    due = F.col("t0") + F.col("minutes") * 60 * SECOND
    asked = experiences.withColumn("minutes", F.explode(F.array(*[F.lit(m).cast("long") for m in minutes]))).withColumn("due", due)
    samples = events.select("symbol", F.col("event_us").alias("at"), "received_us", "price")
    longest = max(minutes) * 60 * SECOND
    inside = range_join(experiences.select("symbol", "seq", "t0"), samples, ["symbol"], "at", F.col("t0") + 1, F.col("t0") + longest, longest).filter(F.col("received_us") > F.col("t0"))

    def within(m: int) -> Column:
        counts = F.greatest("at", "received_us") <= F.col("t0") + m * 60 * SECOND
        return F.struct(F.lit(m).cast("long").alias("minutes"), F.max(F.when(counts, F.col("price"))).alias("top"), F.min(F.when(counts, F.col("price"))).alias("low"), F.count_if(counts).alias("samples"))

    stats = inside.groupBy("symbol", "seq").agg(F.array(*map(within, minutes)).alias("all")).select("symbol", "seq", F.explode("all").alias("of")).select("symbol", "seq", "of.*")
    ends = samples.select("symbol", "at", F.col("at").alias("endpoint_us"), F.col("price").alias("endpoint_price"))
    ended = as_of(asked.withColumn("at", F.col("due")), ends, ["symbol"], "at", ["endpoint_us", "endpoint_price"], forward=True, tie="endpoint_us", width=HALF_HOUR).drop("at")
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    up, down = F.greatest(F.lit(0), F.col("top") - F.col("reference")), F.greatest(F.lit(0), F.col("reference") - F.col("low"))
    joined = ended.join(stats, ["symbol", "seq", "minutes"], "left")
    return joined.select(
        "symbol", "seq", "minutes", "endpoint_us", "endpoint_price", (sign * (F.col("endpoint_price") - F.col("reference"))).alias("directional_change"),
        F.coalesce("samples", F.lit(0)).alias("samples"), F.when(F.col("samples") > 0, up).alias("up"), F.when(F.col("samples") > 0, down).alias("down"),
        F.when(F.col("samples") > 0, F.when(sign > 0, up).otherwise(down)).alias("mfe"), F.when(F.col("samples") > 0, F.when(sign > 0, down).otherwise(up)).alias("mae"),
    )


#: spans in a bucket of the clock, so that a group is worth its own call
_WIDE = 24
_LEVELS = ("zone_low", "zone_high", "stop", "tp1", "tp2")


def _first(found: Callable[[int, int], np.ndarray], low: int, high: int) -> int | None:
    """The first place in low..high-1 that ``found`` (a mask of a slice) marks, looked for in growing slices."""
    size = 64
    while low < high:
        hit = found(low, min(high, low + size))
        if hit.any():
            return low + int(hit.argmax())
        low, size = low + size, size * 2
    return None


def _plan_times(left: pa.Table, right: pa.Table, span: int, arrow: pa.Schema) -> pa.Table:
    """When each plan of a bucket is entered, and first reaches its stop and targets behind that; plans without an entry have no row."""
    out: list[tuple] = []
    right = right.drop_null() if right.num_rows else right
    if left.num_rows and right.num_rows:
        right = right.sort_by([("at", "ascending"), ("event_seq", "ascending")])
        at, known, price, number = (right.column(c).to_numpy() for c in ("at", "received_us", "price", "event_seq"))
        place = lambda k: None if k is None else {"at": int(at[k]), "event_seq": int(number[k]), "price": int(price[k])}
        for r in left.to_pylist():
            t0, sign = r["t0"], r["sign"]
            low, high = (int(np.searchsorted(at, t, "right")) for t in (t0, t0 + span))
            if r["zone_low"] is None or r["zone_high"] is None:
                continue
            entry = _first(lambda i, j: (known[i:j] > t0) & (price[i:j] >= r["zone_low"]) & (price[i:j] <= r["zone_high"]), low, high)  # noqa: B023
            if entry is None:
                continue

            def reached(name: str, beyond: int, until: int) -> int | None:
                level = r[name]  # noqa: B023
                return None if level is None else _first(lambda i, j: (known[i:j] > t0) & (beyond * sign * (price[i:j] - level) >= 0), entry + 1, until)  # noqa: B023

            stop = reached("stop", -1, high)
            # a target behind the stop changes nothing
            until = high if stop is None else stop + 1
            out.append((r["of_symbol"], r["of_seq"], *map(place, (entry, stop, reached("tp1", 1, until), reached("tp2", 1, until)))))
    columns = list(zip(*out, strict=True)) if out else [[]] * len(arrow)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def lifecycles(plans: DataFrame, events: DataFrame, minutes: int = 60) -> DataFrame:
    """States of each plan (symbol, seq, t0, side, zone_low, zone_high, stop, tp1, tp2) over the events of the next hour.

    A plan looks through the sorted events of its bucket of the clock in one task, so no pair of a plan and an event is ever a row: the entry is the first sample in the zone; behind it the first sample at or
    beyond the stop, and those at or beyond each target. A target counts if it comes before the stop (the stop comes
    first at the same sample), the stop if the second target doesn't come before it. A plan without an entry has no
    rows; nulls in a plan or a price meet nothing.
    """
    span = minutes * 60 * SECOND
    sign = F.when(F.col("side") == "long", 1).otherwise(-1).cast("long").alias("sign")
    asked = plans.select(F.col("symbol").alias("of_symbol"), F.col("seq").alias("of_seq"), "t0", sign, *_LEVELS, F.floor(F.col("t0") / F.lit(_WIDE * span)).alias("of_bucket"))
    # a plan meets the events of its own bucket of the clock, and of the next one's first span
    place = lambda us: F.floor(us / F.lit(_WIDE * span))
    samples = events.select("symbol", F.col("event_us").alias("at"), "received_us", "price", F.col("seq").alias("event_seq")).withColumn("bucket", F.explode(F.array_distinct(F.array(place(F.col("at")), place(F.col("at") - span)))))
    schema = f"symbol {dict(plans.dtypes)['symbol']}, seq long, " + ", ".join(f"{n} struct<at:long,event_seq:long,price:long>" for n in ("entry", "stop", "tp1", "tp2"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    times = asked.filter("of_symbol is not null and t0 is not null").groupBy("of_symbol", "of_bucket").cogroup(samples.groupBy("symbol", "bucket")).applyInArrow(lambda left, right: _plan_times(left, right, span, arrow), schema)
    before = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b)))
    always = F.lit(True)
    states = [("ENTRY_TRIGGERED", "entry", always), ("ACTIVE", "entry", always), ("TP1", "tp1", before("tp1", "stop")), ("TP2", "tp2", before("tp2", "stop")),
              ("INVALIDATED", "stop", F.col("stop").isNotNull() & ~before("tp2", "stop"))]
    rows = F.array(*[F.when(holds, F.struct(F.lit(name).alias("state"), F.col(f"{c}.at").alias("at_us"), F.col(f"{c}.price").alias("price"))) for name, c, holds in states])
    return times.select("symbol", "seq", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("symbol", "seq", "r.*")


def candles(events: DataFrame, keys: list[str]) -> DataFrame:
    """Half-hour candles: prices in the order of events, count, and the longest gap between samples."""
    gap = F.col("event_us") - F.lag("event_us").over(Window.partitionBy(*keys, "bucket_us").orderBy("seq"))
    rows = events.withColumn("bucket_us", F.col("event_us") - F.pmod(F.col("event_us"), F.lit(HALF_HOUR))).withColumn("gap", gap)
    return rows.groupBy(*keys, "bucket_us").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.count("*").alias("samples"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"), F.max("gap").alias("max_gap_us"),
    )


def freeze_crossings(events: DataFrame, keys: list[str], lead_us: int) -> DataFrame:
    """Targets whose cutoff an event crosses: FROZEN if the feed was alive in the half hour before, else SKIPPED for the latest."""
    before = F.lag("event_us").over(Window.partitionBy(*keys).orderBy("seq"))

    def bucket(us: Column) -> Column:
        return us - F.pmod(us, F.lit(HALF_HOUR))

    rows = events.withColumn("before", before).filter("before is not null")
    rows = rows.withColumn("first", bucket(F.col("before") + lead_us) + HALF_HOUR).withColumn("final", bucket(F.col("event_us") + lead_us)).filter("first <= final")
    alive = F.col("before") >= F.col("first") - HALF_HOUR
    frozen = F.when(alive, F.struct(F.lit("FROZEN").alias("status"), F.col("first").alias("target_us")))
    skipped = F.when((F.col("final") != F.col("first")) | ~alive, F.struct(F.lit("SKIPPED").alias("status"), F.col("final").alias("target_us")))
    made = rows.withColumn("r", F.explode(F.filter(F.array(frozen, skipped), lambda x: x.isNotNull())))
    return made.select(*keys, "seq", "r.status", "r.target_us")


BIASES = ("BULLISH", "BEARISH", "NEUTRAL", "UNAVAILABLE")


def lean(theta: int) -> Callable[[Column, Column], Column]:
    """An algorithm for ``predictions``: where the reference stands against the oldest close, UNAVAILABLE without one."""
    def bias(reference: Column, closes: Column) -> Column:
        move = reference - F.get(closes, F.lit(0))
        return F.when(move >= theta, "BULLISH").when(move <= -theta, "BEARISH").when(move.isNotNull(), "NEUTRAL").otherwise("UNAVAILABLE")

    return bias


def predictions(events: DataFrame, keys: list[str], lead_us: int, algorithm: Callable[[Column, Column], Column], algorithm_key: str, history: int = 3) -> DataFrame:
    """A record for each target that ``freeze_crossings`` gives, with identities that repeat when the run does.

    ``algorithm`` turns the last price before the cutoff and the closes of up to ``history`` candles that ended before
    the target's predecessor (oldest first) into one of BIASES; any other answer, null included, is UNAVAILABLE, as
    is a target behind a gap in the feed or one whose evidence became known after the snapshot.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    seen = events.select(
        *keys, "seq", F.col("received_us").alias("prediction_us"), F.lag("price").over(w).alias("reference"), F.lag("event_us").over(w).alias("snapshot_us"), F.lag("received_us").over(w).alias("snapshot_received_us")
    )
    due = freeze_crossings(events, keys, lead_us).join(seen, [*keys, "seq"])
    bucket = F.col("event_us") - F.pmod(F.col("event_us"), F.lit(HALF_HOUR))
    closes = events.groupBy(*keys, bucket.alias("bucket_us")).agg(F.max_by("price", "seq").alias("close"), F.max("received_us").alias("known_us"))
    asked = due.select(*keys, "seq", "target_us", "snapshot_received_us", F.explode(F.array(*[F.col("target_us") - (k + 1) * HALF_HOUR for k in range(1, history + 1)])).alias("bucket_us"))
    past = asked.join(closes, [*keys, "bucket_us"]).groupBy(*keys, "seq", "target_us").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket_us", "close"))), lambda x: x["close"]).alias("closes"), F.bool_or(F.col("known_us") > F.col("snapshot_received_us")).alias("late_evidence")
    )
    rows = due.join(past, [*keys, "seq", "target_us"], "left").withColumn("closes", F.coalesce("closes", F.array().cast("array<bigint>")))
    rows = rows.withColumn("said", algorithm(F.col("reference"), F.col("closes")))
    reason = (
        F.when(F.col("status") == "SKIPPED", "discontinuous_feed").when(F.col("late_evidence"), "evidence_after_cutoff")
        .when(~F.coalesce(F.col("said").isin(*BIASES), F.lit(False)), "algorithm_invalid_output")
    )
    candle = F.sha2(canonical(*keys, "target_us"), 256)
    lag = F.greatest(F.lit(0).cast("long"), F.col("prediction_us") - F.col("target_us"))
    return rows.withColumn("reason", reason).withColumn("candle_id", candle).select(
        *keys, "seq", "status", "target_us", (F.col("target_us") - lead_us).alias("cutoff_us"), "snapshot_us", "prediction_us", "reference", F.size("closes").alias("history"), (lag > 0).alias("late"),
        lag.alias("freeze_lag_us"), F.when(F.col("reason").isNull(), F.col("said")).otherwise("UNAVAILABLE").alias("bias"), "reason", "candle_id",
        F.sha2(F.concat_ws("|", F.lit(algorithm_key), "candle_id"), 256).alias("prediction_id"),
    )


def candle_outcomes(events: DataFrame, keys: list[str], theta: int) -> DataFrame:
    """Each candle against the last price before it: returns, excursions and their times, label, first touch."""
    rows = events.withColumn("bucket_us", F.col("event_us") - F.pmod(F.col("event_us"), F.lit(HALF_HOUR)))
    w = Window.partitionBy(*keys).orderBy("seq")
    before = F.lag("price").over(w)
    opens = F.lag("bucket_us").over(w) < F.col("bucket_us")
    by_bucket = Window.partitionBy(*keys, "bucket_us").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ref", F.when(opens, before)).withColumn("ref", F.first("ref", ignorenulls=True).over(by_bucket))
    move = F.col("price") - F.col("ref")
    found = rows.withColumn("move", move).groupBy(*keys, "bucket_us").agg(
        F.max("ref").alias("reference"), F.min_by("price", "seq").alias("open"), F.max_by("price", "seq").alias("close"),
        F.max("move").alias("up"), F.min("move").alias("down"), F.max_by("event_us", F.struct("move", -F.col("seq"))).alias("up_us"),
        F.min_by("event_us", F.struct("move", "seq")).alias("down_us"),
        F.min(F.when(F.col("move") >= theta, F.col("seq"))).alias("up_seq"), F.min(F.when(F.col("move") <= -theta, F.col("seq"))).alias("down_seq"),
    ).filter("reference is not null")
    change = F.col("close") - F.col("reference")
    touch = (
        F.when(F.col("up_seq").isNull() & F.col("down_seq").isNull(), "NONE")
        .when(F.col("down_seq").isNull() | (F.col("up_seq") < F.col("down_seq")), "UP").otherwise("DOWN")
    )
    return found.select(
        *keys, "bucket_us", "reference", change.alias("close_return"), (F.col("close") - F.col("open")).alias("body"), (F.col("open") - F.col("reference")).alias("drift"),
        F.greatest(F.lit(0), F.col("up")).alias("up"), F.greatest(F.lit(0), -F.col("down")).alias("down"),
        F.when(F.col("up") > 0, F.col("up_us")).alias("up_us"), F.when(F.col("down") < 0, F.col("down_us")).alias("down_us"),
        F.when(change >= theta, "UP").when(change <= -theta, "DOWN").otherwise("FLAT").alias("label"), touch.alias("first_touch"),
    )


def event_window_labels(observations: DataFrame, events: DataFrame, length: int, favourable: int, adverse: int) -> DataFrame:
    """Barrier labels over the next ``length`` events of observations (symbol, seq, t0, reference, side).

    Barriers are distances in price; the favourable one is looked at first. A window that reaches beyond the
    last event is censored.
    """
    last = events.groupBy("symbol").agg(F.max("seq").alias("n"))
    samples = events.select("symbol", F.col("seq").alias("at"), "event_us", "received_us", "price")
    inside = range_join(observations, samples, ["symbol"], "at", F.col("seq") + 1, F.col("seq") + length, length)
    inside = inside.filter((F.col("event_us") > F.col("t0")) & (F.col("received_us") > F.col("t0")))
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    inside = inside.withColumn("move", sign * (F.col("price") - F.col("reference")))
    hit = F.when(F.col("move") >= favourable, F.struct("at", F.lit("favorable").alias("what"), (F.col("move") - favourable).alias("over"))).when(
        -F.col("move") >= adverse, F.struct("at", F.lit("adverse").alias("what"), (-F.col("move") - adverse).alias("over"))
    )
    stats = inside.groupBy("symbol", "seq").agg(
        F.count("*").alias("samples"), F.max("move").alias("best"), F.min("move").alias("worst"), F.min(hit).alias("hit"),
        F.max_by("event_us", F.struct("move", -F.col("at"))).alias("best_us"), F.min_by("event_us", F.struct("move", "at")).alias("worst_us"),
    )
    joined = observations.join(stats, ["symbol", "seq"], "left").join(last, "symbol")
    status = (
        F.when(F.col("seq") + length > F.col("n"), "CENSORED_END_OF_DATA").when(F.coalesce("samples", F.lit(0)) == 0, "NO_SAMPLES").otherwise("COMPLETE")
    )
    return joined.select(
        "symbol", "seq", "side", status.alias("status"), F.least(F.col("seq") + length, F.col("n")).alias("window_end"),
        F.greatest(F.lit(0), F.col("best")).alias("mfe"), F.greatest(F.lit(0), -F.col("worst")).alias("mae"),
        F.when(F.col("best") > 0, F.col("best_us") - F.col("t0")).alias("mfe_after_us"), F.when(F.col("worst") < 0, F.col("worst_us") - F.col("t0")).alias("mae_after_us"),
        F.when(F.col("samples") > 0, F.coalesce("hit.what", F.lit("none"))).alias("first_barrier"), F.col("hit.at").alias("barrier_seq"), F.col("hit.over").alias("overshoot"),
    )


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles, least, largest and count of the non-null values of each group.

    Values are counted before they are ranked, so the running sum walks over distinct values, not rows.
    """
    distinct = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    ranked = distinct.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * f), F.col(value))).alias(name) for name, f in fractions.items()]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("least"), *picks, F.max(value).alias("most"))


def overlaps(windows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Pairs of closed windows that meet, and how many are open at once, by a sweep instead of a self-join."""
    marks = windows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("o"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(1).alias("o"), F.lit(-1).alias("d")))).alias("m"))
    # all marks of a place and kind become one row before the sweep
    merged = marks.groupBy(*keys, "m.at", "m.o").agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    swept = merged.withColumn("open", F.sum("d").over(w))
    k, before = F.col("d"), F.col("open") - F.col("d")
    return swept.groupBy(*keys).agg(
        F.sum(F.when(F.col("o") == 0, k * before + F.call_function("div", k * (k - 1), F.lit(2))).otherwise(0)).alias("pairs"), F.max("open").alias("most_open")
    )
