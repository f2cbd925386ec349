"""Stream hygiene: flags, late and repeated rows, admission, and feed quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.running import running


#: Steps of the first order column that one task sorts, whatever the length of a key's history.
WIDTH = 1 << 20


def stream_flags(
    events: DataFrame, keys: list[str], order: list[str], sequence: str = "source_sequence", time: str = "event_us", identity: str = "identity_key", width: int = WIDTH
) -> DataFrame:
    """Adds is_duplicate, is_out_of_order, is_gap and gap_from_sequence, each against all rows before.

    A row is out of order if its sequence or its time is below the largest so far, and leaves a gap if its
    sequence skips numbers. The first row of a key has no flag. Null sequences and times raise no flag. ``order`` begins with a whole
    number; rows are walked through in buckets of ``width`` of it. An empty table gives an empty one.
    """
    return _flagged(events, keys, order, sequence, time, identity, width).drop("__seq", "__time")


def _flagged(events: DataFrame, keys: list[str], order: list[str], sequence: str, time: str, identity: str, width: int) -> DataFrame:
    """The flags, and the largest sequence and time before each row."""
    out = running(events, keys, order, width, {"__seq": ("max", F.col(sequence), False), "__time": ("max", F.col(time), False)})
    nth = F.row_number().over(Window.partitionBy(*keys, identity).orderBy(*order))
    no = F.lit(False)
    gap = F.coalesce(F.col(sequence) > F.col("__seq") + 1, no)
    return out.select(
        *events.columns,
        (nth > 1).alias("is_duplicate"),
        (F.coalesce(F.col(sequence) < F.col("__seq"), no) | F.coalesce(F.col(time) < F.col("__time"), no)).alias("is_out_of_order"),
        gap.alias("is_gap"),
        F.when(gap, F.col("__seq") + 1).alias("gap_from_sequence"),
        "__seq",
        "__time",
    )


def first_of_identity(events: DataFrame, identity: str, order: list[str]) -> DataFrame:
    """Insert-ignore: the first row of each identity stays. A null identity is one identity."""
    columns = events.columns
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("row")
    return events.groupBy(F.col(identity).alias("__identity")).agg(first).select("row.*")


def changed_only(quotes: DataFrame, keys: list[str], order: str, watched: list[str], known: Column) -> DataFrame:
    """Rows whose watched columns differ from those of the row before, among the rows that are ``known``."""
    now = F.struct(*watched)
    last = F.lag(now).over(Window.partitionBy(*keys).orderBy(order))
    return quotes.filter(known).withColumn("__last", last).filter(~now.eqNullSafe(F.col("__last"))).drop("__last")


def drop_late(events: DataFrame, keys: list[str], order: list[str], time: str, identity: str, width: int = WIDTH) -> DataFrame:
    """Rows that are neither earlier than the largest time before them nor repeated; numbered by ``accepted``. Null times are never earlier than others, but others' times hold them back."""
    flagged = _flagged(events, keys, order, "source_sequence", time, identity, width)
    kept = flagged.filter(~F.col("is_duplicate") & (F.col("__time").isNull() | (F.col(time) >= F.col("__time")))).select(*events.columns)
    return running(kept, keys, order, width, {"accepted": ("sum", F.lit(1).cast("long"), True)})


def quality_counters(flagged: DataFrame, keys: list[str], order: list[str], sequence: str = "source_sequence", width: int = WIDTH) -> DataFrame:
    """Running counts of observed, repeated, out-of-order, gap and backfilled rows."""
    marked = running(flagged, keys, order, width, {"__high": ("max", F.col(sequence), False)})
    backfill = F.coalesce(F.col(sequence) <= F.col("__high"), F.lit(False)) & ~F.col("is_out_of_order") & ~F.col("is_duplicate")
    flags = {"duplicates": F.col("is_duplicate"), "out_of_order": F.col("is_out_of_order"), "gaps": F.col("is_gap"), "backfills": F.col("__backfill")}
    counted = {"observed": ("sum", F.lit(1).cast("long"), True)} | {n: ("sum", F.coalesce(f, F.lit(False)).cast("long"), True) for n, f in flags.items()}
    return running(marked.withColumn("__backfill", backfill), keys, order, width, counted).drop("__high", "__backfill")


def completeness(flagged: DataFrame, keys: list[str], order: list[str], width: int = WIDTH) -> DataFrame:
    """Adds completeness: partial from the first gap of the key on, complete before; null flags are no gaps."""
    gaps = running(flagged, keys, order, width, {"__gaps": ("max", F.coalesce(F.col("is_gap"), F.lit(False)).cast("int"), True)})
    return gaps.withColumn("completeness", F.when(F.col("__gaps") > 0, "partial").otherwise("complete")).drop("__gaps")


def quality_status(age_us: Column, latency_ms: Column, market_open: Column, stale_s: int = 10, skew_s: int = 5, slow_ms: int = 3000) -> Column:
    """The first that holds: market_closed, clock_skew, stale, high_latency, live."""
    return (
        F.when(~market_open, "market_closed")
        .when(age_us < -skew_s * 1_000_000, "clock_skew")
        .when(age_us > stale_s * 1_000_000, "stale")
        .when(latency_ms > slow_ms, "high_latency")
        .otherwise("live")
    )


def transport_edges(states: DataFrame, keys: list[str], order: str, status: str) -> DataFrame:
    """Running counts of disconnects (edges into disconnected), reconnects (disconnected to live) and rejections."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(status).over(w)
    edges = states.withColumn("__before", before)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    down = (F.col(status) == "disconnected") & ~F.coalesce(F.col("__before") == "disconnected", F.lit(False))
    up = F.coalesce((F.col(status) == "live") & (F.col("__before") == "disconnected"), F.lit(False))
    return edges.select(
        *states.columns,
        F.sum(down.cast("long")).over(so_far).alias("disconnects"),
        F.sum(up.cast("long")).over(so_far).alias("reconnects"),
        F.sum(F.col(status).isin("error", "unavailable").cast("long")).over(so_far).alias("rejections"),
    )


def admission(events: DataFrame, keys: list[str], order: list[str], identity: str, content: str) -> DataFrame:
    """Adds ``verdict``: accepted, repeated (same identity and content), or the reason for refusal."""
    flagged = stream_flags(events, keys, order, identity=identity)
    first = F.first(content).over(Window.partitionBy(*keys, identity).orderBy(*order))
    verdict = (
        F.when(F.col("is_duplicate") & (F.col(content) == first), "repeated")
        .when(F.col("is_duplicate"), "event_identity_conflict")
        .when(F.col("is_out_of_order"), "noncanonical_event")
        .when(~F.coalesce(F.col("price") > 0, F.lit(False)), "nonpositive_price")
        .when(F.col("received_us") < F.col("event_us"), "received_before_event")
        .otherwise("accepted")
    )
    return flagged.select(*events.columns, verdict.alias("verdict"))


def tick_violation(bid: Column, ask: Column) -> Column:
    """The reason why a tick is refused, or null."""
    return (
        F.when(bid.isNull() | ask.isNull(), "missing_price")
        .when((bid <= 0) | (ask <= 0), "nonpositive_price")
        .when(ask < bid, "crossed_market")
    )


def bar_violation(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """The reason why a bar is refused, or null."""
    return (
        F.when(open_.isNull() | high.isNull() | low.isNull() | close.isNull(), "missing_price")
        .when(F.least(open_, high, low, close) <= 0, "nonpositive_price")
        .when((low > F.least(open_, close)) | (high < F.greatest(open_, close)), "invalid_bar_range")
    )


def select_price(source: Column, bid: Column, ask: Column, last: Column) -> Column:
    """The price that ``source`` names (bid, ask, last or mid), doubled so that a mid stays whole; null if missing."""
    return F.when(source == "bid", bid * 2).when(source == "ask", ask * 2).when(source == "last", last * 2).when(source == "mid", bid + ask)
