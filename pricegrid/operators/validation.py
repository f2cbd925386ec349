"""Validation of observations: outcomes in windows of time, their distributions, guards and comparisons of streams.

Null prices and times take no part in a window; of equal times the smaller ``seq`` comes first; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import range_join
from ..functions.scaled import whole
from .outcomes import nearest_ranks

FIELDS = (
    "mfe", "mae", "mfe_boxes", "mae_boxes", "mfe_after_us", "mae_after_us", "end_move", "samples", "max_gap_us", "invalidated_after_us",
)


def time_window_labels(observations: DataFrame, events: DataFrame, reversals: DataFrame, length_us: int, most_gap_us: int) -> DataFrame:
    """Outcomes of observations (symbol, seq, t0, reference, side, box) within ``length_us`` after them.

    A sample counts if both its clocks are after t0 and not after the due time. A window is closed once an event stands
    beyond it; a gap between samples of more than ``most_gap_us`` censors it too. The stop lies one box against the
    side: the first sample at or beyond it invalidates. ``reversals`` (symbol, seq, event_us, direction) turn adverse
    if they point the other way; the first one within the window is given.
    """
    due, t0 = F.col("t0") + length_us, F.col("t0")
    samples = events.select("symbol", F.col("event_us").alias("at"), "received_us", "price", F.col("seq").alias("event_seq"))
    inside = range_join(observations, samples, ["symbol"], "at", t0 + 1, due, length_us)
    inside = inside.filter((F.col("received_us") > t0) & (F.col("received_us") <= due))
    w = Window.partitionBy("symbol", "seq").orderBy("at", "event_seq")
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    inside = inside.withColumn("gap", F.col("at") - F.coalesce(F.lag("at").over(w), t0)).withColumn("move", sign * (F.col("price") - F.col("reference")))
    order = F.struct("at", "event_seq")
    stats = inside.groupBy("symbol", "seq").agg(
        F.count("*").alias("samples"), F.max("gap").alias("max_gap_us"), F.max("move").alias("best"), F.min("move").alias("worst"), F.max_by("move", order).alias("end_move"),
        F.min(F.when(F.col("move") > 0, F.struct((-F.col("move")).alias("m"), "at"))).alias("up"), F.min(F.when(F.col("move") < 0, F.struct(F.col("move").alias("m"), "at"))).alias("down"),
        F.min(F.when(F.col("move") <= -F.col("box"), F.col("at"))).alias("invalidated_us"),
    )
    turns = reversals.select("symbol", F.col("event_us").alias("at"), F.col("seq").alias("turn_seq"), "direction")
    against = F.col("direction") == F.when(F.col("side") == "long", "O").otherwise("X")
    adverse = range_join(observations, turns, ["symbol"], "at", t0, due, length_us).filter(against & (F.col("turn_seq") > F.col("seq")))
    adverse = adverse.groupBy("symbol", "seq").agg(F.min("turn_seq").alias("reversal_seq"))
    last = events.groupBy("symbol").agg(F.max("event_us").alias("last_us"))
    joined = observations.join(stats, ["symbol", "seq"], "left").join(adverse, ["symbol", "seq"], "left").join(last, "symbol")
    n = F.coalesce("samples", F.lit(0)).cast("long")
    status = (
        F.when(F.col("last_us") <= due, "CENSORED_END_OF_DATA").when(F.col("max_gap_us") > most_gap_us, "CENSORED_GAP").when(n == 0, "NO_SAMPLES").otherwise("COMPLETE")
    )
    mfe, mae = F.greatest(F.lit(0), F.col("best")), F.greatest(F.lit(0), -F.col("worst"))
    some = lambda c: F.when(n > 0, c)
    return joined.select(
        "symbol", "seq", "side", status.alias("status"), n.alias("samples"), "max_gap_us", some(mfe).alias("mfe"), some(mae).alias("mae"),
        some(whole(mfe, F.col("box"))).alias("mfe_boxes"), some(whole(mae, F.col("box"))).alias("mae_boxes"),
        (F.col("up.at") - t0).alias("mfe_after_us"), (F.col("down.at") - t0).alias("mae_after_us"), "end_move", (F.col("invalidated_us") - t0).alias("invalidated_after_us"), "reversal_seq",
    )


def distributions(labels: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Count, nearest ranks and mean of each field of the complete labels, by ``keys`` and field."""
    flat = labels.filter("status = 'COMPLETE'").unpivot(keys, list(fields), "field", "v")
    ranks = nearest_ranks(flat, [*keys, "field"], "v", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    means = flat.groupBy(*keys, "field").agg(F.round(F.avg("v"), 4).alias("mean"))
    return ranks.join(means, [*keys, "field"])


def look_ahead(evidence_event: Column, evidence_known: Column, event: Column, known: Column) -> Column:
    """Why evidence may not be used at an event, or null: it happened later, or was known later; null evidence is missing."""
    return F.when(evidence_event.isNull() | evidence_known.isNull(), "evidence_missing").when(evidence_event > event, "evidence_after_event").when(evidence_known > known, "evidence_known_later")


def compare_streams(left: DataFrame, right: DataFrame, keys: list[str], content: list[str], group: str) -> DataFrame:
    """Rows of two streams met by ``keys`` (null keys meet nothing): how many are equal in content, differ, or stand alone."""
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in content])
    a, b = left.select(*keys, said.alias("a")), right.select(*keys, said.alias("b"))
    met = a.join(b, keys, "full")
    same = F.col("a") == F.col("b")
    return met.groupBy(group).agg(
        F.count_if(same).alias("equal"), F.count_if(~same).alias("different"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only")
    )


def canonical_decimal(value: Column, digits: int = 3) -> Column:
    """A whole number of 10 ** -digits as text without trailing zeros, and 0 for zero."""
    size, scale = F.abs(value), 10**digits
    rest = F.rtrim(F.lpad((size % scale).cast("string"), digits, "0"), F.lit("0"))
    text = F.concat(whole(size, scale).cast("string"), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def canonical_time(us: Column, fixed: bool) -> Column:
    """Microseconds since 1970 as ISO text whatever the session's zone: with six digits and Z, or with +00:00 and digits only if there are any."""
    day, rest = F.date_from_unix_date(whole(us - F.pmod(us, F.lit(86_400_000_000)), 86_400_000_000).cast("int")), F.pmod(us, F.lit(86_400_000_000))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(whole(rest, 3_600_000_000)), two(whole(rest, 60_000_000) % 60), two(whole(rest, 1_000_000) % 60))
    digits = F.concat(F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"))
    head = F.concat(day.cast("string"), F.lit("T"), clock)
    return F.concat(head, digits, F.lit("Z")) if fixed else F.concat(head, F.when(rest % 1_000_000 == 0, "").otherwise(digits), F.lit("+00:00"))


def latest_pivots(moves: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The last confirmed low and high at each transition (null before there is one)."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = moves.select(*keys, "seq").join(found.select(*keys, F.col("confirmed_seq").alias("seq"), "kind", "price"), [*keys, "seq"], "left")
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("price")), ignorenulls=True).over(w)
    return rows.select(*keys, "seq", last("low").alias("low"), last("high").alias("high"))
