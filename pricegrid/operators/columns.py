"""Point and figure: box sizes, columns, cells, and the matrix of several resolutions. Prices in thousandths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import cut
from ..functions.folds import ordered_fold
from ..functions.joins import forward_fill
from ..functions.scaled import divide_half_even

TRANSITION = "seq long, event_us long, kind string, column_id int, direction string, from_price long, to_price long, boxes int, box long"


def atr_box(
    events: DataFrame, keys: list[str], order: str, price: str = "price", period: int = 14, multiplier_percent: int = 100,
    least: int = 100, most: int = 50_000, fixed: int = 1_000, step: int = 1,
) -> DataFrame:
    """Adds box and reason: the average of the last ``period`` true ranges, times the multiplier, within bounds.

    The first row and the rows before ``period`` ranges exist get the fixed box; without any movement the last
    sized box holds. Windows say all of it; there is no fold.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    moved = events.withColumn("__range", F.abs(F.col(price) - F.lag(price).over(w))).withColumn("__n", F.row_number().over(w) - 1)
    total = F.sum("__range").over(w.rowsBetween(-(period - 1), 0))
    sized = moved.withColumn("__sum", F.when(F.col("__n") >= period, total))
    raw = F.least(F.greatest(F.col("__sum") * multiplier_percent, F.lit(least * 100 * period)), F.lit(most * 100 * period))
    rounded = divide_half_even(raw, 100 * period * step) * step
    smallest = max(step, -(-least // step) * step)
    sized = sized.withColumn("__own", F.when(F.col("__sum") > 0, F.when(rounded > 0, rounded).otherwise(F.lit(smallest))))
    held = F.last("__own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    reason = (
        F.when(F.col("__n") == 0, "warmup_missing_previous")
        .when(F.col("__n") < period, "warmup_insufficient_window")
        .when(F.col("__sum") == 0, "zero_volatility_hold_last")
        .when(rounded <= 0, "quantized_to_min")
        .otherwise("atr")
    )
    kept = [c for c in events.columns if c not in ("box", "reason")]
    return sized.select(*kept, F.coalesce(held, F.lit(fixed)).alias("box"), reason.alias("reason"))


class ColumnFold:
    """At most one transition for each price: seed, extension or reversal, by inclusive thresholds."""

    def __init__(self, reversal: int):
        self.reversal, self.seed, self.direction, self.edge, self.column = reversal, None, None, 0, 0

    def step(self, seq: int, event_us: int, price: int | None, box: int | None) -> Iterable[tuple]:
        if price is None or not box or box <= 0:
            return ()
        if self.seed is None:
            self.seed = price
            return ()
        if self.direction is None:
            start, n = self.seed, abs(price - self.seed) // box
            if n < 1:
                return ()
            self.direction, self.column = ("X" if price > start else "O"), 1
            kind = "seed"
        else:
            start = self.edge
            ahead = price - start if self.direction == "X" else start - price
            if ahead >= box:
                kind, n = "extension", ahead // box
            elif -ahead >= self.reversal * box:
                kind, n = "reversal", -ahead // box
                self.direction, self.column = ("O" if self.direction == "X" else "X"), self.column + 1
            else:
                return ()
        self.edge = start + n * box if self.direction == "X" else start - n * box
        return ((seq, event_us, kind, self.column, self.direction, start, self.edge, n, box),)

    def finish(self) -> Iterable[tuple]:
        return ()


def transitions(events: DataFrame, keys: list[str], reversal: int = 3) -> DataFrame:
    """``events`` (keys, seq, event_us, price, box) -> keys and the transitions, one at most for each event."""
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), TRANSITION])
    return ordered_fold(events.select(*keys, "seq", "event_us", "price", "box"), keys, ["seq"], lambda *_: ColumnFold(reversal), schema)


def fan_out(events: DataFrame, resolutions: dict[str, int]) -> DataFrame:
    """Every event for every resolution, with the resolution's fixed box."""
    pairs = F.array(*[F.struct(F.lit(n).alias("resolution"), F.lit(b).cast("long").alias("box")) for n, b in resolutions.items()])
    return events.withColumn("__r", F.explode(pairs)).select(*events.columns, "__r.resolution", "__r.box")


def columns(moves: DataFrame, keys: list[str]) -> DataFrame:
    """The columns: direction, open, close, boxes, first and last event."""
    first = F.min_by(F.struct("from_price", "kind", "box", "event_us"), "seq")
    return (
        moves.groupBy(*keys, "column_id")
        .agg(F.max("direction").alias("direction"), first.alias("f"), F.max_by("to_price", "seq").alias("close_price"), F.sum("boxes").alias("boxes"), F.max("event_us").alias("updated_us"))
        .select(
            *keys, "column_id", "direction",
            # a reversal opens one box inside the old column's extreme
            F.when(F.col("f.kind") == "seed", F.col("f.from_price"))
            .when(F.col("direction") == "X", F.col("f.from_price") + F.col("f.box")).otherwise(F.col("f.from_price") - F.col("f.box")).alias("open_price"),
            "close_price", "boxes", F.col("f.event_us").alias("started_us"), "updated_us",
        )
    )


def cells(moves: DataFrame, keys: list[str], newest: int = 3000) -> DataFrame:
    """One row for each box of each transition, the newest ``newest`` of a key (a report's limit)."""
    sign = F.when(F.col("direction") == "X", 1).otherwise(-1)
    exploded = moves.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("boxes"))))
    start = F.col("from_price") + sign * F.col("box") * (F.col("i") - 1)
    made = exploded.select(*keys, "seq", "i", "column_id", "direction", F.least(start, start + sign * F.col("box")).alias("low"), F.greatest(start, start + sign * F.col("box")).alias("high"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq"), F.desc("i")))
    return made.withColumn("age", nth).filter(F.col("age") <= newest)


def matrix(events: DataFrame, moves: DataFrame, key: str, resolutions: list[str], stale_after: int = 5, width: int = 1 << 18) -> DataFrame:
    """For each event: how many resolutions are ready, their directions, alignment and strength.

    An event is one row for all resolutions, whose last transitions are filled forward within buckets of ``width`` events.
    """
    own = [F.when(F.col("resolution") == r, F.col("direction")) for r in resolutions]
    none = [F.lit(None).cast("string")] * len(resolutions)
    named = lambda values: [v.alias(f"d{i}") for i, v in enumerate(values)]
    # transitions happen at events: a union and one aggregate replace a join
    rows = events.select(key, "seq", *named(none)).unionByName(moves.select(key, "seq", *named(own)))
    merged = cut(rows.groupBy(key, "seq").agg(*[F.max(f"d{i}").alias(f"d{i}") for i in range(len(resolutions))]))
    filled = forward_fill(merged, [key], "seq", {f"got{i}": F.when(F.col(f"d{i}").isNotNull(), F.struct(F.col(f"d{i}").alias("direction"), "seq")) for i in range(len(resolutions))}, width)
    got = [F.col(f"got{i}") for i in range(len(resolutions))]
    fresh = [g.isNotNull() & (F.col("seq") - g["seq"] < stale_after) for g in got]
    total = lambda conditions: sum((F.coalesce(c, F.lit(False)).cast("long") for c in conditions), F.lit(0).cast("long"))
    n = len(resolutions)
    counts = filled.select(
        key, "seq", total(f & (g["direction"] == "X") for f, g in zip(fresh, got, strict=True)).alias("bullish"), total(f & (g["direction"] == "O") for f, g in zip(fresh, got, strict=True)).alias("bearish"),
        total(g.isNotNull() & ~f for f, g in zip(fresh, got, strict=True)).alias("stale"), total(g.isNull() for g in got).alias("warmup"),
    )
    ready = F.col("bullish") + F.col("bearish") == n
    strength = F.when(~ready, 0).when((F.col("bullish") == n) | (F.col("bearish") == n), 3).otherwise(F.abs(F.col("bullish") - F.col("bearish")).cast("int"))
    return counts.select(key, "seq", "bullish", "bearish", "stale", "warmup", alignment(F.col("bullish"), F.col("bearish"), n).alias("alignment"), strength.alias("strength"))


def alignment(bullish: Column, bearish: Column, resolutions: int) -> Column:
    """unavailable unless every resolution has a direction that isn't stale."""
    return (
        F.when(bullish + bearish != resolutions, "unavailable").when(bullish == resolutions, "aligned_bullish").when(bearish == resolutions, "aligned_bearish").otherwise("mixed")
    )


def decision_bias(bullish: Column, bearish: Column, resolutions: int) -> Column:
    """BULLISH or BEARISH if all resolutions agree, a lean if one side leads, MIXED at a tie, UNAVAILABLE without directions."""
    return (
        F.when(bullish + bearish == 0, "UNAVAILABLE").when(bullish == resolutions, "BULLISH").when(bearish == resolutions, "BEARISH")
        .when(bullish > bearish, "BULLISH_LEAN").when(bearish > bullish, "BEARISH_LEAN").otherwise("MIXED")
    )


def decision_state(bias: Column, action: Column) -> Column:
    """DIRECTION_CONFIRMED where bias and action agree fully."""
    return (
        F.when(((bias == "BULLISH") & (action == "BUY")) | ((bias == "BEARISH") & (action == "SELL")), "DIRECTION_CONFIRMED")
        .when(bias.isin("MIXED", "UNAVAILABLE"), "UNAVAILABLE").otherwise("DEVELOPING")
    )
