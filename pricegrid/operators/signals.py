"""Scored signals: evidence for and against at every event, the score, and what may be issued.

Evidence and points are joins on the event, forward fills and expressions; only cooldown and the suppression of
repetitions feed back, and fold over the few rows that could be issued. Cooldown and expiry count events.

Defined results: an event without transition has what the ones before left, but for the matrix, whose transitions go
stale; before the first pivot, while the matrix is unavailable or the regime unknown, and where something was confirmed later
than the event's own time, the action is WAIT. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import cut
from ..functions.folds import ordered_fold
from ..functions.joins import forward_fill
from . import structure as S
from .columns import alignment

# Weights of the components.
WEIGHTS = {"pnf": 20, "structure": 25, "support_resistance": 20, "matrix": 20, "regime": 15, "confirmation": 10, "conflict": 15}


def inputs(events: DataFrame, moves: DataFrame, matrix: DataFrame, resolutions: list[str], structure: str, tolerance: int, width: int = 1 << 16) -> DataFrame:
    """One row for each event, and all that a signal looks at, as of the event.

    Of several transitions at an event, that of the first resolution counts. ``moved_seq`` is the event of the latest one.
    """
    place = F.array_position(F.array(*map(F.lit, resolutions)), F.col("resolution"))
    latest = F.min_by(F.struct("kind", "direction", "to_price", "box", F.col("seq").alias("moved_seq"), F.col("event_us").alias("moved_us")), place).alias("m")
    rows = moves.groupBy("symbol", "seq").agg(latest)
    own = moves.filter(F.col("resolution") == structure)
    key = ["symbol"]
    pivots = S.pivots(own, key)
    by_seq = Window.partitionBy("symbol").orderBy("seq")
    last = [F.struct("kind", "price", "seq").alias("p0"), F.lag(F.struct("kind", "price", "seq"), 1).over(by_seq).alias("p1"), F.lag(F.struct("kind", "price", "seq"), 2).over(by_seq).alias("p2")]
    told_us = F.max("confirmed_us").over(by_seq.rowsBetween(Window.unboundedPreceding, 0)).alias("told_us")
    regime = S.regime(pivots, key).select("symbol", "seq", "label")
    found = S.patterns(pivots, key, tolerance).groupBy("symbol", "seq").agg(
        F.count_if(F.col("direction") == "bullish").alias("bullish_patterns"), F.count_if(F.col("direction") == "bearish").alias("bearish_patterns")
    )
    side = structure_side(F.col("p0"), F.col("p1"), F.col("p2"), tolerance).alias("structure_side")
    known = pivots.select("symbol", "seq", "confirmed_seq", told_us, *last).select("*", side).join(regime, ["symbol", "seq"]).join(found, ["symbol", "seq"], "left").drop("seq").withColumnRenamed("confirmed_seq", "seq")
    levels = S.active_levels(own, key)
    wide = events.select("symbol", "seq", "event_us")
    for part in (matrix.select("symbol", "seq", "alignment"), rows, known, levels):
        wide = wide.join(part, ["symbol", "seq"], "left")
    # pivots, regime, patterns and levels hold until the next confirmation or transition says otherwise
    near = F.struct("support", "resistance")
    filled = {
        "moved": F.col("m"),
        "held": F.when(F.col("p0").isNotNull(), F.struct("p0", "p1", "p2", "label", "bullish_patterns", "bearish_patterns", "told_us", "structure_side")),
        "near": F.when(F.col("support").isNotNull() | F.col("resistance").isNotNull(), near),
    }
    return forward_fill(cut(wide), key, "seq", filled, width).select("symbol", "seq", "event_us", "alignment", "moved.*", "held.*", "near.*")


def evidence(events: DataFrame, moves: DataFrame, facts: DataFrame, resolutions: list[str], structure: str, tolerance: int, stale_after: int = 5, width: int = 1 << 16) -> DataFrame:
    """``inputs`` from what ``structure.facts`` has told, and the place ``at`` of each event within its bucket ``__bucket`` of ``width`` events.

    Events and what is told at them are rows of one table, of which each bucket is sorted once; what the buckets before leave stands in a
    bucket's first rows. A row's place is its event's, and among the rows of an event: what is carried in, facts, transitions (that of the
    first resolution last), the event. ``moves`` and ``facts`` are read several times, so give tables that are written.
    """
    n = len(resolutions)
    k = n + 3  # places of an event
    whole = lambda c, by: F.call_function("div", c, F.lit(by))
    bucket = whole(F.col("seq"), width).alias("__bucket")
    place = F.array_position(F.array(*map(F.lit, resolutions)), F.col("resolution"))
    turned = F.col("seq") * 2 + (F.col("direction") == "X").cast("long")  # grows with seq, so the latest is the greatest
    slots = [f"d{i}" for i in range(n)]
    told = moves.select(
        "symbol", bucket, (F.col("seq") * k + n + 2 - place).alias("at"), *[F.when(F.col("resolution") == r, turned).alias(d) for r, d in zip(resolutions, slots, strict=True)],
        F.struct("kind", "direction", "to_price", "box", F.col("seq").alias("moved_seq"), F.col("event_us").alias("moved_us")).alias("moved"),
    )
    own = facts.filter(F.col("resolution") == structure)
    by_seq = Window.partitionBy("symbol").orderBy("seq")
    pivots = own.filter("fact = 'pivot'").select("symbol", "seq", "us", "state", F.struct("kind", "price", F.col("about").alias("seq")).alias("p"))
    lags = pivots.select("symbol", "seq", F.col("state").alias("label"), F.max("us").over(by_seq.rowsBetween(Window.unboundedPreceding, 0)).alias("told_us"), *[F.lag("p", i).over(by_seq).alias(f"p{i}") for i in range(6)])
    newest_last = [F.col(f"p{i}") for i in range(5, -1, -1)]
    names = S.pattern([p["price"] for p in newest_last], [p["kind"] for p in newest_last], tolerance)
    found = lags.withColumn("names", names).withColumn("side", structure_side(F.col("p0"), F.col("p1"), F.col("p2"), tolerance))
    count = lambda bullish: F.size(F.filter("names", lambda x: x.isin(*S.BULLISH) == bullish)).cast("long")
    at = (F.col("seq") * k + 1).alias("at")
    held = cut(found.select("symbol", bucket, at, F.struct("p0", "p1", "p2", "label", count(True).alias("bullish_patterns"), count(False).alias("bearish_patterns"), "told_us", F.col("side").alias("structure_side")).alias("held")))
    near = own.filter("fact = 'near'").select("symbol", bucket, at, F.struct(F.col("a").alias("support"), F.col("b").alias("resistance")).alias("near"))
    sources = {"moved": told, "held": held, "near": near}

    # what each bucket leaves, by places only; the values are looked up afterwards
    left = told.groupBy("symbol", "__bucket").agg(*[F.max(d).alias(d) for d in slots], F.max("at").alias("moved"))
    left = left.unionByName(held.groupBy("symbol", "__bucket").agg(F.max("at").alias("held")), allowMissingColumns=True).unionByName(near.groupBy("symbol", "__bucket").agg(F.max("at").alias("near")), allowMissingColumns=True)
    ends = events.groupBy("symbol").agg(whole(F.max("seq"), width).alias("to"))
    left = left.unionByName(ends.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), "to")).alias("__bucket")), allowMissingColumns=True)
    left = left.groupBy("symbol", "__bucket").agg(*[F.max(c).alias(c) for c in (*slots, *sources)])
    before = Window.partitionBy("symbol").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(left.select(F.col("symbol").alias("__symbol"), F.col("__bucket").alias("__of"), *[F.max(c).over(before).alias(c) for c in (*slots, *sources)]).filter("__of > 0"))
    first = F.col("__of") * (width * k)
    rows = [events.select("symbol", bucket, (F.col("seq") * k + n + 2).alias("at"), "event_us"), *sources.values(), carried.select(F.col("__symbol").alias("symbol"), F.col("__of").alias("__bucket"), first.alias("at"), *slots)]
    for name, source in sources.items():
        asked = carried.filter(F.col(name).isNotNull()).select("__symbol", "__of", F.col(name).alias("__at"))
        met = source.join(F.broadcast(asked), F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("at") == F.col("__at")))
        rows.append(met.select("symbol", F.col("__of").alias("__bucket"), first.alias("at"), name))
    walk = Window.partitionBy("symbol", "__bucket").orderBy("at")
    last = [F.last(c, ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in (*slots, *sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).select("symbol", "__bucket", "at", "event_us", *last)
    seq = whole(F.col("at"), k)
    of = every.filter(F.col("at") % k == n + 2).select("symbol", seq.alias("seq"), "event_us", "moved.*", "held.*", "near.*", "__bucket", "at", *slots)
    fresh = [F.coalesce(F.col("seq") - F.shiftright(d, 1) < stale_after, F.lit(False)) for d in slots]
    total = lambda x: sum(((f & (F.col(d) % 2 == x)).cast("int") for f, d in zip(fresh, slots, strict=True)), F.lit(0))
    counted = of.select(*of.columns[:-n], total(1).alias("__up"), total(0).alias("__down"))
    return counted.withColumn("alignment", alignment(F.coalesce("__up", F.lit(0)), F.coalesce("__down", F.lit(0)), n)).drop("__up", "__down")


def structure_side(p0: Column, p1: Column, p2: Column, tolerance: int) -> Column:
    """BUY or SELL by the last pivots (p0 is the newest), null while there are fewer than two."""
    def kinds(*names: str) -> Column:
        a, b, c = (p2, p1, p0)
        return (a["kind"] == names[0]) & (b["kind"] == names[1]) & (c["kind"] == names[2])

    low, high = kinds("low", "high", "low"), kinds("high", "low", "high")
    near = F.abs(p2["price"] - p0["price"]) <= tolerance
    return (
        F.when(p1.isNull(), F.lit(None).cast("string"))
        .when(low & near, "BUY").when(high & near, "SELL").when(low & (p0["price"] > p2["price"]), "BUY").when(high & (p0["price"] < p2["price"]), "SELL")
        .when((p1["kind"] == "low") & (p0["kind"] == "high") & (p0["price"] > p1["price"]), "BUY").when((p1["kind"] == "high") & (p0["kind"] == "low") & (p0["price"] < p1["price"]), "SELL")
        .when((p1["kind"] == "low") & (p0["kind"] == "low") & (p0["price"] < p1["price"]), "SELL").when((p1["kind"] == "high") & (p0["kind"] == "high") & (p0["price"] > p1["price"]), "BUY")
        .when(p0["kind"] == "high", "BUY").otherwise("SELL")
    )


def score(rows: DataFrame, tolerance: int, gap_min: int = 8, wait_max: int = 49, action_min: int = 65) -> DataFrame:
    """Adds the side of each component, buy and sell points, the score and the action.

    The side of the structure comes with ``rows``, as it only changes with a pivot: worked out for each event, it made the generated
    method too long to be compiled.
    """
    w = WEIGHTS
    pnf = F.when(F.col("direction") == "X", "BUY").when(F.col("direction") == "O", "SELL")
    near = F.when(F.col("to_price") <= F.col("support"), "BUY").when(F.col("to_price") >= F.col("resistance"), "SELL").otherwise(pnf)
    grid = F.when(F.col("alignment") == "aligned_bullish", "BUY").when(F.col("alignment") == "aligned_bearish", "SELL")
    sided = rows.select(
        *[c for c in rows.columns if c != "structure_side"], pnf.alias("pnf_side"), "structure_side", near.alias("sr_side"), grid.alias("matrix_side"), F.when(F.col("label") == "trend", grid).alias("regime_side"),
    )

    def points(side: str) -> Column:
        parts = [("pnf_side", "pnf"), ("structure_side", "structure"), ("sr_side", "support_resistance"), ("matrix_side", "matrix"), ("regime_side", "regime")]
        total = F.lit(0)
        for column, name in parts:
            total = total + F.when(F.coalesce(F.col(column) == side, F.lit(False)), w[name]).otherwise(0)
        return total

    # each step is a projection of its own that the next one refers to, so everything stays in generated code and is computed once
    up, down = F.coalesce("bullish_patterns", F.lit(0)).cast("int"), F.coalesce("bearish_patterns", F.lit(0)).cast("int")
    later = F.coalesce(F.greatest("told_us", "moved_us") > F.col("event_us"), F.lit(False))
    known = F.col("p0").isNotNull() & F.coalesce(F.col("alignment") != "unavailable", F.lit(False)) & F.coalesce(F.col("label") != "unknown", F.lit(False)) & ~later
    forced = F.coalesce(F.col("alignment") == "mixed", F.lit(False)) | F.coalesce(F.col("label").isin("range", "high_volatility"), F.lit(False))
    led = sided.select("*", points("BUY").alias("__b"), points("SELL").alias("__s"), up.alias("__up"), down.alias("__down"), known.alias("__known"), forced.alias("__forced"))
    b, s, up, down, known, forced = (F.col(f"__{c}") for c in ("b", "s", "up", "down", "known", "forced"))
    # patterns that agree with the leading side confirm it, the others only cost it points
    buy = F.when(b >= s, F.greatest(F.lit(0), F.least(F.lit(100), b + up * w["confirmation"]) - down * w["conflict"])).otherwise(b)
    sell = F.when(b < s, F.greatest(F.lit(0), F.least(F.lit(100), s + down * w["confirmation"]) - up * w["conflict"])).otherwise(s)
    told = led.select(*sided.columns, "__known", "__forced", F.least(F.lit(100), buy).alias("buy_points"), F.least(F.lit(100), sell).alias("sell_points"))
    told = told.select("*", F.abs(F.col("buy_points") - F.col("sell_points")).alias("__gap"))
    gap = F.col("__gap")
    value = F.when(~known, 0).when(forced, F.least(gap, F.lit(wait_max))).otherwise(gap)
    wait = ~known | forced | (gap < gap_min) | (gap <= wait_max) | (gap < action_min)
    action = F.when(wait, "WAIT").when(F.col("buy_points") > F.col("sell_points"), "BUY").otherwise("SELL")
    return told.select(*sided.columns, "buy_points", "sell_points", value.alias("score"), action.alias("action"))


def setup(rows: DataFrame, half_width_percent: int = 50, first_percent: int = 150, second_percent: int = 250) -> DataFrame:
    """Adds zone, stop and targets of BUY and SELL rows; null where the stop lies inside the zone or is missing."""
    half = F.call_function("div", F.col("box") * half_width_percent, F.lit(100))
    last_low = F.when(F.col("p0.kind") == "low", F.col("p0.price")).when(F.col("p1.kind") == "low", F.col("p1.price")).when(F.col("p2.kind") == "low", F.col("p2.price"))
    last_high = F.when(F.col("p0.kind") == "high", F.col("p0.price")).when(F.col("p1.kind") == "high", F.col("p1.price")).when(F.col("p2.kind") == "high", F.col("p2.price"))
    buys, at = F.col("action") == "BUY", F.col("to_price")
    stop = F.when(buys, F.coalesce("support", last_low)).when(F.col("action") == "SELL", F.coalesce("resistance", last_high))
    zoned = rows.select("*", (at - half).alias("__low"), (at + half).alias("__high"), stop.alias("__stop"))
    low, high, stop = F.col("__low"), F.col("__high"), F.col("__stop")
    risk = F.when(buys, low - stop).when(F.col("action") == "SELL", stop - high)
    sized = zoned.select("*", risk.alias("__wide")).select("*", F.when(F.col("__wide") > 0, F.col("__wide")).alias("__risk"))
    risk = F.col("__risk")
    ok, sign = risk.isNotNull(), F.when(buys, 1).otherwise(-1)
    goals = [(at + sign * F.call_function("div", risk * p, F.lit(100))).alias(n) for n, p in (("tp1", first_percent), ("tp2", second_percent))]
    return sized.select(*rows.columns, F.when(ok, low).alias("zone_low"), F.when(ok, high).alias("zone_high"), F.when(ok, stop).alias("stop"), risk.alias("risk"), *goals)


class IssueFold:
    """Which of the rows that could be issued are: none within ``cooldown`` events of the last one, nor the same again while it is active."""

    def __init__(self, cooldown: int, expiry: int):
        self.cooldown, self.expiry, self.last, self.told = cooldown, expiry, None, None

    def step(self, seq: int, action: str, score: int, refs: str) -> Iterable[tuple]:
        if self.last is not None:
            age = seq - self.last
            if age <= self.cooldown or age <= self.expiry and self.told == (action, refs):
                return ()
        self.last, self.told = seq, (action, refs)
        return ((seq, action, score),)

    def finish(self) -> Iterable[tuple]:
        return ()


def issued(scored: DataFrame, cooldown: int = 3, expiry: int = 20) -> DataFrame:
    """symbol, seq, action and score of the signals that are issued; a signal needs a plan. Rows of WAIT change nothing."""
    refs = F.concat_ws("|", "pnf_side", "structure_side", "sr_side", "matrix_side", "regime_side", F.col("p0.seq"), "moved_seq")
    could = setup(scored).filter("action <> 'WAIT' and risk is not null").select("symbol", "seq", "action", "score", refs.alias("refs"))
    return ordered_fold(could, ["symbol"], ["seq"], lambda *_: IssueFold(cooldown, expiry), "symbol string, seq long, action string, score int")


def issue(scored: DataFrame, cooldown: int = 3, expiry: int = 20) -> DataFrame:
    """The signals that are issued and when they expire; ``seq`` is that of the signal, ``at_seq`` that of the event.

    The latest one expires once more than ``expiry`` events have passed; one that another follows before doesn't.
    """
    ends = issued(scored, cooldown, expiry).withColumn("next", F.lead("seq").over(Window.partitionBy("symbol").orderBy("seq")))
    over = F.col("seq") + expiry + 1
    last = scored.groupBy("symbol").agg(F.max("seq").alias("last_seq"))
    states = F.array(F.struct(F.lit("issued").alias("status"), F.col("seq").alias("at_seq")), F.struct(F.lit("expired").alias("status"), over.alias("at_seq")))
    told = ends.join(last, "symbol").withColumn("s", F.explode(states))
    gone = (F.col("s.status") == "issued") | ((over <= F.col("last_seq")) & (F.col("next").isNull() | (F.col("next") >= over)))
    return told.filter(gone).select("symbol", "seq", "action", "s.status", "s.at_seq", "score")
