"""What transitions say: pivots, levels, chart patterns, regime, trendlines, readiness. Prices in thousandths."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folds import ordered_fold


def pivots(moves: DataFrame, keys: list[str]) -> DataFrame:
    """A transition whose target stands above (below) both its neighbours' is a high (low), known at the next one."""
    w = Window.partitionBy(*keys).orderBy("seq")
    near = moves.select(
        *keys, F.col("seq").alias("confirmed_seq"), F.col("event_us").alias("confirmed_us"), F.col("to_price").alias("right"),
        F.lag("to_price", 1).over(w).alias("price"), F.lag("to_price", 2).over(w).alias("left"),
        F.lag("seq", 1).over(w).alias("seq"), F.lag("event_us", 1).over(w).alias("event_us"), F.lag("column_id", 1).over(w).alias("column_id"),
    )
    high = (F.col("price") > F.col("left")) & (F.col("price") > F.col("right"))
    low = (F.col("price") < F.col("left")) & (F.col("price") < F.col("right"))
    kind = F.when(high, "high").when(low, "low")
    return near.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*keys, "seq", "event_us", "kind", "price", "column_id", "confirmed_seq", "confirmed_us")


class LevelFold:
    """Open levels in two heaps: a transition closes those that it passes, each once."""

    def __init__(self):
        self.supports: list[tuple] = []
        self.resistances: list[tuple] = []

    def step(self, seq: int, event_us: int, to_price: int, pivot_seq: int | None, kind: str | None, price: int | None) -> Iterable[tuple]:
        out = []
        while self.supports and -self.supports[0][0] > to_price:
            p, s, c = heapq.heappop(self.supports)
            out.append((s, "support", -p, c, "invalidated", seq))
        while self.resistances and self.resistances[0][0] < to_price:
            p, s, c = heapq.heappop(self.resistances)
            out.append((s, "resistance", p, c, "invalidated", seq))
        if kind == "low":
            heapq.heappush(self.supports, (-price, pivot_seq, seq))
        elif kind == "high":
            heapq.heappush(self.resistances, (price, pivot_seq, seq))
        return out

    def finish(self) -> Iterable[tuple]:
        yield from ((s, "support", -p, c, "confirmed", None) for p, s, c in sorted(self.supports))
        yield from ((s, "resistance", p, c, "confirmed", None) for p, s, c in sorted(self.resistances))


def levels(moves: DataFrame, keys: list[str]) -> DataFrame:
    """Support and resistance with the first later transition that passed them, if any.

    The transition that confirms a level can't pass it, as the fold closes before it opens.
    """
    found = pivots(moves, keys).select(*keys, F.col("seq").alias("pivot_seq"), "kind", "price", F.col("confirmed_seq").alias("seq"))
    rows = moves.select(*keys, "seq", "event_us", "to_price").join(found, [*keys, "seq"], "left")
    types = {f.name: f.dataType.simpleString() for f in moves.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "pivot_seq long, side string, price long, confirmed_seq long, status string, invalidated_seq long"])
    return ordered_fold(rows.select(*keys, "seq", "event_us", "to_price", "pivot_seq", "kind", "price"), keys, ["seq"], lambda *_: LevelFold(), schema)


def pattern(p: list[Column], k: list[Column], tolerance: int) -> Column:
    """The chart patterns that the last pivots form: array of names. p and k: prices and kinds, newest last (6 each)."""

    def kinds(text: str) -> Column:
        ok = F.lit(True)
        for have, want in zip(k[-len(text) :], text, strict=True):
            ok = ok & (have == {"H": "high", "L": "low"}[want])
        return F.coalesce(ok, F.lit(False))

    a, b, c, d, e, f = p
    near = F.abs(a - e) <= tolerance
    shoulders = kinds("HLHLHL") & (c > F.greatest(a, e) + tolerance) & near & (f < F.least(b, d))
    inverse = kinds("LHLHLH") & (c < F.least(a, e) - tolerance) & near & (f > F.greatest(b, d))
    found = {
        "double_bottom": kinds("LHL") & (F.abs(d - f) <= tolerance),
        "double_top": kinds("HLH") & (F.abs(d - f) <= tolerance),
        "failed_breakdown": kinds("LHLH") & (e < c) & (f > d),
        "failed_breakout": kinds("HLHL") & (e > c) & (f < d),
        "head_and_shoulders": shoulders,
        "inverse_head_and_shoulders": inverse,
        "triangle_breakdown": kinds("HLHLHL") & ~F.coalesce(shoulders, F.lit(False)) & (a > c) & (c > e) & (b < d) & (f < b),
        "triangle_breakout": kinds("LHLHLH") & ~F.coalesce(inverse, F.lit(False)) & (a < c) & (c < e) & (b > d) & (f > b),
    }
    return F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), name) for name, ok in found.items()]), lambda x: x.isNotNull())


BULLISH = ("double_bottom", "inverse_head_and_shoulders", "triangle_breakout", "failed_breakdown")


def patterns(found: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """One row for each pattern that a newly confirmed pivot completes, with the pivot that supersedes its window."""
    w = Window.partitionBy(*keys).orderBy("seq")
    p = [F.lag("price", i).over(w) for i in range(5, -1, -1)]
    k = [F.lag("kind", i).over(w) for i in range(5, -1, -1)]
    wide = found.select(
        *keys, "seq", "confirmed_seq", F.lead("confirmed_seq").over(w).alias("expired_seq"),
        *[c.alias(f"p{i}") for i, c in enumerate(p)], *[c.alias(f"k{i}") for i, c in enumerate(k)],
    )
    names = pattern([F.col(f"p{i}") for i in range(6)], [F.col(f"k{i}") for i in range(6)], tolerance)
    rows = wide.withColumn("name", F.explode(names))
    return rows.select(*keys, "seq", "confirmed_seq", "name", F.when(F.col("name").isin(*BULLISH), "bullish").otherwise("bearish").alias("direction"), "expired_seq")


class RegimeFold:
    """The label with hysteresis; slope and width come from a window."""

    def __init__(self, trend: int, volatile: int, hysteresis: int):
        self.trend, self.volatile, self.hysteresis, self.label = trend, volatile, hysteresis, "unknown"

    def step(self, seq: int, slope: int | None, width: int | None, n: int) -> Iterable[tuple]:
        if n < 2:
            label, reason = "unknown", "warmup"
        else:
            if width >= self.volatile:
                label, reason = "high_volatility", "volatility_width_threshold"
            elif abs(slope) >= self.trend:
                label, reason = "trend", "trend_slope_threshold"
            else:
                label, reason = "range", "range_compaction"
            leaves = self.label == "high_volatility" and width >= self.volatile - self.hysteresis
            fades = self.label == "trend" and label == "range" and abs(slope) >= self.trend - self.hysteresis
            if label != self.label and (leaves or fades):
                label, reason = self.label, "hysteresis_hold"
        self.label = label
        return ((seq, slope, width, label, reason),)

    def finish(self) -> Iterable[tuple]:
        return ()


def regime(found: DataFrame, keys: list[str], lookback: int = 4, trend: int = 30_000, volatile: int = 90_000, hysteresis: int = 5_000) -> DataFrame:
    """The regime at each pivot, from the last ``lookback`` of them."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(-(lookback - 1), 0)
    rows = found.select(
        *keys, "seq", (F.col("price") - F.first("price").over(w)).alias("slope"), (F.max("price").over(w) - F.min("price").over(w)).alias("width"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "seq long, slope long, width long, label string, reason string"])
    return ordered_fold(rows, keys, ["seq"], lambda *_: RegimeFold(trend, volatile, hysteresis), schema)


class TrendlineFold:
    """One line for each side: rising lows, falling highs. Distances are compared times the run between anchors, so they stay whole."""

    def __init__(self):
        self.seq = 0
        self.pool: dict[str, list[tuple[int, int, int]]] = {"low": [], "high": []}
        self.line: dict[str, dict | None] = {"low": None, "high": None}

    def step(self, seq: int, column: int, to_price: int, box: int, kind: str | None, price: int | None, pivot_column: int | None, pivot_seq: int | None) -> Iterable[tuple]:
        self.seq += 1
        out: list[tuple] = []
        if kind:
            self.pool[kind] = [*self.pool[kind][-1:], (price, pivot_column, pivot_seq)]
        for side, sign in (("low", 1), ("high", -1)):
            line = self.line[side]
            if line and line["state"] in ("active", "broken", "retesting"):
                run = line["b"][1] - line["a"][1]
                # sign * distance to the projection, times run; negative: the wrong side
                far = sign * ((to_price - line["b"][0]) * run - (line["b"][0] - line["a"][0]) * (column - line["b"][1]))
                wide = box * run
                if line["state"] == "active":
                    new = "broken" if far < 0 else "touch" if far < wide else None
                elif line["state"] == "broken":
                    new = "retesting" if abs(far) < wide else None
                else:
                    new = "retest_held" if far <= -wide else "retest_failed" if far >= wide else None
                if new:
                    out.append(self.row(seq, side, line, new, column))
                    if new != "touch":
                        line["state"] = new
                    if new.startswith("retest_"):
                        line["resolved"] = self.seq
        for side, sign in (("low", 1), ("high", -1)):
            if len(self.pool[side]) < 2:
                continue
            a, b = self.pool[side]
            line = self.line[side]
            if a[1] == b[1] or sign * (b[0] - a[0]) <= 0:
                continue
            if line and (line["state"] in ("active", "retesting") or self.seq <= line["resolved"] or (line["a"][2], line["b"][2]) == (a[2], b[2])):
                continue
            if line:
                out.append(self.row(seq, side, line, "replaced", column))
            self.line[side] = {"a": a, "b": b, "state": "active", "resolved": 0}
            out.append(self.row(seq, side, self.line[side], "active", column))
        return out

    @staticmethod
    def row(seq: int, side: str, line: dict, state: str, column: int) -> tuple:
        kind = "bullish_support" if side == "low" else "bearish_resistance"
        return (seq, kind, line["a"][2], line["b"][2], line["a"][0], line["b"][0], state, column - line["b"][1])

    def finish(self) -> Iterable[tuple]:
        return ()


def trendlines(moves: DataFrame, keys: list[str]) -> DataFrame:
    """The life of each line as rows: active, touch, broken, retesting, retest_held or retest_failed, replaced."""
    found = pivots(moves, keys).select(*keys, F.col("confirmed_seq").alias("seq"), "kind", "price", F.col("column_id").alias("pivot_column"), F.col("seq").alias("pivot_seq"))
    rows = moves.select(*keys, "seq", "column_id", "to_price", "box").join(found, [*keys, "seq"], "left")
    types = {f.name: f.dataType.simpleString() for f in moves.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "seq long, kind string, anchor_a_seq long, anchor_b_seq long, anchor_a_price long, anchor_b_price long, state string, age_columns int"])
    ordered = rows.select(*keys, "seq", "column_id", "to_price", "box", "kind", "price", "pivot_column", "pivot_seq")
    return ordered_fold(ordered, keys, ["seq"], lambda *_: TrendlineFold(), schema)


FACT = "fact string, seq long, us long, about long, kind string, price long, a long, b long, state string, reason string"


class FactFold:
    """Pivots with their regime, passed levels, lines and standing levels, all in one walk through a key's transitions."""

    def __init__(self, standing: bool, lookback: int, trend: int, volatile: int, hysteresis: int):
        self.levels, self.lines, self.active = LevelFold(), TrendlineFold(), ActiveFold() if standing else None
        self.label, self.prices, self.lookback = RegimeFold(trend, volatile, hysteresis), [], lookback
        self.left = self.last = self.near = None
        self.touched: dict[str, tuple | None] = {}

    def step(self, seq: int, event_us: int, column: int, to_price: int, box: int) -> Iterable[tuple]:
        out: list[tuple] = []
        about = kind = price = of_column = None
        if self.left is not None:
            before, (at, price, of_column) = self.left[1], self.last
            kind = "high" if price > before and price > to_price else "low" if price < before and price < to_price else None
            about = at if kind else None
        self.left, self.last = self.last, (seq, to_price, column)
        if kind:
            self.prices = [*self.prices[1 - self.lookback :], price] if self.lookback > 1 else [price]
            slope, width = price - self.prices[0], max(self.prices) - min(self.prices)
            for _, _, _, label, reason in self.label.step(seq, slope, width, len(self.prices)):
                out.append(("pivot", seq, event_us, about, kind, price, slope, width, label, reason))
        else:
            price = None
        for of, side, p, _, _, lost in self.levels.step(seq, event_us, to_price, about, kind, price):
            out.append(("lost", lost, event_us, of, side, p, None, None, None, None))
        for _, line, a, b, _, _, state, _ in self.lines.step(seq, column, to_price, box, kind, price, of_column, about):
            if state == "touch":
                if self.touched.get(line) == (a, b):
                    continue
                self.touched[line] = (a, b)
            out.append(("line", seq, event_us, None, line, None, a, b, state, None))
        if self.active is not None:
            for _, *near in self.active.step(seq, to_price, kind, price):
                if near != self.near and near != [None, None]:
                    self.near = near
                    out.append(("near", seq, event_us, None, None, None, *near, None, None))
        return out

    def finish(self) -> Iterable[tuple]:
        return ()


def facts(moves: DataFrame, keys: list[str], standing: Callable[..., bool], lookback: int = 4, trend: int = 30_000, volatile: int = 90_000, hysteresis: int = 5_000) -> DataFrame:
    """What transitions say, told apart by ``fact``, each at the ``seq`` where it becomes known; one shuffle and one walk for all of it.

    pivot: ``about`` (its event), kind, price, and the regime that it leaves (a: slope, b: width, state: label, reason), as ``pivots`` and ``regime``
    have them. lost: the pivot that a level is ``about``, kind (its side), price, as the invalidated ones of ``levels``. line: kind, a and b (events of
    the anchors) and state, as ``trendlines``, but only the first touch of a line. near: a (support) and b (resistance) of ``active_levels`` wherever
    they change and one holds, for those keys for which ``standing`` is true.
    """
    types = {f.name: f.dataType.simpleString() for f in moves.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), FACT])
    rows = moves.select(*keys, "seq", "event_us", "column_id", "to_price", "box")
    return ordered_fold(rows, keys, ["seq"], lambda *key: FactFold(standing(*key), lookback, trend, volatile, hysteresis), schema)


def readiness(action: Column, line_state: Column) -> Column:
    """Entry readiness of an action against the state of its aligned trendline (null: none)."""
    return (
        F.when(action == "WAIT", "NOT_READY")
        .when(line_state.isNull() | line_state.isin("active", "retest_failed"), "READY")
        .when(line_state == "retesting", "DEVELOPING")
        .when(line_state.isin("broken", "retest_held"), "BLOCKED")
    )


def active_levels(moves: DataFrame, keys: list[str]) -> DataFrame:
    """For each transition, the price of the latest confirmed and not yet passed level of each side.

    A fold over the transitions, as the latest level that still holds needs the history of passed ones.
    """
    found = pivots(moves, keys).select(*keys, "kind", "price", F.col("confirmed_seq").alias("seq"))
    rows = moves.select(*keys, "seq", "to_price").join(found, [*keys, "seq"], "left")
    types = {f.name: f.dataType.simpleString() for f in moves.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "seq long, support long, resistance long"])
    return ordered_fold(rows.select(*keys, "seq", "to_price", "kind", "price"), keys, ["seq"], lambda *_: ActiveFold(), schema)


def standing_levels(moves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, side, price, status at each transition: the levels that stand (confirmed), or, as long as the key has had no level, one support
    at the transition's own price that is unavailable. A transition behind the first level where none stands has no row."""
    began = pivots(moves, keys).groupBy(*keys).agg(F.min("confirmed_seq").alias("began"))
    here = active_levels(moves, keys).unpivot([*keys, "seq"], ["support", "resistance"], "side", "price").filter("price is not null").withColumn("status", F.lit("confirmed"))
    none = moves.join(began, keys, "left").filter("began is null or seq < began")
    none = none.select(*keys, "seq", F.lit("support").alias("side"), F.col("to_price").alias("price"), F.lit("unavailable").alias("status"))
    return here.unionByName(none)


class ActiveFold:
    """Stacks of open levels by age. An older level that is passed no later than a newer one is never asked for,
    so each stack keeps only levels that outlast what came after them."""

    def __init__(self):
        self.supports: list[int] = []
        self.resistances: list[int] = []

    def step(self, seq: int, to_price: int, kind: str | None, price: int | None) -> Iterable[tuple]:
        while self.supports and self.supports[-1] > to_price:
            self.supports.pop()
        while self.resistances and self.resistances[-1] < to_price:
            self.resistances.pop()
        if kind == "low":
            while self.supports and self.supports[-1] >= price:
                self.supports.pop()
            self.supports.append(price)
        elif kind == "high":
            while self.resistances and self.resistances[-1] <= price:
                self.resistances.pop()
            self.resistances.append(price)
        return ((seq, self.supports[-1] if self.supports else None, self.resistances[-1] if self.resistances else None),)

    def finish(self) -> Iterable[tuple]:
        return ()
