"""Trades and positions as automata: requested states, and execution results applied to a position.

A request moves a trade only along an edge of the table. What a run of requests does to every possible state is a map from states
to states, and maps compose: so a long history is folded in segments at the same time, the segments' maps in segments of
their own, and only then, from the top down, each segment learns the state it starts in. No task holds more than a segment.

Defined results: requests for an unknown or null state, and those that no edge allows, are refused and change nothing; asking for
the state that holds is accepted and changes nothing. Rows of equal order are taken by all their columns; null keys are a key; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import cut
from ..functions.folds import ordered_fold

# The states of a trade and the edges between them; states without an entry are final.
STATES = ("SETUP", "WAIT_ENTRY", "ENTRY_PENDING", "OPEN", "MANAGING", "EXIT_PENDING", "CLOSED", "BLOCKED", "REJECTED", "CANCELLED", "EMERGENCY")
EDGES = {
    "SETUP": ("WAIT_ENTRY", "BLOCKED", "CANCELLED"), "WAIT_ENTRY": ("ENTRY_PENDING", "BLOCKED", "REJECTED", "CANCELLED"), "ENTRY_PENDING": ("OPEN", "REJECTED", "EMERGENCY"),
    "OPEN": ("MANAGING", "EXIT_PENDING", "EMERGENCY"), "MANAGING": ("EXIT_PENDING", "EMERGENCY"), "EXIT_PENDING": ("CLOSED", "EMERGENCY"),
}
SEGMENT = 64


def edge_table(states: tuple[str, ...], edges: dict[str, tuple[str, ...]]) -> list[int]:
    """The state after each (state, requested state), both by number; a number more stands for an unknown request."""
    n = len(states)
    return [r if r < n and (states[r] in edges.get(states[s], ()) or r == s) else s for s in range(n) for r in range(n + 1)]


def run_automaton(
    requests: DataFrame, keys: list[str], place: str, requested: str, states: tuple[str, ...] = STATES, edges: dict[str, tuple[str, ...]] = EDGES, start: str = "SETUP", segment: int = SEGMENT
) -> DataFrame:
    """keys, place, requested, before, after, accepted. ``place`` numbers a key's requests 0, 1, 2, ..."""
    n = len(states)
    table = F.array(*map(F.lit, edge_table(states, edges)))
    move = lambda s, r: F.get(table, s * (n + 1) + r)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, states)), F.col(requested)), F.lit(0)).cast("int")
    asked = requests.select(*keys, place, requested, F.when(code > 0, code - 1).otherwise(n).alias("r"))
    seg = F.call_function("div", F.col(place), F.lit(segment))
    packed = asked.groupBy(*keys, seg.alias("seg")).agg(F.array_sort(F.collect_list(F.struct(place, "r", requested))).alias("rows"))
    effect = F.transform(F.array(*map(F.lit, range(n))), lambda s: F.aggregate("rows", s, lambda t, x: move(t, x["r"])))
    packed = cut(packed.withColumn("effect", effect))

    def entered(level: DataFrame) -> DataFrame:
        """keys, seg, state: the state in which each segment of this level starts."""
        if not level.filter("seg > 0").limit(1).count():
            return level.select(*keys, "seg", F.lit(states.index(start)).alias("state"))
        up = level.groupBy(*keys, F.call_function("div", F.col("seg"), F.lit(segment)).alias("of")).agg(F.array_sort(F.collect_list(F.struct("seg", "effect"))).alias("parts"))
        whole = F.transform(F.array(*map(F.lit, range(n))), lambda s: F.aggregate("parts", s, lambda t, p: F.get(p["effect"], t)))
        up = cut(up.withColumn("effect", whole))
        above = entered(up.select(*keys, F.col("of").alias("seg"), "effect"))
        met = up.join(above.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("seg").alias("__of"), "state"), _same(keys) & (F.col("of") == F.col("__of")))
        begin = F.struct(F.col("state").alias("s"), F.array().cast("array<int>").alias("out"))
        walk = F.aggregate("parts", begin, lambda a, p: F.struct(F.get(p["effect"], a["s"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"]
        return met.select(*keys, F.explode(F.zip_with("parts", walk, lambda p, s: F.struct(p["seg"].alias("seg"), s.alias("state")))).alias("e")).select(*keys, "e.seg", "e.state")

    starts = entered(packed.select(*keys, "seg", "effect")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("seg").alias("__seg"), "state")
    met = packed.join(starts, _same(keys) & (F.col("seg") == F.col("__seg")))
    begin = F.struct(F.col("state").alias("s"), F.array().cast("array<int>").alias("out"))
    walk = F.aggregate("rows", begin, lambda a, x: F.struct(move(a["s"], x["r"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"]
    each = met.select(*keys, F.explode(F.zip_with("rows", walk, lambda x, s: F.struct(x.alias("x"), s.alias("s")))).alias("e"))
    name = lambda s: F.get(F.array(*map(F.lit, states)), s)
    after = move(F.col("e.s"), F.col("e.x.r"))
    return each.select(
        *keys, F.col(f"e.x.{place}").alias(place), F.col(f"e.x.{requested}").alias(requested), name(F.col("e.s")).alias("before"), name(after).alias("after"), (after == F.col("e.x.r")).alias("accepted")
    )


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return same


def opening_code(stop: Column, targets: Column, quantity: Column) -> Column:
    """Why a signal can't open a position, null where it can."""
    return (
        F.when(stop.isNull(), "signal_decision_missing_invalidation_price").when(targets.isNull() | (F.size(targets) == 0), "signal_decision_missing_targets")
        .when(quantity.isNull() | (quantity <= 0), "invalid_opening_quantity")
    )


def result_code(position: str = "position", request: str = "request", result: str = "result") -> Column:
    """Why a result can't belong to its position and request (struct columns), null where it can; the first rule that fails."""
    p, q, r = F.col(position), F.col(request), F.col(result)
    differs = lambda a, b: ~a.eqNullSafe(b)
    return (
        F.when(r["action"].isNull(), "result_action_required")
        .when((q["action"] == "OPEN") | (r["action"] == "OPEN"), "open_result_not_applicable")
        .when(differs(r["action"], q["action"]), "result_action_mismatch")
        .when(differs(r["request_ref"], q["request_id"]), "result_request_mismatch")
        .when(differs(q["position_ref"], p["position_id"]), "request_position_mismatch")
        .when(r["position_ref"].isNotNull() & differs(r["position_ref"], q["position_ref"]), "result_position_mismatch")
        .when(differs(q["side"], p["side"]), "request_side_mismatch")
        .when(q["quantity"].isNotNull() & differs(r["requested"], q["quantity"]), "result_requested_quantity_mismatch")
    )


class ResultFold:
    """One position: what each result leaves of it. A refused result changes nothing."""

    def __init__(self) -> None:
        self.state, self.quantity = "OPEN", None

    def step(self, place: int, opening: int, action: str, status: str, requested: int, filled: int, code: str | None) -> Iterable[tuple]:
        if self.quantity is None:
            self.quantity = opening
        code = code or self._apply(action, status, requested or 0, filled or 0)
        return ((place, code, self.state, self.quantity),)

    def _apply(self, action: str, status: str, requested: int, filled: int) -> str:
        if self.state not in ("OPEN", "MANAGING"):
            return "position_not_open_or_managing"
        if action == "MODIFY_PROTECTION" or status != "FILLED":
            return "unchanged"
        if action == "CLOSE":
            if filled != requested or filled != self.quantity:
                return "close_fill_quantity_mismatch"
            self.state, self.quantity = "CLOSED", 0  # through EXIT_PENDING
            return "applied"
        if not 0 < filled < self.quantity:
            return "reduce_fill_quantity_invalid"
        self.state, self.quantity = "MANAGING", self.quantity - filled
        return "applied"

    def finish(self) -> Iterable[tuple]:
        return ()


def apply_results(results: DataFrame, keys: list[str], place: str) -> DataFrame:
    """keys, place, outcome, state, quantity after each result (place, opening, action, status, requested, filled, code) of a position.

    ``opening`` is the quantity that the position was opened with, ``code`` what ``result_code`` found. How much is left decides
    what the next result may do, so a position's results are an ordered fold; a position has few.
    """
    types = {f.name: f.dataType.simpleString() for f in results.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{place} {types[place]}, outcome string, state string, quantity long"])
    rows = results.select(*keys, place, *[F.col(c).cast("long") if c in ("opening", "requested", "filled") else F.col(c) for c in ("opening", "action", "status", "requested", "filled", "code")])
    return ordered_fold(rows, keys, [place], lambda *_: ResultFold(), schema)
