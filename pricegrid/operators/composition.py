"""From decisions to trades and experiences: the operators of the other modules, one behind the other.

``scored`` is what ``signals.score`` gives, a row for each event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import outcomes as O
from . import signals as G
from .gates import canonical
from .structure import readiness

POLICY = "experience-v1"
SIDES = ("pnf_side", "structure_side", "sr_side", "matrix_side", "regime_side")


def side_of(action: str):
    """long for BUY, short for SELL, null for any other action."""
    return F.when(F.col(action) == "BUY", "long").when(F.col(action) == "SELL", "short")


def signal_trades(issued: DataFrame, events: DataFrame, entry_delay_us: int, exit_delay_us: int) -> DataFrame:
    """Fills of issued signals; a signal is decided at the knowledge time of its event, and its expiry changes nothing.

    A signal whose event is missing has no row; one without a later event keeps null fills. Empty tables give none.
    """
    known = events.select("symbol", "seq", F.col("received_us").alias("decision_us"))
    asked = issued.filter("status = 'issued'").select("symbol", "seq", side_of("action").alias("side"), "score").join(known, ["symbol", "seq"])
    return O.fills(asked, events, entry_delay_us, exit_delay_us)


def experiences(scored: DataFrame) -> DataFrame:
    """A new experience wherever the fingerprint of a symbol's decision differs from the one before.

    The fingerprint covers the action, its evidence, the matrix, the last pivots, the levels that hold, the regime and
    the patterns, not scores or times; nulls are values of their own. The plan (zone, stop, targets, entry in the
    middle of the zone) is that of the setup and null for WAIT and where the stop isn't beyond the zone.
    """
    rows = G.setup(scored).select("*", *[F.col(f"p{i}.seq").alias(f"pivot_{i}") for i in range(3)])
    facts = ("action", "alignment", "support", "resistance", "label", "bullish_patterns", "bearish_patterns", *SIDES, *(f"pivot_{i}" for i in range(3)))
    marked = rows.withColumn("fingerprint", F.sha2(canonical(*facts), 256))
    before = F.lag("fingerprint").over(Window.partitionBy("symbol").orderBy("seq"))
    new = marked.withColumn("before", before).filter("before is null or before <> fingerprint")
    name = F.sha2(F.concat_ws("|", F.lit(POLICY), "symbol", "seq", "fingerprint"), 256)
    entry = F.call_function("div", F.col("zone_low") + F.col("zone_high"), F.lit(2))
    return new.select(
        "symbol", "seq", name.alias("experience_id"), "fingerprint", F.col("event_us").alias("t0"), F.col("to_price").alias("reference"), "action",
        side_of("action").alias("side"), "zone_low", "zone_high", "stop", "tp1", "tp2", entry.alias("entry"), F.when(entry.isNotNull(), F.abs(entry - F.col("stop"))).alias("plan_risk"),
    )


def closing_states(found: DataFrame, events: DataFrame, minutes: int = 60) -> DataFrame:
    """The state of each experience at the end of the events.

    TP2 and INVALIDATED stay. Once an event at or after the last horizon is there, the others are CLOSED if they were
    entered or have no direction, else EXPIRED. Before it: TP1, ACTIVE, SIGNAL_CREATED (a direction) or OBSERVED.
    """
    rank = {"ENTRY_TRIGGERED": 0, "ACTIVE": 1, "TP1": 2, "INVALIDATED": 3, "TP2": 4}
    place = F.element_at(F.create_map(*[F.lit(v) for kv in rank.items() for v in kv]), F.col("state"))
    reached = O.lifecycles(found.filter("side is not null and zone_low is not null"), events, minutes).groupBy("symbol", "seq").agg(F.max_by("state", place).alias("reached"))
    last = events.groupBy("symbol").agg(F.max("event_us").alias("last_us"))
    over = F.col("last_us") >= F.col("t0") + minutes * 60 * O.SECOND
    state = (
        F.when(F.col("reached").isin("TP2", "INVALIDATED"), F.col("reached"))
        .when(over & (F.col("reached").isNotNull() | F.col("side").isNull()), "CLOSED").when(over, "EXPIRED")
        .otherwise(F.coalesce("reached", F.when(F.col("side").isNull(), "OBSERVED").otherwise("SIGNAL_CREATED")))
    )
    rows = found.select("symbol", "seq", "experience_id", "t0", "side").join(reached, ["symbol", "seq"], "left").join(last, "symbol", "left")
    return rows.select("symbol", "seq", "experience_id", "side", state.alias("state"))


def entry_readiness(scored: DataFrame, lines: DataFrame) -> DataFrame:
    """symbol, seq, action, readiness: each decision against the line on its side as its event leaves it.

    ``lines``: the trendlines of one resolution. Where one line replaces another the new one counts, and a touch leaves
    a line active. No line, or none on that side, stands in nobody's way.
    """
    active = F.col("state").isin("active", "touch")
    left = lines.filter("state <> 'replaced'").groupBy("symbol", "seq").agg(
        *[F.max_by(F.when(active, "active").otherwise(F.col("state")), F.when(F.col("kind") == k, active)).alias(n) for n, k in (("support_line", "bullish_support"), ("resistance_line", "bearish_resistance"))]
    )
    so_far = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    lined = scored.select("symbol", "seq", "action").join(left, ["symbol", "seq"], "left").select(
        "symbol", "seq", "action", *[F.last(n, ignorenulls=True).over(so_far).alias(n) for n in ("support_line", "resistance_line")]
    )
    own = F.when(F.col("action") == "BUY", F.col("support_line")).when(F.col("action") == "SELL", F.col("resistance_line"))
    return lined.select("symbol", "seq", "action", readiness(F.col("action"), own).alias("readiness"))
