"""Positions and paper orders as decision tables: exit decisions, fills, feature lifecycles, quote freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXIT_STATES = ("OPEN", "MANAGING")
LIFECYCLE = ("DISABLED", "SHADOW", "ACTIVE")


def apply_exit(positions: DataFrame) -> DataFrame:
    """``positions`` with action, new_stop and reduce_by -> new state, quantity and stop, or the reason of refusal.

    HOLD changes nothing; TIGHTEN only moves the stop towards the price; PARTIAL_CLOSE leaves a rest; CLOSE goes
    to EXIT_PENDING, never straight to CLOSED.
    """
    action, state, long = F.col("action"), F.col("state"), F.col("side") == "long"
    tighter = F.coalesce(F.when(long, F.col("new_stop") > F.col("stop")).otherwise(F.col("new_stop") < F.col("stop")), F.lit(False))
    left = F.col("quantity") - F.col("reduce_by")
    reason = (
        F.when(action == "HOLD", F.lit(None).cast("string"))
        .when((action == "TIGHTEN") & ~state.isin(*EXIT_STATES), "tighten_requires_open_or_managing_position")
        .when((action == "TIGHTEN") & ~tighter, "protection_must_only_tighten")
        .when((action == "PARTIAL_CLOSE") & (left <= 0), "partial_close_must_leave_residual_quantity")
        .when((action == "PARTIAL_CLOSE") & ~state.isin(*EXIT_STATES), "transition_not_allowed")
        .when((action == "CLOSE") & ~state.isin(*EXIT_STATES), "transition_not_allowed")
    )
    ok = reason.isNull()
    return positions.select(
        *[c for c in positions.columns if c not in ("state", "quantity", "stop", "reason")],
        F.when(ok & (action == "PARTIAL_CLOSE"), "MANAGING").when(ok & (action == "CLOSE"), "EXIT_PENDING").otherwise(state).alias("state"),
        F.when(ok & (action == "PARTIAL_CLOSE"), left).when(ok & (action == "CLOSE"), F.lit(0).cast("long")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(ok & (action == "TIGHTEN"), F.col("new_stop")).otherwise(F.col("stop")).alias("stop"),
        reason.alias("reason"),
    )


def effective_lifecycle(*levels: Column) -> Column:
    """The least of several lifecycles, DISABLED before SHADOW before ACTIVE; an unknown one disables."""
    ranks = [F.coalesce(F.array_position(F.array(*map(F.lit, LIFECYCLE)), level), F.lit(0)) for level in levels]
    return F.element_at(F.array(*map(F.lit, LIFECYCLE)), F.greatest(F.lit(1), F.least(*ranks)).cast("int"))


def paper_fill(price: Column, size: Column, side: Column, slippage: int, fee: int) -> Column:
    """struct(fill_price, fee, cash): a buy pays the slippage on top, a sale gets it less; the fee is per unit."""
    buys = side == "long"
    fill = F.when(buys, price + slippage).otherwise(price - slippage)
    cash = F.when(buys, -fill * size).otherwise(fill * size) - size * fee
    return F.struct(fill.alias("fill_price"), (size * fee).alias("fee"), cash.alias("cash"))


def quote_freshness(age_us: Column, stale_s: int = 10, skew_s: int = 5) -> Column:
    """clock_skew if the quote is from the future, stale if it is old, else live."""
    return F.when(age_us < -skew_s * 1_000_000, "clock_skew").when(age_us > stale_s * 1_000_000, "stale").otherwise("live")


def recovery_action(status: Column, unresolved: Column, snapshot_complete: Column) -> Column:
    """What recovery may do: nothing if in order, wait without a full snapshot, else look at what is unresolved first."""
    return (
        F.when((status == "SYNCHRONIZED") & (unresolved == 0), "NOT_NEEDED")
        .when(~F.coalesce(snapshot_complete, F.lit(False)), "WAIT_FOR_SNAPSHOT")
        .when(unresolved > 0, "RESOLVE_EXECUTIONS").when(status == "UNKNOWN", "REFUSED_UNKNOWN").otherwise("RECONCILE")
    )
