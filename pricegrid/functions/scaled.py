"""Exact arithmetic on scaled integers: a price is a whole number of thousandths.

Whole numbers add, compare and divide exactly inside generated code, where wide decimals would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1000


def to_scaled(value: Column, scale: int = SCALE) -> Column:
    """A double with few decimals as a whole number of 1 / scale (null stays null)."""
    return F.round(value * scale).cast("long")


def whole(value: Column, by: Column | int) -> Column:
    """value / by as a whole number, cut towards zero."""
    return F.call_function("div", value, F.lit(by) if isinstance(by, int) else by)


def divide_half_even(value: Column, by: Column | int) -> Column:
    """value / by (by > 0) as a whole number, halves to even."""
    by = F.lit(by).cast("long") if isinstance(by, int) else by
    rest = F.pmod(value, by)
    down = whole(value - rest, by)
    up = (rest * 2 > by) | ((rest * 2 == by) & (F.pmod(down, F.lit(2)) == 1))
    return down + up.cast("long")


def half_even(value: Column, step: int) -> Column:
    """A whole number rounded to a multiple of ``step``, halves to the even multiple."""
    return divide_half_even(value, step) * step


def whole_boxes(distance: Column, box: Column | int) -> Column:
    """How many whole boxes fit in a distance."""
    return whole(F.abs(distance), box)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    seconds = (ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("long")
