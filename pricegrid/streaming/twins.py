"""The stream twins of the batch operators: same rules, incremental state, restart from a checkpoint.

Late rows beyond the watermark are left out by the engine; what a batch run would flag as out of order arrives
here sorted within a micro-batch. A half-hour candle is closed by the watermark, the batch one by its last
event.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.columns import TRANSITION, ColumnFold


def deduplicated(events: DataFrame, identity: str = "identity_key", time: str = "event_time", within: str = "10 minutes") -> DataFrame:
    """The first row of each identity; identities are forgotten once the watermark is ``within`` past them."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([identity])


def candles(events: DataFrame, keys: list[str], time: str = "event_time", late: str = "10 seconds") -> DataFrame:
    """Half-hour candles, each given out once the watermark passes its end."""
    w = F.window(time, "30 minutes")
    return (
        events.withWatermark(time, late).groupBy(*keys, w.alias("w"))
        .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").alias("samples"))
        .select(*keys, F.col("w.start").alias("start"), "open", "high", "low", "close", "samples")
    )


def transitions(events: DataFrame, reversal: int = 3) -> DataFrame:
    """Point and figure transitions of a stream (symbol, resolution, seq, event_us, price, box); five values of state a key."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = ColumnFold(reversal)
        if state.exists:
            seed, direction, edge, column = state.get
            fold.seed, fold.direction, fold.edge, fold.column = seed, direction or None, edge, column
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [(*key, *o) for r in rows.itertuples() for o in fold.step(int(r.seq), int(r.event_us), int(r.price), int(r.box))]
        if fold.seed is not None:
            state.update((fold.seed, fold.direction or "", fold.edge or 0, fold.column))
        names = ["symbol", "resolution", *(c.split()[0] for c in TRANSITION.split(", "))]
        yield pd.DataFrame(out, columns=names)

    return events.groupBy("symbol", "resolution").applyInPandasWithState(
        step, f"symbol string, resolution string, {TRANSITION}", "seed long, direction string, edge long, column int", "append", GroupStateTimeout.NoTimeout
    )


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "event_time", late: str = "10 seconds") -> DataFrame:
    """Sessions that end where a key is silent for ``gap``, each given out once the watermark passes its end."""
    w = F.session_window(time, gap)
    return (
        events.withWatermark(time, late).groupBy(*keys, w.alias("w"))
        .agg(F.count("*").alias("events"), F.max("price").alias("high"), F.min("price").alias("low"))
        .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "high", "low")
    )
