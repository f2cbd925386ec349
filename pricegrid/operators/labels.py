"""Labels of observations by what the next events bring, for whatever observed: excursions, end, gaps.

Windows count events. A sample counts if both its clocks are after the observation. All observations at one event share their windows, and
a window is a few dozen pre-summed blocks (``functions/ranges.py``), so neither a long window nor a hot symbol is walked through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import cut
from ..functions.joins import as_of
from ..functions.ranges import range_aggregate
from ..functions.running import running

BUCKET = 65_536
WINDOW = ("events_ahead", "t0", "reference", "status", "samples", "top", "low", "last")
TOLD = ("events_ahead", "status", "samples", "up", "down", "mfe", "mae", "mfe_after_us", "mae_after_us", "end_change")


def directed(observations: DataFrame) -> DataFrame:
    """Adds direction: long, short or neutral. Readiness takes that of the last decision of its symbol; pivots, levels, lines and plain events have none."""
    said = F.split("what", r"\|")
    word = (
        F.when(F.col("subject") == "pnf.transition", F.get(said, F.lit(2))).when(F.col("subject") == "pattern", F.get(said, F.lit(2)))
        .when(F.col("subject").isin("signal.decision", "signal.issued"), F.get(said, F.lit(0)))
    )
    side = F.when(word.isin("X", "bullish", "BUY"), "long").when(word.isin("O", "bearish", "SELL"), "short").otherwise("neutral")
    rows = observations.withColumn("direction", side)
    decided = rows.filter("subject = 'signal.decision'").select("symbol", "seq", F.col("direction").alias("decided"))
    ready = as_of(rows.filter("subject = 'entry_readiness.state'"), decided, ["symbol"], "seq", ["decided"], width=BUCKET)
    ready = ready.withColumn("direction", F.coalesce("decided", F.lit("neutral"))).drop("decided")
    return rows.filter("subject is null or subject <> 'entry_readiness.state'").unionByName(ready)


def event_windows(at: DataFrame, events: DataFrame, lengths: tuple[int, ...], most_gap_us: int) -> DataFrame:
    """symbol, seq, events_ahead, t0, reference, status, samples, top, low, last for each different symbol and seq of ``at`` and each length.

    top and low are struct(price, event_us, seq) of the first sample at the extreme, last struct(seq, price). A window that goes beyond the
    symbol's last event is censored, so is one with an event more than ``most_gap_us`` after all before it. ``seq`` numbers a symbol's
    events from 1 without holes. Observations at events that don't exist have no rows; nulls take no part.
    """
    here = events.select("symbol", "seq", F.col("event_us").alias("t0"), F.col("price").alias("reference"))
    known = at.select("symbol", "seq").distinct().join(here, ["symbol", "seq"])
    asked = cut(known).withColumn("events_ahead", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths])))
    e = running(events.select("symbol", "seq", "event_us", "received_us", "price"), ["symbol"], ["seq"], BUCKET, {"before_us": ("max", F.col("event_us"), False)})
    price, us, seq = F.col("price"), F.col("event_us"), F.col("seq")
    first = lambda p: F.struct(p.alias("p"), (-seq).alias("back"), us.alias("us"))
    stats = range_aggregate(
        asked, e.withColumnRenamed("seq", "at_seq").withColumn("seq", F.col("at_seq")), ["symbol"], "at_seq", F.col("seq") + 1, F.col("seq") + F.col("events_ahead"),
        {
            "samples": (F.sum, F.lit(1).cast("long")), "top": (F.max, first(price)), "low": (F.max, first(-price)), "last": (F.max, F.struct(seq.alias("seq"), price.alias("price"))),
            "first_us": (F.min, us), "first_known_us": (F.min, F.col("received_us")),
        },
        counts=(F.col("first_us") > F.col("t0")) & (F.col("first_known_us") > F.col("t0")), always={"gap": (F.max, F.coalesce(us - F.col("before_us") > most_gap_us, F.lit(False)))},
        sizes=max(2, (max(lengths).bit_length() + 1) // 2),
    )
    ends = events.groupBy("symbol").agg(F.max("seq").alias("n"))
    n = F.coalesce("samples", F.lit(0).cast("long"))
    status = (
        F.when(F.col("seq") + F.col("events_ahead") > F.col("n"), "CENSORED_END_OF_DATA").when(F.coalesce("gap", F.lit(False)), "CENSORED_GAP").when(n == 0, "NO_SAMPLES").otherwise("COMPLETE")
    )
    extreme = lambda c, sign: F.struct((sign * F.col(f"{c}.p")).alias("price"), F.col(f"{c}.us").alias("event_us"), (-F.col(f"{c}.back")).alias("seq"))
    some = lambda c: F.when(n > 0, c)
    return stats.join(ends, "symbol").select(
        "symbol", "seq", "events_ahead", "t0", "reference", status.alias("status"), n.alias("samples"), some(extreme("top", 1)).alias("top"), some(extreme("low", -1)).alias("low"), "last"
    )


def outcomes(observations: DataFrame, events: DataFrame, lengths: tuple[int, ...], most_gap_us: int) -> DataFrame:
    """Each observation (symbol, seq, direction, more) and each length: how far prices went for and against it, after how long, and where they ended.

    Neutral ones (and null directions) have up, down and the end's change alone. Excursions aren't negative, and have a time only where they are above zero.
    Columns of the observations that are named like those of a window or a label are left out.
    """
    observations = observations.drop(*WINDOW, *TOLD)
    w = event_windows(observations, events, lengths, most_gap_us)
    sign = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1)
    some = lambda c: F.when(F.col("samples") > 0, F.greatest(F.lit(0), c))
    up, down = some(F.col("top.price") - F.col("reference")), some(F.col("reference") - F.col("low.price"))
    after = lambda c: F.col(f"{c}.event_us") - F.col("t0")

    def by_side(long: Column, short: Column) -> Column:
        return F.when(sign > 0, long).when(sign < 0, short)

    timed = observations.join(w, ["symbol", "seq"])
    return timed.select(
        *observations.columns, "events_ahead", "status", "samples", up.alias("up"), down.alias("down"), by_side(up, down).alias("mfe"), by_side(down, up).alias("mae"),
        by_side(F.when(up > 0, after("top")), F.when(down > 0, after("low"))).alias("mfe_after_us"), by_side(F.when(down > 0, after("low")), F.when(up > 0, after("top"))).alias("mae_after_us"),
        (F.coalesce(sign, F.lit(1)) * (F.col("last.price") - F.col("reference"))).alias("end_change"),
    )
