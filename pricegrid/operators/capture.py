"""Observations of nine kinds, each at the event where it becomes known, as a validation run captures them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import cut
from . import segments as T
from . import signals as G
from . import structure as S
from .composition import entry_readiness

KINDS = (
    "pnf.transition", "structure.pivot_confirmed", "structure.level_invalidated", "pattern", "trendline.state", "signal.decision", "signal.issued",
    "entry_readiness.state", "baseline.every_nth_event",
)


def observations(events: DataFrame, resolutions: dict[str, int], reversal: int, structure: str, tolerance: int, every: int = 100, with_regime: bool = False) -> DataFrame:
    """subject, symbol, resolution, seq, what: changes only, none of them with anything that a later event tells.

    Trendline states count once for each line. Decisions, signals and readiness are those of a symbol and have no
    resolution; readiness looks at the lines of ``structure``. ``with_regime`` adds the regime, which is no subject.
    """
    key = ["symbol", "resolution"]
    events = cut(events.select("symbol", "seq", "event_us", "price"))  # several readers
    m = cut(T.moves(events, resolutions, reversal))
    told = cut(S.facts(m, key, lambda _, resolution: resolution == structure))

    def kind(subject: str, df: DataFrame, *what: str, resolution: bool = True) -> DataFrame:
        where = F.col("resolution") if resolution else F.lit(None).cast("string")
        said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in what])
        return df.select(F.lit(subject).alias("subject"), "symbol", where.alias("resolution"), "seq", said.alias("what"))

    def fact(name: str) -> DataFrame:
        return told.filter(F.col("fact") == name)

    pivots = fact("pivot").select(*key, F.col("about").alias("seq"), "kind", "price", F.col("seq").alias("confirmed_seq"))
    patterns = S.patterns(pivots, key, tolerance).withColumnRenamed("seq", "about").withColumnRenamed("confirmed_seq", "seq")

    # of the scores only the first of each bucket, those whose action differs from the one before and those of BUY and SELL are kept; only the latter need what a plan is made of
    scored = G.score(G.evidence(events, m, told, list(resolutions), structure, tolerance), tolerance)
    key_of = ("symbol", "__bucket", "at", "seq", "action", "score")
    scored = scored.select(*key_of, F.when(F.col("action") != "WAIT", F.struct(*[c for c in scored.columns if c not in key_of])).alias("plan"))
    before = F.lag("action").over(Window.partitionBy("symbol", "__bucket").orderBy("at"))
    scored = cut(scored.withColumn("before", before).filter("before is null or before <> action or action <> 'WAIT'").select("symbol", "seq", "action", "score", "plan.*"))
    by_seq = Window.partitionBy("symbol").orderBy("seq")
    decided = scored.select("symbol", "seq", "action", "score", F.lag("action").over(by_seq).alias("before")).filter("before is null or before <> action")

    # readiness changes only with the action or a line
    lines = fact("line").filter(F.col("resolution") == structure).select("symbol", "seq", "kind", "state")
    places = decided.select("symbol", "seq", "action").unionByName(lines.select("symbol", "seq", F.lit(None).cast("string").alias("action"))).groupBy("symbol", "seq").agg(F.max("action").alias("action"))
    held = F.last("action", ignorenulls=True).over(by_seq.rowsBetween(Window.unboundedPreceding, 0))
    ready = entry_readiness(places.select("symbol", "seq", held.alias("action")), lines)
    changed = ready.withColumn("before", F.lag("readiness").over(by_seq)).filter("before is null or before <> readiness")

    parts = [
        kind("pnf.transition", m, "kind", "column_id", "direction", "from_price", "to_price"),
        kind("structure.pivot_confirmed", fact("pivot"), "about", "kind", "price"),
        kind("structure.level_invalidated", fact("lost"), "about", "kind", "price"),
        kind("pattern", patterns, "about", "name", "direction"),
        kind("trendline.state", fact("line"), "kind", "a", "b", "state"),
        kind("signal.decision", decided, "action", "score", resolution=False),
        kind("signal.issued", G.issued(scored), "action", "score", resolution=False),
        kind("entry_readiness.state", changed, "readiness", resolution=False),
        kind("baseline.every_nth_event", events.filter(F.col("seq") % every == 0), "price", resolution=False),
    ]
    if with_regime:
        parts.append(kind("regime", fact("pivot"), "a", "b", "state", "reason"))
    return reduce(DataFrame.unionByName, parts)
