"""The causal check and the capture it runs: nothing of the whole job is left out, however it is cut into pieces."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid.operators import columns as C
from pricegrid.operators import segments as T
from pricegrid.operators import signals as G
from pricegrid.operators import structure as S
from pricegrid.plans import market, research
from pricegrid.plans.spine_sql import RESOLUTIONS, REVERSAL, STRUCTURE
from pricegrid.sources.events import price_events

KEY = ["symbol", "resolution"]


def same(got, want):
    want = want.select(got.columns)
    return got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_differences_are_counted_one_by_one(spark, piece):
    """Symbols of two events, without a name and with a bar in it; a capture that looks one event ahead, and an honest one."""
    rng = random.Random(3)
    rows = [(s, i, i, 10_000_000 + rng.randrange(-9, 10) * 1000) for s, n in (("a|b", 40), ("two", 2), ("one", 1), (None, 33), ("c", 9)) for i in range(1, n + 1)]
    events = spark.createDataFrame(rows, "symbol string, seq long, event_us long, price long")

    def seen(price):
        return lambda e: e.select(F.lit("x").alias("subject"), "symbol", F.lit(None).cast("string").alias("resolution"), "seq", price.cast("string").alias("what"))

    peeks = seen(F.lead("price").over(Window.partitionBy("symbol").orderBy("seq")))
    prices, want = {}, Counter()
    for s, _, _, p in rows:
        prices.setdefault(s, []).append(p)
    change = {"reflect": lambda p: 20_000_000 - p, "flatten": lambda p: 10_000_000, "shock": lambda p: p * 2, "prefix": lambda p: None}
    for of in prices.values():
        for cut in {len(of) * k // 4 for k in (1, 2, 3)} - {0}:
            for name, f in change.items():
                tail = [] if name == "prefix" else [f(p) for p in of[cut:]]
                whole, other = of + [None], of[:cut] + tail + [None]
                want[name] += 2 * sum(a != b for a, b in zip(whole[1 : cut + 1], other[1 : cut + 1], strict=True))
    got = {r.change: r.differences for r in research.differences(events, peeks, piece=piece).collect()}
    assert got == {name: want[name] for name in change} and all(want[n] for n in change)
    assert {r.differences for r in research.differences(events, seen(F.col("price")), piece=piece).collect()} == {0}
    assert [r.differences for r in research.differences(events.filter("false"), peeks, piece=piece).collect()] == [0] * 4


def test_facts_are_those_of_the_single_operators(spark, small):
    m = market.moves(spark, small).cache()
    told = S.facts(m, KEY, lambda _, resolution: resolution == "fast").cache()
    fact = lambda name: told.filter(F.col("fact") == name)
    pivots = S.pivots(m, KEY)
    assert same(fact("pivot").select(*KEY, F.col("about").alias("seq"), "kind", "price", F.col("seq").alias("confirmed_seq"), F.col("us").alias("confirmed_us")), pivots)
    regime = S.regime(pivots, KEY)
    assert same(fact("pivot").select(*KEY, F.col("about").alias("seq"), F.col("a").alias("slope"), F.col("b").alias("width"), F.col("state").alias("label"), "reason"), regime)
    lost = S.levels(m, KEY).filter("status = 'invalidated'")
    assert same(fact("lost").select(*KEY, F.col("about").alias("pivot_seq"), F.col("kind").alias("side"), "price", F.col("seq").alias("invalidated_seq")), lost)
    line = Window.partitionBy(*KEY, "kind", "anchor_a_seq", "anchor_b_seq", "state").orderBy("seq")
    lines = S.trendlines(m, KEY).withColumn("nth", F.row_number().over(line)).filter("nth = 1")
    assert same(fact("line").select(*KEY, "seq", "kind", F.col("a").alias("anchor_a_seq"), F.col("b").alias("anchor_b_seq"), "state"), lines)
    held = S.active_levels(m, KEY).filter("resolution = 'fast' and (support is not null or resistance is not null)")
    before = F.lag(F.struct("support", "resistance")).over(Window.partitionBy(*KEY).orderBy("seq"))
    held = held.withColumn("before", before).filter(~F.struct("support", "resistance").eqNullSafe(F.col("before")))
    assert same(fact("near").select(*KEY, "seq", F.col("a").alias("support"), F.col("b").alias("resistance")), held)


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_evidence_is_what_the_inputs_are(spark, small, width):
    """Times that go back make some evidence later than its event."""
    e = price_events(spark, small).withColumn("event_us", F.when(F.col("seq") % 5 == 0, F.col("event_us") - 90_000_000_000).otherwise(F.col("event_us"))).cache()
    m = T.moves(e, RESOLUTIONS, REVERSAL).cache()
    told = S.facts(m, KEY, lambda _, resolution: resolution == STRUCTURE).cache()
    want = G.score(G.inputs(e, m, C.matrix(e, m, "symbol", list(RESOLUTIONS)), list(RESOLUTIONS), STRUCTURE, 2500), 2500)
    got = G.score(G.evidence(e, m, told, list(RESOLUTIONS), STRUCTURE, 2500, width=width), 2500)
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bullish_patterns", "bearish_patterns")]
    columns = [*(c for c in want.columns if c not in ("bullish_patterns", "bearish_patterns")), *counted]
    assert same(got.select(*columns), want.select(*columns)) and got.filter("action <> 'WAIT'").count() > 0


def test_scores_are_compiled(spark, small):
    """A generated method of more than 8,000 bytes is only ever interpreted."""
    e = price_events(spark, small)
    m = T.moves(e, RESOLUTIONS, REVERSAL)
    path = research.cut(G.inputs(e, m, C.matrix(e, m, "symbol", list(RESOLUTIONS)), list(RESOLUTIONS), STRUCTURE, 2500))
    made = G.score(path, 2500)._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000


def test_prices_that_stand_still_move_no_start(monkeypatch):
    """Starts that never meet don't cost a step for each event."""
    steps = []
    plain = C.ColumnFold.step
    monkeypatch.setattr(C.ColumnFold, "step", lambda self, *row: (steps.append(row), plain(self, *row))[1])
    n = 1000
    starts = T.possible(0, 10, 100, 3)
    ends, _, out = T.fold_segment(list(range(n)), list(range(n)), [100] * n, starts, 10, 3)
    assert not out and not steps and [e[:3] for e in ends] == [s[:3] for s in starts] and len(starts) > 1
