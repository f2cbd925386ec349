"""A segmented fold gives what the plain fold gives, wherever segments are cut."""

import random

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import columns as C
from pricegrid.operators import segments as G
from pricegrid.plans import market
from pricegrid.plans.spine_sql import RESOLUTIONS, REVERSAL
from pricegrid.sources.events import price_events

SCHEMA = "symbol string, seq long, event_us long, price long, box long"


def walk(seed, n, step, still=0.3):
    rng, price, out = random.Random(seed), 10_000, []
    for i in range(n):
        if rng.random() > still:
            price += rng.randrange(-step, step + 1)
        out.append((f"s{seed}" if seed else None, i + 1, i, price if rng.random() > 0.05 else None, 100))
    return out


@pytest.mark.parametrize("segment", [1, 3, 16, 10_000])
@pytest.mark.parametrize("reversal", [1, 3])
def test_as_the_plain_fold(spark, segment, reversal):
    rows = walk(0, 60, 40) + walk(1, 200, 90) + walk(2, 150, 1000) + walk(3, 80, 3) + [("none", i, i, None, 100) for i in range(1, 9)] + [("boxless", 1, 1, 5, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(repr, C.transitions(df, ["symbol"], reversal).collect()))
    got = sorted(map(repr, G.transitions(df, ["symbol"], reversal, segment).collect()))
    assert got == want and len(want) > 50


def test_possible_states_hold_the_real_one():
    rng = random.Random(2)
    for _ in range(2000):
        reversal, box, seed = rng.randrange(1, 5), rng.randrange(1, 60), rng.randrange(-500, 500)
        fold = C.ColumnFold(reversal)
        for i, price in enumerate([seed, *(seed + rng.randrange(-400, 400) for _ in range(rng.randrange(1, 6)))]):
            fold.step(i, i, price, box)
        found = [(d, e if d else 0) for _, d, e, _ in G.possible(seed, box, price, reversal)]
        assert (fold.direction, fold.edge if fold.direction else 0) in found and len(found) <= 2 * (reversal + 1) + 1


def test_starts_that_meet_go_on_as_one():
    rows = [(i, i, p, 10) for i, p in enumerate([105, 140, 90, 150, 60, 75])]
    starts = G.possible(100, 10, 100, 3)
    for s, (_, direction, edge, column) in zip(starts, G.segment_map(rows, starts, 3), strict=True):
        fold = G._fold(s, 3)
        for r in rows:
            fold.step(*r)
        assert (fold.direction, fold.edge, fold.column) == (direction, edge, column)


def test_real_events(spark, small):
    e = C.fan_out(price_events(spark, small), RESOLUTIONS).select("symbol", "resolution", "seq", "event_us", "price", "box")
    want = market.moves(spark, small)
    got = G.transitions(e, ["symbol", "resolution"], REVERSAL, 50).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert G.transitions(e.filter(F.lit(False)), ["symbol", "resolution"]).count() == 0


@pytest.mark.parametrize("segment", [1, 3, 16, 10_000])
@pytest.mark.parametrize("reversal", [1, 3])
def test_resolutions_folded_once(spark, segment, reversal):
    rows = walk(0, 60, 40) + walk(1, 200, 90) + walk(2, 150, 1000) + walk(3, 80, 3) + [("none", i, i, None, 100) for i in range(1, 9)]
    df = spark.createDataFrame(rows, SCHEMA).drop("box").repartition(3)
    sizes = {"a": 7, "b": 100, "c": 450}
    want = sorted(map(repr, C.transitions(C.fan_out(df, sizes), ["symbol", "resolution"], reversal).collect()))
    got = sorted(map(repr, G.moves(df, sizes, reversal, segment).collect()))
    assert got == want and len(want) > 50
    assert G.moves(df.filter(F.lit(False)), sizes, reversal, segment).count() == 0


def test_a_transition_is_put_out_once_after_all_starts_have_met():
    """One task's work doesn't grow with the number of starts, and no task needs a symbol's whole history."""
    rng, price = random.Random(5), [100]
    for _ in range(5000):
        price.append(price[-1] + rng.randrange(-40, 41))
    places = list(range(len(price)))
    ends, chains, out = G.fold_segment(places, places, price, G.possible(100, 10, 100, 3), 10, 3)
    assert len(out) < 5100 and len({e[1:3] for e in ends}) == 1 and len({c[-1][0] for c in chains}) == 1
