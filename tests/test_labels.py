"""Aggregates over intervals against brute force; labels of all observations against a replay."""

import random

import pytest
from pyspark.sql import functions as F

from pricegrid.functions.ranges import range_aggregate, tiles
from pricegrid.operators import labels as B
from pricegrid.plans import market, research


@pytest.mark.parametrize("radix,sizes", [(2, 7), (4, 3), (10, 1)])
def test_tiles_cover_each_place_once(spark, radix, sizes):
    pairs = [(a, b) for a in range(0, 40) for b in range(a - 2, 90, 7)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("t", tiles(F.col("a"), F.col("b"), radix, sizes))
    for r in df.collect():
        places = [x for t in r.t for x in range(t.block * radix**t.size, (t.block + 1) * radix**t.size)]
        assert sorted(places) == list(range(r.a, r.b + 1))
        assert sizes == 1 or len(r.t) <= 2 * (radix - 1) * (sizes - 1) + (90 // radix ** (sizes - 1)) + 1


def test_aggregates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b"]), p, rng.choice([None, *range(50)]), rng.randrange(100)) for p in rng.sample(range(-5, 400), 300)] + [("b", None, 1, 1), (None, 3, 1, 1)]
    asked = [(i, rng.choice(["hot", "b", "c", None]), rng.choice([None, rng.randrange(-9, 400)]), rng.randrange(-9, 400), rng.randrange(100)) for i in range(200)]
    got = range_aggregate(
        spark.createDataFrame(asked, "i int, k string, lo long, hi long, least int"), spark.createDataFrame(rows, "k string, p long, v int, t int"), ["k"], "p", F.col("lo"), F.col("hi"),
        {"total": (F.sum, F.col("v").cast("long")), "best": (F.max, F.struct("v", "p")), "first": (F.min, F.col("t"))}, counts=F.col("first") > F.col("least"), always={"top": (F.max, F.col("v"))}, radix=3, sizes=4,
    )
    seen = {r.i: r for r in got.collect()}
    assert len(seen) == len(asked)
    for i, k, lo, hi, least in asked:
        inside = [r for r in rows if k is not None and r[0] == k and r[1] is not None and lo is not None and max(lo, 0) <= r[1] <= hi]
        counted = [r for r in inside if r[3] > least]
        some = [r[2] for r in counted if r[2] is not None]
        every = [r[2] for r in inside if r[2] is not None]
        best = max(((-1 if r[2] is None else r[2], r[1]) for r in counted), default=None)
        assert seen[i].total == (sum(some) if some else None) and seen[i].top == max(every, default=None) and seen[i].first == min((r[3] for r in counted), default=None)
        assert (seen[i].best and (-1 if seen[i].best.v is None else seen[i].best.v, seen[i].best.p)) == best


def replay(of, k, direction, ahead):
    """The window of the event at ``k`` (from 1) read one by one."""
    e, inside = of[k - 1], of[k : k + ahead]
    samples = [x for x in inside if x.event_us > e.event_us and x.received_us > e.event_us]
    late = lambda j: j > 1 and of[j - 1].event_us - max(x.event_us for x in of[: j - 1]) > research.MOST_GAP_US
    status = "CENSORED_END_OF_DATA" if k + ahead > len(of) else "CENSORED_GAP" if any(late(x.seq) for x in inside) else "COMPLETE" if samples else "NO_SAMPLES"
    if not samples:
        return (status, 0, *[None] * 7)
    up, down = max(0, max(x.price for x in samples) - e.price), max(0, e.price - min(x.price for x in samples))
    when = lambda edge: next(x for x in samples if x.price == edge(y.price for y in samples)).event_us - e.event_us
    rise, fall = (up, when(max) if up else None), (down, when(min) if down else None)
    good, bad = {"long": (rise, fall), "short": (fall, rise)}.get(direction, ((None, None), (None, None)))
    return status, len(samples), up, down, good[0], bad[0], good[1], bad[1], (-1 if direction == "short" else 1) * (samples[-1].price - e.price)


def fields(r):
    return r.status, r.samples, r.up, r.down, r.mfe, r.mae, r.mfe_after_us, r.mae_after_us, r.end_change


def test_all_observations_by_replay(spark, small):
    of = {}
    for e in market.QUERIES["price_events_spine"](spark, small).orderBy("symbol", "seq").collect():
        of.setdefault(e.symbol, []).append(e)
    got = research.observation_labels(spark, small).collect()
    plain = research.observations_all(spark, small).collect()
    assert len(got) == len(plain) * len(research.AHEAD) and len({r.subject for r in got}) == 9
    action = {(r.symbol, r.seq): r.what.split("|")[0] for r in plain if r.subject == "signal.decision"}
    words = {"X": "long", "bullish": "long", "BUY": "long", "O": "short", "bearish": "short", "SELL": "short"}
    for r in got:
        said = r.what.split("|")
        word = {"pnf.transition": said[2:3], "pattern": said[2:3], "signal.decision": said[:1], "signal.issued": said[:1]}.get(r.subject, [])
        if r.subject == "entry_readiness.state":
            word = [action[max(k for k in action if k[0] == r.symbol and k[1] <= r.seq)]]
        assert r.direction == words.get(word[0] if word else None, "neutral")
        assert fields(r) == replay(of[r.symbol], r.seq, r.direction, r.events_ahead)


def test_labels_of_odd_events(spark):
    """Times that fall or tie, prices that tie, observations of events that don't exist, null directions, empty tables."""
    rng = random.Random(9)
    rows = [("s", i, us := rng.randrange(40) * 10**9, us + rng.randrange(-2, 3) * 10**9, rng.randrange(5)) for i in range(1, 60)]
    events = spark.createDataFrame(rows, "symbol string, seq long, event_us long, received_us long, price long")
    sides = ["long", "short", "neutral", None]
    asked = [("s", i, sides[i % 4], "extra") for i in range(1, 60)] + [("s", 99, "long", "x"), ("t", 1, "long", "x"), ("s", None, "long", "x"), ("s", 7, "long", "again")]
    obs = spark.createDataFrame(asked, "symbol string, seq long, direction string, price string")
    of = events.orderBy("seq").collect()
    got = B.outcomes(obs, events, (3, 20), research.MOST_GAP_US).collect()
    assert len(got) == 2 * 60 and {r.status for r in got} >= {"COMPLETE", "NO_SAMPLES", "CENSORED_END_OF_DATA"}
    for r in got:
        assert fields(r) == replay(of, r.seq, r.direction, r.events_ahead)
    clash = obs.limit(1).select("*", *[F.lit("mine").alias(c) for c in (*B.WINDOW, *B.TOLD[3:])])
    assert [fields(r) for r in B.outcomes(clash, events, (3,), research.MOST_GAP_US).collect()] == [replay(of, 1, "long", 3)]
    assert B.outcomes(obs, events.limit(0), (3,), 1).collect() == B.outcomes(obs.limit(0), events, (3,), 1).collect() == []


def test_transitions_and_windows_read_events_that_are_written_once(spark):
    from pricegrid.plans.catalog import QUERIES

    read = QUERIES["transition_labels"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if "events.parquet" in f]
