"""Buckets of any width give what one window gives."""

import random

import pytest
from pyspark.sql import functions as F

from pricegrid.functions.joins import as_of
from pricegrid.functions.running import running
from pricegrid.operators import hygiene as H


def made(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i, rng.choice([None, *range(-9, 9)])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running(spark, width):
    rows = made(1)
    df = spark.createDataFrame(rows, "k string, at long, i long, v long").repartition(3)
    v = F.col("v")
    out = running(df, ["k"], ["at", "i"], width, {"top": ("max", v, False), "sum": ("sum", v, True), "n": ("sum", F.lit(1), True)})
    got = {r.i: (r.top, r["sum"], r.n) for r in out.collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for k, at, i, x in rows:
        before = sorted((r for r in rows if r[0] == k and order(r) < order((k, at, i, x))), key=order)
        seen = [r[3] for r in before if r[3] is not None]
        here = seen + ([x] if x is not None else [])
        assert got[i] == (max(seen, default=None), sum(here) if here else None, len(before) + 1)
    assert running(df.limit(0), ["k"], ["at", "i"], width, {"n": ("sum", F.lit(1), True)}).count() == 0


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_in_buckets(spark, forward):
    left = spark.createDataFrame([(k, at, i) for k, at, i, _ in made(2, 80)] + [("only", 5, 900)], "k string, at long, i long").repartition(3)
    right = spark.createDataFrame([(k, at, i, v) for k, at, i, v in made(3, 50)], "k string, at long, tie long, v long").repartition(2)
    want = {tuple(r) for r in as_of(left, right, ["k"], "at", ["v", "tie"], forward=forward, tie="tie").filter("at is not null").collect()}
    for width in (1, 9, 10_000):
        got = {tuple(r) for r in as_of(left, right, ["k"], "at", ["v", "tie"], forward=forward, tie="tie", width=width).filter("at is not null").collect()}
        assert got == want


def test_flags_do_not_depend_on_the_width(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([None, *range(40)]), rng.choice([None, *range(90)]), str(rng.randrange(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, arrival long, source_sequence long, event_us long, identity_key string").repartition(3)
    order = ["arrival", "source_sequence"]

    def told(width):
        flagged = H.stream_flags(df, ["symbol"], order, width=width)
        late = H.drop_late(df, ["symbol"], order, "event_us", "identity_key", width=width)
        return [sorted(map(repr, x.collect())) for x in (flagged, H.quality_counters(flagged, ["symbol"], order, width=width), late)]

    assert told(3) == told(50) == told(1 << 20)
    assert H.quality_counters(H.stream_flags(df.limit(0), ["symbol"], order), ["symbol"], order).count() == 0
