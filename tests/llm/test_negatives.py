"""Dual-tree mining against brute force: no clusters, tight clusters, hot labels, ties, groups of all sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrid.llm import boxes, negatives

SCHEMA = "vec_id long, label long, embedding array<double>, row string, u string, found string, p string"


def brute(rows, asks, k=5, m=10):
    usable = [(r, i, y, [int(np.floor(256 * x)) for x in v]) for r, (i, y, v) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for r, i, y, v in usable:
        if not asks(i):
            continue
        scored = [(-dot(v, w), j, z) for s, j, z, w in usable if s != r]
        positive = sorted((s, j) for s, j, z in scored if z == y)[:k]
        for ps, p in positive:
            inside = sorted((s, j) for s, j, z in scored if z != y and 30 * -ps <= 100 * -s <= 90 * -ps)[:m]
            out += [(i, p, n + 1, j, -ps, -s) for n, (s, j) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, asks=lambda c: F.pmod(c, F.lit(10)) == 0, **how):
    df = spark.createDataFrame([(*r, "r", "u", "f", "p") for r in rows], SCHEMA)
    out = negatives.mine_negatives(df, asks(F.col("vec_id")), F.col("label"), **how)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("noise", "labels", "how"), [(9.0, 10, {}), (0.2, 3, {"group_rows": 60, "batch_rows": 7}), (0.2, 40, {"group_rows": 50, "batch_rows": 5, "families": 4})])
def test_as_by_brute_force(spark, noise, labels, how):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(500):
        at = rng.integers(6)
        v = centres[at] + noise * rng.normal(size=12)
        y = 0 if rng.random() < 0.33 else int(rng.integers(labels))
        rows.append((i, y, [round(float(x), 1) for x in v / np.linalg.norm(v)]))  # rounded, so that scores tie
    assert mined(spark, rows, **how) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    one = [1.0, 0.5]
    rows = [(0, 1, one), (0, 1, one), (10, 1, [0.5]), (20, 2, []), (None, 1, one), (30, None, one), (40, 1, None), (50, 1, [None, 1.0]), (60, 2, [float("nan")]), (70, 2, [float("inf")]),
            (80, 2, [0.4, 0.4]), (81, 2, [0.4, 0.4]), (82, 3, [-1.0, -1.0]), (83, 3, [0.2, 0.1, 5.0]), (90, 3, [-0.1])]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 5
    assert mined(spark, []) == []
    alone = [(i, 1, [1.0]) for i in range(20)]  # no other label
    assert mined(spark, alone) == []


def test_whole_groups_of_anchors_are_pruned():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 8))
    at = rng.integers(16, size=4000)
    m = np.floor(256 * (centres[at] + 0.05 * rng.normal(size=(4000, 8)))).astype(np.int64)
    ids = np.arange(4000)
    side = lambda pick, leaf: negatives.Side.build(ids[pick], ids[pick], at[pick] % 4, m[pick], leaf)
    anchors, candidates = side(ids % 5 == 0, 32), side(ids >= 0, 64)
    of = np.arange(800)
    low, high = np.full(800, negatives._MIN), np.full(800, negatives._MAX)
    who, score, count, scored = negatives.search(anchors, negatives.Side.unpack(candidates.pack()), of, low, high, 5, False)
    pairs = (anchors.tree.child < 0).sum() * (candidates.tree.child < 0).sum()
    assert scored < pairs / 2
    for t in range(0, 800, 7):
        a = ids[ids % 5 == 0][t]
        other = [(-int(m[a] @ m[j]), j) for j in ids if at[j] % 4 != at[a] % 4]
        assert sorted(other)[:5] == [(-s, j) for s, j in zip(score[t], who[t], strict=True)] and count[t] == 5


def test_intervals_hold_every_product():
    rng = np.random.default_rng(6)
    x, y = rng.integers(-9, 9, (30, 5)), rng.integers(-9, 9, (30, 5))
    low, high = negatives.interval(x.min(0), x.max(0), y.min(0), y.max(0))
    products = x @ y.T
    assert low <= products.min() and products.max() <= high


def test_cells_are_dealt_into_bounded_units():
    cells = {(0, 0): 3, (0, 1): 4, (1, 0): 25, (1, 1): 0, (2, 0): 9, (2, 1): 2, (3, 0): 10}
    dealt = boxes.deal(cells, 10)
    assert dealt[1, 0][1] == 3 and dealt[0, 0][0] == dealt[0, 1][0]
    load = {}
    for c, (u, n) in dealt.items():
        load[u] = load.get(u, 0) + cells[c] / n
    assert max(load.values()) <= 10 and set(load) == set(range(len(load)))
