"""Overlays: all references must resolve, projections only where they are kept up to date."""

from fractions import Fraction

from pricegrid.operators import overlays as V
from pricegrid.plans import charts, market
from pricegrid.plans.catalog import QUERIES


def test_an_overlay_needs_all_its_references(spark):
    chart = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("s", 3, 4), ("s", 3, 4), ("t", 9, 1), ("s", 7, None), (None, 4, 2)], "k string, seq long, column_id int")
    asked = [("s", "whole", [3, 1, 2]), ("s", "twice", [1, 1]), ("s", "lost", [1, 8]), ("s", "other", [9]), ("s", "no column", [7]), ("s", "none", []), ("s", "null", None), (None, "nokey", [4])]
    df = spark.createDataFrame(asked, "k string, name string, refs array<long>")
    got = {r.name: r.columns for r in V.resolved(df, ["k", "name"], "refs", chart, ["k"]).collect()}
    assert got == {"whole": [4, 5], "twice": [5], "nokey": [2]}
    assert V.resolved(df, ["k", "name"], "refs", chart.limit(0), ["k"]).count() == 0


def test_projection(spark):
    chart = spark.createDataFrame([("s", 10), ("u", 3)], "k string, column_id int")
    lines = [("s", "up", 1, 100, 4, 109, "active"), ("s", "half", 2, 0, 4, 1, "broken"), ("s", "kept", 1, 100, 4, 109, "retest_held"), ("u", "ahead", 1, 100, 4, 109, "active"), ("v", "no chart", 1, 1, 2, 2, "active"),
             ("s", "flat", 4, 5, 4, 7, "active"), ("s", "priceless", 1, None, 2, 5, "active")]
    df = spark.createDataFrame(lines, "k string, line string, a_column int, a_price long, b_column int, b_price long, state string")
    got = {r.line: (r.to_column, r.to_price, r.projected, r.slope_milli) for r in V.line_overlays(df, chart, ["k"]).collect()}
    assert got == {"up": (10, 127, True, 3000), "half": (10, 4, True, 500), "kept": (4, 109, False, 3000), "ahead": (4, 109, False, 3000), "no chart": (2, 2, False, 1000), "flat": (4, 7, False, None)}


def test_breaks(spark):
    chart = spark.createDataFrame([("s", 5, 2, 70), ("s", 6, 3, None)], "k string, seq long, column_id int, to_price long")
    breaks = spark.createDataFrame([("s", "ok", 2, 5), ("s", "wrong column", 3, 5), ("s", "priceless", 3, 6), ("s", "gone", 1, 1)], "k string, line string, break_column int, break_seq long")
    assert [tuple(r) for r in V.break_overlays(breaks, chart, ["k"]).collect()] == [("s", "ok", 2, 70)]


def test_lines_and_breaks_of_real_events(spark, small):
    from pricegrid.operators import structure as S

    m = market.moves(spark, small).cache()
    column = {(r.symbol, r.resolution, r.seq): (r.column_id, r.to_price) for r in m.collect()}
    newest: dict = {}
    for (s, r, _), (c, _) in column.items():
        newest[s, r] = max(newest.get((s, r), 0), c)
    last, broken = {}, {}
    for r in S.trendlines(m, market.KEY).orderBy("symbol", "resolution", "seq").collect():
        key = (r.symbol, r.resolution, f"{r.kind}:{r.anchor_a_seq}:{r.anchor_b_seq}")
        last[key] = r if key not in last or r.seq >= last[key].seq else last[key]
        if r.state == "broken":
            broken.setdefault(key, r.seq)
    got = {(r.symbol, r.resolution, r.line): (r.to_column, r.to_price, r.projected) for r in QUERIES["trendline_overlays"](spark, small).collect()}
    assert set(got) == set(last) and len(got) > 10
    for key, (to, price, projected) in got.items():
        r, (a, pa), (b, pb) = last[key], column[(*key[:2], last[key].anchor_a_seq)], column[(*key[:2], last[key].anchor_b_seq)]
        if projected:
            assert to == newest[key[:2]] and price == pb + round(Fraction((pb - pa) * (to - b), b - a))
        else:
            assert (to, price) == (b, r.anchor_b_price)
    assert any(p for *_, p in got.values())
    drawn = {(r.symbol, r.resolution, r.line): (r.column_id, r.price) for r in QUERIES["break_overlays"](spark, small).collect()}
    assert drawn == {k: column[(*k[:2], s)] for k, s in broken.items() if column[(*k[:2], s)][0] > newest[k[:2]] - charts.NEWEST}
