"""Hand fixtures with expected results."""

import pytest
from pyspark.sql import functions as F

from pricegrid.functions.joins import as_of, range_join
from pricegrid.functions.scaled import divide_half_even
from pricegrid.operators import columns as C
from pricegrid.operators import gates as G
from pricegrid.operators import hygiene as H
from pricegrid.operators import ledgers as L
from pricegrid.operators import outcomes as O
from pricegrid.operators import structure as S
from pricegrid.sources import journal


def prices(spark, values, box=1000):
    rows = [("s", i + 1, 60_000_000 * i, round(v * 1000), box) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, seq long, event_us long, price long, box long")


def kinds(spark, values, reversal=2):
    return [(r.kind, r.boxes, r.direction) for r in C.transitions(prices(spark, values), ["symbol"], reversal).orderBy("seq").collect()]


def moves(spark, targets):
    rows = [("s", i + 1, i * 60_000_000, "extension", i + 1, "X", 0, t, 1, 1) for i, t in enumerate(targets)]
    return spark.createDataFrame(rows, "symbol string, seq long, event_us long, kind string, column_id int, direction string, from_price long, to_price long, boxes int, box long")


def test_columns(spark):
    assert kinds(spark, [100.0, 100.4, 100.8]) == []
    assert kinds(spark, [100.0, 101.1, 102.2, 103.2, 102.8, 101.0]) == [("seed", 1, "X"), ("extension", 1, "X"), ("extension", 1, "X"), ("reversal", 2, "O")]
    assert kinds(spark, [100.0, 103.0, 101.0]) == [("seed", 3, "X"), ("reversal", 2, "O")]
    assert kinds(spark, [100.0, 104.0, 97.0]) == [("seed", 4, "X"), ("reversal", 7, "O")]


def test_columns_of_empty_and_null_prices(spark):
    assert C.transitions(prices(spark, []), ["symbol"]).count() == 0
    df = prices(spark, [100.0, 105.0]).unionByName(spark.createDataFrame([("s", 3, 0, None, 1000)], "symbol string, seq long, event_us long, price long, box long"))
    assert C.transitions(df, ["symbol"]).count() == 1


def test_box_holds_without_movement(spark):
    out = C.atr_box(prices(spark, [100, 100, 100, 102.5]), ["symbol"], "seq", period=2, multiplier_percent=1000, least=500, most=2000, fixed=1000, step=100).orderBy("seq").collect()
    assert [(r.box, r.reason) for r in out] == [(1000, "warmup_missing_previous"), (1000, "warmup_insufficient_window"), (1000, "zero_volatility_hold_last"), (2000, "atr")]


def test_pivots_and_levels(spark):
    assert [(r.kind, r.price) for r in S.pivots(moves(spark, [100, 105, 101]), ["symbol"]).collect()] == [("high", 105)]
    got = {(r.side, r.price, r.status) for r in S.levels(moves(spark, [100, 105, 101, 106]), ["symbol"]).collect()}
    assert ("resistance", 105, "invalidated") in got


def test_regime(spark):
    def labels(values):
        rows = [("s", i + 1, v) for i, v in enumerate(values)]
        p = spark.createDataFrame(rows, "symbol string, seq long, price long")
        return [(r.label, r.reason) for r in S.regime(p, ["symbol"], lookback=4, trend=4000, volatile=8000, hysteresis=1600).orderBy("seq").collect()]

    assert labels([100000, 101000, 103000, 106000])[-1][0] == "trend"
    assert labels([100000, 101000, 99500, 101200])[-1][0] == "range"
    assert labels([100000, 110000, 101000, 109000])[-1][0] == "high_volatility"
    fold = S.RegimeFold(4000, 8000, 1600)
    assert [fold.step(i, s, s, 4)[0][3:] for i, s in enumerate((6000, 2500, 2300))] == [("trend", "trend_slope_threshold"), ("trend", "hysteresis_hold"), ("range", "range_compaction")]


@pytest.mark.parametrize(
    "name, values",
    [("double_bottom", [99800, 104000, 100000]), ("double_top", [110000, 104000, 110100]), ("head_and_shoulders", [110000, 105000, 115000, 105500, 110300, 104000])],
)
def test_patterns(spark, name, values):
    first = "low" if name == "double_bottom" else "high"
    other = "high" if first == "low" else "low"
    rows = [("s", i, v, (first, other)[i % 2], i + 1) for i, v in enumerate(values)]
    p = spark.createDataFrame(rows, "symbol string, seq long, price long, kind string, confirmed_seq long")
    assert name in {r["name"] for r in S.patterns(p, ["symbol"], 1000).collect()}


def test_trendlines_replayed_by_hand(spark):
    """A brute-force replay with fractions gives the same life of every line."""
    from fractions import Fraction
    import random

    rnd = random.Random(5)
    rows, price, column, direction = [], 100, 1, 1
    for i in range(400):
        if rnd.random() < 0.4:
            direction, column = -direction, column + 1
        price += direction * rnd.randint(1, 4)
        rows.append(("s", i + 1, i, "extension", column, "X" if direction > 0 else "O", 0, price, 1, 1))
    df = spark.createDataFrame(rows, "symbol string, seq long, event_us long, kind string, column_id int, direction string, from_price long, to_price long, boxes int, box long")
    got = [(r.seq, r.kind, r.anchor_a_seq, r.anchor_b_seq, r.state) for r in S.trendlines(df, ["symbol"]).collect()]

    want, pool, line = [], {"low": [], "high": []}, {"low": None, "high": None}
    for i, r in enumerate(rows):
        seq, col, to = r[1], r[4], r[7]
        if i >= 2:
            a, b = rows[i - 2][7], rows[i - 1][7]
            kind = "high" if b > a and b > to else "low" if b < a and b < to else None
            if kind:
                pool[kind].append((b, rows[i - 1][4], rows[i - 1][1]))
        for side in ("low", "high"):
            x = line[side]
            if x and x[2] in ("active", "broken", "retesting"):
                (pa, ca, sa), (pb, cb, sb) = x[0], x[1]
                d = to - (pb + Fraction(pb - pa, cb - ca) * (col - cb))
                d = d if side == "low" else -d
                new = None
                if x[2] == "active":
                    new = "broken" if d < 0 else "touch" if d < 1 else None
                elif x[2] == "broken":
                    new = "retesting" if abs(d) < 1 else None
                else:
                    new = "retest_held" if d <= -1 else "retest_failed" if d >= 1 else None
                if new:
                    want.append((seq, side, sa, sb, new))
                    if new != "touch":
                        x[2] = new
                    if new.startswith("retest_"):
                        x[3] = i
        for side in ("low", "high"):
            if len(pool[side]) < 2:
                continue
            a, b = pool[side][-2:]
            x = line[side]
            if a[1] == b[1] or (b[0] <= a[0] if side == "low" else b[0] >= a[0]):
                continue
            if x and (x[2] not in ("broken", "retest_held", "retest_failed") or x[3] == i or (x[0][2], x[1][2]) == (a[2], b[2])):
                continue
            if x:
                want.append((seq, side, x[0][2], x[1][2], "replaced"))
            line[side] = [a, b, "active", -1]
            want.append((seq, side, a[2], b[2], "active"))
    names = {"low": "bullish_support", "high": "bearish_resistance"}
    assert got == [(s, names[k], a, b, st) for s, k, a, b, st in want]
    assert len(want) > 20


def test_flags(spark):
    rows = [("s", i, s, t, k) for i, (s, t, k) in enumerate([(1, 10, "a"), (2, 20, "b"), (4, 40, "c"), (3, 30, "d"), (4, 40, "c")])]
    df = spark.createDataFrame(rows, "symbol string, arrival long, source_sequence long, event_us long, identity_key string")
    out = H.stream_flags(df, ["symbol"], ["arrival"]).orderBy("arrival").collect()
    assert [(r.is_duplicate, r.is_out_of_order, r.is_gap, r.gap_from_sequence) for r in out] == [
        (False, False, False, None), (False, False, False, None), (False, False, True, 3), (False, True, False, None), (True, False, False, None),
    ]


def test_bad_ticks(spark):
    df = spark.createDataFrame([(100, 101), (None, 5), (-1, 5), (2400250, 2400100)], "bid long, ask long")
    assert [r[0] for r in df.select(H.tick_violation(F.col("bid"), F.col("ask"))).collect()] == [None, "missing_price", "nonpositive_price", "crossed_market"]


def test_fills(spark):
    rows = [("s", i + 1, t * 1_000_000, p * 1000) for i, (t, p) in enumerate([(0, 100), (2, 101), (7, 103), (300, 106), (302, 105), (307, 102)])]
    e = spark.createDataFrame(rows, "symbol string, seq long, event_us long, price long")
    s = spark.createDataFrame([("s", 1, 0, "long"), ("s", 4, 300_000_000, "short"), ("s", 6, 307_000_000, "long")], "symbol string, seq long, decision_us long, side string")
    out = {r.seq: r for r in O.profit(O.fills(s, e, 2_000_000, 5_000_000), 1, 170).collect()}
    assert (out[1].entry_price, out[1].exit_price, out[1].net) == (101000, 103000, 1830)
    assert (out[4].entry_price, out[4].exit_price, out[4].net) == (105000, 102000, 2830)
    assert out[6].entry_us is None and out[6].net is None


def test_candle_and_outcome(spark):
    rows = [("s", 1, -60_000_000, 100200)] + [("s", i + 2, m * 60_000_000, p) for i, (m, p) in enumerate([(0, 100500), (5, 99200), (20, 101300), (29, 100800)])]
    e = spark.createDataFrame(rows, "symbol string, seq long, event_us long, price long")
    c = O.candles(e, ["symbol"]).filter("bucket_us = 0").first()
    assert (c.open, c.high, c.low, c.close, c.samples, c.max_gap_us) == (100500, 101300, 99200, 100800, 4, 900_000_000)
    o = O.candle_outcomes(e, ["symbol"], 3000).filter("bucket_us = 0").first()
    assert (o.up, o.down, o.close_return, o.body, o.drift, o.first_touch) == (1100, 1000, 600, 300, 300, "NONE")


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("g", None)], "g string, v long")
    r = O.nearest_ranks(df, ["g"], "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}).first()
    assert (r.n, r.p25, r.median, r.p75) == (4, 1, 2, 3)


def test_overlaps(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 3), ("g", 5, 9), ("g", 10, 12), ("g", 1, 5)], "g string, a long, b long")
    r = O.overlaps(df, ["g"], "a", "b").first()
    pairs = [(1, 5), (2, 3), (5, 9), (10, 12), (1, 5)]
    want = sum(x[0] <= y[1] and y[0] <= x[1] for i, x in enumerate(pairs) for y in pairs[:i])
    assert (r.pairs, r.most_open) == (want, 3)


def test_lifecycle(spark):
    plan = [("s", 1, 0, "long", 99, 101, 90, 110, 120)]
    p = spark.createDataFrame(plan, "symbol string, seq long, t0 long, side string, zone_low long, zone_high long, stop long, tp1 long, tp2 long")
    rows = [("s", i, 1_000_000 * (i + 1), 1_000_000 * (i + 1), v) for i, v in enumerate([105, 100, 112, 125, 80])]
    e = spark.createDataFrame(rows, "symbol string, seq long, event_us long, received_us long, price long")
    assert [r.state for r in O.lifecycles(p, e).orderBy("at_us").collect()] == ["ENTRY_TRIGGERED", "ACTIVE", "TP1", "TP2"]


def test_risk_gates(spark):
    rows = [("a", 1, 0, 1000, 10, 5, True, False, 0, 0), ("a", 2, 0, 1000, 10, 5, True, True, 0, 0), ("a", 3, 0, 1000, 10, 5, False, False, 0, 0), ("a", 4, 0, 1000, 2, 5, True, False, 0, 0),
            ("a", 5, 0, 1000, 10, 50, True, False, 0, 0), ("a", 6, 0, 400, 10, 5, True, False, 150, 0)]
    df = spark.createDataFrame(rows, "acc string, seq long, day long, equity long, stop long, wanted long, live boolean, kill boolean, released long, pnl long")
    df = df.withColumn("in_use", F.when(F.col("seq") == 5, 60).otherwise(0).cast("long")).withColumn("currency", F.lit(True)).withColumn("quality", F.lit(True))
    limits = {"risk_per_trade": 100, "step": 1, "min_stop": 5, "exposure": 120, "daily_loss": 1000, "drawdown": 500}
    out = L.risk_decisions(df, "acc", limits).orderBy("seq").collect()
    assert [r.reason for r in out] == ["allowed", "kill_switch_active", "stale_or_missing_price", "stop_distance_too_small", "exposure_limit", "drawdown_limit"]
    refused = df.filter("seq = 1").withColumn("currency", F.lit(False)).unionByName(df.filter("seq = 2").withColumn("kill", F.lit(False)).withColumn("quality", F.lit(False)))
    assert [r.reason for r in L.risk_decisions(refused, "acc", limits).orderBy("seq").collect()] == ["currency_mismatch", "quality_unavailable"]


def test_reconcile(spark):
    l = spark.createDataFrame(
        [("L1", "I", "long", 5, 90, False), ("L2", "I", "long", 5, 90, False), ("L3", "J", "short", 1, None, False), ("L4", "K", "long", 1, None, True)],
        "position_id string, instrument string, side string, quantity long, stop long, closed boolean",
    )
    b = spark.createDataFrame(
        [("B1", "L1", "I", "long", 5, 90, False), ("B2", "L2", "I", "long", 6, 91, False), ("B3", "L4", "K", "long", 1, None, False)],
        "broker_ref string, local_ref string, instrument string, side string, quantity long, stop long, close_pending boolean",
    )
    got = {(r.position_ref, r.finding) for r in G.reconcile(l, b).collect()}
    assert got == {("L1", "MATCH"), ("L2", "QUANTITY_MISMATCH"), ("L2", "PROTECTION_MISMATCH"), ("B3", "BROKER_POSITION_LOCAL_MISSING"), ("L3", "BROKER_FLAT_CONFIRMED")}


def test_half_even(spark):
    df = spark.createDataFrame([(5,), (15,), (25,), (-5,), (-15,), (14,), (16,)], "v long")
    assert [r[0] for r in df.select(divide_half_even(F.col("v"), 10)).collect()] == [0, 2, 2, 0, -2, 1, 2]


def test_joins(spark):
    left = spark.createDataFrame([("a", 10), ("a", 5), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("a", 12, 3)], "k string, t long, v long")
    assert {(r.k, r.t, r.v) for r in as_of(left, right, ["k"], "t", ["v"]).collect()} == {("a", 10, 2), ("a", 5, 1), ("b", 1, None)}
    assert {(r.k, r.t, r.v) for r in as_of(left, right, ["k"], "t", ["v"], forward=True).collect()} == {("a", 10, 3), ("a", 5, 1), ("b", 1, None)}
    spans = spark.createDataFrame([("a", 1, 4, 8)], "k string, i long, lo long, hi long")
    got = range_join(spans, right.withColumnRenamed("t", "at"), ["k"], "at", F.col("lo"), F.col("hi"), 3)
    assert sorted(r.v for r in got.collect()) == [1, 2]


def test_journal(spark, tmp_path):
    path = str(tmp_path / "journal")
    one = spark.createDataFrame([("s", "k1", "x"), ("s", "k2", "y")], "stream string, event_key string, payload string")
    assert journal.append(spark, path, one, 0) == 2
    assert journal.append(spark, path, one, 1) == 0
    with pytest.raises(journal.JournalConflict):
        journal.append(spark, path, spark.createDataFrame([("s", "k1", "z")], "stream string, event_key string, payload string"), 2)
    assert journal.corrupt(spark, path).count() == 0


def test_signals_do_not_look_ahead(spark, small):
    """Signals issued by the first half of the events are the same with the other half cut off."""
    from pricegrid.operators import signals as G
    from pricegrid.plans.spine_sql import RESOLUTIONS, STRUCTURE
    from pricegrid.sources.events import price_events

    def issued(events):
        m = C.transitions(C.fan_out(events, RESOLUTIONS), ["symbol", "resolution"])
        scored = G.score(G.inputs(events, m, C.matrix(events, m, "symbol", list(RESOLUTIONS)), list(RESOLUTIONS), STRUCTURE, 2500), 2500)
        return {tuple(r) for r in scored.select("symbol", "seq", "buy_points", "sell_points", "score", "action").filter("seq <= 120").collect()}

    e = price_events(spark, small)
    whole = issued(e)
    assert whole == issued(e.filter("seq <= 120")) and len(whole) > 20


def test_cooldown_and_repetition():
    """Cooldown and expiry count events, not the rows that could be issued."""
    from pricegrid.operators.signals import IssueFold

    fold = IssueFold(cooldown=2, expiry=6)
    asked = [(10, "BUY", "x"), (12, "SELL", "y"), (13, "BUY", "x"), (16, "BUY", "x"), (17, "BUY", "x"), (19, "BUY", "x"), (20, "SELL", "x")]
    assert [s for s, a, r in asked if list(fold.step(s, a, 70, r))] == [10, 17, 20]


def test_signals_expire_unless_another_follows(spark, small):
    from pricegrid.plans.catalog import QUERIES

    got: dict = {}
    for r in QUERIES["signals"](spark, small).collect():
        got.setdefault((r.symbol, r.status), []).append((r.seq, r.at_seq))
    last = {r.symbol: r.n for r in QUERIES["price_events_spine"](spark, small).groupBy("symbol").agg(F.max("seq").alias("n")).collect()}
    assert any(status == "expired" for _, status in got)
    for (symbol, status), rows in got.items():
        if status == "issued":
            seqs = sorted(s for s, _ in rows)
            assert all(b - a > 3 for a, b in zip(seqs, seqs[1:], strict=False))
            gone = [(a, a + 21) for a, b in zip(seqs, [*seqs[1:], None], strict=True) if a + 21 <= last[symbol] and (b is None or b >= a + 21)]
            assert sorted(got.get((symbol, "expired"), [])) == gone


def test_values_are_carried_over_buckets(spark):
    from pricegrid.functions.joins import forward_fill

    rows = [("a", i, i if i % 7 == 0 else None) for i in range(40)] + [("b", 3, None), ("b", 30, 5), ("b", 39, None), (None, 1, 2), (None, 25, None)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(3)
    for width in (1, 5, 1000):
        got = {(r.k, r.at): r.got for r in forward_fill(df, ["k"], "at", {"got": F.col("v")}, width).collect()}
        assert got == {(k, t): next((v for s, u, v in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1]) if u <= t and v is not None), None) for k, t, _ in rows}


def test_ordered_scan_of_all_events(spark, small):
    from pricegrid.plans.catalog import QUERIES
    from pricegrid.sources.events import price_events

    e = sorted((r.event_us, r.received_us, r.source_sequence, r.symbol, r.price) for r in price_events(spark, small).collect())
    got = sorted((r.position, r.event_us, r.source_sequence, r.symbol, r.price) for r in QUERIES["ordered_scan_all"](spark, small).collect())
    assert len(got) == 1000 and got == [(i + 1, t, q, s, p) for i, (t, _, q, s, p) in enumerate(e)]


def test_observations_of_all_kinds(spark, small):
    from pricegrid.operators.capture import KINDS
    from pricegrid.plans import market
    from pricegrid.plans.catalog import QUERIES

    key = ["symbol", "resolution"]
    got = [tuple(r) for r in QUERIES["observations_all"](spark, small).collect()]
    m = market.moves(spark, small).cache()
    pivots = S.pivots(m, key)
    want = {
        "pnf.transition": m.count(),
        "structure.pivot_confirmed": pivots.count(),
        "structure.level_invalidated": S.levels(m, key).filter("status = 'invalidated'").count(),
        "pattern": S.patterns(pivots, key, 2500).count(),
        "trendline.state": S.trendlines(m, key).select(*key, "kind", "anchor_a_seq", "anchor_b_seq", "state").distinct().count(),
        "signal.issued": QUERIES["signals"](spark, small).filter("status = 'issued'").count(),
    }
    assert {k: sum(r[0] == k for r in got) for k in want} == want and set(want) < set(KINDS)
    actions: dict = {}
    for r in QUERIES["signal_evidence"](spark, small).orderBy("symbol", "seq").collect():
        of = actions.setdefault(r.symbol, [])
        if not of or of[-1][1] != r.action:
            of.append((r.seq, r.action))
    decided = {(r[1], r[3], r[4].split("|")[0]) for r in got if r[0] == "signal.decision"}
    assert decided == {(s, *x) for s, of in actions.items() for x in of}
    assert {r[0] for r in got} == set(KINDS)


def test_levels_and_chains_of_every_resolution(spark, small):
    import hashlib

    from pricegrid.plans import market
    from pricegrid.plans.catalog import QUERIES

    key = ["symbol", "resolution"]
    m = market.moves(spark, small).cache()
    levels, chains = [tuple(r) for r in S.levels(m, key).select(*key, "side", "price", "confirmed_seq", "invalidated_seq").collect()], {}
    want = set()
    for r in m.collect():
        row = [r.symbol, r.resolution, r.seq]
        for side in ("support", "resistance"):
            held = [(c, p) for s, n, d, p, c, i in levels if (s, n, d) == (r.symbol, r.resolution, side) and c <= r.seq and (i is None or i > r.seq)]
            row.append(max(held)[1] if held else None)
        want.add(tuple(row))
    assert {tuple(r) for r in QUERIES["active_levels_asof_all"](spark, small).collect()} == want
    for r in S.pivots(m, key).orderBy(*key, "seq").collect():
        chain, n = chains.get((r.symbol, r.resolution), ("", 0))
        chains[r.symbol, r.resolution] = (hashlib.sha256(f"{chain}|{r.kind}:{r.price}".encode()).hexdigest(), n + 1)
    got = {(r.symbol, r.resolution): (r.chain, r.records) for r in QUERIES["hash_chain_all"](spark, small).collect()}
    assert got == chains and {n for _, n in got} == {"fast", "medium", "slow"} == {n for _, n, *_ in want}


def test_a_late_look_ahead_of_any_kind_is_a_difference(spark, small):
    """A capture that looks one event ahead, only after event 120 and only for one kind that is no transition."""
    from pyspark.sql.window import Window

    from pricegrid.plans import research
    from pricegrid.sources.events import price_events

    def peeking(e):
        w = Window.partitionBy("symbol").orderBy("seq")
        pivots = e.withColumn("what", F.when(F.col("seq") > 120, F.lead("price").over(w)).otherwise(F.col("price")).cast("string"))
        return pivots.select(F.lit("structure.pivot_confirmed").alias("subject"), "symbol", F.lit(None).cast("string").alias("resolution"), "seq", "what")

    e = price_events(spark, small)
    got = {r.change: r.differences for r in research.differences(e, peeking).collect()}
    assert set(got) == {"prefix", "reflect", "flatten", "shock"} and all(got.values())
    honest = lambda e: e.select(F.lit("x").alias("subject"), "symbol", F.lit(None).cast("string").alias("resolution"), "seq", F.col("price").cast("string").alias("what"))
    assert not any(r.differences for r in research.differences(e, honest).collect())


def test_lifecycles_meet_events_without_pairs(spark):
    """As a plain loop has it on a crowded clock, across buckets; no join makes a row of every plan and event."""
    import random

    rng = random.Random(4)
    hour = 3_600_000_000
    rows = [("s", i, at, at + rng.choice([-5, 0, hour // 4]), rng.choice([None, *range(80, 121)])) for i, at in enumerate(sorted(rng.randrange(22, 27) * hour + rng.randrange(0, 9) * hour // 8 for _ in range(600)))]
    plans = []
    for k in range(120):
        side, t0, step = rng.choice(["long", "short"]), rng.randrange(21, 27) * hour + rng.randrange(0, 8) * hour // 8, rng.randrange(1, 12)
        sign = 1 if side == "long" else -1
        plans.append(("s", k, t0, side, 100 - step // 2, 100 + step // 2, rng.choice([None, 100 - sign * step]), 100 + sign * step, rng.choice([None, 100 + 2 * sign * step])))
    p = spark.createDataFrame(plans, "symbol string, seq long, t0 long, side string, zone_low long, zone_high long, stop long, tp1 long, tp2 long")
    e = spark.createDataFrame(rows, "symbol string, seq long, event_us long, received_us long, price long")
    want = []
    for _, seq, t0, side, low, high, stop, one, two in plans:
        near = [(at, s, v) for _, s, at, known, v in rows if v is not None and t0 < at <= t0 + hour and known > t0]
        entry = next((x for x in near if low <= x[2] <= high), None)
        if entry is None:
            continue
        sign = 1 if side == "long" else -1
        after = [x for x in near if x > entry]
        first = lambda level, way: None if level is None else next((x for x in after if way * sign * (x[2] - level) >= 0), None)  # noqa: B023, E731
        s, a, b = first(stop, -1), first(one, 1), first(two, 1)
        before = lambda x, s=s: x is not None and (s is None or x < s)
        found = [("ENTRY_TRIGGERED", entry), ("ACTIVE", entry), *([("TP1", a)] if before(a) else []), *([("TP2", b)] if before(b) else []), *([("INVALIDATED", s)] if s and not before(b) else [])]
        want += [("s", seq, n, x[0], x[2]) for n, x in found]
    out = O.lifecycles(p, e)
    assert sorted(map(tuple, out.collect())) == sorted(want) and {w[2] for w in want} == {"ENTRY_TRIGGERED", "ACTIVE", "TP1", "TP2", "INVALIDATED"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_matrix_of_a_symbol_is_cut_into_buckets(spark, small):
    from pricegrid.plans.market import moves
    from pricegrid.plans.spine_sql import RESOLUTIONS
    from pricegrid.sources.events import price_events

    e, m = price_events(spark, small), moves(spark, small)
    want, got = C.matrix(e, m, "symbol", list(RESOLUTIONS)), C.matrix(e, m, "symbol", list(RESOLUTIONS), width=7)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # an event isn't a row for each resolution
