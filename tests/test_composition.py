"""Signals to trades and experiences, against plain replays of the same rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import composition as P
from pricegrid.operators import gates as G
from pricegrid.operators import structure as S
from pricegrid.plans import decisions, market
from pricegrid.plans.research import COST, ENTRY_US, EXIT_US, SIZE
from pricegrid.sources.events import price_events


@pytest.fixture(scope="module")
def events(spark, small):
    out: dict = {}
    for r in price_events(spark, small).orderBy("symbol", "seq").collect():
        out.setdefault(r.symbol, []).append(r)
    return out


def test_spine_over_many_buckets(spark, small):
    """Buckets of 7 ids give the rows that one bucket gives."""
    one, many = ({tuple(r) for r in price_events(spark, small, b).collect()} for b in (1 << 20, 7))
    assert one == many and len(one) == 1000


def test_spine_with_nulls_and_empty(spark, tmp_path):
    schema = "event_type string, event_id long, ts timestamp_ntz, value double, props string"
    rows = [("a", None, None, 1.0, None), ("a", 1, None, None, "{}"), ("a", 9, None, 2.0, '{"k": 1}'), (None, 2, None, 3.0, None), ("b", 3, None, None, None), ("b", 8, None, 1.0, None)]
    for name, given in (("some", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}/events.parquet")
    got = {b: sorted(((r.symbol or "", r.seq, r.source_sequence, r.price) for r in price_events(spark, f"{tmp_path}/some", b).collect())) for b in (4, 1 << 20)}
    assert got[4] == got[1 << 20] and [r[1] for r in got[4]] == [1, 1, 2, 3, 1, 2]
    assert price_events(spark, f"{tmp_path}/none").count() == 0


def test_canonical_rows_differ(spark):
    rows = [("a|b=c", "d"), ("a", "b=c|d"), (None, "d"), ("", "d"), ("\\N", "d"), ("x\\", "d")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert len({r[0] for r in df.select(G.canonical("a", "b")).collect()}) == len(rows)
    assert df.limit(1).select(G.canonical("a", "b")).first()[0] == "a=a\\|b\\=c|b=d"


def test_signal_trades_by_replay(spark, small, events):
    issued = [r for r in decisions.signals(spark, small).collect() if r.status == "issued"]
    want = set()
    for r in issued:
        of = events[r.symbol]
        side, decided = ("long" if r.action == "BUY" else "short"), of[r.seq - 1].received_us
        entry = next((e for e in of if e.event_us >= decided + ENTRY_US), None)
        left = entry and next((e for e in of if e.event_us >= entry.event_us + EXIT_US), None)
        net = None
        if left:
            net = (1 if side == "long" else -1) * (left.price - entry.price) * SIZE - COST * SIZE
        want.add((r.symbol, r.seq, side, decided, entry and entry.event_us, left and left.event_us, net))
    got = decisions.signal_trades(spark, small).select("symbol", "seq", "side", "decision_us", "entry_us", "exit_us", "net").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(issued) > 0
    totals = {r.symbol: (r.trades, r.unfilled) for r in decisions.signal_metrics(spark, small).collect()}
    assert totals == {s: (sum(w[0] == s and w[6] is not None for w in want), sum(w[0] == s and w[6] is None for w in want)) for s in {w[0] for w in want}}


def test_experiences_and_their_end_by_replay(spark, small, events):
    found = {(r.symbol, r.seq): r for r in decisions.signal_experiences(spark, small).collect()}
    want, before = set(), {}
    for r in decisions.scored(spark, small).orderBy("symbol", "seq").collect():
        facts = (r.action, r.alignment, r.support, r.resistance, r.label, r.bullish_patterns, r.bearish_patterns, *(r[s] for s in P.SIDES), *(p and p.seq for p in (r.p0, r.p1, r.p2)))
        if before.get(r.symbol) != facts:
            want.add((r.symbol, r.seq))
        before[r.symbol] = facts
    assert set(found) == want and len({r.experience_id for r in found.values()}) == len(want)
    one = next(iter(found.values()))
    assert one.experience_id == hashlib.sha256(f"{P.POLICY}|{one.symbol}|{one.seq}|{one.fingerprint}".encode()).hexdigest()
    planned = [r for r in found.values() if r.stop is not None]
    assert planned and all(r.plan_risk > 0 and (r.stop < r.zone_low if r.side == "long" else r.stop > r.zone_high) for r in planned)

    hour, ends = 3_600_000_000, {}
    for key, x in found.items():
        of, entered, state = events[x.symbol], False, None
        sign = 1 if x.side == "long" else -1
        for e in of if x.side and x.zone_low is not None else ():
            if not (x.t0 < e.event_us <= x.t0 + hour and e.received_us > x.t0) or state in ("TP2", "INVALIDATED"):
                continue
            if not entered:
                entered = x.zone_low <= e.price <= x.zone_high
                state = "ACTIVE" if entered else None
            elif sign * (e.price - x.stop) <= 0:
                state = "INVALIDATED"
            elif sign * (e.price - x.tp2) >= 0:
                state = "TP2"
            elif sign * (e.price - x.tp1) >= 0:
                state = "TP1"
        if state not in ("TP2", "INVALIDATED"):
            if of and max(e.event_us for e in of) >= x.t0 + hour:
                state = "CLOSED" if entered or not x.side else "EXPIRED"
            else:
                state = state or ("SIGNAL_CREATED" if x.side else "OBSERVED")
        ends[key] = state
    assert {(r.symbol, r.seq): r.state for r in decisions.experience_closing(spark, small).collect()} == ends
    horizons = decisions.signal_horizons(spark, small)
    assert horizons.count() == 4 * sum(r.side is not None for r in found.values())


def test_every_closing_state(spark):
    minute, hour = 60_000_000, 3_600_000_000
    plans = {
        "TP2": ("long", [100, 125]), "INVALIDATED": ("long", [100, 89, 125]), "CLOSED": ("long", [100, 112]), "EXPIRED": ("long", [105, 125]), "no direction": (None, [100, 125]),
        "ACTIVE": ("long", [100]), "TP1": ("short", [100, 88]), "SIGNAL_CREATED": ("long", [105]), "OBSERVED": (None, [100]),
    }
    found, events = [], []
    for name, (side, path) in plans.items():
        sign = -1 if side == "short" else 1
        found.append((name, 1, name, 0, side, *((99, 101, 100 - 10 * sign, 100 + 10 * sign, 100 + 20 * sign) if side else [None] * 5)))
        events += [(name, i + 2, (i + 1) * minute, (i + 1) * minute, v) for i, v in enumerate(path)]
        if name in ("CLOSED", "EXPIRED", "no direction"):
            events.append((name, 99, hour, hour + 1, 105))
    x = spark.createDataFrame(found, "symbol string, seq long, experience_id string, t0 long, side string, zone_low long, zone_high long, stop long, tp1 long, tp2 long")
    e = spark.createDataFrame(events, "symbol string, seq long, event_us long, received_us long, price long")
    got = {r.symbol: r.state for r in P.closing_states(x, e).collect()}
    assert got == {n: "CLOSED" if n == "no direction" else n for n in plans}


def test_readiness_against_real_lines(spark, small):
    lines: dict = {}
    for r in S.trendlines(market.moves(spark, small).filter(F.col("resolution") == "fast"), market.KEY).collect():
        lines.setdefault((r.symbol, r.seq), []).append(r)
    got = {(r.symbol, r.seq): r.readiness for r in decisions.entry_readiness_all(spark, small).collect()}
    states, want = {}, {}
    for r in decisions.scored(spark, small).select("symbol", "seq", "action").orderBy("symbol", "seq").collect():
        at: dict = {}
        for x in lines.get((r.symbol, r.seq), []):
            if x.state != "replaced":
                at.setdefault(x.kind, []).append("active" if x.state == "touch" else x.state)
        for kind, seen in at.items():
            states[r.symbol, kind] = "active" if "active" in seen else seen[-1]
        line = states.get((r.symbol, {"BUY": "bullish_support", "SELL": "bearish_resistance"}.get(r.action)))
        want[r.symbol, r.seq] = "NOT_READY" if r.action == "WAIT" else {None: "READY", "active": "READY", "retest_failed": "READY", "retesting": "DEVELOPING"}.get(line, "BLOCKED")
    assert got == want and len(got) > 100


def test_empty_tables(spark):
    events = spark.createDataFrame([], "symbol string, seq long, event_us long, received_us long, price long")
    issued = spark.createDataFrame([], "symbol string, seq long, action string, status string, at_seq long, score int")
    assert P.signal_trades(issued, events, 1, 1).count() == 0
    found = spark.createDataFrame([], "symbol string, seq long, experience_id string, t0 long, side string, zone_low long, zone_high long, stop long, tp1 long, tp2 long")
    assert P.closing_states(found, events).count() == 0


def test_predictions(spark, tmp_path):
    """A frozen target, a late one, one behind a gap; a second writing of the records changes nothing."""
    from pricegrid.operators import outcomes as O
    from pricegrid.sources import journal

    minute = 60_000_000
    given = [(10, 10, 100_000), (40, 40, 101_000), (70, 70, 104_000), (100, 100, 109_000), (119.5, 125, 110_000), (300, 300, 90_000)]
    rows = [("s", i + 1, int(t * minute), int(r * minute), p) for i, (t, r, p) in enumerate(given)]
    e = spark.createDataFrame(rows, "symbol string, seq long, event_us long, received_us long, price long")
    made = O.predictions(e, ["symbol"], minute, O.lean(3_000), "lean-v1")
    got = {r.target_us // minute: r for r in made.collect()}
    assert {t: (r.status, r.bias, r.reason, r.reference, r.history) for t, r in got.items()} == {
        30: ("FROZEN", "UNAVAILABLE", None, 100_000, 0), 60: ("FROZEN", "NEUTRAL", None, 101_000, 1), 90: ("FROZEN", "BULLISH", None, 104_000, 2),
        120: ("FROZEN", "BULLISH", None, 109_000, 3), 300: ("SKIPPED", "UNAVAILABLE", "discontinuous_feed", 110_000, 0),
    }
    assert (got[120].late, got[120].freeze_lag_us) == (True, 5 * minute) and len({r.prediction_id for r in got.values()}) == 5
    odd = O.predictions(e, ["symbol"], minute, lambda reference, closes: F.lit("MAYBE"), "odd-v1")
    assert {(r.bias, r.reason) for r in odd.collect()} == {("UNAVAILABLE", "algorithm_invalid_output"), ("UNAVAILABLE", "discontinuous_feed")}
    assert O.predictions(e.limit(0), ["symbol"], minute, O.lean(1), "x").count() == 0

    def kept(df):
        return df.select(F.lit("m30").alias("stream"), F.col("prediction_id").alias("event_key"), F.to_json(F.struct(*df.columns)).alias("payload"))

    path = str(tmp_path / "predictions")
    assert (journal.append(spark, path, kept(made), 0), journal.append(spark, path, kept(made), 1)) == (5, 0)
    with pytest.raises(journal.JournalConflict):
        journal.append(spark, path, kept(made.withColumn("bias", F.lit("BEARISH"))), 2)
