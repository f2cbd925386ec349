"""Names against difflib, documents with every mistake, plug-ins that fail, sessions of a stream."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import decoding as D
from pricegrid.operators import plugins as P
from pricegrid.operators import similarity as N
from pricegrid.plans.catalog import QUERIES
from pricegrid.plans.configuration import CONFIG
from pricegrid.streaming import twins


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_is_that_of_the_standard_library():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcd"[: rng.randrange(1, 5)], k=rng.randrange(14))) for _ in range(2))
        assert (2.0 * N.matching_letters(a, b) / (len(a) + len(b)) if a or b else 1.0) == ratio(a, b)


@pytest.mark.parametrize("least", [0.7, 0.8, 1.0])
def test_no_alike_pair_is_missed(spark, least):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abcde", k=rng.randrange(1, 12))) for _ in range(220)} | {"", "abab", "baba", "axbxcx", "aybycy"})
    df = spark.createDataFrame([(n,) for n in names] + [(None,), (names[3],)], "name string")
    got = {(r.a, r.b, r.ratio) for r in N.similar_names(df, "name", least).collect()}
    assert got == {(a, b, ratio(a, b)) for a in names for b in names if a < b and ratio(a, b) >= least}
    with pytest.raises(ValueError):
        N.similar_names(df, "name", 0.5)


def test_candidates_of_a_hint(spark, small):
    part = spark.read.parquet(f"{small}/part.parquet").collect()
    got = {(r.p_partkey, r.exact, r.ratio) for r in QUERIES["symbol_discovery"](spark, small).collect()}
    assert got == {(r.p_partkey, r.p_brand == "Brand#1", ratio("spring part", r.p_name)) for r in part}
    names = {r.p_name for r in part}
    assert {(r.a, r.b) for r in QUERIES["similar_part_names"](spark, small).collect()} == {(a, b) for a in names for b in names if a < b and ratio(a, b) >= 0.8}


def test_documents(spark):
    good = '{"name": "n", "box": 1e3, "reversal": 3, "enabled": false, "mode": "atr", "from": null, "sizing": {"least": "-.5", "most": 2, "note": "x"}}'
    cases = [
        (good, []), (None, ["$:undecodable_json"]), ("", ["$:undecodable_json"]), ("[]", ["$.box:missing_field"]), ("7", None),
        (good.replace('"reversal": 3', '"reversal": 3.5'), ["$.reversal:invalid_scalar"]), (good.replace('"note": "x"', '"note": 1'), ["$.sizing.note:invalid_scalar"]),
        (good.replace('"mode": "atr"', '"mode": null'), ["$.mode:missing_field"]), (good.replace('"from": null', '"from": "yesterday"'), ["$.from:invalid_scalar"]),
        (good.replace("1e3", "Infinity"), ["$:undecodable_json"]), (good.replace('"least"', '"Least"'), ["$.sizing.least:missing_field", "$.sizing:unknown_schema_fields:Least"]),
        (good.replace("{\"least\"", "{\"deep\": {\"least\": 1}, \"least\""), ["$.sizing:unknown_schema_fields:deep"]),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    got = {r.i: (list(r.no), r.yes) for r in spark.createDataFrame(rows, "i int, t string").select("i", D.refusals(F.col("t"), CONFIG).alias("no"), D.decoded(F.col("t"), CONFIG).isNotNull().alias("yes")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i][1] == (i == 0)
        if i not in (3, 4):
            assert got[i][0] == want
    assert got[3][0] == ["$:invalid_object"] and got[4][0] == ["$:invalid_object"]


def test_a_unit_that_fails_leaves_the_rest_alone(spark):
    class Sometimes:
        def find(self, rows):
            if rows[-1][0] is None:
                raise RuntimeError("no value")
            yield f"{len(rows)}:{rows[0][0]}"

    class Always:
        def find(self, rows):
            raise KeyError("k")

    class Greedy:
        def find(self, rows):
            rows.clear()
            return ()

    rows = [("a", i, i if i != 3 else None) for i in range(6)] + [("b", 1, 7), (None, 1, 8)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(3)
    out = P.run_units(df, ["k"], "at", ["v"], {"some": Sometimes(), "greedy": Greedy(), "never": Always()}, window=3)
    got = {(r.k, r["at"], r.unit): (r.status, r.what) for r in out.collect()}
    for k, t, v in rows:
        assert got[k, t, "never"] == ("algorithm_failed", "KeyError: 'k'")
        before = [x for x in rows if x[0] == k and x[1] <= t][-3:]
        assert got[k, t, "some"] == (("algorithm_failed", "RuntimeError: no value") if v is None else ("found", f"{len(before)}:{before[0][2]}"))
    assert len(got) == 2 * len(rows)
    assert P.run_units(df.limit(0), ["k"], "at", ["v"], {"some": Sometimes()}).count() == 0


def test_sessions_of_a_stream(spark, small, tmp_path):
    want = QUERIES["gap_sessions"](spark, small)
    from pricegrid.sources.events import price_events

    e = price_events(spark, small).select("symbol", "price", F.timestamp_micros("event_us").alias("event_time"))
    end = e.agg(F.max("event_time")).first()[0]
    late = spark.createDataFrame([("end", 1)], "symbol string, price long").withColumn("event_time", F.lit(end) + F.expr("interval 2 days"))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    e.unionByName(late).coalesce(1).write.parquet(source)
    spark.createDataFrame([("end", 1)], "symbol string, price long").withColumn("event_time", F.lit(end) + F.expr("interval 4 days")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = twins.sessions(stream, ["symbol"], "10 minutes").writeStream.format("parquet").option("checkpointLocation", state).start(out)
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(out).filter("symbol <> 'end'").select("symbol", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("end_us"), "events", "high", "low")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
