"""State in the store, snapshots of it, and each reason to leave a snapshot aside."""

import json

import pytest
from pyspark.sql import functions as F

from pricegrid.operators import columns as C
from pricegrid.plans.spine_sql import RESOLUTIONS, REVERSAL
from pricegrid.sources.events import price_events
from pricegrid.streaming import recovery as R


@pytest.fixture(scope="module")
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, R.PROVIDER)
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def events(spark, small):
    e = C.fan_out(price_events(spark, small).filter("symbol in ('click', 'view')"), RESOLUTIONS)
    key = F.concat_ws(":", "symbol", "seq")
    return e.select("symbol", "resolution", "seq", "event_us", "price", "box", key.alias("event_key"), F.sha2(key, 256).alias("content_hash")).cache()


@pytest.fixture(scope="module")
def journal(events):
    return events.select(F.concat_ws("/", "symbol", "resolution").alias("stream"), F.col("seq").alias("sequence"), "event_key", "content_hash")


@pytest.fixture(scope="module")
def stopped(spark, events, provider, tmp_path_factory):
    """A stream that saw the first 100 events of each symbol, out of order and some twice, and its rows."""
    at = tmp_path_factory.mktemp("stream")
    source, out, state = (str(at / x) for x in ("in", "out", "state"))
    for low, high in ((30, 60), (0, 40), (55, 100)):
        events.filter((F.col("seq") > low) & (F.col("seq") <= high)).orderBy(F.rand(7)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        query = R.columns_of_stream(stream, REVERSAL).writeStream.format("parquet").option("checkpointLocation", state).start(out)
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(out), R.stored_states(spark, state)


def batch(events):
    return C.transitions(events.select("symbol", "resolution", "seq", "event_us", "price", "box"), ["symbol", "resolution"], REVERSAL)


def same(a, b):
    return sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_stream_out_of_order_equals_the_batch_run(events, stopped):
    rows, states = stopped
    assert same(rows, batch(events.filter("seq <= 100"))) and rows.count() > 5
    got = {(r.symbol, r.resolution): (r.seq, r.event_key, r.event_count) for r in states.collect()}
    assert got == {(s, r): (100, f"{s}:100", 100) for s in ("click", "view") for r in RESOLUTIONS}


def test_restart_equals_replay(spark, events, journal, stopped, tmp_path):
    kept = spark.read.parquet(R.save_snapshots(stopped[1], str(tmp_path), "test"))
    checked = R.checked_snapshots(kept, journal, "test")
    assert [r.reason for r in checked.collect()] == [None] * 6
    assert same(R.recovered(events, checked, REVERSAL), batch(events).filter("seq > 100"))
    # keys whose snapshot can't be trusted are replayed from the beginning, the others go on
    doubtful = checked.withColumn("reason", F.when(F.col("resolution") == "fast", "blob_hash_mismatch"))
    assert same(R.recovered(events, doubtful, REVERSAL), batch(events).filter("seq > 100 or resolution = 'fast'"))


def test_each_reason_to_reject(spark, journal, stopped, tmp_path):
    first = stopped[1].filter("symbol = 'click' and resolution = 'fast'")
    (row,) = spark.read.parquet(R.save_snapshots(first, str(tmp_path), "test")).collect()
    header, blob = json.loads(row.header), bytes(row.blob)

    def rehashed(data):
        frame = spark.createDataFrame([(data,)], "b binary").select(F.sha2("b", 256)).first()[0]
        return {"blob_hash": frame, "blob_size": len(data)}

    cases = {
        None: (header, blob), "header_corrupt": ("{", blob), "schema_version_mismatch": (header | {"version": 9}, blob), "environment_mismatch": (header | {"environment": "other"}, blob),
        "stream_mismatch": (header | {"stream": "x/y"}, blob), "code_fingerprint_mismatch": (header | {"fingerprint": "f"}, blob), "blob_hash_mismatch": (header, blob + b" "),
        "event_reference_invalid": (header | {"last_content_hash": "c"}, blob), "event_count_mismatch": (header | {"event_count": 99}, blob), "decode_failed": (header | rehashed(b'{"symbol": NaN'), b'{"symbol": NaN'),
    }
    for reason, (told, data) in cases.items():
        kept = spark.createDataFrame([(row.stream, told if isinstance(told, str) else json.dumps(told), data)], "stream string, header string, blob binary")
        (got,) = R.checked_snapshots(kept, journal, "test").collect()
        assert got.reason == reason and (got.symbol == "click") == (reason is None)
    missing = {k: v for k, v in header.items() if k != "event_count"}
    assert R.checked_snapshots(spark.createDataFrame([(row.stream, json.dumps(missing), blob)], "stream string, header string, blob binary"), journal, "test").first().reason == "header_corrupt"
    with pytest.raises(ValueError, match="checkpoint_environment_required"):
        R.save_snapshots(first, str(tmp_path), "")
