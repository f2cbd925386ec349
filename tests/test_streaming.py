"""A stream that stops and starts again gives the rows of the batch run."""

from pyspark.sql import functions as F

from pricegrid.operators import columns as C
from pricegrid.plans.market import moves
from pricegrid.plans.spine_sql import RESOLUTIONS, REVERSAL
from pricegrid.sources.events import price_events
from pricegrid.streaming import twins


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_transitions_survive_a_restart(spark, small, tmp_path):
    e = C.fan_out(price_events(spark, small).filter("symbol in ('click', 'view')"), RESOLUTIONS).select("symbol", "resolution", "seq", "event_us", "price", "box")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for low, high in ((0, 100), (100, 10_000)):
        e.filter((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        drain(twins.transitions(stream, REVERSAL).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").start(out))
    want = moves(spark, small).filter("symbol in ('click', 'view')")
    got = spark.read.parquet(out)
    assert got.count() == want.count() > 0
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_duplicates_and_candles(spark, small, tmp_path):
    e = price_events(spark, small).filter("symbol = 'click'").select("symbol", "seq", "price", F.timestamp_micros("event_us").alias("event_time"), F.col("seq").cast("string").alias("identity_key"))
    e.unionByName(e.filter("seq % 10 = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    drain(twins.deduplicated(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).start(str(tmp_path / "dedup")))
    assert spark.read.parquet(str(tmp_path / "dedup")).count() == e.count()
    once = spark.readStream.schema(e.schema).parquet(str(tmp_path / "dedup"))
    drain(twins.candles(once, ["symbol"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).start(str(tmp_path / "candles")))
    got = spark.read.parquet(str(tmp_path / "candles"))
    batch = e.groupBy(F.window("event_time", "30 minutes").start.alias("start")).agg(F.min_by("price", "seq").alias("open"), F.count("*").alias("samples"))
    assert got.join(batch, ["start", "open", "samples"]).count() == got.count() >= batch.count() - 2
