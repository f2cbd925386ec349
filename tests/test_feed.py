"""The recorded feed: range reads, pushed filters and a stream give the rows that reading the files gives."""

import pytest
from pyspark.sql import functions as F

from pricegrid.functions.scaled import micros
from pricegrid.plans.catalog import QUERIES
from pricegrid.sources import feed


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("feed") / "in")
    spark.read.parquet(f"{small}/events.parquet").repartitionByRange(4, "event_id").write.parquet(where)
    feed.register(spark)
    return where


@pytest.fixture(scope="module")
def plain(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    return {(r.symbol, r.sequence, r.at, r.value, r.props) for r in e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("sequence"), micros(F.col("ts")).alias("at"), "value", "props").collect()}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_backfill_is_the_range_scan(spark, small, folder, plain):
    for start, end in ((0, None), (100, 250), (999, 999), (5_000, None), (-9, 3)):
        got = rows(feed.backfill(spark, folder, start, end))
        assert sorted(got) == sorted(r for r in plain if r[1] >= start and (end is None or r[1] <= end))
    with pytest.raises(Exception, match="invalid_backfill_range"):
        feed.backfill(spark, folder, 9, 3).collect()


def test_backfill_of_the_range_scan(spark, tmp_path):
    """The rows of the query range_scan, from a feed with more events."""
    feed.register(spark)
    sf = "/root/testdata/sf0.01"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    want = QUERIES["range_scan"](spark, sf).select("symbol", "source_sequence", "event_us", (F.col("raw") / 1000).alias("value"))
    got = feed.backfill(spark, str(tmp_path / "in"), 1000, 1999).select("symbol", "sequence", "event_us", "value")
    assert sorted(rows(got)) == sorted(rows(want)) and got.count() == 1000


def test_filters_are_taken_over(spark, folder, plain):
    df = spark.read.format("pricegrid_feed").option("path", folder).load()
    asked = df.filter("sequence > 50 and sequence <= 120 and symbol in ('click', 'view') and value > 3")
    assert sorted(rows(asked)) == sorted(r for r in plain if 50 < r[1] <= 120 and r[0] in ("click", "view") and r[3] > 3)
    assert rows(df.filter("sequence = 7")) == [r for r in plain if r[1] == 7]
    assert rows(df.filter("sequence > 120 and sequence < 100")) == []
    reader = feed.FeedReader({"path": folder})
    left = list(reader.pushFilters([feed.GreaterThan(("sequence",), 50), feed.LessThanOrEqual(("sequence",), 120), feed.In(("symbol",), ("a", "b")), feed.EqualTo(("symbol",), "b"), feed.EqualTo(("value",), 1.0)]))
    assert (reader.low, reader.high, reader.symbols, len(left)) == (51, 120, ["b"], 1)
    ranges = reader.partitions()
    assert [r.low for r in ranges] == [51, *[r.high + 1 for r in ranges[:-1]]] and ranges[-1].high == 120 and len(ranges) <= 8


def test_stream_goes_on_behind_its_offset(spark, small, tmp_path):
    feed.register(spark)
    e = spark.read.parquet(f"{small}/events.parquet")
    where, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for low, high in ((0, 300), (300, 700), (700, 10_000)):
        e.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(where)
        stream = spark.readStream.format("pricegrid_feed").option("path", where).option("start", 10).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).start(out)
        query.processAllAvailable()
        query.stop()
    got = spark.read.parquet(out)
    assert sorted(r.sequence for r in got.collect()) == list(range(10, 1000))
    assert sorted(rows(got.select("symbol", "sequence", "value"))) == sorted(rows(e.filter("event_id >= 10").select("event_type", "event_id", "value")))


def test_an_empty_feed(spark, tmp_path):
    feed.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("pricegrid_feed").option("path", str(tmp_path / "none")).load().count() == 0
