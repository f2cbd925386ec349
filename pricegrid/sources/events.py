"""Price events from the driver's tables: the spine that every operator reads.

An event type is a symbol, an event's id its source sequence, its time the market time; the knowledge time is
later by ten milliseconds for each unit of ``k`` in ``props``. ``raw`` is the value itself, ``price`` a walk
that adds the value at even ids and subtracts it at odd ones, a tenth each time, from 10,000. Prices count
thousandths, times microseconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scaled import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that one bucket of the spine spans: what one task sorts, however long the history of a symbol is.
BUCKET = 1 << 20


def price_events(spark: SparkSession, sf_dir: str, bucket: int = BUCKET) -> DataFrame:
    """symbol, seq (1, 2, ... by symbol), source_sequence, event_us, received_us, raw, price.

    Places and walks are sums within buckets of ids plus the totals of the buckets before, so that no task walks
    through all events of a symbol; only one row for each bucket does. A null value moves nothing; null symbols are a
    symbol, null ids come first.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    delay = F.get_json_object("props", "$.k").cast("long") * 10_000
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("source_sequence"),
        micros(F.col("ts")).alias("event_us"),
        (micros(F.col("ts")) + delay).alias("received_us"),
        (cents * 10).alias("raw"),
        F.when(F.col("event_id") % 2 == 0, cents).otherwise(-cents).alias("move"),
    )
    e = e.withColumn("bucket", F.call_function("div", F.col("source_sequence"), F.lit(bucket)))
    earlier = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = e.groupBy("symbol", "bucket").agg(F.count("*").alias("rows"), F.sum("move").alias("moved"))
    before = totals.select(
        F.col("symbol").alias("of_symbol"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("moved").over(earlier).alias("moved_before")
    )
    w = Window.partitionBy("symbol", "bucket").orderBy("source_sequence")
    own = e.withColumn("nth", F.row_number().over(w)).withColumn("walked", F.sum("move").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = own.join(before, F.col("symbol").eqNullSafe(F.col("of_symbol")) & F.col("bucket").eqNullSafe(F.col("of_bucket")))
    walked = F.coalesce(F.col("walked") + F.col("moved_before"), "walked", "moved_before")
    seq = F.col("nth") + F.col("rows_before")
    return placed.select("symbol", seq.alias("seq"), "source_sequence", "event_us", "received_us", "raw", (walked + 10_000_000).alias("price"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a feed might bring them: some twice, some late.

    Every 97th event comes again 50 events later, every 89th is held back by 5 events. ``arrival`` orders the
    rows of a symbol.
    """
    e = price_events(spark, sf_dir).withColumn("identity_key", F.concat_ws(":", F.lit("feed"), "symbol", F.lit("tick"), F.lit("mid"), F.concat(F.lit("sequence:"), F.col("source_sequence"))))
    late = F.when(F.col("source_sequence") % 89 == 0, F.col("seq") * 10 + 55).otherwise(F.col("seq") * 10)
    again = e.filter(F.col("source_sequence") % 97 == 0).withColumn("arrival", F.col("seq") * 10 + 503)
    return e.withColumn("arrival", late).unionByName(again)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bid, ask and last around the raw value, in thousandths; some are crossed, empty or not positive."""
    e = price_events(spark, sf_dir)
    s = F.col("source_sequence")
    spread = F.col("source_sequence") % 7 * 10
    bid = F.when(s % 101 == 0, F.lit(0)).when(s % 103 == 0, F.lit(None).cast("long")).otherwise(F.col("raw") - spread)
    ask = F.when(s % 107 == 0, F.col("raw") - spread - 10).otherwise(F.col("raw") + spread)
    last = F.when(s % 3 == 0, F.col("raw"))
    return e.select("symbol", "seq", "source_sequence", "event_us", "received_us", bid.alias("bid"), ask.alias("ask"), last.alias("last"))
