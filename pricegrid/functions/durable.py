"""Tables written once to the folder that driver and executors share, and positions in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    A folder of this machine is taken only where that setting is absent and tasks run in this process, as in tests.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again, so that nothing depends on a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds position, 1, 2, ... in ``order``: range partitions number their rows, their totals give the offsets.

    Only one row for each partition meets in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at)
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(dealt.withColumn("__part", part).withColumn("__row", row).drop("__at"))
    totals = placed.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__before") + F.col("__row") + 1).alias("position"))
