"""Consecutive numbers per group without a window over a whole group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own if unset on a local master."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compressed Parquet in the shared folder, read back: smaller than a checkpoint, and the planner knows its size. Removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_in_groups(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within ``group`` by ``order``.

    Rows are range-partitioned by (group, order), so a group that holds most rows
    spans many tasks. They are written once in that order with their place in the task;
    a table of one row per group and task, which is small, turns places into numbers.
    """
    placed = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    placed = stored(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    runs = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = runs.select(group, "_part", (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n") - F.col("_first") + 1).alias("_shift"))
    before = stored(before, "runs")
    return placed.join(F.broadcast(before), [group, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
