"""Shared helpers: checkpoints, written scratch tables, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; if that is unset, one of our own on a local master, where there is but one machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise small tables on reliable storage and cut their lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def put_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a small file into a folder of its own below the shared one."""
    path = f"{scratch_path(spark, 'file')}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(content)
    out.close()
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialise a large table as compressed Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A null text is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
