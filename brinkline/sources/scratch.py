"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 200_000  # rows of a table that may be sent to the executors


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may have none, and then uses a temporary folder."""
    out = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not out:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        out = tempfile.mkdtemp(prefix="brinkline-")
        spark.conf.set("spark.checkpoint.dir", out)
    return out.rstrip("/")


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The table as read back from where it is written, a folder for each value of ``by``: later plans do not compute it again."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Marked for a broadcast join if it has few rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over all cores, for steps that cost far more than reading: a small file of
    one row group would else be the work of one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def swept(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes the shuffle files of plans that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
