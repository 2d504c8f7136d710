"""Consecutive numbers over a whole table without a task that sees all of it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir). Where none is set, a local session gets a new one; a cluster needs one that all its machines see."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column of the numbers 1 to n in an order.

    Rows are dealt into ranges and counted by range; a range starts where those before it end. The ranges are written
    first, so all steps see the same ones.
    """
    shared_folder(df.sparkSession)
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges = ranges.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).checkpoint()
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_k"))
    # one row a range
    starts = counts.select("_range", (F.sum("_k").over(Window.orderBy("_range")) - F.col("_k")).alias("_start"))
    return ranges.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_start") + F.col("_n")).alias(name))
