"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..operators.numbering import shared_folder as shared_dir


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to and from Python at once: executors hold a few batches each, and texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of bounded size; release it once what reads it is written."""
    return spark.sparkContext.broadcast(value)


def release(*shared: Broadcast | None) -> None:
    for b in shared:
        if b is not None:
            b.destroy()


def unused(taken: list[str], name: str) -> str:
    """name, or the first of name_, name__ ... that no column has; Spark ignores case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
