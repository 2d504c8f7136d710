"""Exact percentiles by counting: which range of values holds a rank, again and again until a range is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .numbering import shared_folder

#: Ranges that values are dealt into in a round; rows of a range that a task sorts at most.
RANGES, FEW = 1024, 10_000


def nearest_ranks(df: DataFrame, value: str, group: str, shares: tuple[float, ...], few: int = FEW, above: bool = False) -> DataFrame:
    """(group, q, value) for each group of df and each share q: the least value that at least q of the group's values don't exceed.
    above: the least one that more than q of them don't exceed (the place floor(q * n) counted from 0).

    Nulls don't count, and a group without values has no row; a group of null is one of its own. A round counts values
    by range between the least and the largest that are still open; the range that holds the rank goes on. Ranges
    hold few rows in the end, or equal ones. No task holds a group's values.
    """
    spark = df.sparkSession
    shared_folder(spark)
    rows = df.select(F.struct(F.col(group).alias("g")).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    q = spark.createDataFrame([(float(s),) for s in shares], "q double")
    whole = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).join(F.broadcast(q))
    # ceil of a product that is whole but for rounding
    nearest = F.floor(F.col("q") * F.col("n") + 1e-9) + 1 if above else F.ceil(F.col("q") * F.col("n") - 1e-9)
    rank = F.least(F.greatest(F.lit(1), nearest), F.col("n")).cast("long")
    open_ = whole.select("k", "q", rank.alias("rank"), "n", "low", "high").checkpoint()
    done = open_.where("low = high").select("k", "q", F.col("low").alias("v"))
    open_ = open_.where("low < high")
    while not open_.where(F.col("n") > few).isEmpty():
        range_ = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))
        within = rows.join(open_, "k").where("v between low and high").withColumn("range", range_)
        counts = within.groupBy("k", "q", "rank", "range").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        # at most RANGES rows each
        upto = counts.withColumn("upto", F.sum("m").over(Window.partitionBy("k", "q").orderBy("range")))
        held = upto.where("rank <= upto and rank > upto - m")
        open_ = held.select("k", "q", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"), F.col("m").alias("n"), "low", "high").checkpoint()
        done = done.unionByName(open_.where("low = high").select("k", "q", F.col("low").alias("v")))
        open_ = open_.where("low < high")
    last = rows.join(open_, "k").where("v between low and high").withColumn("place", F.row_number().over(Window.partitionBy("k", "q").orderBy("v")))
    done = done.unionByName(last.where("place = rank").select("k", "q", "v"))
    return done.select(F.col("k.g").alias(group), "q", F.col("v").alias("value"))
