"""A lake of cached provider responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: How long a kind of entry stays fresh, in hours; 0 is never.
TTL_HOURS = {"listing": 120, "events": 12, "exact_identity": 4320, "absence": 720, "temporary_failure": 0}
NEGATIVE = (400, 404, 409, 410, 422)


def lookup_cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(provider, operation, identifier) with value, status_code and status: hit, negative or miss.

    Of several entries the latest counts (by retrieved_at). An error other than the negative ones is a miss, and the
    misses are the work to acquire.
    """
    key = ["provider", "operation", "identifier"]
    last = cache.groupBy(*key).agg(F.max_by(F.struct("value", "status_code"), "retrieved_at").alias("c"))
    df = requests.join(last, key, "left")
    negative = F.col("c.status_code").isin(*NEGATIVE)
    status = F.when(F.col("c").isNull(), "miss").when(negative, "negative").when(F.col("c.status_code").isNotNull() & (F.col("c.status_code") >= 400),
        "miss").otherwise("hit")
    return df.select(*requests.columns, F.when(status == "hit", F.col("c.value")).alias("value"),
        F.when(status == "negative", F.col("c.status_code")).alias("status_code"), status.alias("status"))


def freshness(df: DataFrame, now, ttl_hours: dict[str, int] = TTL_HOURS) -> DataFrame:
    """df(kind, retrieved_at) with age_ms and fresh: age is at most the kind's time to live; an unknown kind, or one of 0, is never fresh."""
    ttl = F.lit(None).cast("long")
    for kind, hours in ttl_hours.items():
        ttl = F.when(F.col("kind") == kind, F.lit(hours * 3_600_000).cast("long")).otherwise(ttl)
    age = F.round((F.lit(now).cast("timestamp").cast("double") - F.col("retrieved_at").cast("double")) * 1000).cast("long")
    df = df.withColumn("age_ms", age).withColumn("ttl_ms", ttl)
    return df.withColumn("fresh", F.coalesce((F.col("ttl_ms") > 0) & (F.col("age_ms") <= F.col("ttl_ms")) & (F.col("age_ms") >= 0), F.lit(False)))
