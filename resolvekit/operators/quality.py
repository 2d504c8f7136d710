"""Data quality: rule tables, references, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import content_id


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is a condition that a good row meets (null breaks it)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items())))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows) of values that several rows have; nulls aside."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return stacked.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("rows")).where("rows > 1")


def ref_violations(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """(value, rows) of a column's values that target lacks."""
    known = target.select(F.col(target_column).alias(column))
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti").groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def key_drift(df: DataFrame, key: str, stored: dict[str, Column]) -> DataFrame:
    """(key, column) where a stored derived column differs from what is computed afresh."""
    off = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(fresh), F.lit(c)) for c, fresh in stored.items())))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(off).alias("column"))


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever its order.

    Digests of rows are added up in four parts of 32 bits, so partitions combine their sums and no list of all rows
    is made; the digest is that of the sums and the number of rows.
    """
    row = F.substring(content_id(*df.columns), 8, 64)
    parts = [F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = df.select(*(p.alias(f"p{k}") for k, p in enumerate(parts))).agg(F.count("*").alias("rows"),
        *(F.coalesce(F.sum(f"p{k}"), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4)))
    return sums.select("rows", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "s0", "s1", "s2", "s3"), 256)).alias("digest"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether two tables have equal rows, by digest."""
    return table_digest(before).alias("a").crossJoin(table_digest(after).alias("b")).select((F.col("a.digest") == F.col("b.digest")).alias("unchanged"), F.col("a.rows").alias("rows_before"), F.col("b.rows").alias("rows_after"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def union_unique(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """The rows of all tables, each key once: that of the first table that has it, of several rows there the smallest."""
    rest = [c for c in tables[0].columns if c not in key]
    every = tables[0].withColumn("_table", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.withColumn("_table", F.lit(i)))
    return every.groupBy(*key).agg(F.min(F.struct("_table", *rest)).alias("_r")).select(*(F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in tables[0].columns))


#: Keys whose values are secret, and where a secret stands in a text.
SECRET_KEYS = "(?i)(api[_-]?key|client[_-]?secret|access[_-]?token|authorization|bearer)"
SECRET_URL, SECRET_BEARER = r"(?i)([?&](?:apikey|api_key|access_token|client_secret)=)[^&\s]+", r"(?i)Bearer\s+\S+"


def redact_logs(df: DataFrame, texts: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """df with secrets replaced in text columns (URL parameters, bearer tokens) and in the values of string maps (also by key)."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, SECRET_URL, "$1REDACTED"), SECRET_BEARER, "Bearer REDACTED")
    for c in texts:
        df = df.withColumn(c, clean(F.col(c)))
    for c in maps:
        df = df.withColumn(c, F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET_KEYS), "REDACTED").otherwise(clean(v))))
    return df
