"""The directory: projection, filters, picks and comparison of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import nearest_ranks


def project_directory(df: DataFrame) -> DataFrame:
    """A flat view of rows of two versions, with the fields that drift.

    df: schema_version, artist_id, name, genre, tier, spotify_id, identity struct<name>, editorial struct<genre, tier>,
    external_ids map<string, string>. Version 2 takes the nested fields first, version 1 the flat ones.
    """
    v2 = F.col("schema_version") == 2
    pairs = {"name": F.col("identity.name"), "genre": F.col("editorial.genre"), "tier": F.col("editorial.tier"),
        "spotify_id": F.try_element_at("external_ids", F.lit("spotify"))}
    flat = [F.when(v2, F.coalesce(nested, F.col(c))).otherwise(F.col(c)).alias(c) for c, nested in pairs.items()]
    drift = F.array_compact(F.array(*(F.when(v2 & F.col(c).isNotNull() & nested.isNotNull() & (F.col(c) != nested), F.lit(c)) for c, nested in pairs.items())))
    return df.select("schema_version", "artist_id", *flat, drift.alias("drift"))


def filter_directory(df: DataFrame, genre: str | None = None, tier: str | None = None) -> DataFrame:
    """Rows with exactly this genre and tier; None or "all" is any."""
    for column, value in (("genre", genre), ("tier", tier)):
        if value is not None and value != "all":
            df = df.where(F.col(column) == value)
    return df


def select_cohort(df: DataFrame, outcomes: list[str], blocked: bool = True) -> DataFrame:
    """Rows of a supported outcome, by default those that aren't eligible."""
    df = df.where(F.col("outcome").isin(*outcomes))
    return df.where("not eligible") if blocked else df


def pick_one(df: DataFrame, by: list[str], r: float | None = None, order: str = "artist_id", seed: int = 0) -> DataFrame:
    """A row of each group: that at index floor(r * n), or a uniform one if r is None."""
    w = Window.partitionBy(*by)
    draw = F.lit(r) if r is not None else F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30)) / (1 << 30)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return df.where(F.col("_i") == F.floor(draw * F.col("_n"))).drop("_i", "_n")


def resolve_saved(saved: DataFrame, directory: DataFrame) -> DataFrame:
    """saved(artist_id, position) that the directory has, each once, in order of first position."""
    first = saved.groupBy("artist_id").agg(F.min("position").alias("position"))
    return first.join(directory, "artist_id").orderBy("position")


def _same(columns: list[str], left: str = "l", right: str = "r") -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def parity(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, difference, columns): rows on one side alone, and rows whose values differ."""
    j = left.select(key, *columns).alias("l").join(right.select(key, *columns).alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col(f"r.{key}").isNull(), "left_only").when(F.col(f"l.{key}").isNull(), "right_only").when(~_same(columns), "changed")
    out = j.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), kind.alias("difference"),
        F.array_join(F.when(kind == "changed", changed).otherwise(F.array().cast("array<string>")), ",").alias("columns"))
    return out.where("difference is not null")


def preserved(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Violations of "nothing of `before` is lost or changed": parity() without what is new."""
    return parity(before, after, key, columns).where("difference <> 'right_only'")


#: Where in a group picks are compared.
DRAWS = (0.0, 0.19, 0.5, 0.81, 0.999999)


def pick_parity(left: DataFrame, right: DataFrame, filters: list[str], columns: list[str], draws: tuple[float, ...] = DRAWS) -> DataFrame:
    """(filters, draw, equal): for each combination of filter values on either side, whether a draw picks equal rows.

    left and right have a position, the order of the directory. A draw r of a group of n picks the row at place
    floor(r * n); a group that is empty on one side differs from any row. Picks come from counts, no task ranks a group.
    """

    def picked(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("_g", F.struct(*filters)).withColumn("_p", F.col("position").cast("double"))
        at = nearest_ranks(df, "_p", "_g", draws, above=True)
        rows = df.select("_g", "_p", F.struct(*columns).alias("_row"))
        return at.join(rows, at["_g"].eqNullSafe(rows["_g"]) & (at["value"] == rows["_p"])).select(at["_g"], "q", F.col("_row").alias(name))

    a, b = picked(left, "row_a").alias("a"), picked(right, "row_b").alias("b")
    both = a.join(b, F.col("a._g").eqNullSafe(F.col("b._g")) & (F.col("a.q") == F.col("b.q")), "full")
    return both.select(F.coalesce("a._g", "b._g").alias("_g"), F.coalesce("a.q", "b.q").alias("draw"), F.col("row_a").eqNullSafe(F.col("row_b")).alias("equal")).select("_g.*", "draw", "equal")
