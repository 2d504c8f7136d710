"""Release catalogs: variants, metrics, fingerprints and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import clamp_round, partial_date, title_key
from .numbering import shared_folder

DAY = 86_400.0


def release_variants(releases: DataFrame, unicode: bool = True) -> DataFrame:
    """releases(artist_id, id, name, release_date, release_date_precision, album_type, total_tracks, position) with `kept` and `variant_group`.

    The first row of an id counts, rows without id go. Of one type, title key and year the earliest is kept, then
    that with the fewest tracks, then the first; an unknown date or track number sorts last.
    """
    first = Window.partitionBy("artist_id", "id").orderBy("position")
    df = releases.where("id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    df = df.withColumn("date", partial_date("release_date", "release_date_precision")).withColumn("title", title_key("name", unicode))
    df = df.withColumn("kind", F.coalesce("album_type", F.lit("unknown"))).withColumn("year", F.year("date.start"))
    group = Window.partitionBy("artist_id", "kind", "title", "year")
    order = group.orderBy(F.col("date.start").asc_nulls_last(), F.when(F.col("total_tracks") > 0, F.col("total_tracks")).asc_nulls_last(), "position")
    return df.withColumn("kept", F.row_number().over(order) == 1).withColumn("group_size", F.count("*").over(group))


def catalog_metrics(releases: DataFrame, now, unicode: bool = True, complete: bool = True) -> DataFrame:
    """A row for each artist: span, counts, activity before `now`, and the four scores."""
    now = F.lit(now).cast("timestamp")
    v = release_variants(releases, unicode)
    kept = F.col("kept")
    days = lambda x: (now.cast("double") - x.cast("double")) / DAY
    since = lambda n: F.count_if(kept & (days(F.col("date.end")) <= n) & (now >= F.col("date.start")))
    out = v.groupBy("artist_id").agg(
        F.min(F.when(kept, F.col("date.start"))).alias("earliest"),
        F.max(F.when(kept, F.struct(F.col("date.start"), F.col("date.end")))).alias("last"),
        F.count_if(kept).alias("unique_release_count"),
        F.count_if(kept & (F.col("album_type") == "album")).alias("album_count"),
        F.count_if(kept & (F.col("album_type") == "single")).alias("single_count"),
        F.coalesce(F.sum(F.when(kept, F.col("total_tracks"))), F.lit(0)).cast("long").alias("track_count"),
        since(90).alias("releases_90"), since(365).alias("releases_365"), since(730).alias("releases_730"),
        F.count_if(kept & (F.col("group_size") > 1)).alias("variant_groups"),
        F.count_if(kept & (F.col("date.precision") != "day")).alias("partial_dates"),
    )
    last = F.col("last.end")
    out = out.withColumn("span_years", F.floor((last.cast("double") - F.col("earliest").cast("double")) / (365.2425 * DAY) * 10 + 0.5) / 10)
    out = out.withColumn("days_since_latest", F.greatest(F.lit(0), F.floor(days(last))).cast("long"))
    out = out.withColumn("days_since_latest", F.when(last.isNotNull(), F.col("days_since_latest")))
    raw = F.col("album_count") * 9 + F.col("single_count") * 2.5 + F.col("track_count") * 0.35
    recency = F.coalesce(45 * F.exp(-F.col("days_since_latest") / 240), F.lit(0.0))
    trust = 100 - 3 * F.col("variant_groups") - 1.5 * F.col("partial_dates") - (0 if complete else 35)
    return out.select(
        "artist_id", "unique_release_count", "album_count", "single_count", "track_count", "releases_90", "releases_365", "releases_730",
        "variant_groups", "partial_dates", "span_years", "days_since_latest",
        F.coalesce(clamp_round(F.col("span_years") * 5), F.lit(0)).cast("long").alias("maturity_score"),
        clamp_round(100 * (1 - F.exp(-raw / 55))).alias("depth_score"),
        clamp_round(recency + F.col("releases_90") * 18 + F.col("releases_365") * 8 + F.col("releases_730") * 3).alias("momentum_score"),
        F.when(F.col("unique_release_count") == 0, F.lit(25 if complete else 0)).otherwise(clamp_round(trust)).cast("long").alias("confidence_score"),
    )


def suggest_tiers(metrics: DataFrame) -> DataFrame:
    """metrics with the tiers that they support, as text in a fixed order."""
    span = F.col("span_years")
    base = F.when(span >= 20, F.array(F.lit("legacy"), F.lit("classic"))).when((span <= 6) & (F.col("momentum_score") >= 35),
        F.array(F.lit("emerging"))).otherwise(F.array(F.lit("underground"), F.lit("emerging")))
    more = F.when(F.col("depth_score") >= 70, F.array(F.lit("mainstream"))).otherwise(F.array().cast("array<string>"))
    return metrics.withColumn("tiers", F.array_join(F.concat(base, more), ","))


def fingerprint(releases: DataFrame, unicode: bool = True) -> DataFrame:
    """Release count, distinct title keys, earliest and latest year of each artist; releases without a title key go."""
    df = releases.withColumn("title", title_key("name", unicode)).where("title <> ''").withColumn("year",
        F.year(partial_date("release_date", "release_date_precision")["start"]))
    return df.groupBy("artist_id").agg(F.count("*").alias("release_count"), F.countDistinct("title").alias("title_count"),
        F.min("year").alias("earliest_year"), F.max("year").alias("latest_year"))


#: Profiles of a title that meet in a task, twice.
PANEL = 1000


def _meeting(df: DataFrame, least: int) -> DataFrame:
    """(group_id, left_id, right_id, overlap) of different profiles, left below right, of distinct df(group_id, profile_id, title)."""
    sizes = df.groupBy("group_id", "title").agg(F.count("*").alias("_m")).where("_m > 1")
    shared = df.join(sizes, ["group_id", "title"])
    if least > 1:  # of a profile's shared titles, all but the most frequent ones
        place = Window.partitionBy("group_id", "profile_id").orderBy(F.desc("_m"), "title")
        meet = shared.withColumn("_place", F.row_number().over(place)).where(F.col("_place") >= least).drop("_place")
        sizes = meet.groupBy("group_id", "title").agg(F.count("*").alias("_m"))
        meet = meet.drop("_m").join(sizes.where("_m > 1"), ["group_id", "title"])
    else:
        meet = shared
    panels = F.ceil(F.col("_m") / PANEL).cast("int")
    own, every = F.pmod(F.xxhash64("profile_id"), panels).cast("int"), F.explode(F.sequence(F.lit(0), panels - 1))
    left = meet.select("group_id", "title", F.col("profile_id").alias("left_id"), own.alias("_i"), every.alias("_j"))
    right = meet.select("group_id", "title", F.col("profile_id").alias("right_id"), every.alias("_i"), own.alias("_j"))
    pairs = left.join(right, ["group_id", "title", "_i", "_j"]).where("left_id < right_id")
    if least == 1:
        return pairs.groupBy("group_id", "left_id", "right_id").agg(F.count("*").alias("overlap"))
    whole = shared.groupBy("group_id", "profile_id").agg(F.collect_list("title").alias("_titles"))
    of = lambda side: whole.select("group_id", F.col("profile_id").alias(f"{side}_id"), F.col("_titles").alias(f"_{side}"))
    found = pairs.select("group_id", "left_id", "right_id").distinct().join(of("left"), ["group_id", "left_id"]).join(of("right"), ["group_id", "right_id"])
    found = found.withColumn("overlap", F.size(F.array_intersect("_left", "_right")).cast("long"))
    return found.where(F.col("overlap") >= least).select("group_id", "left_id", "right_id", "overlap")


def pairwise_overlap(titles: DataFrame, least: int = 1, common: int | None = None) -> DataFrame:
    """(group_id, left_id, right_id, overlap) of titles(group_id, profile_id, title): how many titles two profiles of a group share.

    Profiles of a group with the same titles are compared once, by the least of them; what that one shares holds for all of
    them, and they meet in panels of PANEL, without a shuffle of their pairs. Of these, only profiles that share a title meet,
    at titles. With `least` above 1 a pair also shares one that isn't among the least - 1 most frequent ones of either profile,
    so these make no pairs, and a title that all have costs nothing; the pairs that are left are counted by their whole titles.
    Profiles of a title go in panels of PANEL, and a task has two panels, not the title. `common` leaves out titles that more
    profiles of a group have (generic ones); None leaves out none.
    """
    df = titles.where("title is not null and title <> ''").select("group_id", "profile_id", "title").distinct()
    if common is not None:
        df = df.withColumn("_n", F.count("*").over(Window.partitionBy("group_id", "title"))).where(F.col("_n") <= common).drop("_n")
    shared_folder(df.sparkSession)
    sets = df.groupBy("group_id", "profile_id").agg(F.array_sort(F.collect_list("title")).alias("_set"))
    same = sets.groupBy("group_id", "_set").agg(F.min("profile_id").alias("_rep"), F.count("*").alias("_k"))
    # written once, as several steps read them; few where many profiles are alike
    same = same.checkpoint()
    pairs = _meeting(same.select("group_id", F.col("_rep").alias("profile_id"), F.explode("_set").alias("title")), least)
    alike = same.where("_k > 1")
    if alike.isEmpty():
        return pairs
    own = alike.where(F.size("_set") >= least).select("group_id", F.col("_rep").alias("left_id"), F.col("_rep").alias("right_id"), F.size("_set").cast("long").alias("overlap"))
    # members of a set, in panels
    members = sets.join(same.select("group_id", "_set", "_rep", "_k"), ["group_id", "_set"])
    panel = F.pmod(F.xxhash64("profile_id"), F.ceil(F.col("_k") / PANEL)).alias("_panel")
    members = members.groupBy("group_id", "_rep", panel).agg(F.collect_list("profile_id").alias("_members")).drop("_panel").checkpoint()
    side = lambda c: members.select("group_id", F.col("_rep").alias(f"{c}_id"), F.col("_members").alias(f"_{c}"))
    met = pairs.unionByName(own).join(side("left"), ["group_id", "left_id"]).join(side("right"), ["group_id", "right_id"])
    met = met.select("group_id", (F.col("left_id") == F.col("right_id")).alias("_own"), "overlap", F.explode("_left").alias("_a"), "_right")
    met = met.select("group_id", "_own", "overlap", "_a", F.explode("_right").alias("_b")).where(~F.col("_own") | (F.col("_a") < F.col("_b")))
    return met.select("group_id", F.least("_a", "_b").alias("left_id"), F.greatest("_a", "_b").alias("right_id"), "overlap")


def enrich_catalog(editorial: DataFrame, identity: DataFrame, releases: DataFrame, now) -> DataFrame:
    """editorial(name) x identity(name, artist_id) x catalog_metrics; a row without identity says so in `error`."""
    found = editorial.join(identity.select("name", "artist_id").dropDuplicates(["name"]), "name", "left")
    out = found.join(catalog_metrics(releases, now), "artist_id", "left")
    return out.withColumn("error", F.when(F.col("artist_id").isNull(), "missing_identity").when(F.col("unique_release_count").isNull(), "empty_catalog"))
