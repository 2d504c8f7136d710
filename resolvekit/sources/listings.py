"""Provider listings and records, flattened and normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def flatten_listing(pages: DataFrame, mode: str) -> DataFrame:
    """(ref, record_id, entity_id, name, position, parent_id) of listing pages.

    exact: items array<struct<id, name, source_record_id>>. search: artists struct<offset, items array<struct<id, name>>>
    and query. albums: albums array<struct<id, name, artists array<struct<id, name>>>>, a row for each album and artist.
    """
    null = F.lit(None).cast("string")
    if mode == "exact":
        x = pages.select("ref", F.posexplode("items").alias("i", "x"))
        return x.select("ref", F.coalesce("x.source_record_id", "x.id").alias("record_id"), F.col("x.id").alias("entity_id"),
            F.col("x.name").alias("name"), F.col("i").cast("long").alias("position"), null.alias("parent_id"))
    if mode == "search":
        x = pages.select("ref", "query", F.coalesce("artists.offset", F.lit(0)).alias("o"), F.posexplode("artists.items").alias("i", "x"))
        place = (F.col("o") + F.col("i")).cast("long")
        return x.select("ref", F.concat_ws(":", "query", place.cast("string"), "x.id").alias("record_id"), F.col("x.id").alias("entity_id"),
            F.col("x.name").alias("name"), place.alias("position"), null.alias("parent_id"))
    if mode == "albums":
        x = pages.select("ref", F.posexplode("albums").alias("i", "a")).select("ref", "i", "a", F.posexplode("a.artists").alias("j", "x"))
        return x.select("ref", F.concat_ws(":", "a.id", "x.id").alias("record_id"), F.col("x.id").alias("entity_id"), F.col("x.name").alias("name"),
            (F.col("i") * 1000 + F.col("j")).cast("long").alias("position"), F.col("a.id").alias("parent_id"))
    raise ValueError(f"unknown mode {mode}")


def flatten_events(pages: DataFrame) -> DataFrame:
    """A row for each event and attraction of pages(ref, events array<struct<...>>): date, venue, place, coordinates and the legacy ids in the attraction's URL."""
    e = pages.select("ref", F.explode("events").alias("e")).select("ref", "e", F.posexplode_outer("e.attractions").alias("i", "a"),
        F.try_element_at("e.venues", F.lit(1)).alias("v"))
    legacy = F.array_distinct(F.array_compact(F.array(F.nullif(F.regexp_extract("a.url", "/artist/([0-9]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract("a.url", "[?&]id=([0-9]+)", 1), F.lit("")))))
    return e.select(
        "ref", F.col("e.id").alias("event_id"), F.col("e.name").alias("event_name"), F.col("i").cast("long").alias("position"),
            F.col("a.id").alias("attraction_id"), F.col("a.name").alias("attraction_name"),
        F.coalesce("e.date_time", "e.local_date").alias("starts"), F.col("v.name").alias("venue"), F.col("v.city").alias("city"), F.col("v.country").alias("country"),
        F.col("v.latitude").try_cast("double").alias("latitude"), F.col("v.longitude").try_cast("double").alias("longitude"),
            F.coalesce(legacy, F.array().cast("array<string>")).alias("legacy_ids"),
    )


def normalise_attractions(df: DataFrame) -> DataFrame:
    """df(id, name, images array<struct<ratio, url, width>>, classifications array<struct<is_primary, segment, genre>>, upcoming map) with its best image (16:9 first, then the widest), primary classification and number of upcoming events."""
    rank = lambda x: F.struct(F.when(x["ratio"] == "16_9", 1).otherwise(0), F.coalesce(x["width"], F.lit(0)), x["url"])
    best = F.array_max(F.transform(F.filter("images", lambda x: x["url"].isNotNull()), lambda x: F.struct(rank(x).alias("r"), x["url"].alias("url"))))["url"]
    main = F.coalesce(F.try_element_at(F.filter("classifications", lambda c: c["is_primary"]), F.lit(1)), F.try_element_at("classifications", F.lit(1)))
    return df.select("id", "name", best.alias("image_url"), main["segment"].alias("segment"), main["genre"].alias("genre"),
        F.coalesce(F.try_element_at("upcoming", F.lit("_total")), F.lit(0)).alias("upcoming"))


def collapse_bindings(rows: DataFrame, key: str = "lookup") -> DataFrame:
    """(lookup, entities, entity, external_ids, ranks, status) of a row for each combination (lookup, qid, external_id, rank): distinct sets, and 409 where several entities answer."""
    out = rows.groupBy(key).agg(F.countDistinct("qid").alias("entities"), F.min("qid").alias("entity"),
        F.array_sort(F.collect_set("external_id")).alias("external_ids"), F.array_sort(F.collect_set(F.regexp_extract("rank", "([A-Za-z]+)Rank$", 1))).alias("ranks"))
    return out.withColumn("status", F.when(F.col("entities") == 1, 200).when(F.col("entities") > 1, 409).otherwise(404)).withColumn("entity",
        F.when(F.col("entities") == 1, F.col("entity")))


def normalise_authority(df: DataFrame) -> DataFrame:
    """df(id, name, type, country, begin, `end`, aliases array<struct<name>>, relations array<struct<type, url>>) flat, with alias names and distinct URLs."""
    return df.select("id", "name", F.lower("type").alias("kind"), "country", "begin", F.col("`end`").alias("ended"),
        F.array_sort(F.array_distinct(F.transform("aliases", lambda a: a["name"]))).alias("aliases"),
            F.array_sort(F.array_distinct(F.array_compact(F.transform("relations", lambda r: r["url"])))).alias("urls"))


def url_relations(df: DataFrame) -> DataFrame:
    """(url, id, name): artists behind each exact URL of df(position, id, name, relations), the last row of an id counts."""
    x = df.select("position", "id", "name", F.explode("relations").alias("r"))
    return x.groupBy(F.col("r.url").alias("url"), "id").agg(F.max_by("name", "position").alias("name")).where("url is not null")


def normalise_discography(df: DataFrame) -> DataFrame:
    """df(id, name, realname, urls, aliases array<struct<name>>, namevariations) with blanks and repeats gone."""
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: F.trim(x) != "")))
    return df.select(F.col("id").cast("string").alias("id"), "name", F.nullif(F.trim("realname"), F.lit("")).alias("real_name"),
        clean("urls").alias("urls"), clean(F.transform("aliases", lambda a: a["name"])).alias("aliases"), clean("namevariations").alias("variations"))
