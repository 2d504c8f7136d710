"""Identifier claims: extraction, agreement, corroboration and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import clamp_round, corroboration_keys, id_from_url, name_key, reasons
from .lifecycle import _is_small

#: Where an id stands in a URL of each kind.
URL_PATTERNS = {
    "spotify": r"open\.spotify\.com/artist/([A-Za-z0-9]{22})",
    "musicbrainz": r"musicbrainz\.org/artist/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
    "discogs": r"discogs\.com/artist/([0-9]+)",
    "wikidata": r"wikidata\.org/(?:wiki|entity)/(Q[0-9]+)",
}


def extract_claims(records: DataFrame, patterns: dict[str, str] = URL_PATTERNS) -> DataFrame:
    """Claims of records(entity, source, path, origin, asserted_by, urls): a row for each id found in a URL, each once."""
    urls = records.select("entity", "source", "path", "origin", "asserted_by", F.explode("urls").alias("url"))
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("identifier_type"), id_from_url("url", p).alias("value")) for k, p in patterns.items())))
    out = urls.select("entity", "source", "path", "origin", "asserted_by", found.alias("c")).select("entity", "c.*", "source", "path", "origin", "asserted_by")
    return out.where("value is not null").dropDuplicates(["entity", "identifier_type", "value", "source", "path", "asserted_by"])


def claim_agreement(claims: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(entity, identifier_type, status, value_count, origins): one value agrees, several conflict; with types(identifier_type), missing ones are not_observed.

    Repeated claims of one origin count once.
    """
    out = claims.groupBy("entity", "identifier_type").agg(F.countDistinct("value").alias("value_count"), F.min("value").alias("value"),
        F.countDistinct("origin").alias("origins"))
    if types is not None:
        types = types.select("identifier_type").distinct()
        every = claims.select("entity").distinct().crossJoin(F.broadcast(types) if _is_small(types) else types)
        out = every.join(out, ["entity", "identifier_type"], "left").fillna(0, ["value_count", "origins"])
    return out.withColumn("status", F.when(F.col("value_count") == 0, "not_observed").when(F.col("value_count") == 1, "agreement").otherwise("conflict"))


def same_name_audit(expected: DataFrame, candidates: DataFrame, details: DataFrame) -> DataFrame:
    """(entity, competitors, competitor_ids, linked_ids) for expected(entity, name, expected_id): other entities with its name key.

    candidates: name, candidate_id. details: candidate_id, url.
    """
    asked = expected.select("entity", "expected_id", name_key("name").alias("k"))
    other = candidates.select("candidate_id", name_key("name").alias("k")).distinct()
    found = asked.join(other, "k", "left").where("candidate_id is null or candidate_id <> expected_id")
    links = details.select("candidate_id",
        F.coalesce(*(id_from_url("url",
            p) for p in URL_PATTERNS.values())).alias("linked")).where("linked is not null").groupBy("candidate_id").agg(F.array_sort(F.collect_set("linked")).alias("linked"))
    found = found.join(links, "candidate_id", "left").groupBy("entity").agg(F.array_sort(F.collect_set("candidate_id")).alias("competitor_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("linked")))).alias("linked_ids"))
    out = asked.select("entity").distinct().join(found, "entity", "left")
    return out.select("entity", F.coalesce(F.size("competitor_ids"), F.lit(0)).alias("competitors"), "competitor_ids", "linked_ids")


def select_exact_url(lookup: DataFrame) -> DataFrame:
    """(url, outcome, entity_id) of lookup(url, found, entity_id): a single entity behind a URL is selected; found says whether the URL is known at all."""
    out = lookup.groupBy("url").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("one"), F.max(F.coalesce("found", F.lit(True))).alias("found"))
    # fixed values
    outcome = F.when(F.col("n") == 1, "unique_exact_url_relationship").when(F.col("n") > 1, "multiple_exact_url_relationships")
    outcome = outcome.when(~F.col("found"), "exact_url_not_found").otherwise("no_artist_relationship")
    return out.select("url", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("one")).alias("entity_id"))


def candidate_occurrences(associations: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences of each candidate of associations(occurrence_id, target_type, target_id)."""
    own = associations.where("target_type = 'candidate'").select("occurrence_id", F.col("target_id").alias("candidate_id")).distinct()
    return own.join(occurrences, "occurrence_id")


def build_evidence(names: DataFrame, releases: DataFrame, authority: DataFrame) -> DataFrame:
    """Evidence of names(artist_id, name, external_id) from releases(artist_id, year) and authority(authority_id, name, alias, linked_id, begin_year), joined by name key or alias.

    Authorities are counted by key, and by key and linked id, before names meet them, so a name that many artists and many
    authorities have makes no pairs. Only where an artist has several keys are authorities counted by set of keys.
    """
    both = authority.select("authority_id", "linked_id", "begin_year",
        F.explode(F.array_distinct(F.array(name_key("name"), name_key(F.coalesce("alias", "name"))))).alias("k")).where("k is not null")
    by_key = both.groupBy("k").agg(F.countDistinct("authority_id").alias("n"), F.count("linked_id").alias("n_linked"), F.max("begin_year").alias("last_begin"))
    by_link = both.where("linked_id is not null").groupBy("k", F.col("linked_id").alias("external_id")).agg(F.count("*").alias("linked"))
    first = releases.groupBy("artist_id").agg(F.min("year").alias("first_year"), F.count("*").alias("releases"))
    df = names.select("artist_id", "external_id", name_key("name").alias("k")).join(by_key, "k", "left").join(by_link, ["k", "external_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = df.withColumn("linked", zero("linked")).withColumn("apart", F.when(F.col("external_id").isNotNull(), zero("n_linked") - F.col("linked")).otherwise(0))
    df = df.groupBy("artist_id").agg(F.max(zero("n")).alias("n"), F.array_sort(F.collect_set("k")).alias("keys"), F.sum("linked").alias("linked"), F.sum("apart").alias("conflicting_links"),
        F.max("last_begin").alias("last_begin"))
    sets = df.where(F.size("keys") > 1).select("keys").distinct().select("keys", F.explode("keys").alias("k")).join(both.select("k", "authority_id"), "k")
    sets = sets.groupBy("keys").agg(F.countDistinct("authority_id").alias("n_set"))
    df = df.join(sets, "keys", "left").join(first, "artist_id", "left")
    return df.select(
        "artist_id", F.coalesce("n_set", "n").alias("authority_ids"), "linked", "conflicting_links",
        F.coalesce(F.col("first_year") < F.col("last_begin"), F.lit(False)).alias("chronology_conflict"), zero("releases").alias("releases"),
    )


def distinctive_overlap(left, right):
    """How many distinct title keys two arrays of titles share, generic titles aside; a null array has none."""
    return F.coalesce(F.size(F.array_intersect(corroboration_keys(left), corroboration_keys(right))), F.lit(0))


def corroboration_scores(df: DataFrame) -> DataFrame:
    """df with the score of each class of evidence, and the conflicts, as second_stage takes them.

    Columns, each null where nothing is known: url_match, verified_id_match, id_conflict (booleans); alias_match,
    type_match, area_match, dates_match (true compatible; a false type_match conflicts); titles and other_titles
    (arrays); chronology (compatible or conflict); primary_coherent, empty_alternatives, several_catalogs,
    catalog_complete; image, case_agrees, has_release; duplicate_id.
    """
    yes = lambda c, n: F.when(F.col(c), n).otherwise(0)
    out = df.withColumn("identifier_score", F.greatest(yes("url_match", 35), yes("verified_id_match", 40)))
    out = out.withColumn("metadata_score", yes("alias_match", 7) + yes("type_match", 5) + yes("area_match", 4) + yes("dates_match", 4))
    out = out.withColumn("overlap", distinctive_overlap("titles", "other_titles"))
    out = out.withColumn("coherent_alternatives", F.coalesce(F.col("primary_coherent") & (F.col("empty_alternatives") > 0), F.lit(False)))
    out = out.withColumn("weak_score", yes("image", 2) + yes("case_agrees", 2) + yes("has_release", 3))
    conflicts = reasons(
        ("external_identifier_conflict", F.col("id_conflict")), ("artist_type_conflict", ~F.col("type_match")),
            ("chronology_conflict", F.col("chronology") == "conflict"),
        ("multiple_plausible_same_name_catalogs", F.col("several_catalogs")), ("incomplete_catalog_evidence", ~F.col("catalog_complete")),
            ("duplicate_spotify_id", F.col("duplicate_id")),
    )
    return out.withColumn("conflicts", conflicts).withColumn("conflict", F.size("conflicts") > 0)


def second_stage(df: DataFrame) -> DataFrame:
    """First-stage rows with status and confidence after corroboration.

    Columns: status, confidence and those of corroboration_scores: identifier_score (0, 35 or 40), metadata_score, overlap,
    chronology, coherent_alternatives, weak_score, conflict. One strong or two moderate independent classes promote a row
    under review, to 95 at most.
    """
    points = F.when(F.col("overlap") >= 3, 30).when(F.col("overlap") == 2, 20).when(F.col("overlap") == 1, 7).otherwise(0)
    catalog = points + F.when(F.col("chronology") == "compatible", 5).otherwise(0) + F.when(F.col("coherent_alternatives"), 15).otherwise(0)
    level = lambda x, strong, moderate: F.when(x >= strong, 2).when(x >= moderate, 1).otherwise(0)
    levels = F.array(level(F.col("identifier_score"), 30, 1), level(F.col("metadata_score"), 999, 10), level(catalog, 30, 10))
    strong, moderate = F.size(F.filter(levels, lambda x: x >= 2)), F.size(F.filter(levels, lambda x: x >= 1))
    enough = (strong >= 1) | (moderate >= 2)
    verified = F.col("status") == "verified_existing"
    total = clamp_round(F.col("identifier_score") + F.least(F.col("metadata_score"), F.lit(20)) + F.least(catalog, F.lit(40)) + F.col("weak_score"))
    bad = F.col("conflict") | F.coalesce(F.col("chronology") == "conflict", F.lit(False))
    promoted = (F.col("status") == "manual_review_required") & enough
    out = df.withColumn("corroboration_score", total).withColumn("corroborated", enough)
    out = out.withColumn("final_status", F.when(verified, "verified_existing").when(bad, "conflicting_identity").when(promoted,
        "high_confidence_candidate").otherwise(F.col("status")))
    return out.withColumn("final_confidence", F.when(verified, 100).when(bad, F.least("confidence", F.lit(49))).when(promoted,
        F.least(F.lit(95), F.col("confidence") + F.floor(total / 3 + 0.5))).otherwise(F.col("confidence")).cast("long"))


def promotion_summary(df: DataFrame) -> DataFrame:
    """(final_status, rows, promoted, still_in_review, mean_score) of second-stage rows."""
    moved = (F.col("status") == "manual_review_required") & (F.col("final_status") == "high_confidence_candidate")
    return df.groupBy("final_status").agg(F.count("*").alias("rows"), F.count_if(moved).alias("promoted"),
        F.count_if(F.col("final_status").isin("manual_review_required", "conflicting_identity", "unresolved")).alias("still_in_review"),
            F.round(F.avg("corroboration_score"), 4).alias("mean_score"))
