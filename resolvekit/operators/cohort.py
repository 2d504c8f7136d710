"""Cohorts on their way into the directory: ids, reconciliation, review and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import reasons
from .numbering import numbered


def propose_ids(df: DataFrame, registry: DataFrame, prefix: str = "artist_", width: int = 6) -> DataFrame:
    """df(external_id, position) with artist_id: the registered one, or the next numbers in order of position."""
    known = registry.groupBy("external_id").agg(F.min("artist_id").alias("artist_id"))
    number = F.regexp_extract("artist_id", "([0-9]+)$", 1).try_cast("long")
    top = registry.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    joined = df.join(known, "external_id", "left")
    new = numbered(joined.where("artist_id is null").drop("artist_id"), [F.asc("position"), F.asc("external_id")], "_number").crossJoin(F.broadcast(top))  # one row
    new = new.withColumn("artist_id", F.concat(F.lit(prefix), F.lpad((F.col("_top") + F.col("_number")).cast("string"), width, "0")))
    out = joined.where("artist_id is not null").withColumn("proposed", F.lit(False))
    return out.select(*df.columns, "artist_id", "proposed").unionByName(new.withColumn("proposed", F.lit(True)).select(*df.columns, "artist_id", "proposed"))


def cohort_status(source: DataFrame, enriched: DataFrame, live: DataFrame) -> DataFrame:
    """source(key, name) with status, confidence and concerns, from the stored match enriched(key, external_id, name) and live(key).

    A live row is verified. Without a stored id it is unresolved, with another stored name in conflict. The stored
    match doesn't say what else had the name, so short names and names with symbols need a review.
    """
    found = enriched.groupBy("key").agg(F.min(F.struct("external_id", F.col("name").alias("name"))).alias("_e"))
    df = source.select("key", "name").join(found, "key", "left").join(live.select("key", F.lit(True).alias("_live")).distinct(), "key", "left")
    text = F.trim("name")
    short = (F.size(F.split(text, r"\s+")) == 1) | (F.length(text) <= 4)
    symbol = F.col("name").rlike(r"[^\p{L}\p{N}\s]")
    status = (
        F.when(F.col("_live"), "verified_existing").when(F.coalesce(F.col("_e.external_id"), F.lit("")) == "",
            "unresolved").when(~F.col("_e.name").eqNullSafe(F.col("name")), "conflicting_identity")
        .when(short | symbol, "manual_review_required").otherwise("high_confidence_candidate")
    )
    level = F.create_map(*(F.lit(x) for pair in (("verified_existing", 100), ("unresolved", 0), ("conflicting_identity", 49),
        ("manual_review_required", 75), ("high_confidence_candidate", 95)) for x in pair))
    df = df.withColumn("status", status)
    is_ = lambda *names: F.col("status").isin(*names)
    concerns = reasons(
        ("missing_stored_spotify_candidate", is_("unresolved")), ("stored_returned_name_difference", is_("conflicting_identity")),
        ("short_or_single_token_name", is_("manual_review_required") & short), ("punctuation_or_symbol_risk", is_("manual_review_required") & symbol),
        ("exact_name_candidate_is_review_only", is_("high_confidence_candidate")),
            ("stored_enrichment_does_not_preserve_alternate_exact_candidates", is_("manual_review_required", "high_confidence_candidate")),
    )
    return df.select("key", "status", level[F.col("status")].cast("long").alias("confidence"), concerns.alias("concerns"))


def reconcile_cohort(source: DataFrame, enriched: DataFrame, live: DataFrame, registry: DataFrame) -> DataFrame:
    """source(key, name, external_id) against enriched(key, external_id, name), live(external_id) and registry(external_id, artist_id): a status and the drifts."""
    e = enriched.select("key", F.col("external_id").alias("e_id"), F.col("name").alias("e_name"))
    df = source.join(e, "key", "left").join(live.select("external_id", F.lit(True).alias("_live")).distinct(), "external_id", "left")
    df = df.join(registry.groupBy("external_id").agg(F.min("artist_id").alias("artist_id")), "external_id", "left")
    drift = F.array_compact(F.array(F.when(F.col("e_id").isNotNull() & (F.col("e_id") != F.col("external_id")), "external_id"),
        F.when(F.col("e_name").isNotNull() & (F.col("e_name") != F.col("name")), "name")))
    status = F.when(F.col("e_id").isNull(), "missing_enrichment").when(F.size(drift) > 0, "drift").when(F.col("_live"),
        "already_live").when(F.col("artist_id").isNotNull(), "registered").otherwise("new")
    return df.select("key", "external_id", "artist_id", status.alias("status"), F.array_join(drift, ",").alias("drift"))


def review_package(reports: DataFrame, accounting: DataFrame, proposed: DataFrame, live: DataFrame, outcomes: list[str]) -> DataFrame:
    """(artist_id, external_id, outcome, origin): selected reports with their accounting and proposed id, less the live ones, and the live rows."""
    picked = reports.where(F.col("outcome").isin(*outcomes)).join(accounting.select("key", "external_id"),
        "key").join(proposed.select("external_id", "artist_id"), "external_id")
    new = picked.join(live.select("external_id"), "external_id", "left_anti").select("artist_id", "external_id", "outcome", F.lit("review").alias("origin"))
    return live.select("artist_id", "external_id", F.lit(None).cast("string").alias("outcome"), F.lit("live").alias("origin")).unionByName(new)


def evidence_notes(df: DataFrame) -> DataFrame:
    """df(conflicts, evidence_refs, competitor_ids, profile_ids) with a text for each."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    text = F.concat(count("conflicts"), F.lit(" conflicts; "), count("evidence_refs"), F.lit(" evidence references"))
    names = F.when(F.coalesce(F.size("competitor_ids"), F.lit(0)) > 0, F.concat(F.lit("Same name: "), F.array_join("competitor_ids", ", ")))
    many = F.when(F.coalesce(F.size("profile_ids"), F.lit(0)) > 1, F.concat(F.lit("Profiles: "), F.array_join("profile_ids", ", ")))
    return df.withColumn("evidence_text", text).withColumn("same_name_note", names).withColumn("multiplicity_note", many)
