"""From reviewed candidates to the directory: full rows, the package that a person reviews, and the promotion of what is approved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .directory import parity

#: What a candidate's row says before a review and after it.
CANDIDATE, BASIS, IN_REVIEW = "review_only_candidate", "multi_source_identity_corroboration_review_only", "candidate"
APPROVED, APPROVED_BASIS, ACTIVE = "verified_human_approved", "explicit_human_approval_of_multi_source_identity_corroboration", "active"
MULTIPLICITY = "provider_profile_multiplicity"
_NONE = "cast(array() as array<string>)"


def to_v2(df: DataFrame) -> DataFrame:
    """Nested version-2 rows of df(artist_id, name, genre, tier, spotify_id, url, image, evidence_ref, generated_at): candidates under review, with the flat fields of version 1."""
    null, none = F.lit(None).cast("string"), F.expr(_NONE)
    some = lambda key, c: F.map_from_entries(F.array_compact(F.array(F.when(F.col(c).isNotNull(), F.struct(F.lit(key), F.col(c))))))
    refs = F.array_compact(F.array("evidence_ref"))
    place = F.struct(null.alias("city"), null.alias("region"), null.alias("country"), F.lit(None).cast("struct<latitude:double,longitude:double>").alias("coordinates"))
    return df.select(
        "artist_id", F.lit(2).alias("schema_version"), "name", F.col("name").alias("display_name"),
        F.struct(F.lit(CANDIDATE).alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit(BASIS).alias("verification_basis"), refs.alias("evidence_refs")).alias("identity"),
        some("spotify", "spotify_id").alias("external_ids"), some("spotify", "url").alias("external_urls"),
        F.struct(F.col("tier").alias("stage"), F.lit(None).cast("double").alias("stage_confidence")).alias("editorial"), F.array_compact(F.array("genre")).alias("genres"), F.col("genre").alias("primary_genre"),
        F.struct(place.alias("home"), F.lit("unknown").alias("confidence"), none.alias("evidence_refs"), none.alias("scene_associations"), none.alias("current_touring_markets"), none.alias("upcoming_event_markets")).alias("geography"),
        F.struct(refs.alias("identity"), none.alias("mainstream"), none.alias("catalog"), none.alias("geographic"), none.alias("user_engagement")).alias("evidence"),
        F.struct(F.col("image").alias("primary_image_url"), F.lit("spotify").alias("image_source")).alias("media"), F.struct(null.alias("instagram"), null.alias("tiktok")).alias("social_urls"),
        F.struct(F.lit(IN_REVIEW).alias("directory"), F.lit("unclaimed").alias("profile_claim"), F.lit("editorial").alias("submission_source")).alias("status"),
        F.col("generated_at").alias("created_at"), F.col("generated_at").alias("updated_at"), "genre", "tier", "spotify_id", F.col("url").alias("spotify"), "image", null.alias("instagram"), null.alias("tiktok"),
    )


def _fault(name: str, df: DataFrame, key: str) -> DataFrame:
    return df.select(F.lit(name).alias("fault"), F.col(key).cast("string").alias("key"))


def _repeated(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def package_faults(reports: DataFrame, accounting: DataFrame, package: DataFrame, registry: DataFrame, outcomes: list[str]) -> DataFrame:
    """(fault, key) of a review package: everything that must not be so.

    reports: key, outcome. accounting: key, external_id. package: artist_id, external_id, origin (live or review),
    identity_status, directory_status, the union of live rows and candidates. registry: artist_id, external_id, the
    permanent bindings. Faults: repeated_external_id and repeated_artist_id of the union, missing_accounting of a selected
    report, escaped_review (a candidate that isn't under review), permanent_binding_changed, permanent_binding_lost.
    """
    new = package.where("origin = 'review'")
    lost = reports.where(F.col("outcome").isin(*outcomes)).join(accounting.select("key"), "key", "left_anti")
    escaped = new.where(~(F.col("identity_status").eqNullSafe(CANDIDATE) & F.col("directory_status").eqNullSafe(IN_REVIEW)))
    held = registry.select("external_id", F.col("artist_id").alias("bound")).join(package.where("origin = 'live'").select("external_id", "artist_id"), "external_id", "left")
    parts = [
        _fault("repeated_external_id", _repeated(package, "external_id"), "external_id"), _fault("repeated_artist_id", _repeated(package, "artist_id"), "artist_id"), _fault("missing_accounting", lost, "key"),
        _fault("escaped_review", escaped, "artist_id"), _fault("permanent_binding_changed", held.where("artist_id <> bound"), "external_id"),
        _fault("permanent_binding_lost", held.where("artist_id is null"), "external_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def promote(preview: DataFrame, approvals: DataFrame, live: DataFrame, registry: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(directory, registry, faults): live and what is approved of preview, the bindings of all of them, and what speaks against it.

    preview and live: artist_id, external_id, columns (those that must stay as they are, name, genre and tier among them),
    identity_status, directory_status; preview has the live rows too. approvals: artist_id, external_id, name, genre,
    stage, outcome, notes (array), one row for each approval. registry: artist_id, external_id, display_name.

    A row is promoted where its external id is approved and no fault is its own. Faults: unapproved (in preview),
    mapping_drift and classification_drift against the approval, missing_multiplicity_notes, binding_conflict (the id or
    the external id is bound otherwise), repeated ids of preview, and live_changed or live_lost in preview.
    """
    every = ["artist_id", "external_id", *columns, "identity_status", "directory_status"]
    new = preview.join(live.select("artist_id"), "artist_id", "left_anti")
    said = approvals.select("external_id", *(F.col(c).alias(f"_{c}") for c in ("artist_id", "name", "genre", "stage", "outcome", "notes")))
    told = new.join(said, "external_id", "left")
    unapproved = told.where("_artist_id is null")
    known = told.where("_artist_id is not null")
    drift = known.where("not (artist_id <=> _artist_id and name <=> _name)")
    classes = known.where("not (genre <=> _genre and tier <=> _stage)")
    silent = known.where((F.col("_outcome") == MULTIPLICITY) & (F.coalesce(F.size("_notes"), F.lit(0)) <= 0))
    by_id, by_external = registry.select("artist_id", F.col("external_id").alias("_x")), registry.select("external_id", F.col("artist_id").alias("_a"))
    bound = new.join(by_id, "artist_id").where("_x <> external_id").select("artist_id").unionByName(new.join(by_external, "external_id").where("_a <> artist_id").select("artist_id")).distinct()
    kept = parity(live, preview.join(live.select("artist_id"), "artist_id", "left_semi"), "artist_id", ["external_id", *columns])
    own = [_fault("unapproved", unapproved, "artist_id"), _fault("mapping_drift", drift, "artist_id"), _fault("classification_drift", classes, "artist_id"),
        _fault("missing_multiplicity_notes", silent, "artist_id"), _fault("binding_conflict", bound, "artist_id"), _fault("repeated_artist_id", _repeated(preview, "artist_id"), "artist_id")]
    twice = _repeated(preview, "external_id")
    own.append(_fault("repeated_external_id", new.join(twice, "external_id").select("artist_id").distinct(), "artist_id"))
    whole = [_fault("live_changed", kept.where("difference = 'changed'"), "artist_id"), _fault("live_lost", kept.where("difference = 'left_only'"), "artist_id")]
    blocked = reduce(DataFrame.unionByName, own)
    good = known.join(blocked.select(F.col("key")).distinct(), F.col("artist_id").cast("string") == F.col("key"), "left_anti").select(
        *every[:-2], F.lit(APPROVED).alias("identity_status"), F.lit(ACTIVE).alias("directory_status"))
    directory = live.select(*every).unionByName(good)
    bindings = registry.select("artist_id", "external_id", "display_name").unionByName(good.select("artist_id", "external_id", F.col("name").alias("display_name")))
    return directory, bindings, reduce(DataFrame.unionByName, [blocked, *whole])
