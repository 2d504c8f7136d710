"""Queries of full rows, review packages and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import promotion
from .inputs import read
from .registry import query


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("k"), k.cast("long").alias("artist_id"), F.concat(F.lit("s"), k).alias("external_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("genre"),
        F.col("c_nationkey").cast("string").alias("tier"))


@query("""SELECT c_custkey AS artist_id, 2 AS schema_version, c_name AS display_name, 'review_only_candidate' AS identity_status, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS refs,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 's' || c_custkey END AS spotify_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'https://x/' || c_custkey END AS url, cast(c_nationkey AS string) AS stage,
    c_mktsegment AS primary_genre, 'unknown' AS place_confidence, 'candidate' AS directory_status, 'unclaimed' AS profile_claim, c_mktsegment AS genre FROM customer""")
def p4_to_v2(spark, sf_dir):
    c = _customers(spark, sf_dir)
    k = F.col("k")
    df = c.withColumn("spotify_id", F.when(k % 3 != 0, F.col("external_id"))).withColumn("url", F.when(k % 3 != 0, F.concat(F.lit("https://x/"), k))).withColumn("image", F.lit(None).cast("string"))
    v2 = promotion.to_v2(df.withColumn("evidence_ref", F.when(k % 5 != 0, F.lit("ref"))).withColumn("generated_at", F.lit("2026-01-01")))
    return v2.select("artist_id", "schema_version", "display_name", F.col("identity.status").alias("identity_status"), F.size("evidence.identity").alias("refs"),
        F.try_element_at("external_ids", F.lit("spotify")).alias("spotify_id"), F.try_element_at("external_urls", F.lit("spotify")).alias("url"), "editorial.stage", "primary_genre",
        F.col("geography.confidence").alias("place_confidence"), F.col("status.directory").alias("directory_status"), "status.profile_claim", "genre")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), p AS (SELECT k, CASE WHEN k % 90 = 1 THEN k + 1 ELSE k END AS artist_id, 's' || CASE WHEN k % 70 = 2 THEN k + 1 ELSE k END AS x, k % 2 = 0 AS live,
        CASE WHEN k % 50 = 3 THEN 'verified' ELSE 'review_only_candidate' END AS s FROM c)
    SELECT 'repeated_external_id' AS fault, x AS key FROM p GROUP BY x HAVING count(*) > 1 UNION ALL SELECT 'repeated_artist_id', cast(artist_id AS string) FROM p GROUP BY artist_id HAVING count(*) > 1
    UNION ALL SELECT 'missing_accounting', cast(k AS string) FROM c WHERE k % 3 = 0 AND k % 11 = 0 UNION ALL SELECT 'escaped_review', cast(artist_id AS string) FROM p WHERE NOT live AND s = 'verified'
    UNION ALL SELECT 'permanent_binding_changed', x FROM p JOIN c r ON x = 's' || r.k WHERE live AND r.k % 2 = 0 AND artist_id <> CASE WHEN r.k % 40 = 0 THEN 0 ELSE r.k END
    UNION ALL SELECT 'permanent_binding_lost', 's' || k FROM c WHERE k % 2 = 0 AND 's' || k NOT IN (SELECT x FROM p WHERE live)""")
def j11_package_faults(spark, sf_dir):
    c, k = _customers(spark, sf_dir), F.col("k")
    package = c.select(
        F.when(k % 90 == 1, k + 1).otherwise(k).cast("long").alias("artist_id"), F.concat(F.lit("s"), F.when(k % 70 == 2, k + 1).otherwise(k)).alias("external_id"), F.when(k % 2 == 0, "live").otherwise("review").alias("origin"),
        F.when(k % 50 == 3, "verified").otherwise(promotion.CANDIDATE).alias("identity_status"), F.lit(promotion.IN_REVIEW).alias("directory_status"),
    )
    reports = c.select(F.col("k").alias("key"), F.when(k % 3 == 0, "coherent_identity_evidence").otherwise("unresolved_identity").alias("outcome"))
    registry = c.where("k % 2 = 0").select(F.when(k % 40 == 0, 0).otherwise(F.col("artist_id")).alias("artist_id"), "external_id")
    return promotion.package_faults(reports, c.where("k % 11 <> 0").select(F.col("k").alias("key"), "external_id"), package, registry, ["coherent_identity_evidence"])


def _promotion(spark, sf_dir):
    c, k = _customers(spark, sf_dir), F.col("k")
    of = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    live = c.where("k % 2 = 0").withColumn("identity_status", F.lit("verified")).withColumn("directory_status", F.lit(promotion.ACTIVE))
    preview = c.where("k % 34 <> 0").withColumn("name", of(46, "changed", F.col("name"))).withColumn("identity_status", F.lit(promotion.CANDIDATE)).withColumn("directory_status", F.lit(promotion.IN_REVIEW))
    notes = F.when(k % 9 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    approvals = c.where("k % 5 <> 0").select("artist_id", "external_id", of(7, F.concat("name", F.lit("!")), F.col("name")).alias("name"), "genre", of(11, "other", F.col("tier")).alias("stage"),
        of(3, promotion.MULTIPLICITY, "coherent_identity_evidence").alias("outcome"), notes.alias("notes"))
    registry = live.select("artist_id", "external_id", F.col("name").alias("display_name")).unionByName(c.where("k % 26 = 13").select((F.col("artist_id") + 1_000_000).alias("artist_id"), "external_id", F.col("name").alias("display_name")))
    return promotion.promote(preview.drop("k"), approvals, live.drop("k"), registry, ["name", "genre", "tier"])


_PROMOTED = """WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer), n AS (SELECT k, name, k % 5 = 0 AS unapproved, k % 5 > 0 AND k % 7 = 0 AS mapping, k % 5 > 0 AND k % 11 = 0 AS class,
        k % 5 > 0 AND k % 3 = 0 AND k % 9 > 0 AS silent, k % 26 = 13 AS bound FROM c WHERE k % 2 = 1),
    good AS (SELECT * FROM n WHERE NOT (unapproved OR mapping OR class OR silent OR bound))"""


@query(f"""{_PROMOTED} SELECT k AS artist_id, 'verified' AS identity_status, 'active' AS directory_status, name AS display_name FROM c WHERE k % 2 = 0
    UNION ALL SELECT k, 'verified_human_approved', 'active', name FROM good UNION ALL SELECT k + 1000000, NULL, NULL, name FROM c WHERE k % 26 = 13""")
def j12_promote(spark, sf_dir):
    """The directory and its registry, side by side."""
    directory, registry, _ = _promotion(spark, sf_dir)
    return registry.select("artist_id", "display_name").join(directory.select("artist_id", "identity_status", "directory_status"), "artist_id", "left")


@query(f"""{_PROMOTED} SELECT 'unapproved' AS fault, cast(k AS string) AS key FROM n WHERE unapproved UNION ALL SELECT 'mapping_drift', cast(k AS string) FROM n WHERE mapping
    UNION ALL SELECT 'classification_drift', cast(k AS string) FROM n WHERE class UNION ALL SELECT 'missing_multiplicity_notes', cast(k AS string) FROM n WHERE silent
    UNION ALL SELECT 'binding_conflict', cast(k AS string) FROM n WHERE bound UNION ALL SELECT 'live_lost', cast(k AS string) FROM c WHERE k % 2 = 0 AND k % 34 = 0
    UNION ALL SELECT 'live_changed', cast(k AS string) FROM c WHERE k % 46 = 0 AND k % 34 > 0""")
def j12_promotion_faults(spark, sf_dir):
    return _promotion(spark, sf_dir)[2]
