"""Rankings, names and first-stage identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import name_key, reasons
from .numbering import numbered


def rank_report(ranking: DataFrame, n: int) -> DataFrame:
    """(finding, rank, rows): duplicate, missing and out-of-range ranks and blank names of ranking(rank, name), with n ranks expected."""
    counts = ranking.groupBy("rank").agg(F.count("*").alias("rows"))
    wanted = ranking.sparkSession.range(1, n + 1).select(F.col("id").alias("rank"))
    missing = wanted.join(counts, "rank", "left_anti").select(F.lit("missing").alias("finding"), "rank", F.lit(0).cast("long").alias("rows"))
    twice = counts.where("rows > 1").select(F.lit("duplicate").alias("finding"), "rank", "rows")
    outside = counts.where((F.col("rank") < 1) | (F.col("rank") > n) | F.col("rank").isNull()).select(F.lit("out_of_range").alias("finding"), "rank", "rows")
    blank = ranking.where("name is null or trim(name) = ''").groupBy("rank").agg(F.count("*").alias("rows")).select(F.lit("blank_name").alias("finding"), "rank", "rows")
    return missing.unionByName(twice).unionByName(outside).unionByName(blank)


def collisions(df: DataFrame, name: str = "name", id_: str = "id", unicode: bool = True) -> DataFrame:
    """(name_key, members, ids): names that several rows share, ids in order."""
    keyed = df.withColumn("name_key", name_key(name, unicode))
    return keyed.groupBy("name_key").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.col(id_))).alias("ids")).where("members > 1")


def suspicious_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name is one token or has four characters at most."""
    key = name_key(name)
    return df.where(~key.contains(" ") | (F.length(key) <= 4))


def duplicate_ids(df: DataFrame, id_: str = "external_id", key: str = "id") -> DataFrame:
    """(external id, rows, keys) of ids that several rows have; nulls aside."""
    return df.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(key)).alias("keys")).where("rows > 1")


def match_by_name(ranking: DataFrame, directory: DataFrame, unicode: bool = True) -> DataFrame:
    """ranking(name, ...) with the directory row of its name key; of several, that with the last position."""
    known = directory.withColumn("name_key", name_key("name", unicode)).groupBy("name_key").agg(F.max_by("artist_id", "position").alias("artist_id"))
    out = ranking.withColumn("name_key", name_key("name", unicode)).join(known, "name_key", "left")
    return out.withColumn("in_directory", F.col("artist_id").isNotNull()).withColumn("method", F.when(F.col("artist_id").isNotNull(), "normalized_name"))


def overlap_by_id(df: DataFrame, directory: DataFrame, id_: str = "external_id") -> DataFrame:
    """df with the directory entry that has its external id, and whether there is one."""
    known = directory.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.max_by("artist_id", "position").alias("existing_id"))
    return df.join(known, id_, "left").withColumn("exists", F.col("existing_id").isNotNull())


def resolve_names(requests: DataFrame, candidates: DataFrame, k: int = 10, unicode: bool = True) -> DataFrame:
    """The k best of candidates(request_id, name, candidate_id, position) for requests(request_id, name).

    With exact matches of the name key, only these; else prefix (1), contained (2), other (3), then by position.
    """
    asked = requests.select("request_id", name_key("name", unicode).alias("wanted"))
    found = candidates.select("request_id", "candidate_id", "position", name_key("name", unicode).alias("got")).join(asked, "request_id")
    score = F.when(F.col("got") == F.col("wanted"), 0).when(F.col("got").startswith(F.col("wanted")), 1).when(F.col("got").contains(F.col("wanted")), 2).otherwise(3)
    found = found.withColumn("score", score)
    group = Window.partitionBy("request_id")
    found = found.withColumn("best", F.min("score").over(group)).where("best > 0 or score = 0")
    found = found.withColumn("rank", F.row_number().over(group.orderBy("score", "position", "candidate_id"))).where(F.col("rank") <= k)
    return found.select("request_id", "candidate_id", "score", "rank")


def identity_review(ranking: DataFrame, candidates: DataFrame, by: tuple[str, ...] = ("external_id", "name")) -> DataFrame:
    """ranking(id, name, and the columns `by`) with its exact candidates(candidate_id, name, image, position, and `by`), those with equal `by`: the first, how many, and why it is ambiguous.

    Candidates are counted by their key before rows meet them, so many rows with the key of many candidates make no pairs.
    """
    keys = [F.col(c).alias(f"_by_{c}") for c in by]
    best = candidates.groupBy(*keys).agg(F.min_by(F.struct("candidate_id", "name", "image"), "position").alias("match"), F.count("*").alias("exact_count"))
    same = [F.col(c) == F.col(f"_by_{c}") for c in by]
    df = ranking.join(best, same, "left").drop(*(f"_by_{c}" for c in by))
    key = name_key("name")
    why = reasons(
        ("no_exact_candidate", F.col("match").isNull()),
        ("multiple_exact_name_profiles", F.col("exact_count") > 1),
        ("punctuation_or_symbol_difference_risk", F.col("name").rlike(r"[^\p{L}\p{N}\s]")),
        ("spotify_returned_name_differs", F.col("match.name") != F.col("name")),
        ("short_or_single_token_name", ~key.contains(" ") | (F.length(key) <= 4)),
    )
    return df.withColumn("ambiguity", why).withColumn("review_status", F.when(F.size(why) == 0, "exact_match").otherwise("needs_review"))


def first_stage(df: DataFrame) -> DataFrame:
    """df(name, match_name, exact_count, image, verified, duplicate, ambiguity) with status, confidence and review reasons.

    A column external_id_conflict, if there is one, says that another id is known for the name; like a duplicate it is a conflict.

    60 for the name key, 25 for a single candidate, 10 for the displayed name, 5 for an image. Verified gives 100; a
    conflict 49 at most; a reason to review 79 at most; from 90 on it is a candidate, with 95 at most.
    """
    has = F.col("match_name").isNotNull()
    same = F.coalesce(name_key("name") == name_key("match_name"), F.lit(False))
    shown = F.coalesce(F.col("name") == F.col("match_name"), F.lit(False))
    points = F.when(same, 60).otherwise(0) + F.when(F.col("exact_count") == 1, 25).otherwise(0) + F.when(shown, 10).otherwise(0) + F.when(F.col("image"), 5).otherwise(0)
    conflict = F.coalesce(F.col("duplicate"), F.lit(False)) | ~same
    if "external_id_conflict" in df.columns:
        conflict = conflict | F.coalesce(F.col("external_id_conflict"), F.lit(False))
    why = reasons(
        ("multiple_exact_name_profiles", F.col("exact_count") > 1),
        ("punctuation_or_symbol_risk", F.array_contains("ambiguity", "punctuation_or_symbol_difference_risk")),
        ("returned_name_difference", F.array_contains("ambiguity", "spotify_returned_name_differs") | ~shown),
        ("short_or_common_name_without_verified_id", F.array_contains("ambiguity", "short_or_single_token_name")),
    )
    verified = F.coalesce(F.col("verified"), F.lit(False))
    status = (
        F.when(~has, "unresolved").when(verified, "verified_existing").when(conflict, "conflicting_identity")
        .when(F.size(why) > 0, "manual_review_required").when(points >= 90, "high_confidence_candidate").otherwise("manual_review_required")
    )
    level = F.when(~has, 0).when(verified, 100).when(conflict, F.least(points, F.lit(49))).when(F.size(why) > 0,
        F.least(points, F.lit(79))).when(points >= 90, F.least(points, F.lit(95))).otherwise(points)
    shown_why = F.when(verified | ~has, F.array().cast("array<string>")).when(~conflict & (F.size(why) == 0) & (points < 90),
        F.array(F.lit("insufficient_independent_evidence"))).otherwise(why)
    return df.withColumn("status", status).withColumn("confidence", level.cast("long")).withColumn("review_reasons",
        shown_why).withColumn("requires_review", ~status.isin("verified_existing", "high_confidence_candidate"))


def review_priority(df: DataFrame) -> DataFrame:
    """df(status, requires_review, review_reasons) with priority 0 to 100."""
    has = lambda r, n: F.when(F.array_contains("review_reasons", r), n).otherwise(0)
    base = F.when(F.col("requires_review"), 50).otherwise(0) + has("multiple_exact_name_profiles", 30) + has("returned_name_difference",
        15) + has("punctuation_or_symbol_risk", 10) + has("short_or_common_name_without_verified_id", 5)
    return df.withColumn("priority", F.when(F.col("status") == "conflicting_identity", 100).when(F.col("status") == "unresolved",
        95).otherwise(F.least(base, F.lit(100))).cast("long"))


def review_queue(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Rows to review with their place: priority descending, then rank."""
    return numbered(df.where("requires_review"), [F.desc("priority"), F.asc(rank)], "place")


def zero_fill(counts: DataFrame, domain: DataFrame, key: str, value: str) -> DataFrame:
    """Every value of domain(key), with 0 where counts has none."""
    return domain.join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def status_summary(df: DataFrame, domain: list[str], key: str = "status") -> DataFrame:
    """Rows and share (percent, 2 decimals) of each status of a fixed domain."""
    known = df.sparkSession.createDataFrame([(x,) for x in domain], f"{key} string")
    out = zero_fill(df.groupBy(key).agg(F.count("*").alias("rows")), known, key, "rows")
    total = df.agg(F.count("*").alias("total"))
    return out.crossJoin(total).select(key, "rows", F.round(F.try_divide(100.0 * F.col("rows"), F.col("total")), 2).alias("percent"))
