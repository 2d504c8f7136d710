"""Registered queries of the reference's own operators, each with DuckDB's SQL for the same rows where SQL has it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import name_key
from ..operators import admission, catalog, claims, cohort, converge, directory, lifecycle, metrics, quality, ranking, records
from ..operators.numbering import shared_folder
from ..sources import adapters, cache, html, listings, readers
from ..streaming import streams
from . import inputs
from .inputs import get, read
from .registry import ORACLES, QUERIES, query

NOW = "2001-01-01"
START, END = "2024-01-08", "2024-01-15"


def queries() -> dict:
    from . import operations_queries, promotion_queries, record_queries, resolution_queries  # noqa: F401  (they register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


# Catalogs. The CTEs below date a release, keep one of each variant, and count.
_VARIANTS = """
r AS (SELECT *, CASE length(release_date) WHEN 4 THEN 'year' WHEN 7 THEN 'month' ELSE 'day' END AS precision_,
        cast(CASE length(release_date) WHEN 4 THEN release_date || '-01-01' WHEN 7 THEN release_date || '-01' ELSE release_date END AS date) AS start_,
        trim(regexp_replace(regexp_replace(lower(name), '\\(.*\\)', ''), '[^a-z0-9]+', ' ', 'g')) AS title FROM @releases),
d AS (SELECT *, epoch(cast(CASE precision_ WHEN 'year' THEN start_ + INTERVAL 1 YEAR WHEN 'month' THEN start_ + INTERVAL 1 MONTH
        ELSE start_ + INTERVAL 1 DAY END AS timestamp)) - 0.001 AS end_s, epoch(cast(start_ AS timestamp)) AS start_s FROM r),
v AS (SELECT *, row_number() OVER (PARTITION BY artist_id, album_type, title, year(start_) ORDER BY start_, total_tracks, position) = 1 AS kept,
        count(*) OVER (PARTITION BY artist_id, album_type, title, year(start_)) AS group_size FROM d)"""
_METRICS = f"""WITH {_VARIANTS.strip()},
k AS (SELECT artist_id, count(*) AS unique_release_count, count(*) FILTER (album_type = 'album') AS album_count,
        count(*) FILTER (album_type = 'single') AS single_count, cast(sum(total_tracks) AS bigint) AS track_count,
        count(*) FILTER (now_s - end_s <= 90 * 86400.0 AND now_s >= start_s) AS releases_90, count(*) FILTER (now_s - end_s <= 365 * 86400.0
        AND now_s >= start_s) AS releases_365, count(*) FILTER (now_s - end_s <= 730 * 86400.0 AND now_s >= start_s) AS releases_730,
        count(*) FILTER (group_size > 1) AS variant_groups, count(*) FILTER (precision_ <> 'day') AS partial_dates, min(start_s) AS first_s,
        arg_max(end_s, start_s * 1000000 + end_s / 100000) AS last_s
        FROM v, (SELECT epoch(TIMESTAMP '{NOW}') AS now_s) WHERE kept GROUP BY artist_id),
m AS (SELECT *, floor((last_s - first_s) / (365.2425 * 86400.0) * 10 + 0.5) / 10 AS span_years, cast(greatest(0,
        floor((epoch(TIMESTAMP '{NOW}') - last_s) / 86400.0)) AS bigint) AS days_since_latest FROM k),
s AS (SELECT *, cast(least(greatest(floor(span_years * 5 + 0.5), 0), 100) AS bigint) AS maturity_score,
        cast(least(greatest(floor(100 * (1 - exp(-(album_count * 9 + single_count * 2.5 + track_count * 0.35) / 55)) + 0.5), 0),
        100) AS bigint) AS depth_score,
        cast(least(greatest(floor(45 * exp(-days_since_latest / 240) + releases_90 * 18 + releases_365 * 8 + releases_730 * 3 + 0.5), 0),
        100) AS bigint) AS momentum_score, cast(least(greatest(floor(100 - 3 * variant_groups - 1.5 * partial_dates + 0.5), 0),
        100) AS bigint) AS confidence_score FROM m)
"""
_COLUMNS = "artist_id, unique_release_count, album_count, single_count, track_count, releases_90, releases_365, releases_730, variant_groups, partial_dates, span_years, days_since_latest, maturity_score, depth_score, momentum_score, confidence_score"


def flagship(spark, sf_dir):
    """The 20 customers with the highest momentum of their catalog of orders."""
    return catalog.catalog_metrics(get(spark, sf_dir, "releases"), NOW, unicode=False).orderBy(F.desc("momentum_score"), "artist_id").limit(20)


@query(f"{_METRICS} SELECT {_COLUMNS} FROM s ORDER BY momentum_score DESC, artist_id LIMIT 20")
def top_momentum(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"{_METRICS} SELECT {_COLUMNS} FROM s")
def a5_catalog_metrics(spark, sf_dir):
    return catalog.catalog_metrics(get(spark, sf_dir, "releases"), NOW, unicode=False)


@query(f"WITH {_VARIANTS.strip()} SELECT artist_id, id, title, kept, group_size FROM v")
def w1_release_variants(spark, sf_dir):
    return catalog.release_variants(get(spark, sf_dir, "releases"), unicode=False).select("artist_id", "id", "title", "kept", "group_size")


@query(f"""{_METRICS} SELECT artist_id, (CASE WHEN span_years >= 20 THEN 'legacy,classic' WHEN span_years <= 6 AND momentum_score >= 35 THEN 'emerging'
        ELSE 'underground,emerging' END)
        || (CASE WHEN depth_score >= 70 THEN ',mainstream' ELSE '' END) AS tiers FROM s""")
def e11_suggest_tiers(spark, sf_dir):
    return catalog.suggest_tiers(a5_catalog_metrics(spark, sf_dir)).select("artist_id", "tiers")


@query("""WITH s AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'verified_existing' WHEN id % 8 = 0 THEN 'unresolved'
        WHEN id % 7 = 0 THEN 'conflicting_identity' WHEN id % 5 = 0 OR id % 4 = 0 THEN 'manual_review_required'
        ELSE 'high_confidence_candidate' END AS status FROM @names)
    SELECT id AS key, status, CASE status WHEN 'verified_existing' THEN 100 WHEN 'unresolved' THEN 0 WHEN 'conflicting_identity' THEN 49
        WHEN 'manual_review_required' THEN 75 ELSE 95 END::BIGINT AS confidence,
    CASE status WHEN 'verified_existing' THEN '' WHEN 'unresolved' THEN 'missing_stored_spotify_candidate'
        WHEN 'conflicting_identity' THEN 'stored_returned_name_difference'
        WHEN 'high_confidence_candidate' THEN 'exact_name_candidate_is_review_only,stored_enrichment_does_not_preserve_alternate_exact_candidates'
    ELSE concat_ws(',', CASE WHEN id % 5 = 0 THEN 'short_or_single_token_name' END, CASE WHEN id % 4 = 0 THEN 'punctuation_or_symbol_risk' END,
        'stored_enrichment_does_not_preserve_alternate_exact_candidates') END AS concerns FROM s""")
def e11_cohort_status(spark, sf_dir):
    k = F.col("id")
    # a name of one word, of several, and with a symbol
    name = F.concat(F.lit("n"), F.when(k % 4 == 0, "-").otherwise(""), k.cast("string"), F.when(k % 5 == 0, "").otherwise(" band"))
    s = get(spark, sf_dir, "names").select(k.alias("key"), name.alias("name"))
    key = F.col("key")
    rich = s.select("key", F.when(key % 8 != 0, F.concat(F.lit("s"), key)).alias("external_id"),
        F.when(key % 7 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"))
    return cohort.cohort_status(s, rich, s.where("key % 9 = 0").select("key")).withColumn("concerns", F.array_join("concerns", ","))


@query(f"""WITH {_VARIANTS.strip()} SELECT artist_id, count(*) AS release_count, count(DISTINCT title) AS title_count,
        cast(min(year(start_)) AS int) AS earliest_year, cast(max(year(start_)) AS int) AS latest_year FROM d WHERE title <> '' GROUP BY artist_id""")
def a6_fingerprint(spark, sf_dir):
    return catalog.fingerprint(get(spark, sf_dir, "releases"), unicode=False)


@query("""WITH t AS (SELECT DISTINCT * FROM @titles) SELECT a.group_id, a.profile_id AS left_id, b.profile_id AS right_id, count(*) AS overlap FROM t a
        JOIN t b ON a.group_id = b.group_id AND a.title = b.title AND a.profile_id < b.profile_id GROUP BY ALL""")
def j13_pairwise_overlap(spark, sf_dir):
    return catalog.pairwise_overlap(get(spark, sf_dir, "titles"))


@query("""WITH t AS (SELECT DISTINCT o_custkey AS profile_id, o_orderpriority AS title, o_orderkey % 7 AS more FROM orders), u AS (SELECT 1 AS group_id, profile_id, title FROM t
        UNION SELECT 1, profile_id, 'm' || (profile_id % 97 * 7 + more) FROM t UNION SELECT 1, profile_id, 'all' FROM t),
    p AS (SELECT a.group_id, a.profile_id AS left_id, b.profile_id AS right_id, count(*) AS overlap FROM u a JOIN u b ON a.group_id = b.group_id AND a.title = b.title AND a.profile_id < b.profile_id GROUP BY ALL)
    SELECT * FROM p WHERE overlap >= 10""")
def j13_overlap_of_hot_titles(spark, sf_dir):
    """Customers of one group that share ten titles: six titles that nearly all of them have make no pairs."""
    o = read(spark, sf_dir, "orders")
    profile = F.col("o_custkey").alias("profile_id")
    narrow = F.concat(F.lit("m"), (F.col("o_custkey") % 97 * 7 + F.col("o_orderkey") % 7).cast("string"))
    titles = [o.select(profile, t.alias("title")) for t in (F.col("o_orderpriority"), narrow, F.lit("all"))]
    found = titles[0].unionByName(titles[1]).unionByName(titles[2]).withColumn("group_id", F.lit(1))
    return catalog.pairwise_overlap(found, least=10)


# Rankings and names.
@query("""SELECT 'missing' AS finding, k AS rank, 0::BIGINT AS rows FROM range(1, 61) t(k) WHERE k NOT IN (SELECT rank FROM @ranking)
    UNION ALL SELECT 'duplicate', rank, count(*) FROM @ranking GROUP BY rank HAVING count(*) > 1
    UNION ALL SELECT 'out_of_range', rank, count(*) FROM @ranking WHERE rank < 1 OR rank > 60 GROUP BY rank""")
def a1_rank_report(spark, sf_dir):
    return ranking.rank_report(get(spark, sf_dir, "ranking"), 60)


@query("SELECT lower(trim(name)) AS name_key, count(*) AS members, list_sort(list(id)) AS ids FROM @names GROUP BY 1 HAVING count(*) > 1")
def a2_collisions(spark, sf_dir):
    return ranking.collisions(get(spark, sf_dir, "names"), unicode=False)


@query("SELECT external_id, count(*) AS rows, list_sort(list(DISTINCT id)) AS keys FROM @names WHERE external_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a3_duplicate_ids(spark, sf_dir):
    return ranking.duplicate_ids(get(spark, sf_dir, "names"))


@query("""WITH k AS (SELECT lower(name) AS name_key, arg_max(artist_id, position) AS artist_id FROM @directory GROUP BY 1) SELECT id, rank, artist_id,
        artist_id IS NOT NULL AS in_directory FROM @ranking r LEFT JOIN k ON lower(r.name) = k.name_key""")
def j1_match_by_name(spark, sf_dir):
    return ranking.match_by_name(get(spark, sf_dir, "ranking"), get(spark, sf_dir, "directory"), unicode=False).select("id", "rank", "artist_id", "in_directory")


@query("""WITH k AS (SELECT external_id, arg_max(artist_id, position) AS existing_id FROM @directory GROUP BY 1), c AS (SELECT id,
        'x' || (id % 90) AS external_id FROM @names) SELECT id, existing_id, existing_id IS NOT NULL AS exists FROM c LEFT JOIN k USING (external_id)""")
def j2_overlap_by_id(spark, sf_dir):
    df = get(spark, sf_dir, "names").select("id", F.concat(F.lit("x"), (F.col("id") % 90).cast("string")).alias("external_id"))
    return ranking.overlap_by_id(df, get(spark, sf_dir, "directory")).select("id", "existing_id", "exists")


def _requests(spark, sf_dir):
    part = get(spark, sf_dir, "names")
    asked = part.select(F.col("external_id").alias("request_id"), F.split("name", " ")[0].alias("name")).groupBy("request_id").agg(F.min("name").alias("name"))
    return asked, part.select(F.col("external_id").alias("request_id"), "name", F.col("id").alias("candidate_id"), "position")


@query("""WITH q AS (SELECT external_id AS request_id, min(split_part(name, ' ', 1)) AS wanted FROM @names GROUP BY 1),
    f AS (SELECT external_id AS request_id, id AS candidate_id, position, CASE WHEN name = wanted THEN 0 WHEN starts_with(name, wanted) THEN 1
        WHEN contains(name, wanted) THEN 2 ELSE 3 END AS score FROM @names JOIN q ON external_id = request_id),
    b AS (SELECT *, min(score) OVER (PARTITION BY request_id) AS best FROM f), k AS (SELECT *,
        row_number() OVER (PARTITION BY request_id ORDER BY score, position, candidate_id) AS rank FROM b WHERE best > 0 OR score = 0)
    SELECT request_id, candidate_id, score, cast(rank AS int) AS rank FROM k WHERE rank <= 10""")
def j3_resolve_names(spark, sf_dir):
    return ranking.resolve_names(*_requests(spark, sf_dir), unicode=False)


_FIRST = """WITH c AS (SELECT *, count(*) OVER (PARTITION BY external_id, lower(name)) AS exact_count, CASE id % 4 WHEN 0 THEN NULL
        WHEN 1 THEN upper(name) ELSE name END AS match_name, id % 3 = 0 AS image, id % 11 = 0 AS verified, id % 13 = 0 OR id % 17 = 0 AS duplicate
        FROM @names),
p AS (SELECT *, CASE WHEN lower(match_name) = lower(name) THEN 60 ELSE 0 END + CASE WHEN exact_count = 1 THEN 25 ELSE 0 END + CASE
        WHEN match_name = name THEN 10 ELSE 0 END + CASE WHEN image THEN 5 ELSE 0 END AS points,
    list_filter([CASE WHEN exact_count > 1 THEN 'multiple_exact_name_profiles' END, CASE WHEN match_name <> name THEN 'returned_name_difference' END],
        lambda x: x IS NOT NULL) AS why FROM c),
s AS (SELECT *, CASE WHEN match_name IS NULL THEN 'unresolved' WHEN verified THEN 'verified_existing' WHEN duplicate THEN 'conflicting_identity'
        WHEN len(why) > 0 THEN 'manual_review_required' WHEN points >= 90 THEN 'high_confidence_candidate' ELSE 'manual_review_required' END AS status,
    cast(CASE WHEN match_name IS NULL THEN 0 WHEN verified THEN 100 WHEN duplicate THEN least(points, 49) WHEN len(why) > 0 THEN least(points, 79)
        WHEN points >= 90 THEN least(points, 95) ELSE points END AS bigint) AS confidence FROM p),
g AS (SELECT *, status NOT IN ('verified_existing', 'high_confidence_candidate') AS requires_review, CASE WHEN status = 'conflicting_identity' THEN 100
        WHEN status = 'unresolved' THEN 95 ELSE least(100, CASE WHEN status = 'manual_review_required' THEN 50 ELSE 0 END
    + CASE WHEN status <> 'verified_existing' AND list_contains(why, 'multiple_exact_name_profiles') THEN 30 ELSE 0 END + CASE
        WHEN status <> 'verified_existing' AND list_contains(why, 'returned_name_difference') THEN 15 ELSE 0 END) END AS priority FROM s)
"""


def _first_stage(spark, sf_dir):
    df = get(spark, sf_dir, "names").withColumn("k", F.lower("name"))
    n = df.groupBy("external_id", "k").agg(F.count("*").alias("exact_count"))
    df = df.join(n, ["external_id", "k"]).withColumn("match_name", F.when(F.col("id") % 4 == 1, F.upper("name")).when(F.col("id") % 4 != 0, F.col("name")))
    df = df.select("id", "name", "match_name", "exact_count", (F.col("id") % 3 == 0).alias("image"), (F.col("id") % 11 == 0).alias("verified"),
        (F.col("id") % 13 == 0).alias("duplicate"), (F.col("id") % 17 == 0).alias("external_id_conflict"), F.array().cast("array<string>").alias("ambiguity"))
    return ranking.review_priority(ranking.first_stage(df))


@query(f"{_FIRST} SELECT id, status, confidence, cast(priority AS bigint) AS priority, requires_review FROM g")
def e1_first_stage(spark, sf_dir):
    return _first_stage(spark, sf_dir).select("id", "status", "confidence", "priority", "requires_review")


@query(f"{_FIRST} SELECT id, cast(row_number() OVER (ORDER BY priority DESC, id) AS bigint) AS place FROM g WHERE requires_review")
def w7_review_queue(spark, sf_dir):
    return ranking.review_queue(_first_stage(spark, sf_dir), "id").select("id", "place")


STATUSES = ["verified_existing", "high_confidence_candidate", "manual_review_required", "conflicting_identity", "unresolved", "withdrawn"]


@query(f"""{_FIRST} SELECT d.status, count(g.id) AS rows, round(100.0 * count(g.id) / (SELECT count(*) FROM g), 2) AS percent
        FROM (SELECT unnest({STATUSES}) AS status) d LEFT JOIN g USING (status) GROUP BY d.status""")
def a4_status_summary(spark, sf_dir):
    return ranking.status_summary(_first_stage(spark, sf_dir), STATUSES)


@query("""WITH m AS (SELECT r.id, r.name, count(c.id) AS exact_count FROM @names r LEFT JOIN @names c ON c.external_id = r.external_id
        AND c.name = r.name AND c.id % 2 = 0 GROUP BY ALL)
    SELECT id, exact_count, CASE WHEN exact_count = 1 AND contains(name, ' ') AND length(name) > 4 THEN 'exact_match'
        ELSE 'needs_review' END AS review_status FROM m""")
def e2_identity_review(spark, sf_dir):
    df = get(spark, sf_dir, "names")
    found = df.where("id % 2 = 0").select("external_id", "name", F.col("id").alias("candidate_id"), "position", F.lit(None).cast("string").alias("image"))
    return ranking.identity_review(df.select("id", "external_id", "name"), found).select("id", F.coalesce("exact_count", F.lit(0)).alias("exact_count"), "review_status")


# Event logs.
_LAST = """WITH c AS (SELECT candidate_id, max(candidate_revision) AS revision, arg_max(next_state, candidate_revision) AS state,
        min(occurred_at) AS created_at, max(occurred_at) AS updated_at FROM @log GROUP BY 1)"""


@query("""SELECT candidate_id, max(candidate_revision) AS revision, arg_max(next_state, candidate_revision) AS state, arg_max(identifier,
        candidate_revision) FILTER (identifier IS NOT NULL) AS external_id, count(*) FILTER (event_type = 'state_transition') AS transitions,
        count(DISTINCT CASE WHEN event_type IN ('discovery_attached', 'candidate_discovered') THEN occurrence_id END) AS attached FROM @log GROUP BY 1""")
def l1_replay(spark, sf_dir):
    return lifecycle.replay(get(spark, sf_dir, "log")).select("candidate_id", "revision", "state", "external_id", "transitions",
        F.size("occurrences").cast("long").alias("attached"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, to in lifecycle.TRANSITIONS.items() for b in to)


@query(f"""WITH l AS (SELECT *, lag(next_state) OVER w AS before FROM @log WINDOW w AS (PARTITION BY candidate_id ORDER BY candidate_revision)),
    t AS (SELECT * FROM (VALUES {_PAIRS}) v(a, b))
    SELECT candidate_id, candidate_revision, 'illegal_transition' AS fault FROM l WHERE event_type = 'state_transition' AND NOT EXISTS (SELECT 1 FROM t
        WHERE a = previous_state AND b = next_state)
    UNION ALL SELECT candidate_id, candidate_revision, 'attachment_moves_state' FROM l WHERE event_type = 'discovery_attached'
        AND previous_state IS DISTINCT FROM next_state
    UNION ALL SELECT candidate_id, max(candidate_revision), 'repeated_attachment' FROM l WHERE event_type = 'discovery_attached' GROUP BY candidate_id,
        occurrence_id HAVING count(*) > 1
    UNION ALL SELECT candidate_id, max(candidate_revision), 'identifier_overwritten' FROM l WHERE identifier IS NOT NULL
        GROUP BY candidate_id HAVING count(DISTINCT identifier) > 1""")
def l2_validate_log(spark, sf_dir):
    return lifecycle.validate_log(get(spark, sf_dir, "log"), lifecycle.transition_table(spark))


@query(f"""SELECT k AS instant, candidate_id, arg_max(next_state, candidate_revision) AS state FROM @log JOIN (SELECT unnest(['{START}',
        '{END}']) AS k) ON occurred_at < cast(k AS timestamp) GROUP BY 1, 2""")
def l3_states_as_of(spark, sf_dir):
    at = spark.sql("select cast(k as timestamp) instant from (select explode(array(:a, :b)) k)", {"a": START, "b": END})
    return lifecycle.states_as_of(get(spark, sf_dir, "log"), at).select(F.date_format("instant", "yyyy-MM-dd").alias("instant"), "candidate_id", "state")


@query("""WITH i AS (SELECT DISTINCT date_trunc('hour', occurred_at) AS instant FROM @log), x AS (SELECT candidate_id, occurred_at, arg_max(next_state, candidate_revision) OVER w AS state,
        min(occurred_at) OVER w AS created_at, lead(occurred_at) OVER (PARTITION BY candidate_id ORDER BY occurred_at, candidate_revision) AS until FROM @log
        WINDOW w AS (PARTITION BY candidate_id ORDER BY occurred_at))
    SELECT instant, candidate_id, state, epoch_us(created_at) AS created FROM x JOIN i ON occurred_at < instant AND (until IS NULL OR instant <= until)""")
def l3_states_each_hour(spark, sf_dir):
    """All candidates at every full hour of the log: by time ranges, not by a broadcast."""
    log = get(spark, sf_dir, "log")
    hours = log.select(F.date_trunc("hour", "occurred_at").alias("instant"))
    return lifecycle.states_as_of(log, hours, small=0).select("instant", "candidate_id", "state", F.unix_micros("created_at").alias("created"))


@query(f"""{_LAST}, d AS (SELECT candidate_id, revision, state, CASE WHEN cast(candidate_id AS bigint) % 3 = 0 THEN revision - 1
        ELSE revision END AS expected FROM c), t AS (SELECT * FROM (VALUES {_PAIRS}) v(a, b)), e AS (SELECT *, EXISTS (SELECT 1 FROM t WHERE a = state AND b = 'needs_review') AS legal FROM d)
    SELECT candidate_id, CASE WHEN expected = revision AND legal THEN revision + 1 END AS candidate_revision, state AS previous_state, CASE WHEN expected <> revision THEN 'stale'
        WHEN NOT legal THEN 'illegal' END AS refused FROM e""")
def l4_emit_events(spark, sf_dir):
    now = lifecycle.replay(get(spark, sf_dir, "log"))
    late = F.when(F.col("candidate_id").cast("long") % 3 == 0, F.col("revision") - 1).otherwise(F.col("revision"))
    decisions = now.select("candidate_id", late.alias("expected_revision"), F.lit("state_transition").alias("event_type"),
        F.lit("needs_review").alias("next_state"), F.lit("held").alias("reason_code"), F.col("updated_at").alias("occurred_at"),
            F.lit(None).cast("string").alias("occurrence_id"), F.lit(None).cast("string").alias("identifier"))
    events, refused = lifecycle.emit_events(decisions, now)
    no = refused.join(now.select("candidate_id", F.col("state").alias("previous_state")), "candidate_id")
    return events.select("candidate_id", "candidate_revision", "previous_state", F.lit(None).cast("string").alias("refused")).unionByName(
        no.select("candidate_id", F.lit(None).cast("long").alias("candidate_revision"), "previous_state", "refused"))


@query(f"""{_LAST}, s AS (SELECT candidate_id, CASE WHEN cast(candidate_id AS bigint) % 5 = 0 THEN 'changed' ELSE state END AS state FROM c)
    SELECT candidate_id, state, 'snapshot' AS side FROM s WHERE state = 'changed' UNION ALL SELECT candidate_id, state, 'replay' FROM c WHERE cast(candidate_id AS bigint) % 5 = 0""")
def j18_verify_snapshot(spark, sf_dir):
    log = get(spark, sf_dir, "log")
    stored = F.when(F.col("candidate_id").cast("long") % 5 == 0, "changed").otherwise(F.col("state"))
    return lifecycle.verify_snapshot(lifecycle.replay(log).select("candidate_id", stored.alias("state")), log)


_RETRY = """WITH f AS (SELECT *, row_number() OVER w AS attempt, min(occurred_at) OVER w AS first_at
        FROM @failures WINDOW w AS (PARTITION BY candidate_id ORDER BY occurred_at)),
    g AS (SELECT *, epoch_us(occurred_at) - epoch_us(first_at) >= 72 * 3600000000 AS late FROM f)
"""


@query(f"""{_RETRY} SELECT candidate_id, cast(attempt AS int) AS attempt, late OR attempt > 3 AS exhausted, CASE
        WHEN late THEN 'retry_elapsed_time_exhausted' WHEN attempt > 3 THEN 'retry_attempts_exhausted' END AS exhaustion_reason,
    CASE WHEN NOT (late OR attempt > 3) THEN greatest(CASE attempt WHEN 1 THEN 900.0 WHEN 2 THEN 7200.0 ELSE 86400.0 END,
        coalesce(cast(retry_after AS double), 0.0)) END AS wait_seconds FROM g""")
def w5_retry_schedule(spark, sf_dir):
    df = lifecycle.retry_schedule(get(spark, sf_dir, "failures"))
    return df.select("candidate_id", "attempt", "exhausted", "exhaustion_reason",
        F.round(F.col("next_retry_at").cast("double") - F.col("occurred_at").cast("double"), 3).alias("wait_seconds"))


@query("""WITH f AS (SELECT *, row_number() OVER w AS attempt, min(occurred_at) OVER w AS first_at
        FROM @failures WINDOW w AS (PARTITION BY candidate_id ORDER BY occurred_at)),
    x AS (SELECT DISTINCT candidate_id FROM f WHERE attempt > 3 OR epoch_us(occurred_at) - epoch_us(first_at) >= 72 * 3600000000),
        c AS (SELECT candidate_id, max(candidate_revision) AS revision, arg_max(next_state, candidate_revision) AS state FROM @log GROUP BY 1)
    SELECT candidate_id, revision AS expected_revision, 'needs_review' AS next_state FROM c JOIN x USING (candidate_id) WHERE state = 'retry_wait'""")
def l11_route_exhausted(spark, sf_dir):
    return lifecycle.route_exhausted(lifecycle.replay(get(spark, sf_dir, "log")),
        lifecycle.retry_schedule(get(spark, sf_dir, "failures"))).select("candidate_id", "expected_revision", "next_state")


@query("""SELECT provider, count(*) AS requests, count(*) FILTER (status_code = 200) AS successes,
        count(*) FILTER (status_code = 401) AS authentication_failures, count(*) FILTER (status_code = 404) AS permanent_absences,
        count(*) FILTER (status_code = 503) AS transient_failures, count(*) FILTER (status_code = 418) AS permanent_failures FROM @calls GROUP BY 1""")
def l10_failure_metrics(spark, sf_dir):
    return lifecycle.failure_metrics(get(spark, sf_dir, "calls"))


_BREAKER = """WITH RECURSIVE c AS (SELECT cast(user_id AS string) AS provider, event_id AS call_id, epoch(ts) AS t, CASE
        WHEN event_type = 'error' THEN 'transient' WHEN event_id % 101 = 0 THEN 'authentication_or_configuration'
        WHEN event_id % 103 = 0 THEN 'permanent' END AS kind,
        CASE WHEN event_id % 7 = 0 THEN 5000.0 ELSE 0.0 END AS wait, 'r' || (event_id % 3) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts,
        event_id) AS n FROM events),
    b AS (SELECT provider, 0::BIGINT AS call_id, 0::BIGINT AS n, 'closed' AS state, 0 AS failures, false AS skipped, NULL::DOUBLE AS probe,
        NULL::VARCHAR AS cause, NULL::VARCHAR AS owner FROM c WHERE n = 1
        UNION ALL SELECT provider, call_id, n, CASE WHEN skip THEN state WHEN kind IS NULL THEN 'closed' WHEN opens THEN 'open'
        WHEN half THEN 'half_open' ELSE state END, CASE WHEN skip THEN failures WHEN kind IS NULL THEN 0 WHEN counts THEN failures + 1
        ELSE failures END, skip,
            CASE WHEN skip THEN probe WHEN kind IS NULL THEN NULL WHEN opens THEN t + greatest(900.0, wait) ELSE probe END, CASE WHEN skip THEN cause
        WHEN kind IS NULL THEN NULL WHEN counts THEN kind ELSE cause END, CASE WHEN skip THEN owner WHEN kind IS NULL THEN NULL WHEN counts THEN run
        ELSE owner END
        FROM (SELECT *, counts AND (kind <> 'transient' OR half OR failures + 1 >= 2) AS opens FROM (SELECT *, state IN ('open', 'half_open')
        AND NOT skip AS half, coalesce(kind IN ('transient', 'authentication_or_configuration'), false) AS counts
            FROM (SELECT c.*, b.state, b.failures, b.probe, b.cause, b.owner, b.state = 'open' AND CASE
        WHEN b.cause = 'authentication_or_configuration' THEN c.run = b.owner ELSE c.t < b.probe END AS skip FROM b JOIN c ON c.provider = b.provider
        AND c.n = b.n + 1))))
"""


def _lane_calls(df):
    id_ = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "transient").when(id_ % 101 == 0, "authentication_or_configuration").when(id_ % 103 == 0, "permanent")
    return df.select(F.col("user_id").cast("string").alias("provider"), id_.alias("call_id"),
        F.col("ts").cast("timestamp").cast("double").alias("occurred_at"), kind.alias("kind"),
            F.when(id_ % 7 == 0, 5000.0).otherwise(0.0).alias("retry_after"), F.concat(F.lit("r"), id_ % 3).alias("run_id"))


@query(f"{_BREAKER} SELECT provider, call_id, state, failures AS failure_count, skipped, probe AS next_probe_at FROM b WHERE n > 0")
def l9_breaker_history(spark, sf_dir):
    return lifecycle.breaker_history(_lane_calls(read(spark, sf_dir, "events")))


@query(f"""WITH e AS (SELECT cast(user_id AS string) AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
        event_type AS t FROM events),
    k AS (SELECT *, n + CASE WHEN n > 20 THEN 1 ELSE 0 END AS revision, (n - 1) % 7 + 1 AS place, CASE WHEN n = 1
        AND event_id % 19 > 0 THEN 'run_created' WHEN event_id % 31 = 0 THEN 'run_stopped' WHEN t = 'error' THEN 'run_paused'
        WHEN t = 'signup' THEN 'run_resumed' WHEN t = 'purchase' THEN 'provider_execution_recorded' ELSE 'phase_completed' END AS et FROM e),
    p AS (SELECT *, CASE et WHEN 'run_created' THEN 1 WHEN 'phase_completed' THEN place END AS done, CASE WHEN et IN ('run_created',
        'run_resumed') THEN 'running' WHEN et = 'run_paused' THEN 'paused' WHEN et = 'run_stopped' THEN 'stopped' WHEN et = 'phase_completed'
        AND place = 7 THEN 'completed' END AS control FROM k),
    w AS (SELECT *, lag(revision) OVER o AS prev, last_value(done IGNORE NULLS) OVER x AS before, coalesce(last_value(control IGNORE NULLS) OVER x,
        'none') AS was FROM p WINDOW o AS (PARTITION BY run_id ORDER BY revision),
        x AS (PARTITION BY run_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT run_id, list_sort(list(fault)) AS faults FROM (SELECT run_id, unnest([CASE WHEN coalesce(revision <> prev + 1,
        revision <> 1) THEN 'revision_gap' END, CASE WHEN (prev IS NULL) <> (et = 'run_created') THEN 'not_created_first' END, CASE
        WHEN et = 'phase_completed' AND NOT coalesce(done = before + 1, false) THEN 'phase_out_of_order' END,
        CASE WHEN et = 'run_paused' AND was <> 'running' THEN 'paused_while_not_running' END, CASE WHEN et = 'run_resumed'
        AND was <> 'paused' THEN 'resumed_while_not_paused' END, CASE WHEN et = 'run_stopped' AND was NOT IN ('running',
        'paused') THEN 'stopped_while_not_active' END]) AS fault FROM w) WHERE fault IS NOT NULL GROUP BY 1),
    g AS (SELECT run_id, max(revision) AS revision, coalesce(arg_max(done, revision) FILTER (done IS NOT NULL), 0) AS d,
        count(*) FILTER (et = 'phase_completed' AND event_id % 4 = 0) AS skipped_phases, arg_max(control,
        revision) FILTER (control IS NOT NULL) AS status,
        arg_max(CASE WHEN et = 'run_paused' THEN 'p' || event_id ELSE '' END, revision) FILTER (et IN ('run_created', 'run_paused', 'run_resumed')
        OR control = 'completed') AS pr, arg_max(CASE WHEN et = 'run_stopped' THEN 's' || event_id ELSE '' END, revision) FILTER (et IN ('run_created',
        'run_stopped', 'run_resumed') OR control = 'completed') AS sr,
        arg_max(event_id, revision) AS requests, arg_min(event_id % 3, revision) <> arg_max(event_id % 3, revision) AS checksum_changed FROM w
        GROUP BY 1),
    l AS (SELECT run_id, arg_max(event_id, revision) AS lane FROM w WHERE et = 'provider_execution_recorded' AND event_id % 2 = 0 GROUP BY 1),
        n AS (SELECT {list(lifecycle.PHASES)} AS names)
    SELECT run_id, revision, d AS phases_done, skipped_phases, CASE WHEN d > 0 THEN names[d] END AS last_phase, names[d + 1] AS first_open_phase,
        status, nullif(pr, '') AS pause_reason, nullif(sr, '') AS stop_reason, requests, lane, checksum_changed, coalesce(array_to_string(faults, ','),
        '') AS faults
    FROM g LEFT JOIN f USING (run_id) LEFT JOIN l USING (run_id), n""")
def l8_replay_runs(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    n, id_, t = F.col("n"), F.col("event_id"), F.col("event_type")
    kind = F.when((n == 1) & (id_ % 19 > 0), "run_created").when(id_ % 31 == 0, "run_stopped").when(t == "error", "run_paused").when(t == "signup",
        "run_resumed").when(t == "purchase", "provider_execution_recorded").otherwise("phase_completed")
    e = e.withColumn("kind", kind)
    at = lambda *names: F.col("kind").isin(*names)
    phase = F.when(at("phase_completed"), F.element_at(F.array(*map(F.lit, lifecycle.PHASES)), ((n - 1) % 7 + 1).cast("int")))
    journal = e.select(
        F.col("user_id").cast("string").alias("run_id"), (n + F.when(n > 20, 1).otherwise(0)).alias("revision"), F.col("kind").alias("event_type"),
            phase.alias("phase"), F.when(at("phase_completed"), F.when(id_ % 4 == 0, "skipped").otherwise("completed")).alias("disposition"),
        F.concat(F.when(at("run_paused"), "p").when(at("run_stopped"), "s"), id_).alias("reason"),
            F.when(at("provider_execution_recorded"), F.when(id_ % 2 == 0, "even").otherwise("odd")).alias("provider"), id_.alias("requests"),
                (id_ % 3).alias("checksum"),
    )
    out = lifecycle.replay_runs(journal).withColumn("lane", F.try_element_at("providers", F.lit("even")))
    return out.drop("providers").withColumn("faults", F.array_join("faults", ","))


@query(f"""{_LAST}, n AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY updated_at, candidate_id) AS p FROM c) SELECT candidate_id, state,
        cast(p AS int) AS queue_place FROM n WHERE p <= 5""")
def w9_select_work(spark, sf_dir):
    return lifecycle.select_work(lifecycle.replay(get(spark, sf_dir, "log")), None, 5).select("candidate_id", "state", "queue_place")


@query(f"""{_LAST}, w AS (SELECT *, row_number() OVER (ORDER BY updated_at, candidate_id) AS p FROM c WHERE state = 'identity_pending')
    SELECT candidate_id, revision AS expected_revision, 'retry_wait' AS next_state, 'identity_worker_lease_expired' AS reason_code FROM c
        WHERE state = 'identity_resolving'
    UNION ALL SELECT candidate_id, revision, 'identity_pending', 'identity_retry_became_eligible' FROM c WHERE state = 'retry_wait' AND updated_at <= TIMESTAMP '2024-01-30'
    UNION ALL SELECT candidate_id, revision, CASE WHEN cast(candidate_id AS bigint) % 2 = 0 THEN 'identity_coherent' ELSE 'failed_match' END, CASE
        WHEN cast(candidate_id AS bigint) % 2 = 0 THEN 'identity_evidence_coherent' ELSE 'no_safe_exact_identity_resolved' END FROM w WHERE p <= 25""")
def l6_identity_batch(spark, sf_dir):
    now = lifecycle.replay(get(spark, sf_dir, "log")).withColumn("retry_at",
        F.col("updated_at") + F.expr("interval 1 day")).withColumn("resume_state", F.lit("identity_pending"))
    out = now.select("candidate_id",
        F.when(F.col("candidate_id").cast("long") % 2 == 0, "coherent_identity_evidence").otherwise("unresolved_identity").alias("outcome"),
            F.lit(False).alias("mechanically_closed"))
    return lifecycle.run_identity_batch(now, out, "2024-01-31").select("candidate_id", "expected_revision", "next_state", "reason_code")


@query(f"""{_LAST}, w AS (SELECT *, cast(candidate_id AS bigint) % 2 = 0 AS one, cast(cast(candidate_id AS bigint) // 8 AS string) AS x,
        row_number() OVER (ORDER BY updated_at, candidate_id) AS p FROM c WHERE state = 'identity_pending'),
    u AS (SELECT *, first_value(candidate_id) OVER (PARTITION BY x ORDER BY p) AS f FROM w WHERE p <= 25 AND one)
    SELECT candidate_id, revision AS expected_revision, CASE WHEN one THEN 'candidate_identifier_attached' ELSE 'state_transition' END AS event_type,
        CASE WHEN one THEN 'identity_discovery_pending' ELSE 'conflicting_identity' END AS next_state FROM w WHERE p <= 25
    UNION ALL SELECT candidate_id, revision + 1, 'state_transition', CASE WHEN f <> candidate_id OR cast(x AS bigint) % 5 = 0 THEN 'duplicate'
        ELSE 'identity_pending' END FROM u""")
def l7_bridge_batch(spark, sf_dir):
    now = lifecycle.replay(get(spark, sf_dir, "log")).withColumn("state",
        F.when(F.col("state") == "identity_pending", "identity_discovery_pending").otherwise(F.col("state")))
    id_ = F.floor(F.col("candidate_id").cast("long") / 8)
    found = now.select("candidate_id", F.when(F.col("candidate_id").cast("long") % 2 == 0,
        "unique_exact_bridge").otherwise("conflicting_identity").alias("status"), id_.cast("string").alias("external_id"))
    known = now.select(id_.cast("string").alias("external_id"), F.lit("someone").alias("holder"), (id_ % 2 == 0).alias("live")).where(id_ % 5 == 0)
    return lifecycle.run_bridge_batch(now.drop("external_id"), found, "2024-01-31", known=known).select("candidate_id", "expected_revision", "event_type", "next_state")


# Metrics.
@query(f"""WITH s AS (SELECT k, candidate_id, arg_max(next_state, candidate_revision) AS state FROM @log JOIN (SELECT unnest(['{START}',
        '{END}']) AS k) ON occurred_at < cast(k AS timestamp) GROUP BY 1, 2)
    SELECT state, count(*) FILTER (k = '{START}') AS before, count(*) FILTER (k = '{END}') AS after,
        count(*) FILTER (k = '{END}') - count(*) FILTER (k = '{START}') AS growth FROM s GROUP BY 1""")
def a8_queue_growth(spark, sf_dir):
    return metrics.queue_growth(get(spark, sf_dir, "log"), START, END)


@query(f"""{_LAST}, a AS (SELECT state, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3600000000.0 AS age FROM c)
    SELECT state, round(quantile_disc(age, 0.5), 4) AS p50_hours, round(quantile_disc(age, 0.75), 4) AS p75_hours, round(quantile_disc(age, 0.9),
        4) AS p90_hours, round(quantile_disc(age, 0.95), 4) AS p95_hours, round(max(age), 4) AS max_hours, count(*) AS candidates FROM a GROUP BY 1""")
def a9_queue_ages(spark, sf_dir):
    return metrics.queue_ages(lifecycle.replay(get(spark, sf_dir, "log")), "2024-02-01", "state")


@query(f"""WITH t AS (SELECT candidate_id, min(occurred_at) AS born, min(occurred_at) FILTER (event_type = 'state_transition'
        AND next_state = 'identity_coherent') AS done FROM @log GROUP BY 1)
    SELECT round(median((epoch_us(done) - epoch_us(born)) / 3600000000.0), 4) AS median_hours, count(*) AS candidates FROM t
        WHERE done >= TIMESTAMP '2024-01-01' AND done < TIMESTAMP '{END}'""")
def a10_time_to_terminal(spark, sf_dir):
    return metrics.time_to_terminal(get(spark, sf_dir, "log"), "2024-01-01", END)


@query(f"""SELECT previous_state, next_state, count(*) AS events, count(DISTINCT candidate_id) AS candidates FROM @log
        WHERE event_type = 'state_transition' AND occurred_at >= TIMESTAMP '{START}' AND occurred_at < TIMESTAMP '{END}' GROUP BY 1, 2""")
def a13_outcomes_by_state(spark, sf_dir):
    return metrics.outcomes_by_state(get(spark, sf_dir, "log"), START, END)


_BLOCK = f"""{_LAST}, y AS (SELECT candidate_id, bool_or(reason_code = 'retry_budget_exhausted') AS spent,
        bool_or(reason_code = 'bridge_not_found') AS missing FROM @log GROUP BY 1), x AS (SELECT candidate_id, arg_max(identifier,
        candidate_revision) FILTER (identifier IS NOT NULL) AS e FROM @log GROUP BY 1),
    b AS (SELECT candidate_id, state, created_at, CASE WHEN spent THEN 'retry_budget_exhausted'
        WHEN cast(candidate_id AS bigint) % 7 = 0 THEN 'same_name_ambiguity' WHEN e IS NULL OR missing THEN 'missing_exact_bridge'
        WHEN state = 'identity_coherent' THEN 'editorial_input_missing' ELSE 'unresolved_identifiers' END AS blocker FROM c JOIN y USING (candidate_id)
        JOIN x USING (candidate_id))
"""


def _blocked(spark, sf_dir):
    log = get(spark, sf_dir, "log")
    now = lifecycle.replay(log).withColumn("outcome", F.lit(None).cast("string")).withColumn("same_name",
        F.when(F.col("candidate_id").cast("long") % 7 == 0, 1)).withColumn("stage", F.lit(None).cast("string"))
    return now, log


@query(f"{_BLOCK} SELECT candidate_id, blocker FROM b")
def e12_blockers(spark, sf_dir):
    return metrics.blockers(*_blocked(spark, sf_dir)).select("candidate_id", "blocker")


@query(f"""{_BLOCK} SELECT blocker, count(*) AS entries, round(max((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3600000000.0),
        4) AS oldest_hours FROM b WHERE state IN ('retry_wait', 'identity_coherent') GROUP BY 1""")
def a15_weekly_review(spark, sf_dir):
    return metrics.weekly_review(*_blocked(spark, sf_dir), "2024-02-01").select("blocker", "entries", "oldest_hours")


def _runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    lane = e.groupBy("user_id", "event_type").agg(F.count("*").alias("requests"), F.sum((F.col("event_id") % 3 == 0).cast("long")).alias("retries"),
        F.max("t").alias("t"))
    x = F.struct(F.create_map(F.lit("requests"), "requests", F.lit("retries"), "retries").alias("metrics"),
        F.when(F.col("requests") > 15, "open").otherwise("closed").alias("breaker"), F.when(F.col("retries") > 5, "request_budget_reached").alias("stop_reason"))
    return lane.groupBy(F.col("user_id").alias("run_id")).agg(F.max("t").alias("updated_at"),
        F.map_from_entries(F.collect_list(F.struct("event_type", x))).alias("providers"),
            F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(F.lit("requests"), "requests")))).alias("budget"))


_RUNS = """WITH l AS (SELECT user_id, event_type AS provider, count(*) AS requests, count(*) FILTER (event_id % 3 = 0) AS retries FROM events
        GROUP BY 1, 2), u AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1)
"""


@query(f"""{_RUNS} SELECT provider, cast(sum(requests) AS bigint) AS requests, cast(sum(retries) AS bigint) AS retries, arg_max(CASE
        WHEN requests > 15 THEN 'open' ELSE 'closed' END, t) AS breaker, bool_or(retries > 5) AS stopped FROM l JOIN u USING (user_id) GROUP BY 1""")
def a11_provider_rollup(spark, sf_dir):
    return metrics.provider_rollup(_runs(spark, sf_dir)).select("provider", "requests", "retries", "breaker", (F.size("stop_reasons") > 0).alias("stopped"))


@query(f"{_RUNS} SELECT provider AS lane, 'requests' AS counter, cast(sum(requests) AS bigint) AS used FROM l GROUP BY 1")
def a12_budget_rollup(spark, sf_dir):
    return metrics.budget_rollup(_runs(spark, sf_dir))


@query("""WITH r AS (SELECT event_type AS provider, CASE event_id % 3 WHEN 0 THEN 'create' ELSE 'attach' END AS action, user_id AS target_id
        FROM events), w AS (SELECT target_id, count(DISTINCT provider) > 1 AS x FROM r GROUP BY 1)
    SELECT action, count(*) AS results, count(DISTINCT target_id) AS targets, count(DISTINCT CASE WHEN x THEN target_id END) AS cross_source FROM r
        JOIN w USING (target_id) GROUP BY 1""")
def a16_action_metrics(spark, sf_dir):
    return metrics.action_metrics(read(spark, sf_dir, "events").select(F.col("event_type").alias("provider"),
        F.when(F.col("event_id") % 3 == 0, "create").otherwise("attach").alias("action"), F.col("user_id").alias("target_id")))


@query(f"""{_LAST} SELECT candidate_id, state FROM c WHERE state IN ('identity_pending', 'identity_discovery_pending', 'retry_wait') ORDER BY created_at,
        candidate_id LIMIT 10""")
def w8_oldest_pending(spark, sf_dir):
    return metrics.oldest_pending(lifecycle.replay(get(spark, sf_dir, "log"))).select("candidate_id", "state")


@query("SELECT user_id AS checkpoint_id, max(event_id) AS revision, arg_max(event_type, event_id) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def w3_latest_by(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("checkpoint_id"), F.col("event_id").alias("revision"), "event_type",
        F.col("ts").cast("timestamp").alias("updated_at"))
    return lifecycle.latest_by(e, ["checkpoint_id"], "revision", before=END).select("checkpoint_id", "revision", "event_type")


@query("""WITH p AS (SELECT user_id AS checkpoint_id, event_id AS revision, value AS page FROM events), b AS (SELECT *,
        max(page) OVER (PARTITION BY checkpoint_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p)
        SELECT checkpoint_id, revision FROM b WHERE page < m""")
def t8_backward_moves(spark, sf_dir):
    return streams.backward_moves(read(spark, sf_dir, "events").select(F.col("user_id").alias("checkpoint_id"), F.col("event_id").alias("revision"),
        F.col("value").alias("page"), F.lit(0).alias("item_offset")))


# Claims and outcomes.
@query("""WITH k AS (SELECT DISTINCT identifier_type FROM @claims), e AS (SELECT DISTINCT entity FROM @claims), g AS (SELECT entity, identifier_type,
        count(DISTINCT value) AS value_count, count(DISTINCT origin) AS origins FROM @claims GROUP BY 1, 2) SELECT entity, identifier_type,
        coalesce(value_count, 0) AS value_count, coalesce(origins, 0) AS origins, CASE WHEN value_count IS NULL THEN 'not_observed'
        WHEN value_count = 1 THEN 'agreement' ELSE 'conflict' END AS status FROM e CROSS JOIN k LEFT JOIN g USING (entity, identifier_type)""")
def a7_claim_agreement(spark, sf_dir):
    df = get(spark, sf_dir, "claims")
    return claims.claim_agreement(df, df.select("identifier_type").distinct()).select("entity", "identifier_type", "value_count", "origins", "status")


@query("""SELECT page_id AS entity, 'site' AS identifier_type, regexp_extract(url, '://([^/]+)', 1) AS value FROM pages UNION ALL SELECT page_id, 'page',
        regexp_extract(url, '/([0-9]+)', 1) FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> ''""")
def e5_extract_claims(spark, sf_dir):
    rec = read(spark, sf_dir, "pages").select(F.col("page_id").alias("entity"), F.lit("crawl").alias("source"), F.lit("url").alias("path"),
        F.lit("web").alias("origin"), F.lit("x").alias("asserted_by"), F.array("url").alias("urls"))
    return claims.extract_claims(rec, {"site": "://([^/]+)", "page": "/([0-9]+)"}).select("entity", "identifier_type", "value")


@query("""WITH p AS (SELECT p_brand AS entity, cast(p_partkey AS string) AS candidate_id, p_name FROM part), x AS (SELECT entity,
        min(candidate_id) AS expected_id, arg_min(p_name, candidate_id) AS name FROM p GROUP BY 1) SELECT x.entity,
        count(DISTINCT p.candidate_id) AS competitors FROM x LEFT JOIN p ON p.p_name = x.name AND p.candidate_id <> x.expected_id GROUP BY 1""")
def j6_same_name_audit(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_name").alias("name"))
    asked = p.groupBy("entity").agg(F.min("candidate_id").alias("expected_id"), F.min_by("name", "candidate_id").alias("name"))
    links = p.select("candidate_id", F.concat(F.lit("https://www.wikidata.org/wiki/Q"), "candidate_id").alias("url"))
    return claims.same_name_audit(asked, p.select("name", "candidate_id"), links).select("entity", F.col("competitors").cast("long").alias("competitors"))


@query("""SELECT cast(l_orderkey AS string) AS url, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'unique_exact_url_relationship' ELSE 'multiple_exact_url_relationships' END AS outcome, CASE
        WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS entity_id FROM lineitem GROUP BY 1""")
def j8_select_exact_url(spark, sf_dir):
    return claims.select_exact_url(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("url"), F.lit(True).alias("found"), F.col("l_suppkey").alias("entity_id")))


@query("""SELECT l_orderkey AS occurrence_id, l_suppkey AS candidate_id, o_custkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
        JOIN orders ON o_orderkey = l_orderkey""")
def j7_candidate_occurrences(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("occurrence_id"), F.lit("candidate").alias("target_type"),
        F.col("l_suppkey").alias("target_id"))
    return claims.candidate_occurrences(links, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("occurrence_id"), "o_custkey"))


_SECOND = f"""{_FIRST.strip()}, e AS (SELECT *, CASE id % 6 WHEN 0 THEN 35 WHEN 1 THEN 40 ELSE 0 END AS ids, (CASE WHEN id % 5 <= 1 THEN 7
        ELSE 0 END + CASE WHEN id % 5 <= 1 AND id % 67 <> 0 THEN 5 ELSE 0 END + CASE WHEN id % 5 = 1 THEN 8 ELSE 0 END) AS meta, id % 4 AS overlap,
        CASE id % 9 WHEN 0 THEN 'conflict' WHEN 1 THEN 'compatible' ELSE 'unknown' END AS chrono, id % 8 = 0 AS alt, CASE id % 3 WHEN 1 THEN 2
        WHEN 2 THEN 3 ELSE 0 END AS weak,
    id % 9 = 0 OR id % 61 = 0 OR id % 67 = 0 OR id % 71 = 0 OR id % 73 = 0 OR id % 79 = 0 AS bad FROM g),
    f AS (SELECT *, CASE WHEN overlap >= 3 THEN 30 WHEN overlap = 2 THEN 20 WHEN overlap = 1 THEN 7 ELSE 0 END + CASE WHEN chrono = 'compatible' THEN 5
        ELSE 0 END + CASE WHEN alt THEN 15 ELSE 0 END AS cat FROM e),
    h AS (SELECT *, (ids >= 30 OR cat >= 30) OR ((CASE WHEN ids >= 1 THEN 1 ELSE 0 END) + (CASE WHEN meta >= 10 THEN 1 ELSE 0 END) + (CASE
        WHEN cat >= 10 THEN 1 ELSE 0 END) >= 2) AS enough, cast(least(100, ids + least(meta, 20) + least(cat, 40) + weak) AS bigint) AS score FROM f),
    z AS (SELECT *, CASE WHEN status = 'verified_existing' THEN status WHEN bad THEN 'conflicting_identity' WHEN status = 'manual_review_required'
        AND enough THEN 'high_confidence_candidate' ELSE status END AS final_status,
    cast(CASE WHEN status = 'verified_existing' THEN 100 WHEN bad THEN least(confidence, 49) WHEN status = 'manual_review_required'
        AND enough THEN least(95, confidence + floor(score / 3 + 0.5)) ELSE confidence END AS bigint) AS final_confidence FROM h)
"""


def _second_stage(spark, sf_dir):
    i = F.col("id")
    few = i % 5 <= 1
    titles = F.array(*map(F.lit, ("Alpha (Deluxe Edition)", "Bravo", "C\u00e2f\u00e9 del mar", "Live")))
    others = F.concat(F.slice(F.array(*map(F.lit, ("ALPHA", "bravo!", "Cafe  del-mar"))), F.lit(1), (i % 4).cast("int")), F.array(F.lit("live"), F.lit("Greatest Hits")))
    df = _first_stage(spark, sf_dir).withColumns({
        "url_match": i % 6 == 0, "verified_id_match": i % 6 == 1, "id_conflict": i % 61 == 0, "alias_match": few,
            "type_match": F.when(i % 67 == 0, False).when(few, True), "area_match": i % 5 == 1, "dates_match": i % 5 == 1,
        "titles": titles, "other_titles": others, "chronology": F.when(i % 9 == 0, "conflict").when(i % 9 == 1, "compatible"),
            "primary_coherent": F.lit(True), "empty_alternatives": F.when(i % 8 == 0, 1).otherwise(0),
        "several_catalogs": i % 71 == 0, "catalog_complete": i % 73 != 0, "duplicate_id": i % 79 == 0, "image": i % 3 == 1,
            "case_agrees": F.lit(None).cast("boolean"), "has_release": i % 3 == 2,
    })
    return claims.second_stage(claims.corroboration_scores(df))


@query(f"{_SECOND} SELECT id, score AS corroboration_score, final_status, final_confidence FROM z")
def e3_second_stage(spark, sf_dir):
    return _second_stage(spark, sf_dir).select("id", "corroboration_score", "final_status", "final_confidence")


@query(f"""{_SECOND} SELECT final_status, count(*) AS rows, count(*) FILTER (status = 'manual_review_required'
        AND final_status = 'high_confidence_candidate') AS promoted, count(*) FILTER (final_status IN ('manual_review_required', 'conflicting_identity',
        'unresolved')) AS still_in_review, round(avg(score), 4) AS mean_score FROM z GROUP BY 1""")
def a18_promotion_summary(spark, sf_dir):
    return claims.promotion_summary(_second_stage(spark, sf_dir))


@query("""WITH n AS (SELECT c_custkey AS artist_id, c_mktsegment AS name, 's' || (c_custkey % 50) AS external_id FROM customer),
        a AS (SELECT 'a' || s_suppkey AS authority_id, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'OTHER' END AS name,
        's' || (s_suppkey % 50) AS linked_id, 1990 + s_suppkey % 12 AS begin_year FROM supplier),
    r AS (SELECT o_custkey AS artist_id, min(year(o_orderdate)) AS first_year, count(*) AS releases FROM orders GROUP BY 1)
    SELECT n.artist_id, count(DISTINCT authority_id) AS authority_ids, count(*) FILTER (linked_id = external_id) AS linked,
        count(*) FILTER (linked_id <> external_id) AS conflicting_links, coalesce(bool_or(first_year < begin_year), false) AS chronology_conflict,
        coalesce(max(releases), 0) AS releases FROM n LEFT JOIN a ON lower(a.name) = lower(n.name) LEFT JOIN r USING (artist_id) GROUP BY 1""")
def e4_build_evidence(spark, sf_dir):
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artist_id"), F.col("c_mktsegment").alias("name"),
        F.concat(F.lit("s"), (F.col("c_custkey") % 50).cast("string")).alias("external_id"))
    k = F.col("s_suppkey")
    auth = read(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), k.cast("string")).alias("authority_id"),
        F.when(k % 3 == 0, "BUILDING").when(k % 3 == 1, "MACHINERY").otherwise("OTHER").alias("name"), F.lit(None).cast("string").alias("alias"),
            F.concat(F.lit("s"), (k % 50).cast("string")).alias("linked_id"), (1990 + k % 12).alias("begin_year"))
    rel = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artist_id"), F.year("o_orderdate").alias("year"))
    return claims.build_evidence(names, rel, auth)


# Convergence.
@query("""WITH live AS (SELECT external_id, max(artist_id) AS a FROM @registry GROUP BY 1), act AS (SELECT * FROM @queue
        WHERE state NOT IN ('duplicate', 'migrated', 'rejected')),
    nm AS (SELECT lower(name) AS k, external_id AS e, candidate_id AS c FROM act UNION ALL SELECT lower(name), external_id, NULL FROM @live_names),
    kn AS (SELECT k, count(*) AS n FROM nm GROUP BY 1), ke AS (SELECT k, e, count(*) AS n FROM nm WHERE e IS NOT NULL GROUP BY 1, 2), kc AS (SELECT k,
        c, count(*) AS n FROM nm WHERE c IS NOT NULL AND e IS NULL GROUP BY 1, 2),
    x AS (SELECT c.*, r.artist_id AS known, r.external_id AS bound, live.a, (SELECT arg_min(q.candidate_id, q.position) FROM act q
        WHERE q.external_id = c.external_id AND q.candidate_id <> c.candidate_id) AS qid,
        coalesce(kn.n, 0) - coalesce(ke.n, 0) - coalesce(kc.n, 0) > 0 AS clash FROM @candidates c LEFT JOIN @registry r ON r.artist_id = c.asserted_id
        LEFT JOIN live ON live.external_id = c.external_id
        LEFT JOIN kn ON kn.k = lower(c.name) LEFT JOIN ke ON ke.k = lower(c.name) AND ke.e = c.external_id LEFT JOIN kc ON kc.k = lower(c.name)
        AND kc.c = c.candidate_id AND c.external_id IS NULL),
    y AS (SELECT *, CASE WHEN asserted_id IS NOT NULL AND known IS NULL THEN 'asserted_id_not_found' WHEN asserted_id IS NOT NULL
        AND external_id IS NOT NULL AND bound <> external_id THEN 'asserted_binding_conflict' WHEN asserted_id IS NOT NULL THEN 'asserted_binding_reused'
        WHEN a IS NOT NULL THEN 'existing_live_spotify_binding_reused' WHEN qid IS NOT NULL THEN 'queued_spotify_duplicate_detected' END AS d FROM x)
    SELECT candidate_id, CASE WHEN d IN ('asserted_id_not_found', 'asserted_binding_conflict') THEN 'needs_review' WHEN d IS NOT NULL THEN 'duplicate'
        WHEN external_id IS NOT NULL THEN 'identity_pending' ELSE 'identity_discovery_pending' END AS next_state,
    coalesce(d, (CASE WHEN external_id IS NOT NULL THEN 'identity_queued' ELSE 'identity_discovery_queued' END) || (CASE
        WHEN clash THEN '_with_name_warning' ELSE '' END)) AS reason_code, CASE WHEN d = 'queued_spotify_duplicate_detected' THEN qid END AS duplicate_of,
    CASE WHEN d = 'asserted_binding_reused' THEN asserted_id WHEN d = 'existing_live_spotify_binding_reused' THEN a END AS live_id, d IS NULL AND clash AS name_warning
        FROM y""")
def j4_duplicate_preflight(spark, sf_dir):
    return converge.duplicate_preflight(*(get(spark, sf_dir, n) for n in ("candidates", "registry", "queue", "live_names")))


def _occurrences(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("o"), k.cast("string")).alias("occurrence_id"), F.lit("p").alias("provider"), F.lit("artist").alias("entity_type"),
        F.when(k % 6 == 0, F.concat(F.lit("c"), "o_custkey")).otherwise(F.concat(F.lit("k"), k.cast("string"))).alias("entity_id"),
            F.when(k % 4 == 0, F.array(F.concat(F.lit("s"), (F.col("o_custkey")).cast("string")))).when(k % 35 == 1,
                F.array(F.lit("s1"), F.lit("s2"))).otherwise(F.array().cast("array<string>")).alias("external_ids"),
                    F.lit(None).cast("string").alias("asserted_id"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"))


_CONVERGED = """WITH occ AS (SELECT 'o' || o_orderkey AS id, o_orderdate AS day, 'p:artist:' || CASE WHEN o_orderkey % 6 = 0 THEN 'c' || o_custkey ELSE 'k' || o_orderkey END AS key,
        CASE WHEN o_orderkey % 4 = 0 THEN ['s' || o_custkey] WHEN o_orderkey % 35 = 1 THEN ['s1', 's2'] ELSE [] END AS ext FROM orders),
    link AS (SELECT id, key, 't' || id AS target FROM occ WHERE id LIKE '%0'),
    fresh AS (SELECT * FROM occ WHERE id NOT IN (SELECT id FROM link)),
    way AS (SELECT f.id, 'candidate' AS t, target AS i FROM fresh f JOIN link USING (key) UNION SELECT id, 'candidate', 'old' || c_custkey
        FROM (SELECT id, unnest(ext) AS e FROM fresh) JOIN customer ON e = 's' || c_custkey WHERE c_custkey % 3 = 1
        UNION SELECT id, 'live_artist', artist_id FROM (SELECT id, unnest(ext) AS e FROM fresh) JOIN @registry ON e = external_id WHERE cast(external_id[2:] AS int) % 3 <> 1),
    base AS (SELECT f.*, count(t) AS n, min(t || '|' || i) AS one, ext[1] AS e, len(ext) > 1 OR count(t) > 1 AS several,
        row_number() OVER (PARTITION BY key ORDER BY day, f.id) = 1 AS head FROM fresh f LEFT JOIN way ON way.id = f.id GROUP BY f.id, day, key, ext),
    maker AS (SELECT e, id AS made, day AS made_at FROM base WHERE head AND n = 0 AND NOT several AND e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e ORDER BY day, id) = 1),
    told AS (SELECT b.*, CASE WHEN made IS NOT NULL AND (made_at, made) < (day, id) AND one IS DISTINCT FROM 'candidate|candidate:' || made THEN 'candidate|candidate:' || made END AS late
        FROM base b LEFT JOIN maker USING (e)),
    fixed AS (SELECT *, n + (late IS NOT NULL)::INT AS k, coalesce(one, late) AS best FROM told),
    first AS (SELECT key, id, CASE WHEN several OR k > 1 THEN 'route_ambiguous_exact_convergence_to_review' WHEN k = 1 THEN CASE WHEN best LIKE 'live%' THEN 'associate_existing_live_artist'
        ELSE 'attach_existing_candidate' END WHEN e IS NOT NULL THEN 'create_new_candidate' ELSE 'create_identity_discovery_candidate' END AS action,
        CASE WHEN NOT several AND k = 1 THEN best ELSE 'candidate|candidate:' || id END AS target FROM fixed WHERE head),
    later AS (SELECT f.id, f.key, f.day, target, several OR k > 1 OR (k = 1 AND best <> target) AS breaks FROM fixed f JOIN first USING (key) WHERE NOT head),
    lost AS (SELECT *, bool_or(breaks) OVER (PARTITION BY key ORDER BY day, id) AS gone FROM later),
    every AS (SELECT id, action, target FROM first UNION ALL SELECT id, CASE WHEN gone THEN 'route_ambiguous_exact_convergence_to_review' WHEN target LIKE 'live%' THEN 'associate_existing_live_artist'
        ELSE 'attach_existing_candidate' END, CASE WHEN gone THEN 'candidate|candidate:' || id ELSE target END FROM lost
        UNION ALL SELECT id, 'idempotent_existing_occurrence', 'candidate|' || target FROM link)
"""


@query(f"{_CONVERGED} SELECT id AS occurrence_id, action, split_part(target, '|', 1) AS target_type, split_part(target, '|', 2) AS target_id FROM every")
def j5_converge(spark, sf_dir):
    occ = _occurrences(spark, sf_dir)
    c = read(spark, sf_dir, "customer")
    known = c.where("c_custkey % 3 = 1").select(F.concat(F.lit("old"), "c_custkey").alias("candidate_id"), F.concat(F.lit("s"), "c_custkey").alias("external_id"))
    registry = get(spark, sf_dir, "registry").where("cast(substr(external_id, 2) as int) % 3 <> 1")
    linked = occ.where("occurrence_id like '%0'").select("occurrence_id", F.lit("candidate").alias("target_type"),
        F.concat(F.lit("t"), "occurrence_id").alias("target_id"), F.concat_ws(":", "provider", "entity_type", "entity_id").alias("key"))
    return converge.converge(occ, linked, known, registry)


@query(f"""{_CONVERGED} SELECT action, count(*) AS results, count(DISTINCT target) AS targets, count(DISTINCT CASE WHEN w > 1 THEN target END) AS cross_source
    FROM (SELECT *, max(p) OVER (PARTITION BY target) AS w FROM (SELECT *, dense_rank() OVER (PARTITION BY target ORDER BY CASE WHEN cast(id[2:] AS int) % 2 = 0 THEN 'a' ELSE 'b' END) AS p FROM every)) GROUP BY 1""")
def a16_actions_of_convergence(spark, sf_dir):
    """What the actions of a batch come to: their names are those that convergence gives."""
    routed = j5_converge(spark, sf_dir)
    source = F.when(F.substring("occurrence_id", 2, 20).cast("long") % 2 == 0, "a").otherwise("b")
    return metrics.action_metrics(routed.select(source.alias("provider"), "action", F.concat_ws("|", "target_type", "target_id").alias("target_id")))


@query()
def l5_intake(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.lit("manual").alias("source_type"), F.col("source").alias("source_name"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_record_id"), F.col("lang").alias("name"),
            F.concat(F.lit("s"), (F.col("doc_id") % 997).cast("string")).alias("external_id"), F.lit(None).cast("string").alias("asserted_id"),
                F.timestamp_seconds("doc_id").alias("discovered_at"))
    none = spark.createDataFrame([], "discovery_id string")
    return converge.intake(d, none, *(get(spark, sf_dir, n) for n in ("registry", "queue", "live_names"))).drop("candidate_id")


@query("SELECT l_partkey AS key, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY 1")
def s14_build_indexes(spark, sf_dir):
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("occurrence_id"), F.col("l_partkey").alias("key"),
        F.lit("candidate").alias("target_type"), F.col("l_suppkey").alias("target_id"))
    return converge.build_indexes(links)[0].select("key", F.size("targets").cast("long").alias("targets"))


@query("""WITH h AS (SELECT md5(coalesce(text, '')) AS k, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'x' END AS lang, doc_id % 5 = 0 AS old FROM documents),
    b AS (SELECT k, count(DISTINCT lang) AS n, min(lang) AS lang, max(lang) AS top FROM h GROUP BY k), o AS (SELECT DISTINCT k, lang FROM h WHERE old),
    c AS (SELECT k FROM b WHERE n > 1 UNION SELECT b.k FROM b JOIN o USING (k) JOIN h ON h.k = b.k WHERE h.lang <> o.lang)
    SELECT k, lang, false AS collision FROM b WHERE k NOT IN (SELECT k FROM o) AND k NOT IN (SELECT k FROM c) UNION ALL SELECT k, NULL, true FROM c""")
def s12_append_new(spark, sf_dir):
    """What is appended to the texts of every fifth document, and which texts come with other content."""
    lang = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("x").alias("lang")
    d = read(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("k"), lang, (F.col("doc_id") % 5 == 0).alias("old"))
    new, bad = readers.append_new(d.where("old").select("k", "lang"), d.select("k", "lang"), "k")
    return new.select("k", "lang", F.lit(False).alias("collision")).unionByName(bad.select("k", F.lit(None).cast("string").alias("lang"), F.lit(True).alias("collision")))


# Admission, cache, directory, cohorts and quality.
@query("""WITH i AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY provider ORDER BY position) = page THEN 0 ELSE 1 END AS fresh,
        creates_candidate::INT AS new FROM @items),
    s AS (SELECT *, coalesce(sum(fresh) OVER b, 0) AS pages, row_number() OVER (PARTITION BY provider ORDER BY position) - 1 AS occ,
        coalesce(sum(new) OVER b, 0) AS made, coalesce(sum(new) OVER (PARTITION BY provider,
        target_state ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE target_state WHEN 'needs_review' THEN 97
        ELSE 10 END AS queued,
        CASE target_state WHEN 'needs_review' THEN 100 ELSE 50 END AS mark, CASE provider WHEN '1-URGENT' THEN 2 ELSE 8 END AS most
        FROM i WINDOW b AS (PARTITION BY provider ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, CASE WHEN fresh = 1 AND pages >= 6 THEN 'request_budget_reached' WHEN fresh = 1 AND pages >= 2 THEN 'page_budget_reached'
        WHEN occ >= 15 THEN 'occurrence_budget_reached' WHEN creates_candidate AND made >= most THEN 'new_candidate_budget_reached'
        WHEN creates_candidate AND queued >= mark THEN 'queue_high_water_reached:' || target_state END AS stop FROM s),
    f AS (SELECT provider, min(position) AS p, arg_min(stop, position) AS why FROM t WHERE stop IS NOT NULL GROUP BY 1) SELECT provider, position,
        p IS NULL OR position < p AS admitted, why AS stop_reason FROM t LEFT JOIN f USING (provider)""")
def w6_admit_with_budget(spark, sf_dir):
    queue = spark.createDataFrame([("needs_review", 97), ("identity_pending", 10)], "state string, n long")
    return admission.admit_with_budget(get(spark, sf_dir, "items"), queue, budgets={"1-URGENT": {"new_candidates": 2}}).select("provider", "position",
        "admitted", "stop_reason")


@query("""WITH l AS (SELECT provider, operation, identifier, arg_max({'v': value, 's': status_code}, retrieved_at) AS c FROM @cache GROUP BY ALL)
        SELECT r.provider, r.identifier, CASE WHEN c IS NULL THEN 'miss' WHEN c.s = 404 THEN 'negative' WHEN c.s >= 400 THEN 'miss'
        ELSE 'hit' END AS status, CASE WHEN c IS NOT NULL AND c.s IS NULL THEN c.v END AS value FROM @requests r LEFT JOIN l USING (provider, operation,
        identifier)""")
def s10_lookup_cached(spark, sf_dir):
    return cache.lookup_cached(get(spark, sf_dir, "requests"), get(spark, sf_dir, "cache")).select("provider", "identifier", "status", "value")


@query("""SELECT provider, kind, count(*) AS rows, count(*) FILTER (CASE kind WHEN 'listing' THEN 120 WHEN 'events' THEN 12
        WHEN 'exact_identity' THEN 4320 ELSE -1 END * 3600000000 >= epoch_us(TIMESTAMP '2024-01-31') - epoch_us(retrieved_at)) AS fresh FROM @cache
        GROUP BY 1, 2""")
def s15_freshness(spark, sf_dir):
    return cache.freshness(get(spark, sf_dir, "cache"), "2024-01-31").groupBy("provider", "kind").agg(F.count("*").alias("rows"), F.count_if("fresh").alias("fresh"))


@query("""SELECT artist_id, name, genre, CASE WHEN artist_id % 2 = 0 THEN '7' ELSE tier END AS tier, CASE WHEN artist_id % 2 = 0 AND tier <> '7' THEN 1
        ELSE 0 END AS drifts FROM @customers""")
def p1_project_directory(spark, sf_dir):
    c = get(spark, sf_dir, "customers")
    df = c.select((F.col("artist_id") % 2 == 0).cast("int").alias("_v"), "*").select((F.col("_v") + 1).alias("schema_version"), "artist_id", "name",
        "genre", "tier", F.lit(None).cast("string").alias("spotify_id"), F.struct("name").alias("identity"),
            F.struct(F.col("genre").alias("genre"), F.lit("7").alias("tier")).alias("editorial"), F.lit(None).cast("map<string,string>").alias("external_ids"))
    return directory.project_directory(df).select("artist_id", "name", "genre", "tier", F.size("drift").alias("drifts"))


@query("SELECT artist_id, name FROM @customers WHERE genre = 'BUILDING' AND tier = '3'")
def p2_filter_directory(spark, sf_dir):
    return directory.filter_directory(get(spark, sf_dir, "customers"), "BUILDING", "3").select("artist_id", "name")


@query("SELECT artist_id, genre AS outcome FROM @customers WHERE genre IN ('BUILDING', 'MACHINERY') AND artist_id % 3 <> 0")
def p3_select_cohort(spark, sf_dir):
    df = get(spark, sf_dir, "customers").select("artist_id", F.col("genre").alias("outcome"), (F.col("artist_id") % 3 == 0).alias("eligible"))
    return directory.select_cohort(df, ["BUILDING", "MACHINERY"]).select("artist_id", "outcome")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY genre, tier ORDER BY artist_id) - 1 AS i, count(*) OVER (PARTITION BY genre, tier) AS n
        FROM @customers) SELECT genre, tier, artist_id FROM n WHERE i = floor(0.5 * n)""")
def w10_pick_one(spark, sf_dir):
    return directory.pick_one(get(spark, sf_dir, "customers"), ["genre", "tier"], 0.5).select("genre", "tier", "artist_id")


@query("SELECT o_custkey AS artist_id, min(o_orderkey) AS position, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 3")
def j15_resolve_saved(spark, sf_dir):
    saved = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artist_id"), F.col("o_orderkey").alias("position"))
    return directory.resolve_saved(saved, get(spark, sf_dir, "customers")).select("artist_id", "position", "name")


@query("""SELECT l.artist_id, CASE WHEN r.artist_id IS NULL THEN 'left_only' ELSE 'changed' END AS difference, CASE WHEN r.artist_id IS NULL THEN ''
        ELSE concat_ws(',', CASE WHEN l.name <> r.name THEN 'name' END, CASE WHEN l.tier <> r.tier THEN 'tier' END) END AS columns FROM @customers l
        LEFT JOIN @customers_later r USING (artist_id) WHERE r.artist_id IS NULL OR l.name <> r.name OR l.tier <> r.tier""")
def j14_parity(spark, sf_dir):
    return directory.parity(get(spark, sf_dir, "customers"), get(spark, sf_dir, "customers_later"), "artist_id", ["name", "genre", "tier"])


@query("""SELECT l.artist_id, CASE WHEN r.artist_id IS NULL THEN 'left_only' ELSE 'changed' END AS difference FROM @customers l LEFT
        JOIN @customers_later r USING (artist_id) WHERE r.artist_id IS NULL OR l.tier <> r.tier""")
def j17_preserved(spark, sf_dir):
    return directory.preserved(get(spark, sf_dir, "customers"), get(spark, sf_dir, "customers_later"), "artist_id", ["genre", "tier"]).select("artist_id", "difference")


@query("""WITH n AS (SELECT 's' || c_custkey AS external_id, c_custkey AS position FROM customer), t AS (SELECT max(cast(substr(artist_id,
        8) AS bigint)) AS top FROM @registry), k AS (SELECT n.*, r.artist_id FROM n LEFT JOIN @registry r USING (external_id)),
    f AS (SELECT *, row_number() OVER (ORDER BY position) AS i FROM k WHERE artist_id IS NULL) SELECT external_id, artist_id, false AS proposed FROM k
        WHERE artist_id IS NOT NULL UNION ALL SELECT external_id, 'artist_' || lpad(cast(top + i AS string), 6, '0'), true FROM f, t""")
def w4_propose_ids(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("external_id"), F.col("c_custkey").alias("position"))
    return cohort.propose_ids(df, get(spark, sf_dir, "registry")).select("external_id", "artist_id", "proposed")


@query("""WITH s AS (SELECT c_custkey AS key, c_name AS name, 's' || c_custkey AS external_id FROM customer) SELECT key, CASE
        WHEN key % 7 = 0 THEN 'missing_enrichment' WHEN key % 11 = 0 THEN 'drift' WHEN key % 5 = 0 THEN 'already_live'
        WHEN r.artist_id IS NOT NULL THEN 'registered' ELSE 'new' END AS status, CASE WHEN key % 7 <> 0 AND key % 11 = 0 THEN 'name'
        ELSE '' END AS drift FROM s LEFT JOIN @registry r USING (external_id)""")
def j10_reconcile_cohort(spark, sf_dir):
    s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.concat(F.lit("s"), "c_custkey").alias("external_id"))
    rich = s.where("key % 7 <> 0").withColumn("name", F.when(F.col("key") % 11 == 0, F.concat("name", F.lit("*"))).otherwise(F.col("name")))
    return cohort.reconcile_cohort(s, rich, s.where("key % 5 = 0"), get(spark, sf_dir, "registry")).select("key", "status", "drift")


@query("""SELECT r.artist_id, 'live' AS origin FROM @registry r WHERE cast(substr(external_id, 2) AS bigint) % 8 = 0 UNION ALL SELECT r.artist_id,
        'review' FROM @registry r WHERE cast(substr(external_id, 2) AS bigint) % 8 <> 0 AND cast(substr(external_id, 2) AS bigint) % 3 = 0""")
def j11_review_package(spark, sf_dir):
    reg = get(spark, sf_dir, "registry").withColumn("key", F.substring("external_id", 2, 20).cast("long"))
    reports = reg.select("key", F.when(F.col("key") % 3 == 0, "coherent_identity_evidence").otherwise("unresolved_identity").alias("outcome"))
    return cohort.review_package(reports, reg, reg, reg.where("key % 8 = 0"), ["coherent_identity_evidence"]).select("artist_id", "origin")


@query("""SELECT cast(o_orderkey AS string) AS key, 'price_positive' AS rule FROM orders WHERE NOT coalesce(o_totalprice > 1000, false) UNION ALL
        SELECT cast(o_orderkey AS string), 'status_known' FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)""")
def q1_violations(spark, sf_dir):
    return quality.violations(read(spark, sf_dir, "orders"), "o_orderkey",
        {"price_positive": F.col("o_totalprice") > 1000, "status_known": F.col("o_orderstatus").isin("F", "O")})


def _record_query(kind):
    union = " UNION ALL ".join(f"SELECT cast(k AS string) AS key, '{rule}' AS rule FROM r WHERE NOT coalesce({inputs.duck_condition(condition)}, false)" for rule, condition in records.RULES[kind].items())
    named = "*, lower(trim(raw_name)) AS computed_name" if "normalized_name" in records.RULES[kind] else "*"

    def run(spark, sf_dir):
        return records.record_violations(get(spark, sf_dir, f"record_{kind}"), kind, "k")

    run.__name__ = f"q1_{kind}"
    return query(f"WITH r AS (SELECT {named} FROM @record_{kind}) {union}")(run)


for _kind in inputs.RECORDS:
    _record_query(_kind)


@query("SELECT 'p_name' AS \"column\", p_name AS value, count(*) AS rows FROM part GROUP BY p_name HAVING count(*) > 1")
def q2_unique_violations(spark, sf_dir):
    return quality.unique_violations(read(spark, sf_dir, "part"), ["p_partkey", "p_name"])


@query("""SELECT cast(o_custkey AS string) AS value, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer
        WHERE c_custkey % 2 = 0) GROUP BY 1""")
def q2_ref_violations(spark, sf_dir):
    return quality.ref_violations(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "c_custkey")


@query("SELECT cast(doc_id AS string) AS key, 'n_chars' AS \"column\" FROM documents WHERE n_chars IS DISTINCT FROM octet_length(encode(text))")
def q3_key_drift(spark, sf_dir):
    """Counts of characters against those of bytes: texts with marks drift."""
    return quality.key_drift(read(spark, sf_dir, "documents"), "doc_id", {"n_chars": F.octet_length("text").cast("long")})


@query("""SELECT true AS unchanged, count(*) AS rows_before, count(*) AS rows_after FROM orders UNION ALL SELECT false, count(*), (SELECT count(*)
        FROM @customers_later) FROM @customers UNION ALL SELECT false, count(*), count(*) FROM customer""")
def q4_unchanged(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus")
    a, b = get(spark, sf_dir, "customers"), get(spark, sf_dir, "customers_later")
    other = a.withColumn("name", F.when(F.col("artist_id") == 7, "another").otherwise(F.col("name")))  # one row of all
    return quality.unchanged(o, o.repartition(3)).unionByName(quality.unchanged(a, b)).unionByName(quality.unchanged(a, other))


@query("""WITH h AS (SELECT sha256(to_json({'artist_id': artist_id, 'genre': genre, 'name': name, 'tier': tier})::VARCHAR) AS h FROM @customers),
        p AS (SELECT list_transform(range(0, 4), lambda k: ('0x' || substr(h, 1 + 8 * k::INT, 8))::UBIGINT) AS p FROM h),
    s AS (SELECT count(*) AS rows, sum(p[1])::VARCHAR AS a, sum(p[2])::VARCHAR AS b, sum(p[3])::VARCHAR AS c, sum(p[4])::VARCHAR AS d FROM p)
        SELECT rows, 'sha256:' || sha256(concat_ws('|', rows, a, b, c, d)) AS digest FROM s""")
def a17_table_digest(spark, sf_dir):
    return quality.table_digest(get(spark, sf_dir, "customers")).select("rows", "digest")


@query("""SELECT artist_id, name, tier, 'left' AS side FROM @customers EXCEPT ALL SELECT artist_id, name, tier, 'left' FROM @customers_later
        UNION ALL (SELECT artist_id, name, tier, 'right' FROM @customers_later EXCEPT ALL SELECT artist_id, name, tier, 'right' FROM @customers)""")
def u4_multiset_difference(spark, sf_dir):
    cols = ["artist_id", "name", "tier"]
    return quality.multiset_difference(get(spark, sf_dir, "customers").select(*cols), get(spark, sf_dir, "customers_later").select(*cols))


@query("""SELECT artist_id, l.name, l.tier FROM @customers_later l UNION ALL SELECT artist_id, name, tier FROM @customers WHERE artist_id NOT IN (SELECT artist_id FROM @customers_later)
    UNION ALL SELECT -1 - s_suppkey::BIGINT, s_name, cast(s_nationkey AS string) FROM supplier""")
def u1_union_unique(spark, sf_dir):
    cols = ["artist_id", "name", "tier"]
    supplier = read(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("artist_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("tier"))
    later, now = get(spark, sf_dir, "customers_later").select(*cols), get(spark, sf_dir, "customers").select(*cols)
    return quality.union_unique([later, now, supplier.unionByName(supplier)], ["artist_id"])


# Pages.
@query("""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*href=\"([^\"]*)\"[^>]*>[^<]*</a>', 1) AS h FROM pages) SELECT page_id,
        unnest(range(0, len(h))) AS position, unnest(h) AS href FROM a""")
def s2_page_links(spark, sf_dir):
    return html.extract_links(read(spark, sf_dir, "pages")).select("page_id", "position", "href")


@query("""WITH t AS (SELECT p_size AS page_id, p_name, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS row FROM part)
    SELECT page_id, row, p_name || ' & co' AS artist, cast(p_partkey AS string) AS listeners, NULL::VARCHAR AS error FROM t WHERE page_id % 3 <> 0
        UNION ALL SELECT DISTINCT page_id, NULL, NULL, NULL, 'no_table_with_required_headers' FROM t WHERE page_id % 3 = 0 UNION ALL
        SELECT DISTINCT -page_id, NULL, NULL, NULL, 'no_table_with_required_headers' FROM pages""")
def s2_html_table(spark, sf_dir):
    cells = lambda tag, *x: F.concat(F.lit(f"<tr><{tag}>"), x[0], F.lit(f"</{tag}>\n <{tag}>"), x[1], F.lit(f"</{tag}></tr>"))
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey",
        "p_name"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: cells("td class='c'", F.concat(F.lit("<b>"), x["p_name"], F.lit("</b> &amp; co")),
        x["p_partkey"].cast("string"))), "").alias("body")
    body = rows.select("page_id", F.regexp_replace(body, "</td class='c'>", "</td>").alias("body"))
    head = cells("th", F.when(F.col("page_id") % 3 == 0, "Other").otherwise("Artist"), F.lit("Listeners"))
    made = body.select("page_id", F.concat(F.lit("<html><table><tr><td>x</td></tr></table><TABLE id='t'>"), head, "body", F.lit("</TABLE></html>")).alias("html"))
    pages = made.unionByName(read(spark, sf_dir, "pages").select((-F.col("page_id")).cast("long").alias("page_id"), "html"))
    out = html.extract_html_table(pages, ["Artist", "Listeners"])
    return out.select("page_id", "row", F.try_element_at("cells", F.lit("Artist")).alias("artist"),
        F.try_element_at("cells", F.lit("Listeners")).alias("listeners"), "error")


# Streams, over what is there now.
def _stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark) -> str:
    """A new folder where driver and executors both see it."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


_TYPES = {"view": "artist_impression", "click": "spotify_clicked", "purchase": "artist_saved", "signup": "roll_again"}


@query(f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, cast(user_id AS string) AS artist_id,
        CASE event_type {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in _TYPES.items())} END AS type, count(*) AS events FROM events
        WHERE event_type <> 'error' GROUP BY ALL""")
def t6_behaviour_counts(spark, sf_dir):
    types = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    e = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("artist_id"),
        F.coalesce(types[F.col("event_type")], F.lit("crash")).alias("type"))
    out = streams.run_now(streams.behaviour_counts(e, id_pattern="[0-9]+"), ["day", "artist_id", "type"], _folder(spark))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "artist_id", "type", "events")


@query("SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS start, event_type AS state, count(*) AS events FROM events GROUP BY ALL")
def t7_period_counts(spark, sf_dir):
    e = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("occurred_at"), F.col("event_type").alias("next_state"))
    out = streams.run_now(streams.period_counts(e), ["start", "state"], _folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "state", "events")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
        SELECT cast(user_id AS string) AS candidate_id, max(n) AS revision, arg_max(event_type, n) AS state FROM r GROUP BY 1""")
def t1_candidate_states(spark, sf_dir):
    from pyspark.sql import Window

    folder = _folder(spark)
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("candidate_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("candidate_revision"), F.col("event_type").alias("next_state"))
    e.repartition(4, F.rand(1)).write.parquet(f"{folder}/in")
    log = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    return streams.run_now(streams.candidate_states(log), ["candidate_id"], folder)


# Sources, over files and nested rows that Spark derives from the tables.
@query("SELECT cast(p_partkey AS bigint) AS rank, p_name AS name, cast(round(p_retailprice) AS bigint) AS value, true AS row_in_place FROM part")
def s1_ranking_csv(spark, sf_dir):
    from pyspark.sql import Window

    path = f"{_folder(spark)}/ranking"
    part = read(spark, sf_dir, "part").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    part.select(F.col("p_partkey").alias("Ranking"), F.col("p_name").alias("Artist"),
        F.format_number(F.round("p_retailprice"), 0).alias("Listeners")).write.csv(path, header=True, quoteAll=True)
    first = F.min("rank").over(Window.partitionBy("file"))  # a file has a range of ranks
    return readers.read_ranking_csv(spark, path).select("rank", "name", "value", (F.col("source_row") == F.col("rank") - first + 1).alias("row_in_place"))


@query("SELECT cast(c_custkey AS string) AS source_record_id, c_name AS raw_name FROM customer WHERE c_custkey % 5 <> 0")
def s3_discoveries(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    raw = c.select(F.lit("chart").alias("sourceType"), F.lit("n").alias("sourceName"), F.col("c_custkey").cast("string").alias("sourceRecordId"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("rawArtistName"), F.lit("2026-01-01T00:00:00Z").alias("discoveredAt"))
    good = readers.normalise_discoveries(raw).where(F.size("faults") == 0)
    return good.select("source_record_id", "raw_name")


@query("""SELECT 'o' || l_orderkey || ':' || l_suppkey AS record_id, cast(l_suppkey AS string) AS entity_id, 'o' || l_orderkey AS parent_id
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)""")
def s4_flatten_listing(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("s")).distinct()
    albums = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("id"), F.col("s").alias("name")))).alias("artists"))
    key = F.concat(F.lit("o"), "l_orderkey")
    pages = albums.select(key.alias("ref"), F.array(F.struct(key.alias("id"), key.alias("name"), "artists")).alias("albums"))
    return listings.flatten_listing(pages, "albums").select("record_id", "entity_id", "parent_id")


@query("""SELECT cast(o_orderkey AS string) AS event_id, cast(l_suppkey AS string) AS attraction_id, cast(l_suppkey AS string) AS legacy_id,
        c_name AS venue, cast(c_nationkey AS double) AS latitude FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
        JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def s5_flatten_events(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("s")).distinct()
    acts = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("id"), F.col("s").alias("name"),
        F.concat(F.lit("https://x/artist/"), "s").alias("url")))).alias("attractions"))
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(acts,
        F.col("o_orderkey") == F.col("l_orderkey"))
    venue = F.struct(F.col("c_name").alias("name"), F.lit("c").alias("city"), F.lit("x").alias("country"),
        F.col("c_nationkey").cast("string").alias("latitude"), F.lit("bad").alias("longitude"))
    event = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("date_time"),
        F.lit("2026-01-01").alias("local_date"), F.array(venue).alias("venues"), "attractions")
    return listings.flatten_events(o.select(F.lit("r").alias("ref"), F.array(event).alias("events"))).select("event_id", "attraction_id",
        F.element_at("legacy_ids", 1).alias("legacy_id"), "venue", "latitude")


@query("""SELECT p_brand AS id, arg_max('u' || p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN 1000000000000
        ELSE 0 END) + p_size * 10000000::BIGINT + p_partkey) AS image_url, count(*) AS upcoming FROM part GROUP BY 1""")
def s6_attractions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    image = F.struct(F.when(k % 2 == 0, "16_9").otherwise("4_3").alias("ratio"), F.concat(F.lit("u"), k.cast("string")).alias("url"),
        (F.col("p_size") * 10_000_000 + k).cast("int").alias("width"))
    df = p.groupBy(F.col("p_brand").alias("id")).agg(F.collect_list(image).alias("images"), F.count("*").alias("n"))
    df = df.select("id", F.lit("n").alias("name"), "images", F.array(F.struct(F.lit(True).alias("is_primary"), F.lit("s").alias("segment"),
        F.lit("g").alias("genre"))).alias("classifications"), F.create_map(F.lit("_total"), "n").alias("upcoming"))
    return listings.normalise_attractions(df).select("id", "image_url", "upcoming")


@query("""SELECT l_orderkey AS lookup, count(DISTINCT l_suppkey) AS entities, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 200 ELSE 409 END AS status,
        count(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1""")
def s7_collapse_bindings(spark, sf_dir):
    rows_ = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lookup"), F.col("l_suppkey").alias("qid"),
        F.col("l_partkey").alias("external_id"), F.concat("l_returnflag", F.lit("Rank")).alias("rank"))
    return listings.collapse_bindings(rows_).select("lookup", "entities", "status", F.size("external_ids").cast("long").alias("ids"))


@query("SELECT 'https://x/' || l_suppkey AS url, cast(l_orderkey AS string) AS id FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)")
def s8_url_relations(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    df = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("official").alias("type"),
        F.concat(F.lit("https://x/"), "l_suppkey").alias("url"))).alias("relations"))
    return listings.url_relations(df.select(F.col("l_orderkey").alias("position"), F.col("l_orderkey").cast("string").alias("id"),
        F.lit("n").alias("name"), "relations")).select("url", "id")


@query("SELECT cast(p_size AS string) AS id, count(DISTINCT p_name) AS aliases FROM part GROUP BY 1")
def s9_discography(spark, sf_dir):
    p = read(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_list(F.struct(F.col("p_name").alias("name"))).alias("aliases"))
    df = p.select(F.col("p_size").alias("id"), F.lit("n").alias("name"), F.lit(" ").alias("realname"), F.array(F.lit("")).alias("urls"), "aliases",
        F.array().cast("array<string>").alias("namevariations"))
    return listings.normalise_discography(df).select("id", F.size("aliases").cast("long").alias("aliases"))


@query("""SELECT 'occurrences' AS kind, cast(p_partkey AS string) AS id, p_brand AS owner, p_name AS detail, cast(NULL AS bigint) AS number FROM part
        UNION ALL SELECT 'associations', cast(o_orderkey AS string), cast(o_custkey AS string), 'candidate', NULL FROM orders
    UNION ALL SELECT 'events', cast(event_id AS string), cast(user_id AS string), event_type, event_id % 9 FROM events UNION ALL SELECT 'runs',
        cast(s_suppkey AS string), 'running', NULL, s_nationkey FROM supplier
    UNION ALL SELECT 'checkpoints', cast(c_custkey AS string), c_mktsegment, 'spotify', c_nationkey FROM customer UNION ALL SELECT 'evidence',
        cast(n_nationkey AS string), n_name, 'reviewed', NULL FROM nation""")
def s11_event_lake(spark, sf_dir):
    root = f"{_folder(spark)}/lake"
    t = lambda name: read(spark, sf_dir, name)
    text = lambda c: F.col(c).cast("string")
    made = {
        "occurrences": t("part").select(text("p_partkey").alias("occurrenceId"), F.col("p_brand").alias("provider"),
            F.struct(F.col("p_name").alias("rawName")).alias("artist")),
        "associations": t("orders").select(text("o_orderkey").alias("associationId"), F.lit("candidate").alias("targetType"), text("o_custkey").alias("targetId")),
        "events": t("events").select(text("event_id").alias("eventId"), text("user_id").alias("candidateId"), F.col("event_type").alias("eventType"),
            (F.col("event_id") % 9).alias("candidateRevision")),
        "runs": t("supplier").select(text("s_suppkey").alias("runId"), F.struct(F.lit("running").alias("status")).alias("control"),
            F.col("s_nationkey").alias("revision")),
        "checkpoints": t("customer").select(text("c_custkey").alias("checkpointId"), F.col("c_mktsegment").alias("sourceName"),
            F.lit("spotify").alias("provider"), F.struct(F.col("c_nationkey").alias("page")).alias("position")),
        "evidence": t("nation").select(text("n_nationkey").alias("evidenceId"), F.col("n_name").alias("sourceClass"), F.lit("reviewed").alias("reviewStatus")),
    }
    for kind, df in made.items():
        df.write.json(f"{root}/{kind}")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    got = {kind: readers.read_artifacts(spark, root, kind, multi_line=False) for kind in made}
    out = [
        got["occurrences"].select("occurrence_id", "provider", "raw_name", number),
            got["associations"].select("association_id", "target_id", "target_type", number),
                got["events"].select("event_id", "candidate_id", "event_type", "candidate_revision"),
        got["runs"].select("run_id", "status", none, "revision"), got["checkpoints"].select("checkpoint_id", "source_name", "provider", "page"),
            got["evidence"].select("evidence_id", "source_class", "review_status", number),
    ]
    out = [df.toDF("id", "owner", "detail", "number").select(F.lit(kind).alias("kind"), "*") for kind,
        df in zip(("occurrences", "associations", "events", "runs", "checkpoints", "evidence"), out, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4]).unionByName(out[5])


@query("""SELECT p_partkey AS id, p_name AS name, 'snapshot-1' AS snapshot_id, 'part' AS source, p_partkey % 10 = 0 AS blank, count(*) OVER () AS rows,
        count(*) FILTER (p_partkey % 10 = 0) OVER () AS blank_names, 0::BIGINT AS repeated_ids FROM (SELECT p_partkey, CASE
        WHEN p_partkey % 10 <> 0 THEN p_name END AS p_name FROM part)""")
def s13_snapshot(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("name"))
    path = f"{_folder(spark)}/snapshots"
    about = readers.build_snapshot(p, "snapshot-1", path, "part", "id")
    kept = spark.read.parquet(path)
    # the records carry the digest of what they were made of
    return kept.join(F.broadcast(about.select("snapshot_id", F.col("digest").alias("input_digest"), "rows", "blank_names", "repeated_ids")),
        ["snapshot_id", "input_digest"]).select("id", "name", "snapshot_id", "source", F.col("name").isNull().alias("blank"), "rows", "blank_names", "repeated_ids")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'")
def p5_in_period(spark, sf_dir):
    return metrics.in_period(read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp")), "t", START, END).select("event_id")


@query("SELECT event_id, 'https://x/?api_key=REDACTED&k=' || user_id AS url, 'REDACTED' AS secret FROM events")
def p6_redact_logs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://x/?api_key="), "event_id", F.lit("&k="), "user_id").alias("url"),
        F.create_map(F.lit("client_secret"), F.col("event_id").cast("string")).alias("m"))
    return quality.redact_logs(e, ["url"], ["m"]).select("event_id", "url", F.element_at("m", "client_secret").alias("secret"))


@query("""SELECT d.c_mktsegment AS outcome, count(c.c_custkey) AS rows FROM (SELECT unnest(['BUILDING', 'NONE']) AS c_mktsegment) d LEFT
        JOIN customer c USING (c_mktsegment) GROUP BY 1""")
def p7_zero_fill(spark, sf_dir):
    counts = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("outcome")).agg(F.count("*").alias("rows"))
    return ranking.zero_fill(counts, spark.createDataFrame([("BUILDING",), ("NONE",)], "outcome string"), "outcome", "rows")


@query(f"""{_METRICS}, e AS (SELECT 'n' || c_custkey AS name, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END AS artist_id FROM customer) SELECT name,
        momentum_score, CASE WHEN e.artist_id IS NULL THEN 'missing_identity' WHEN s.artist_id IS NULL THEN 'empty_catalog' END AS error FROM e LEFT
        JOIN s ON s.artist_id = e.artist_id""")
def j16_enrich_catalog(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_custkey").alias("name"), F.col("c_custkey").cast("long").alias("artist_id"))
    return catalog.enrich_catalog(c.select("name"), c.where("artist_id % 6 <> 0"), get(spark, sf_dir, "releases"), NOW).select("name", "momentum_score", "error")


@query("""SELECT c_custkey AS id, (c_custkey % 3) || ' conflicts; ' || (c_custkey % 5) || ' evidence references' AS evidence_text, CASE
        WHEN c_custkey % 2 = 0 THEN 'Same name: x' || c_custkey || ', y' END AS same_name_note, CASE
        WHEN c_custkey % 4 >= 2 THEN 'Profiles: ' || array_to_string(list_transform(range(1, c_custkey % 4 + 1), lambda i: 'p' || i), ', ') END AS multiplicity_note
        FROM customer""")
def e13_evidence_notes(spark, sf_dir):
    k = F.col("c_custkey")
    some = lambda n, c: F.transform(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.concat(F.lit(c), i))
    c = read(spark, sf_dir, "customer").select(k.alias("id"), some(k % 3, "c").alias("conflicts"), some(k % 5, "e").alias("evidence_refs"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("x"), k), F.lit("y"))).alias("competitor_ids"), some(k % 4, "p").alias("profile_ids"))
    return cohort.evidence_notes(c).select("id", "evidence_text", "same_name_note", "multiplicity_note")


@query("SELECT cast(s_suppkey AS string) AS entity_id, lower(s_name) AS name_key FROM supplier WHERE s_suppkey % 4 <> 0")
def x1_adapter(spark, sf_dir):
    k = F.col("s_suppkey")
    adapters.register("supplier_list", "suppliers", "v1", lambda raw: raw.select(F.when(k % 4 != 0,
        "suppliers").otherwise("others").alias("provider"), F.lit("chart").alias("source_type"), F.lit("n").alias("source_name"),
            k.cast("string").alias("source_record_id"), F.col("s_name").alias("raw_name"), F.lit("artist").alias("entity_type"),
                k.cast("string").alias("entity_id"), F.lit("2026-01-01").cast("timestamp").alias("discovered_at")))
    return adapters.occurrences("supplier_list", read(spark, sf_dir, "supplier"))[0].select("entity_id", "name_key")


@query("""WITH e AS (SELECT cast(user_id AS string) AS occurrence_id, event_type AS label, ts FROM events), f AS (SELECT occurrence_id, arg_min(label, ts) AS first FROM e GROUP BY 1)
    SELECT occurrence_id, first AS label, false AS collision FROM f UNION ALL SELECT DISTINCT occurrence_id, label, true FROM e JOIN f USING (occurrence_id) WHERE label <> first""")
def t2_ingest(spark, sf_dir):
    folder = _folder(spark)
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("occurrence_id"), F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("discovered_at"))
    for _ in range(2):  # the second run finds nothing new
        streams.ingest(e, folder, f"{folder}/checkpoint").awaitTermination()
    kinds = {"table": False, "collisions": True}
    found = [spark.read.parquet(f"{folder}/{k}").select("occurrence_id", "label", F.lit(v).alias("collision")) for k, v in kinds.items()]
    return found[0].unionByName(found[1])


@query("""WITH RECURSIVE f AS (SELECT candidate_id, epoch_us(occurred_at) AS t, coalesce(cast(retry_after AS double), 0.0) AS wait, row_number() OVER (PARTITION BY candidate_id
        ORDER BY occurred_at, coalesce(cast(retry_after AS double), 0.0)) AS n FROM @failures),
    r AS (SELECT candidate_id, n, t, wait, t AS first, 1 AS attempt, n AS head FROM f WHERE n = 1 UNION ALL SELECT candidate_id, n, t, wait, CASE WHEN old THEN first ELSE t END,
        CASE WHEN old THEN attempt + 1 ELSE 1 END, CASE WHEN old THEN head ELSE n END FROM (SELECT f.*, r.first, r.attempt, r.head, f.t - r.first < 72 * 3600000000 AS old FROM r
        JOIN f ON f.candidate_id = r.candidate_id AND f.n = r.n + 1)),
    d AS (SELECT *, first + 72 * 3600000000 AS until, CASE WHEN attempt <= 3 THEN t + cast(round(1000000 * greatest(CASE attempt WHEN 1 THEN 900.0 WHEN 2 THEN 7200.0 ELSE 86400.0 END,
        wait)) AS bigint) END AS due, coalesce(lead(t) OVER (PARTITION BY candidate_id ORDER BY n), 9000000000000000) AS later FROM r),
    m AS (SELECT (max(t) // 1000 - 2 * 86400000) * 1000 AS mark FROM f)
    SELECT candidate_id, 'failure' AS kind, attempt, t AS at, due, CASE WHEN attempt > 3 THEN 'retry_attempts_exhausted' END AS exhausted FROM d
    UNION ALL SELECT candidate_id, 'due', attempt, due, NULL, NULL FROM d, m WHERE due < until AND due <= later AND (due <= mark OR later < 9000000000000000)
    UNION ALL SELECT candidate_id, 'ended', attempt, until, NULL, 'retry_elapsed_time_exhausted' FROM d, m WHERE later >= until AND (until <= mark OR later < 9000000000000000)""")
def t3_retry_timers(spark, sf_dir):
    e = _stream(spark, sf_dir).where("event_type = 'error'")
    wait = F.when(F.col("event_id") % 5 == 0, F.floor(F.col("value") * 100).cast("double"))
    e = e.select(F.col("user_id").cast("string").alias("candidate_id"), F.col("ts").cast("timestamp").alias("occurred_at"), wait.alias("retry_after"))
    out = streams.run_now(streams.retry_timers(e), ["candidate_id", "kind", "attempt", "at"], _folder(spark), "append")
    return out.select("candidate_id", "kind", "attempt", F.unix_micros("at").alias("at"), F.unix_micros("due_at").alias("due"), "exhausted")


@query("""WITH l AS (SELECT cast(user_id AS string) AS item, max(ts) AS last, arg_max(event_type, ts) AS state FROM events GROUP BY 1),
        m AS (SELECT max(ts) AS top FROM events)
    SELECT item, epoch_us(last) // 1000 AS since FROM l, m WHERE state = 'click' AND epoch_us(last) // 1000 + 300000 < epoch_us(top) // 1000 - 3600000""")
def t4_stalled_work(spark, sf_dir):
    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("item"), F.col("event_type").alias("state"),
        F.col("ts").cast("timestamp").alias("occurred_at"))
    return streams.run_now(streams.stalled_work(e, ("click",), 5, "1 hour"), ["item"], _folder(spark), "append").select("item", F.unix_millis("since").alias("since"))


@query(f"""{_BREAKER} SELECT provider, arg_max(state, n) AS state, cast(arg_max(failures, n) AS bigint) AS failures, nullif(arg_max(coalesce(probe, -1),
        n), -1) AS next_probe_at FROM b GROUP BY 1""")
def t5_breaker_states(spark, sf_dir):
    return streams.run_now(streams.breaker_states(_lane_calls(_stream(spark, sf_dir))), ["provider"], _folder(spark))
