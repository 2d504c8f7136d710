"""Queries of daily and weekly summaries, status, queue index and parity of picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import converge, directory, lifecycle, metrics, positions
from ..streaming import streams
from .inputs import INPUTS, get, read
from .registry import query

START, END = "2024-01-08", "2024-01-15"
_STATES = ("identity_resolving", "identity_discovering", "needs_review", "identity_coherent", "retry_wait", "failed_match", "conflicting_identity", "identity_pending")
_STATE = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"
#: A user's events as the log of a worker: states by turns, outcomes, evidence, and a fifth of candidates from event listings.
INPUTS["worker_log"] = f"""SELECT candidate_id, candidate_revision, CASE WHEN candidate_revision = 1 THEN 'candidate_discovered' WHEN event_id % 13 = 0 THEN 'candidate_identifier_attached'
        WHEN event_id % 11 = 0 THEN 'discovery_attached' ELSE 'state_transition' END AS event_type, previous_state, next_state,
        CASE WHEN event_id % 43 = 0 THEN 'retry_budget_exhausted' WHEN event_id % 41 = 0 THEN 'bridge_not_found' ELSE 'routed' END AS reason_code, occurred_at,
        CASE WHEN candidate_revision = 1 AND event_id % 5 < 2 THEN 'ticketmaster_event' WHEN candidate_revision = 1 THEN 'playlist' END AS source_type,
        CASE WHEN previous_state = 'identity_resolving' AND event_id % 3 = 0 THEN 'coherent_identity_evidence' WHEN previous_state = 'identity_resolving' AND event_id % 3 = 1
            THEN 'semantic_identity_conflict' END AS identity_outcome, CASE WHEN previous_state = 'identity_discovering' THEN concat('bridge', cast(event_id % 2 AS string)) END AS bridge_outcome,
        concat('ref', cast(event_id % 4 AS string)) AS ref, concat('s', cast(event_id % 50 AS string)) AS external_id FROM (SELECT *, lag(next_state) OVER (PARTITION BY candidate_id
            ORDER BY candidate_revision) AS previous_state FROM (SELECT event_id, cast(user_id AS string) AS candidate_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint)
            AS candidate_revision, cast(ts AS timestamp) AS occurred_at, {_STATE} AS next_state FROM {{events}}))"""


def _log(spark, sf_dir):
    return get(spark, sf_dir, "worker_log").withColumn("evidence_refs", F.array("ref"))


_PERIOD = f"occurred_at >= TIMESTAMP '{START}' AND occurred_at < TIMESTAMP '{END}'"
_COUNTS = """count(*) FILTER (m AND next_state = 'identity_resolving') AS selections, count(*) FILTER (m AND next_state = 'identity_discovering') AS bridge_selections,
    count(*) FILTER (m AND previous_state = 'identity_resolving' AND next_state = 'identity_coherent') AS coherent,
    count(*) FILTER (m AND previous_state = 'identity_resolving' AND next_state = 'failed_match') AS failed,
    count(*) FILTER (m AND previous_state IN ('identity_resolving', 'identity_discovering') AND next_state IN ('needs_review', 'conflicting_identity')) AS review,
    count(*) FILTER (m AND next_state = 'retry_wait') AS entries, count(*) FILTER (m AND previous_state = 'retry_wait' AND next_state <> 'needs_review') AS recoveries,
    count(*) FILTER (reason_code = 'retry_budget_exhausted') AS exhaustions, count(DISTINCT CASE WHEN (m AND next_state = 'retry_wait') OR (m AND previous_state = 'retry_wait'
        AND next_state <> 'needs_review') OR reason_code = 'retry_budget_exhausted' THEN candidate_id END) AS retried,
    count(*) FILTER (event_type = 'candidate_identifier_attached' AND candidate_id IN (SELECT candidate_id FROM @worker_log WHERE source_type = 'ticketmaster_event')) AS bridges"""


@query(f"""SELECT selections AS identity_selections, bridge_selections, coherent, failed AS failed_match, review, entries AS retry_entries, recoveries AS retry_recoveries,
    exhaustions AS retry_exhaustions, retried AS retry_candidates, bridges AS exact_bridges FROM (SELECT {_COUNTS} FROM (SELECT *, event_type = 'state_transition' AS m FROM @worker_log WHERE {_PERIOD}))""")
def a13_worker_metrics(spark, sf_dir):
    return metrics.worker_metrics(_log(spark, sf_dir), START, END)


@query(f"""WITH e AS (SELECT * FROM @worker_log WHERE {_PERIOD}), m AS (SELECT * FROM e WHERE event_type = 'state_transition')
    SELECT 'identity' AS worker, 'by_state' AS item, next_state AS name, count(*) AS n FROM m WHERE previous_state = 'identity_resolving' GROUP BY 3
    UNION ALL SELECT 'identity', 'by_outcome', identity_outcome, count(*) FROM m WHERE previous_state = 'identity_resolving' AND identity_outcome IS NOT NULL GROUP BY 3
    UNION ALL SELECT 'bridge', 'by_state', next_state, count(*) FROM m WHERE previous_state = 'identity_discovering' GROUP BY 3
    UNION ALL SELECT 'bridge', 'by_outcome', bridge_outcome, count(*) FROM m WHERE previous_state = 'identity_discovering' AND bridge_outcome IS NOT NULL GROUP BY 3
    UNION ALL SELECT 'all', 'newly_entered', next_state, count(DISTINCT candidate_id) FROM e WHERE next_state IN ('needs_review', 'conflicting_identity', 'failed_match', 'retry_wait') GROUP BY 3""")
def a13_outcome_counts(spark, sf_dir):
    return metrics.outcome_counts(_log(spark, sf_dir), START, END)


_ACTION = "CASE o_orderkey % 5 WHEN 0 THEN 'create_new_candidate' WHEN 1 THEN 'create_identity_discovery_candidate' WHEN 2 THEN 'attach_existing_candidate' WHEN 3 THEN 'associate_existing_live_artist' ELSE 'other' END"
# an order is what convergence recorded, on one of the first ten days; later days have no record
INPUTS["actions"] = f"SELECT {_ACTION} AS action, date_add(cast('2024-01-01' AS date), cast(o_orderkey % 10 AS int)) AS day FROM {{orders}}"


@query(f"""WITH e AS (SELECT *, strftime(occurred_at, '%Y-%m-%d') AS day, event_type = 'state_transition' AS m FROM @worker_log),
    a AS (SELECT day, count(*) FILTER (event_type = 'candidate_discovered') AS found, count(*) FILTER (event_type = 'discovery_attached') AS attached,
        count(*) FILTER (event_type <> 'state_transition') AS occurrences, count(*) FILTER (event_type <> 'state_transition' AND cast(candidate_id AS bigint) % 4 = 0) AS known, {_COUNTS} FROM e GROUP BY 1),
    s AS (SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (action LIKE 'create%') AS said_new, count(*) FILTER (action LIKE 'attach%') AS said_attached,
        count(*) FILTER (action LIKE 'associate%') AS said_known FROM (SELECT action, DATE '2024-01-01' + CAST(o_orderkey % 10 AS INT) AS day FROM (SELECT o_orderkey, {_ACTION} AS action FROM orders)) GROUP BY 1),
    l AS (SELECT candidate_id, arg_min(occurred_at, candidate_revision) AS born, arg_min(occurred_at, candidate_revision) FILTER (m AND next_state IN ('identity_coherent', 'needs_review',
        'conflicting_identity', 'failed_match')) AS done FROM e GROUP BY 1),
    h AS (SELECT strftime(done, '%Y-%m-%d') AS day, round(median((epoch_us(done) - epoch_us(born)) / 3600000000.0), 4) AS median_hours FROM l WHERE done IS NOT NULL GROUP BY 1),
    j AS (SELECT coalesce(a.day, s.day) AS day, coalesce(occurrences, 0) AS occurrences, coalesce(said_new, found, 0) AS new_candidates, coalesce(said_attached, attached, 0) AS attachments,
        coalesce(said_known, known, 0) AS rediscoveries, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('selections', 'bridge_selections', 'coherent', 'review', 'failed', 'bridges', 'recoveries', 'exhaustions', 'retried'))}
        FROM a FULL JOIN s ON a.day = s.day)
    SELECT j.*, round(new_candidates / nullif(occurrences, 0), 4) AS discovery_yield, round(rediscoveries / nullif(occurrences, 0), 4) AS rediscovery_rate,
        round((rediscoveries + attachments) / nullif(occurrences, 0), 4) AS duplicate_prevention_rate, round(coherent / nullif(selections, 0), 4) AS coherent_rate,
        round(review / nullif(selections + bridge_selections, 0), 4) AS review_rate, round(failed / nullif(selections, 0), 4) AS failed_match_rate,
        round(bridges / nullif(bridge_selections, 0), 4) AS exact_bridge_rate, round(recoveries / nullif(retried, 0), 4) AS retry_recovery_rate,
        round(exhaustions / nullif(retried, 0), 4) AS retry_exhaustion_rate, median_hours FROM j LEFT JOIN h ON h.day = j.day""")
def a14_daily_summary(spark, sf_dir):
    log = _log(spark, sf_dir)
    found = log.where("event_type <> 'state_transition'")
    kind = F.when(F.col("candidate_id").cast("long") % 4 == 0, "live_artist").otherwise("candidate")
    actions = get(spark, sf_dir, "actions").select("action", F.col("day").cast("timestamp").alias("created_at"))
    linked = found.select(kind.alias("target_type"), F.col("occurred_at").alias("created_at"))
    return metrics.daily_summary(log, found.select(F.col("occurred_at").alias("discovered_at")), linked, actions)


_NOW = """WITH c AS (SELECT candidate_id, arg_max(next_state, candidate_revision) AS state, min(occurred_at) AS created_at, arg_max(identity_outcome, candidate_revision)
        FILTER (identity_outcome IS NOT NULL) AS outcome, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs, count(DISTINCT ref) AS n_refs, bool_or(reason_code = 'retry_budget_exhausted') AS spent,
        bool_or(reason_code = 'bridge_not_found') AS missing, string_agg(DISTINCT external_id, ',' ORDER BY external_id) AS xs FROM @worker_log GROUP BY 1)"""


def _now(log):
    last = log.groupBy("candidate_id").agg(
        F.max_by("next_state", "candidate_revision").alias("state"), F.min("occurred_at").alias("created_at"),
        F.max_by("identity_outcome", F.when(F.col("identity_outcome").isNotNull(), F.col("candidate_revision"))).alias("outcome"), F.max("external_id").alias("external_id"),
    )
    same = F.when(F.col("candidate_id").cast("long") % 7 == 0, 1)
    few = F.when(F.col("candidate_id").cast("long") % 3 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return last.withColumn("same_name", same).withColumn("stage", F.lit(None).cast("string")).withColumn("conflicts", few)


@query(f"""{_NOW} SELECT CASE WHEN spent THEN 'retry_budget_exhausted' WHEN outcome = 'semantic_identity_conflict' OR state = 'conflicting_identity' THEN 'semantic_identity_conflict'
        WHEN cast(candidate_id AS bigint) % 7 = 0 THEN 'same_name_ambiguity' WHEN missing THEN 'missing_exact_bridge' WHEN state = 'identity_coherent' THEN 'editorial_input_missing'
        ELSE 'unresolved_identifiers' END AS blocker, candidate_id, state, outcome, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 3600000000.0, 4) AS age_hours, refs AS evidence_refs,
    CASE WHEN cast(candidate_id AS bigint) % 3 = 0 THEN '1 conflict(s); ' || n_refs || ' evidence reference(s).' ELSE n_refs || ' evidence reference(s); outcome ' || coalesce(outcome, 'null') || '.' END
        AS summary, 'spotify=' || xs AS ids, p.first AS provenance FROM c JOIN (SELECT candidate_id, string_agg(source_type || '@' || epoch_us(occurred_at), ',' ORDER BY occurred_at) AS first
        FROM @worker_log WHERE source_type IS NOT NULL GROUP BY 1) p USING (candidate_id)
    WHERE state IN ('needs_review', 'conflicting_identity', 'failed_match', 'retry_wait', 'identity_coherent', 'validation_pending')""")
def a15_weekly_entries(spark, sf_dir):
    log = _log(spark, sf_dir)
    found = log.where("source_type is not null").select("candidate_id", "source_type", F.lit("n").alias("source_name"), F.lit("r").alias("source_record_id"), F.col("occurred_at").alias("discovered_at"))
    ids = log.select("candidate_id", F.lit("spotify").alias("kind"), F.col("external_id").alias("value"))
    out = metrics.weekly_entries(_now(log), log, "2024-02-01", found, ids)
    first = F.array_join(F.transform("provenance", lambda p: F.concat(p["source_type"], F.lit("@"), F.unix_micros(p["discovered_at"]))), ",")
    of_kind = F.array_join(F.transform(F.map_entries("ids"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return out.select("blocker", "candidate_id", "state", "outcome", F.round("age_hours", 4).alias("age_hours"), F.array_join("evidence_refs", ",").alias("evidence_refs"), "summary",
        of_kind.alias("ids"), first.alias("provenance"))


# a user and hour is a run, an event type a provider of it
INPUTS["lanes"] = """SELECT concat(cast(user_id AS string), '-', cast(event_id % 6 AS string)) AS run_id, CASE WHEN (user_id + event_id % 6) % 4 = 0 THEN 'paused' ELSE 'completed' END AS status,
    event_type AS provider, cast(ts AS timestamp) AS ended_at, event_id % 9 = 0 AS opened, CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS asked FROM {events}"""


@query("""WITH r AS (SELECT run_id, status, max(ended_at) AS t FROM @lanes GROUP BY 1, 2), d AS (SELECT * FROM r WHERE status = 'completed'),
    l AS (SELECT run_id, provider, sum(asked) AS asked, bool_or(opened) AS opened FROM @lanes GROUP BY 1, 2), x AS (SELECT * FROM l JOIN d USING (run_id)),
    c AS (SELECT candidate_id, arg_max(next_state, candidate_revision) AS state, min(occurred_at) AS created_at FROM @worker_log GROUP BY 1)
    SELECT 'last_run' AS item, 'run' AS name, run_id AS value FROM (SELECT run_id FROM d ORDER BY t DESC, run_id DESC LIMIT 1)
    UNION ALL SELECT 'last_provider_run', provider, run_id FROM (SELECT * FROM x WHERE asked > 0 QUALIFY row_number() OVER (PARTITION BY provider ORDER BY t DESC, run_id DESC) = 1)
    UNION ALL SELECT 'open_breaker', provider, 'open' FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY provider ORDER BY t DESC, run_id DESC) = 1) WHERE opened
    UNION ALL SELECT 'queue', state, cast(count(*) AS string) FROM c GROUP BY state
    UNION ALL SELECT 'open_candidate', candidate_id, state FROM (SELECT * FROM c WHERE state NOT IN ('migrated', 'approved', 'identity_coherent') ORDER BY created_at, candidate_id LIMIT 10)""")
def a19_ops_status(spark, sf_dir):
    lanes = get(spark, sf_dir, "lanes")
    per = lanes.groupBy("run_id", "status", "provider").agg(F.max("ended_at").alias("at"), F.sum("asked").alias("requests"), F.max("opened").alias("opened"))
    x = F.struct(F.create_map(F.lit("requests"), F.col("requests").cast("long")).alias("metrics"), F.when(F.col("opened"), "open").otherwise("closed").alias("breaker"), F.lit(None).cast("string").alias("stop_reason"))
    runs = per.groupBy("run_id", "status").agg(F.max("at").alias("completed_at"), F.map_from_entries(F.collect_list(F.struct("provider", x))).alias("providers"))
    return metrics.ops_status(runs, _now(_log(spark, sf_dir)))


_REVIEW = "state IN ('needs_review', 'conflicting_identity', 'failed_match', 'retry_wait', 'identity_coherent', 'validation_pending')"


@query(f"""{_NOW} SELECT 'entry' AS item, candidate_id AS name, state, cast({_REVIEW} AS BIGINT) AS for_review, 1::BIGINT AS candidates FROM c
    UNION ALL SELECT 'count', state, state, count(*) FILTER ({_REVIEW}), count(*) FROM c GROUP BY state""")
def s14_queue_index(spark, sf_dir):
    entries, counts = converge.queue_index(_now(_log(spark, sf_dir)), ["external_id"])
    one = entries.select(F.lit("entry").alias("item"), F.col("candidate_id").alias("name"), "state", F.col("for_review").cast("long").alias("for_review"), F.lit(1).cast("long").alias("candidates"))
    return one.unionByName(counts.select(F.lit("count").alias("item"), F.col("state").alias("name"), "state", "for_review", "candidates"))


@query("""WITH l AS (SELECT genre, tier, artist_id, name FROM @customers), r AS (SELECT genre, tier, artist_id, name FROM @customers_later), d AS (SELECT unnest([0.0, 0.19, 0.5, 0.81, 0.999999]) AS draw),
    a AS (SELECT genre, tier, draw, artist_id, name FROM (SELECT *, row_number() OVER (PARTITION BY genre, tier ORDER BY artist_id) - 1 AS p, count(*) OVER (PARTITION BY genre, tier) AS n FROM l), d WHERE p = floor(draw * n)),
    b AS (SELECT genre, tier, draw, artist_id, name FROM (SELECT *, row_number() OVER (PARTITION BY genre, tier ORDER BY artist_id) - 1 AS p, count(*) OVER (PARTITION BY genre, tier) AS n FROM r), d WHERE p = floor(draw * n))
    SELECT coalesce(a.genre, b.genre) AS genre, coalesce(a.tier, b.tier) AS tier, cast(coalesce(a.draw, b.draw) AS DOUBLE) AS draw,
        a.artist_id IS NOT DISTINCT FROM b.artist_id AND a.name IS NOT DISTINCT FROM b.name AS equal FROM a FULL JOIN b ON a.genre = b.genre AND a.tier = b.tier AND a.draw = b.draw""")
def j14_pick_parity(spark, sf_dir):
    sides = [get(spark, sf_dir, n).withColumn("position", F.col("artist_id")) for n in ("customers", "customers_later")]
    return directory.pick_parity(*sides, ["genre", "tier"], ["artist_id", "name"])


@query("""WITH f AS (SELECT candidate_id, min(occurred_at) AS first, max(occurred_at) AS last, count(*) AS attempts FROM @failures GROUP BY 1)
    SELECT candidate_id, cast(attempts AS int) AS attempts, CASE WHEN epoch_us(last) - epoch_us(first) >= 72 * 3600000000 THEN 'retry_elapsed_time_exhausted' WHEN attempts > 3 THEN 'retry_attempts_exhausted'
        WHEN epoch_us(TIMESTAMP '2024-01-20') - epoch_us(first) >= 72 * 3600000000 THEN 'retry_elapsed_time_exhausted' END AS exhaustion_reason FROM f WHERE first < TIMESTAMP '2024-01-20'""")
def w5_retry_ageing(spark, sf_dir):
    """Where each record stands at an instant, also those that end by age alone."""
    f = get(spark, sf_dir, "failures").withColumn("first_at", F.min("occurred_at").over(_by_candidate()))
    known = lifecycle.retry_schedule(f.where("first_at < timestamp'2024-01-20'").drop("first_at"))
    return lifecycle.evaluate_retries(known, "2024-01-20").select("candidate_id", F.col("attempt").alias("attempts"), "exhaustion_reason")


def _by_candidate():
    from pyspark.sql import Window

    return Window.partitionBy("candidate_id")


# an order is an item of a listing of its priority, ten to a page; checkpoints stand in the middle of a page
INPUTS["listing"] = """SELECT provider, cast(floor(n / 10) AS bigint) AS page, cast(n % 10 AS bigint) AS item_offset, id FROM (SELECT concat(o_orderpriority, cast(o_custkey % 20 AS string)) AS provider,
    o_orderkey AS id, row_number() OVER (PARTITION BY concat(o_orderpriority, cast(o_custkey % 20 AS string)) ORDER BY o_orderkey) - 1 AS n FROM {orders})"""
INPUTS["positions"] = """SELECT concat('c', provider) AS checkpoint_id, provider, CASE WHEN k % 9 = 0 THEN 'old' ELSE 'h' END AS configuration_hash, cast(k % 5 + 1 AS bigint) AS revision,
    CASE WHEN k % 7 = 0 THEN 9000 ELSE cast(k % 6 AS bigint) END AS page, cast(k % 10 AS bigint) AS item_offset, k % 7 = 0 AND k % 2 = 0 AS exhausted FROM (SELECT provider, min(id) AS k FROM
    (SELECT concat(o_orderpriority, cast(o_custkey % 20 AS string)) AS provider, o_orderkey AS id FROM {orders}) GROUP BY provider)"""
_ACQUIRED = """WITH e AS (SELECT provider, max(page * 10 + item_offset) AS last FROM @listing GROUP BY 1), c AS (SELECT p.*, last, CASE WHEN configuration_hash <> 'h' THEN 'configuration_changed'
        WHEN NOT exhausted AND p.page * 10 + p.item_offset > last THEN 'position_beyond_listing' END AS reason FROM @positions p JOIN e USING (provider)),
    t AS (SELECT checkpoint_id, i.*, row_number() OVER (PARTITION BY checkpoint_id ORDER BY i.page, i.item_offset) AS n FROM c JOIN @listing i USING (provider)
        WHERE reason IS NULL AND i.page * 10 + i.item_offset >= c.page * 10 + c.item_offset), k AS (SELECT * FROM t WHERE n <= 25),
    s AS (SELECT checkpoint_id, max(page * 10 + item_offset) AS top FROM k GROUP BY 1)"""


@query(f"""{_ACQUIRED} SELECT 'taken' AS item, checkpoint_id, page, item_offset, cast(id AS string) AS what FROM k UNION ALL SELECT 'refused', checkpoint_id, NULL, NULL, reason FROM c WHERE reason IS NOT NULL
    UNION ALL SELECT 'next', checkpoint_id, CASE WHEN top IS NULL THEN page WHEN top = last THEN top // 10 + 1 ELSE (top + 1) // 10 END, CASE WHEN top IS NULL THEN item_offset WHEN top = last THEN 0
        ELSE (top + 1) % 10 END, (revision + 1) || CASE WHEN coalesce(top = last, true) THEN ' exhausted' ELSE ' open' END FROM c LEFT JOIN s USING (checkpoint_id) WHERE reason IS NULL""")
def x1_acquire(spark, sf_dir):
    """Up to 25 items from where each checkpoint stands, the next checkpoints, and those that are refused."""
    known = get(spark, sf_dir, "positions")
    taken, after, refused = positions.acquire(get(spark, sf_dir, "listing"), known, known.select("provider", F.lit("h").alias("configuration_hash")), 25)
    state = F.concat(F.col("revision"), F.when(F.col("exhausted"), " exhausted").otherwise(" open"))
    null = F.lit(None).cast("long")
    out = taken.select(F.lit("taken").alias("item"), "checkpoint_id", "page", "item_offset", F.col("id").cast("string").alias("what"))
    out = out.unionByName(refused.select(F.lit("refused").alias("item"), "checkpoint_id", null.alias("page"), null.alias("item_offset"), F.col("reason").alias("what")))
    return out.unionByName(after.select(F.lit("next").alias("item"), "checkpoint_id", "page", "item_offset", state.alias("what")))


@query("""WITH p AS (SELECT cast(user_id AS string) AS checkpoint_id, event_id AS revision, value AS page FROM events), b AS (SELECT *,
        max(page) OVER (PARTITION BY checkpoint_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) SELECT checkpoint_id, revision FROM b WHERE page < m""")
def t8_backward_stream(spark, sf_dir):
    from .catalog_queries import _folder, _stream

    e = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("checkpoint_id"), F.col("event_id").alias("revision"), F.col("value").alias("page"), F.lit(0).alias("item_offset"))
    found = streams.backward_positions(e).withColumn("seen", F.lit(True))
    return streams.run_now(found, ["checkpoint_id", "revision"], _folder(spark), "append").select("checkpoint_id", "revision")
