"""Inputs of the registered queries: the given tables seen as releases, names, event logs, claims and so on.

Each is a SELECT that Spark and DuckDB read alike; a table stands in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DATE = "cast(cast(o_orderdate AS date) AS string)"
INPUTS = {
    # an order is a release of its customer, dated to the year, month or day
    "releases": f"""SELECT cast(o_custkey AS bigint) AS artist_id, cast(o_orderkey AS string) AS id, concat('Collection ',
        cast(o_orderkey % 7 AS string), CASE WHEN o_orderkey % 3 = 0 THEN ' (Deluxe Edition)' ELSE '' END) AS name,
        CASE o_orderkey % 5 WHEN 0 THEN substr({_DATE}, 1, 4) WHEN 1 THEN substr({_DATE}, 1, 7) ELSE substr({_DATE}, 1, 10) END AS release_date,
        cast(NULL AS string) AS release_date_precision,
        CASE o_orderstatus WHEN 'F' THEN 'album' WHEN 'O' THEN 'single' ELSE 'compilation' END AS album_type, cast(n AS int) AS total_tracks,
        cast(o_orderkey AS bigint) AS position
        FROM {{orders}} JOIN (SELECT l_orderkey, count(*) AS n FROM {{lineitem}} GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "ranking": "SELECT cast(p_size AS bigint) AS rank, p_name AS name, cast(p_partkey AS bigint) AS id FROM {part}",
    "names": "SELECT cast(p_partkey AS bigint) AS id, p_name AS name, p_brand AS external_id, cast(p_partkey AS bigint) AS position FROM {part}",
    "directory": """SELECT cast(p_partkey AS bigint) AS artist_id, p_name AS name, concat('x', cast(p_partkey % 40 AS string)) AS external_id,
        cast(p_partkey AS bigint) AS position FROM {part} WHERE p_partkey % 3 = 0""",
    # a user's events are the log of a candidate
    "log": """SELECT candidate_id, candidate_revision, CASE WHEN candidate_revision = 1 THEN 'candidate_discovered'
        WHEN event_id % 11 = 0 THEN 'discovery_attached' ELSE 'state_transition' END AS event_type,
        previous_state, next_state, CASE WHEN event_id % 43 = 0 THEN 'retry_budget_exhausted' WHEN event_id % 41 = 0 THEN 'bridge_not_found'
        ELSE 'routed' END AS reason_code, occurred_at,
        concat('o', cast(event_id % 500 AS string)) AS occurrence_id, CASE WHEN event_id % 97 = 0 THEN concat('s',
        cast(event_id % 50 AS string)) END AS identifier
        FROM (SELECT *, lag(next_state) OVER (PARTITION BY candidate_id ORDER BY candidate_revision) AS previous_state FROM (
            SELECT event_id, cast(user_id AS string) AS candidate_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts,
        event_id) AS bigint) AS candidate_revision, cast(ts AS timestamp) AS occurred_at,
            CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'view' THEN 'identity_pending' WHEN 'click' THEN 'identity_resolving'
        WHEN 'purchase' THEN 'identity_coherent' ELSE 'retry_wait' END AS next_state FROM {events}))""",
    "failures": """SELECT cast(user_id AS string) AS candidate_id, 'p' AS provider, 'op' AS operation, cast(ts AS timestamp) AS occurred_at, CASE
        WHEN event_id % 5 = 0 THEN cast(cast(floor(value * 100) AS int) AS string) END AS retry_after FROM {events} WHERE event_type = 'error'""",
    "calls": """SELECT event_type AS provider, cast(CASE event_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 401 WHEN 3 THEN 418
        ELSE 200 END AS int) AS status_code FROM {events}""",
    # a line item claims that its order has a supplier, on the word of its return flag
    "claims": """SELECT l_orderkey AS entity, l_linestatus AS identifier_type, cast(l_suppkey AS string) AS value, l_returnflag AS origin, concat('l',
        cast(l_linenumber AS string)) AS source, 'x' AS path, cast(l_partkey AS string) AS asserted_by FROM {lineitem}""",
    "titles": "SELECT cast(p_size AS bigint) AS group_id, cast(p_partkey AS bigint) AS profile_id, p_name AS title FROM {part}",
    "registry": """SELECT concat('artist_', lpad(cast(c_custkey AS string), 6, '0')) AS artist_id, concat('s', cast(c_custkey AS string)) AS external_id
        FROM {customer} WHERE c_custkey % 4 = 0""",
    "candidates": """SELECT concat('c', cast(c_custkey AS string)) AS candidate_id, c_mktsegment AS name, CASE WHEN c_custkey % 5 <> 0 THEN concat('s',
        cast(c_custkey % 700 AS string)) END AS external_id, CASE WHEN c_custkey % 9 = 0 THEN concat('artist_', lpad(cast(c_custkey % 50 AS string), 6,
        '0')) END AS asserted_id FROM {customer}""",
    "queue": """SELECT concat('c', cast(c_custkey AS string)) AS candidate_id, CASE c_custkey % 4 WHEN 0 THEN 'rejected'
        ELSE 'identity_pending' END AS state, c_mktsegment AS name, CASE WHEN c_custkey % 5 <> 0 THEN concat('s',
        cast(c_custkey % 700 AS string)) END AS external_id, cast(c_custkey AS bigint) AS position FROM {customer}""",
    "live_names": "SELECT n_name AS name, concat('n', cast(n_nationkey AS string)) AS external_id FROM {nation}",
    "customers": "SELECT cast(c_custkey AS bigint) AS artist_id, c_name AS name, c_mktsegment AS genre, cast(c_nationkey AS string) AS tier FROM {customer}",
    "customers_later": """SELECT cast(c_custkey AS bigint) AS artist_id, CASE WHEN c_custkey % 10 = 3 THEN concat(c_name, '!') ELSE c_name END AS name,
        c_mktsegment AS genre, CASE WHEN c_custkey % 14 = 5 THEN '99' ELSE cast(c_nationkey AS string) END AS tier FROM {customer}
        WHERE c_custkey % 17 <> 1""",
    "items": """SELECT o_orderpriority AS provider, cast(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS bigint) AS position,
        cast(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 9) AS bigint) AS page,
        o_custkey % 2 = 0 AS creates_candidate, CASE o_custkey % 3 WHEN 0 THEN 'needs_review' ELSE 'identity_pending' END AS target_state FROM {orders}""",
    "cache": """SELECT event_type AS provider, 'get' AS operation, cast(user_id AS string) AS identifier, cast(ts AS timestamp) AS retrieved_at,
        props AS value, cast(CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 END AS int) AS status_code, CASE event_id % 4 WHEN 0 THEN 'listing'
        WHEN 1 THEN 'events' WHEN 2 THEN 'exact_identity' ELSE 'other' END AS kind FROM {events}""",
    "requests": """SELECT DISTINCT event_type AS provider, 'get' AS operation, cast(user_id AS string) AS identifier FROM {events}
        UNION ALL SELECT DISTINCT 'view', 'get', concat('new', cast(user_id AS string)) FROM {events}""",
}


#: An id of a kind made of a number, and a content id of a text.
_ID = "concat('{kind}_00000000-0000-7000-8000-', lpad(cast({n} AS string), 12, '0'))"
_SHA = "concat('sha256:', md5({x}), md5({x}))"
_artist = lambda n: f"concat('mr_artist_', lpad(cast({n} AS string), 6, '0'))"
_id = lambda kind, n: _ID.format(kind=kind, n=n)
_sha = lambda x: _SHA.format(x=x)
_or = lambda n, bad, good: f"CASE WHEN {n} = 0 THEN {bad} ELSE {good} END"

#: Records of each type, most of them good; a remainder of the key decides which fault one has.
RECORDS = {
    "registry": f"""SELECT c_custkey AS k, {_or('c_custkey % 41', "'artist'", _artist('c_custkey'))} AS artist_id, {_or('c_custkey % 13', "' '", "concat('s', cast(c_custkey AS string))")} AS external_id
        FROM {{customer}}""",
    "artist_v2": f"""SELECT c_custkey AS k, {_or('c_custkey % 43', 1, 2)} AS schema_version, {_or('c_custkey % 41', "'mr_artist_1'", _artist('c_custkey'))} AS artist_id,
        {_or('c_custkey % 37', "'famous'", "'emerging'")} AS stage, cast(c_custkey % 110 AS double) AS stage_confidence,
        split({_or('c_custkey % 29', "'pop,pop'", "'pop,rock'")}, ',') AS genres, 'pop' AS genre, {_or('c_custkey % 23', "'rock'", "'pop'")} AS primary_genre,
        {_or('c_custkey % 31', "'classic'", "'emerging'")} AS tier,
        split(CASE c_custkey % 19 WHEN 0 THEN 'spotify,napster' WHEN 1 THEN 'spotify,musicbrainz' ELSE 'spotify' END, ',') AS external_providers,
        {_or('c_custkey % 5', "split('e1', ',')", 'NULL')} AS identity_evidence, concat('s', cast(c_custkey AS string)) AS spotify_id,
        {_or('c_custkey % 17', "'other'", "concat('s', cast(c_custkey AS string))")} AS external_spotify_id, {_or('c_custkey % 6', 'NULL', "'u'")} AS spotify_url,
        {_or('c_custkey % 3', 'NULL', "'u'")} AS external_spotify_url, 'i' AS image, {_or('c_custkey % 47', 'NULL', "'i'")} AS primary_image_url,
        CASE c_custkey % 7 WHEN 0 THEN 'guessed' WHEN 1 THEN 'reported' ELSE 'verified' END AS geo_confidence, CASE
        WHEN c_custkey % 2 = 0 THEN cast(c_custkey % 95 AS double) END AS latitude, CASE
        WHEN c_custkey % 2 = 0 THEN cast(c_custkey % 185 AS double) END AS longitude,
        {_or('c_custkey % 22', 'NULL', "'c'")} AS city, 'x' AS country, {_or('c_custkey % 26', 'NULL', "split('g1', ',')")} AS geo_evidence,
        {_or('c_custkey % 53', 'NULL', "split('a', ',')")} AS scene_associations FROM {{customer}}""",
    "live_event": f"""SELECT o_orderkey AS k, {_or('o_orderkey % 43', 2, 1)} AS schema_version, {_or('o_orderkey % 41', "'event'", "concat('mr_event_', lpad(cast(o_orderkey % 1000000 AS string), 6, '0'))")} AS event_id,
        CASE o_orderkey % 37 WHEN 0 THEN NULL WHEN 1 THEN split('mr_artist_000001,x', ',') ELSE split('mr_artist_000001,mr_artist_000002',
        ',') END AS artist_ids, {_or('o_orderkey % 31', "''", "'ticketmaster'")} AS provider, {_or('o_orderkey % 29', "' '", "cast(o_orderkey AS string)")} AS external_event_id,
        {_or('o_orderkey % 23', "'soon'", "cast(cast(o_orderdate AS date) AS string)")} AS starts_at, '2026-01-01' AS retrieved_at,
        {_or('o_orderkey % 19', 'NULL', "'p'")} AS provenance, cast(o_custkey % 95 AS double) AS latitude,
        cast(o_custkey % 190 - 5 AS double) AS longitude, 'c' AS city, {_or('o_custkey % 17', 'NULL', "'x'")} AS country FROM {{orders}}""",
    "evidence": f"""SELECT p_partkey AS k, {_or('p_partkey % 43', 'NULL', 1)} AS schema_version, {_or('p_partkey % 41', "'evidence'", "concat('mr_evidence_', lpad(cast(p_partkey AS string), 6, '0'))")} AS evidence_id,
        {_or('p_partkey % 37', "'x'", _artist('p_partkey'))} AS artist_id,
        CASE p_partkey % 6 WHEN 0 THEN 'rumour' WHEN 1 THEN 'catalog' ELSE 'identity' END AS evidence_type, {_or('p_partkey % 31', "''", 'p_brand')} AS source_class,
        {_or('p_partkey % 29', "'2026-13-45'", "'2026-01-02 03:04:05'")} AS observed_at, {_or('p_partkey % 23', 'NULL', 'p_name')} AS payload,
        {_or('p_partkey % 19', "'seen'", "'reviewed'")} AS review_status FROM {{part}}""",
    "discovery": f"""SELECT p_partkey AS k, {_or('p_partkey % 43', "'sha256:1'", _sha('p_name'))} AS discovery_id, {_or('p_partkey % 41', "'radio'", "'chart'")} AS source_type,
        {_or('p_partkey % 37', "' '", 'p_brand')} AS source_name, {_or('p_partkey % 31', "' '", 'p_name')} AS raw_name,
        CASE p_partkey % 31 WHEN 0 THEN '' WHEN 1 THEN 'drift' ELSE lower(p_name) END AS normalized_name, {_or('p_partkey % 29', "'never'", "'2026-01-01'")} AS discovered_at,
        CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' ELSE 'AAAAAAAAAAAAAAAAAAAAAA' END AS spotify_id,
        CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://x/' WHEN 2 THEN 'https://open.spotify.com/artist/BBBBBBBBBBBBBBBBBBBBBB'
        ELSE 'https://open.spotify.com/artist/AAAAAAAAAAAAAAAAAAAAAA' END AS spotify_url, {_or('p_partkey % 23', "'someone'", 'NULL')} AS asserted_id
        FROM {{part}}""",
    "candidate": f"""SELECT c_custkey AS k, {_or('c_custkey % 43', 2, 1)} AS schema_version, {_or('c_custkey % 41', "'c'", _id('mr_candidate', 'c_custkey'))} AS candidate_id,
        c_custkey % 37 AS revision, CASE c_custkey % 9 WHEN 0 THEN 'lost' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'approved'
        ELSE 'needs_review' END AS state,
        {_or('c_custkey % 31', "'x'", "'2026-01-01'")} AS created_at, '2026-01-02' AS updated_at, {_or('c_custkey % 29', 'NULL', "'2026-01-02'")} AS state_entered_at,
        c_name AS raw_name, {_or('c_custkey % 23', 'c_name', 'lower(c_name)')} AS normalized_name,
        CASE c_custkey % 19 WHEN 0 THEN NULL WHEN 1 THEN split('a,b,a', ',') ELSE split('a,b', ',') END AS discovery_ids, {_or('c_custkey % 3', 'NULL', "'AAAAAAAAAAAAAAAAAAAAAA'")} AS spotify_id,
        CASE c_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN {_artist('c_custkey')} END AS asserted_id,
        cast(c_custkey % 103 AS double) AS identity_confidence, cast(NULL AS double) AS stage_confidence,
        cast(c_custkey % 7 - 1 AS double) AS geo_confidence, {_or('c_custkey % 17', "'maybe'", "'unresolved_identity'")} AS identity_outcome,
        CASE c_custkey % 4 WHEN 0 THEN 'queued_candidate' WHEN 1 THEN 'twin' ELSE 'not_duplicate' END AS duplicate_status, {_or('c_custkey % 2', "'approved'", "'not_approved'")} AS approval_status,
        {_or('c_custkey % 47', "'held'", "'not_reserved'")} AS reservation_status,
        CASE c_custkey % 6 WHEN 0 THEN 'later' WHEN 1 THEN '2026-02-01' END AS retry_at, {_or('c_custkey % 53', "'e'", _id('mr_candidate_event', 'c_custkey'))} AS last_event_id
        FROM {{customer}}""",
    "candidate_event": f"""SELECT event_id AS k, {_or('event_id % 43', 2, 1)} AS schema_version, {_or('event_id % 41', "'e'", _id('mr_candidate_event', 'event_id'))} AS event_id,
        {_or('event_id % 37', 'NULL', _id('mr_candidate', 'user_id'))} AS candidate_id,
        CASE event_id % 7 WHEN 0 THEN 'candidate_discovered' WHEN 1 THEN 'discovery_attached' WHEN 2 THEN 'noted'
        ELSE 'state_transition' END AS event_type, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'limbo' ELSE 'discovered' END AS previous_state,
        {_or('event_id % 3', "'needs_review'", "'discovered'")} AS next_state,
        event_id % 11 - 1 AS previous_revision, {_or('event_id % 31', 99, 'event_id % 11')} AS candidate_revision, {_or('event_id % 29', "'Why?'", "'routed'")} AS reason_code,
        {_or('event_id % 23', "'ghost'", "'worker'")} AS actor_type, {_or('event_id % 19', "''", "'w1'")} AS actor_id,
        {_or('event_id % 17', "'then'", "cast(ts AS string)")} AS occurred_at, {_or('event_id % 13', 'NULL', "split('r', ',')")} AS evidence_refs,
        props AS payload FROM {{events}}""",
    "occurrence": f"""SELECT p_partkey AS k, {_or('p_partkey % 43', 3, 1)} AS schema_version, {_or('p_partkey % 41', "'o'", _sha('p_name'))} AS occurrence_id,
        {_or('p_partkey % 37', "'Spotify'", "'spotify'")} AS provider, {_or('p_partkey % 31', "'radio'", "'playlist'")} AS source_type,
        p_brand AS source_name,
        {_or('p_partkey % 29', "' '", 'cast(p_partkey AS string)')} AS source_record_id, p_name AS raw_name, {_or('p_partkey % 23', "'drift'", 'lower(p_name)')} AS normalized_name,
        'spotify' AS entity_provider, {_or('p_partkey % 19', "'-x'", "'artist'")} AS entity_type,
        {_or('p_partkey % 17', "'a b'", 'cast(p_partkey AS string)')} AS entity_id, {_or('p_partkey % 13', 'NULL', "split('l', ',')")} AS legacy_ids,
        {_or('p_partkey % 11', "'short'", 'NULL')} AS spotify_id, {_or('p_partkey % 7', "'x'", _artist('p_partkey'))} AS asserted_id,
        split('b', ',') AS bridges, {_or('p_partkey % 47', 'NULL', "'c'")} AS source_context, {_or('p_partkey % 53', "'x'", "'2026-01-01'")} AS discovered_at,
        p_partkey % 59 <> 0 AS review_only FROM {{part}}""",
    "association": f"""SELECT o_orderkey AS k, {_or('o_orderkey % 43', 2, 1)} AS schema_version, {_or('o_orderkey % 41', "'a'", _sha('cast(o_orderkey AS string)'))} AS association_id,
        {_or('o_orderkey % 37', 'NULL', _sha('cast(o_custkey AS string)'))} AS occurrence_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'live_artist' ELSE 'label' END AS target_type, CASE WHEN o_orderkey % 31 = 0 THEN 'x'
        WHEN o_orderkey % 3 = 0 THEN {_id('mr_candidate', 'o_custkey')} ELSE {_artist('o_custkey')} END AS target_id,
        {_or('o_orderkey % 29', 'NULL', "split('id', ',')")} AS matched_by, split('r', ',') AS evidence_refs, {_or('o_orderkey % 23', "'x'", "'2026-01-01'")} AS created_at,
        o_orderkey % 19 <> 0 AS review_only FROM {{orders}}""",
    "run": f"""SELECT o_orderkey AS k, {_or('o_orderkey % 43', 2, 1)} AS schema_version, {_or('o_orderkey % 41', "'r'", _id('mr_discovery_run', 'o_orderkey'))} AS run_id,
        o_orderkey % 37 AS revision, '2026-01-01' AS created_at, {_or('o_orderkey % 31', "'x'", "'2026-01-01'")} AS started_at,
        {_or('o_orderkey % 4', 'NULL', "'2026-01-02'")} AS completed_at, {_or('o_orderkey % 29', "'h'", _sha('o_orderstatus'))} AS configuration_hash,
        CASE o_orderkey % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'summary_complete' ELSE 'somewhere' END AS last_phase,
        CASE o_orderkey % 5 WHEN 0 THEN 'lost' WHEN 1 THEN 'completed' ELSE 'running' END AS status, {_or('o_orderkey % 23', 'NULL', _id('mr_discovery_run_event', 'o_orderkey'))} AS last_event_id,
        o_orderkey % 19 - 1 AS requests FROM {{orders}}""",
}
INPUTS |= {f"record_{k}": v for k, v in RECORDS.items()}
#: What DuckDB calls functions of the rules; its arrays and Spark's begin with 1 in element_at.
_DUCK = {"regexp_like(": "regexp_matches(", "size(": "len(", "array_join(": "array_to_string(", "element_at(": "list_extract("}


def duck_condition(condition: str) -> str:
    for a, b in _DUCK.items():
        condition = condition.replace(a, b)
    return condition


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = INPUTS[name]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def duck(sql: str) -> str:
    """DuckDB's form of a query that names inputs as @name and tables as they are."""
    used = [n for n in INPUTS if re.search(rf"@{n}\b", sql)]
    with_ = ", ".join(f"in_{n} AS ({re.sub(r'[{}]', '', INPUTS[n])})" for n in used)
    body = re.sub(r"@(\w+)", r"in_\1", sql).strip()
    if with_ and body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {with_}, {body[5:]}" if with_ else body
    return f"WITH {with_} {body}" if with_ else body
