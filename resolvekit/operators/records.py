"""Rules of each type of record, as conditions that a good record meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import name_key
from .lifecycle import EVENT_TYPES, PHASES, TRANSITIONS
from .quality import violations

#: The forms of ids.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
FORMS = {
    "artist": "^mr_artist_[0-9]{6}$",
    "event": "^mr_event_[0-9]{6}$",
    "evidence": "^mr_evidence_[0-9]{6}$",
    "candidate": f"^mr_candidate_{UUID}$",
    "candidate_event": f"^mr_candidate_event_{UUID}$",
    "run": f"^mr_discovery_run_{UUID}$",
    "run_event": f"^mr_discovery_run_event_{UUID}$",
    "digest": "^sha256:[0-9a-f]{64}$",
    "spotify": "^[A-Za-z0-9]{22}$",
    "provider": "^[a-z][a-z0-9_]{0,63}$",
    "entity": "^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}$",
    "reason": "^[a-z0-9_]+$",
}
#: What a column may hold.
STAGES = ("underground", "emerging", "mainstream", "legacy", "classic")
PROVIDERS = ("spotify", "musicbrainz", "ticketmaster", "bandsintown", "appleMusic")
GEO_CONFIDENCE = ("unknown", "reported", "corroborated", "verified", "conflicting")
EVIDENCE_TYPES = ("identity", "mainstream", "catalog", "geographic", "user_engagement")
REVIEW_STATUS = ("review_only", "reviewed", "verified", "conflicting", "rejected")
SOURCE_TYPES = ("manual_curated_list", "playlist", "chart", "festival_lineup", "venue_calendar", "ticketmaster_event", "public_music_database",
    "related_artist", "local_scene_submission")
ACTORS = ("system", "command", "worker", "human")
OUTCOMES = ("coherent_identity_evidence", "coherent_identity_with_same_name_ambiguity", "provider_profile_multiplicity", "insufficient_corroboration",
    "semantic_identity_conflict", "unresolved_identity")
DUPLICATE_STATUS = ("not_duplicate", "existing_live_artist", "queued_candidate")
APPROVAL, RESERVATION = ("not_approved", "approved"), ("not_reserved", "reserved", "promoted", "released")
CONTROL = ("running", "paused", "stopped", "completed")


def _form(column: str, name: str) -> str:
    return f"regexp_like({column}, '{FORMS[name]}')"


def _optional(column: str, condition: str) -> str:
    return f"{column} IS NULL OR {condition}"


def _one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _text(column: str) -> str:
    return f"length(trim({column})) > 0"


def _time(column: str) -> str:
    return f"try_cast({column} AS timestamp) IS NOT NULL"


def _each(column: str, pattern: str) -> str:
    """Every string of an array has a form; none of them holds a comma."""
    return f"regexp_like(array_join({column}, ','), '^{pattern}(,{pattern})*$')"


def _same(a: str, b: str) -> str:
    return f"{a} = {b} OR ({a} IS NULL AND {b} IS NULL)"


_PLACE = {
    "coordinates_have_a_place": "(latitude IS NULL AND longitude IS NULL) OR (city IS NOT NULL AND country IS NOT NULL)",
    "latitude": "(latitude IS NULL AND longitude IS NULL) OR latitude BETWEEN -90 AND 90",
    "longitude": "(latitude IS NULL AND longitude IS NULL) OR longitude BETWEEN -180 AND 180",
}
_NAME = {"normalized_name": "normalized_name = computed_name"}
_SPOTIFY_URL = "open[.]spotify[.]com/artist/"

#: Record type -> rule -> condition, in SQL over flat columns; a null condition is broken.
RULES: dict[str, dict[str, str]] = {
    "registry": {"artist_id": _form("artist_id", "artist"), "external_id": _text("external_id")},
    "artist_v2": {
        "schema_version": "schema_version = 2", "artist_id": _form("artist_id", "artist"), "stage": _one_of("stage", STAGES),
            "stage_confidence": _optional("stage_confidence", "stage_confidence BETWEEN 0 AND 100"),
        "genres_given": "size(genres) > 0", "genres_distinct": "size(array_distinct(genres)) = size(genres)",
            "genre_is_primary": "genre = primary_genre", "first_genre_is_primary": "element_at(genres, 1) = primary_genre",
        "tier_is_stage": "tier = stage", "providers_known": _each("external_providers", f"({'|'.join(PROVIDERS)})"),
            "other_ids_have_evidence": "array_join(external_providers, ',') = 'spotify' OR size(identity_evidence) > 0",
        "spotify_id": "spotify_id = external_spotify_id", "spotify_url": _same("spotify_url", "external_spotify_url"),
            "image": _same("image", "primary_image_url"), "geo_confidence": _one_of("geo_confidence", GEO_CONFIDENCE), **_PLACE,
        "coordinates_confident": "latitude IS NULL OR geo_confidence IN ('corroborated', 'verified')",
            "coordinates_have_evidence": "latitude IS NULL OR size(geo_evidence) > 0", "scenes_given": "scene_associations IS NOT NULL",
    },
    "live_event": {
        "schema_version": "schema_version = 1", "event_id": _form("event_id", "event"), "artists_given": "size(artist_ids) > 0",
            "artist_ids": _each("artist_ids", FORMS["artist"].strip("^$")), "provider": _text("provider"),
        "external_event_id": _text("external_event_id"), "starts_at": _time("starts_at"), "retrieved_at": _time("retrieved_at"),
            "provenance": "provenance IS NOT NULL", **_PLACE,
    },
    "evidence": {
        "schema_version": "schema_version = 1", "evidence_id": _form("evidence_id", "evidence"), "artist_id": _form("artist_id", "artist"),
            "evidence_type": _one_of("evidence_type", EVIDENCE_TYPES), "source_class": _text("source_class"),
        "observed_at": _time("observed_at"), "payload": "payload IS NOT NULL", "review_status": _one_of("review_status", REVIEW_STATUS),
    },
    "discovery": {
        "discovery_id": _form("discovery_id", "digest"), "source_type": _one_of("source_type", SOURCE_TYPES), "source_name": _text("source_name"),
            "raw_name": _text("raw_name"), **_NAME, "discovered_at": _time("discovered_at"),
        "spotify_id": _optional("spotify_id", _form("spotify_id", "spotify")),
            "spotify_url": _optional("spotify_url", f"regexp_like(spotify_url, '{_SPOTIFY_URL}[A-Za-z0-9]{{22}}')"),
        "url_agrees": f"spotify_url IS NULL OR spotify_id IS NULL OR regexp_extract(spotify_url, '{_SPOTIFY_URL}([A-Za-z0-9]{{22}})', 1) = spotify_id", "asserted_id": _optional("asserted_id", _form("asserted_id", "artist")),
    },
    "candidate": {
        "schema_version": "schema_version = 1", "candidate_id": _form("candidate_id", "candidate"), "revision": "revision >= 1",
            "state": _one_of("state", TRANSITIONS), "created_at": _time("created_at"), "updated_at": _time("updated_at"),
        "state_entered_at": _time("state_entered_at"), **_NAME, "discoveries_given": "size(discovery_ids) > 0",
            "discoveries_distinct": "size(array_distinct(discovery_ids)) = size(discovery_ids)",
        "spotify_id": _optional("spotify_id", _form("spotify_id", "spotify")), "asserted_id": _optional("asserted_id", _form("asserted_id", "artist")),
        **{f"{k}_confidence": _optional(f"{k}_confidence", f"{k}_confidence BETWEEN 0 AND 100") for k in ("identity", "stage", "geo")},
            "identity_outcome": _one_of("identity_outcome", OUTCOMES),
        "duplicate_status": _one_of("duplicate_status", DUPLICATE_STATUS),
            "duplicate_has_evidence": "state <> 'duplicate' OR duplicate_status <> 'not_duplicate'", "approval_status": _one_of("approval_status", APPROVAL),
        "approved_before_live": "state NOT IN ('approved', 'migration_pending', 'migrated') OR approval_status = 'approved'",
            "reservation_status": _one_of("reservation_status", RESERVATION),
        "retry_at": _optional("retry_at", _time("retry_at")), "last_event_id": _form("last_event_id", "candidate_event"),
    },
    "candidate_event": {
        "schema_version": "schema_version = 1", "event_id": _form("event_id", "candidate_event"), "candidate_id": _form("candidate_id", "candidate"),
            "event_type": _one_of("event_type", EVENT_TYPES),
        "previous_state": _optional("previous_state", _one_of("previous_state", TRANSITIONS)), "next_state": _one_of("next_state", TRANSITIONS),
            "previous_revision": "previous_revision >= 0", "sequential": "candidate_revision = previous_revision + 1",
        "reason_code": _form("reason_code", "reason"), "actor_type": _one_of("actor_type", ACTORS), "actor_id": _text("actor_id"),
            "occurred_at": _time("occurred_at"), "evidence_refs": "evidence_refs IS NOT NULL", "payload": "payload IS NOT NULL",
        "first_event": "event_type <> 'candidate_discovered' OR (previous_state IS NULL AND previous_revision = 0 AND next_state = 'discovered')",
        "attachment_keeps_state": "event_type NOT IN ('discovery_attached', 'candidate_identifier_attached') OR previous_state = next_state",
            "transition_has_a_past": "event_type <> 'state_transition' OR previous_state IS NOT NULL",
    },
    "occurrence": {
        "schema_version": "schema_version = 1", "occurrence_id": _form("occurrence_id", "digest"), "provider": _form("provider", "provider"),
            "source_type": _one_of("source_type", SOURCE_TYPES), "source_name": _text("source_name"),
        "source_record_id": _text("source_record_id"), **_NAME, "entity_provider": "entity_provider = provider",
            "entity_type": _form("entity_type", "entity"), "entity_id": _form("entity_id", "entity"), "legacy_ids": "legacy_ids IS NOT NULL",
        "spotify_id": _optional("spotify_id", _form("spotify_id", "spotify")),
            "asserted_id": _optional("asserted_id", _form("asserted_id", "artist")), "bridges": "bridges IS NOT NULL", "source_context": "source_context IS NOT NULL",
        "discovered_at": _time("discovered_at"), "review_only": "review_only",
    },
    "association": {
        "schema_version": "schema_version = 1", "association_id": _form("association_id", "digest"),
            "occurrence_id": _form("occurrence_id", "digest"), "target_type": _one_of("target_type", ("candidate", "live_artist")),
        "target_id": f"(target_type = 'candidate' AND {_form('target_id', 'candidate')}) OR (target_type <> 'candidate' AND {_form('target_id', 'artist')})", "matched_by": "matched_by IS NOT NULL", "evidence_refs": "evidence_refs IS NOT NULL",
        "created_at": _time("created_at"), "review_only": "review_only",
    },
    "run": {
        "schema_version": "schema_version = 1", "run_id": _form("run_id", "run"), "revision": "revision >= 1", "created_at": _time("created_at"),
            "started_at": _time("started_at"), "completed_at": _optional("completed_at", _time("completed_at")),
        "configuration_hash": _form("configuration_hash", "digest"), "last_phase": _one_of("last_phase", PHASES),
            "status": _one_of("status", CONTROL), "last_event_id": _form("last_event_id", "run_event"),
        "completed_is_complete": f"status <> 'completed' OR (last_phase = '{PHASES[-1]}' AND completed_at IS NOT NULL)", "requests": "requests >= 0",
    },
}


#: Types of a run's events, states of a breaker, what a finished phase was, and the rates of a day.
RUN_EVENTS = ("run_created", "phase_completed", "provider_execution_recorded", "run_paused", "run_resumed", "run_stopped")
BREAKER, DISPOSITION = ("closed", "open", "half_open"), ("completed", "skipped")
RATES = ("discovery_yield", "rediscovery_rate", "duplicate_prevention_rate", "coherent_rate", "review_rate", "failed_match_rate", "exact_bridge_rate", "retry_recovery_rate", "retry_exhaustion_rate")
GROUPS = ("same_name_ambiguity", "provider_profile_multiplicity", "missing_exact_bridge", "unresolved_identifiers", "semantic_identity_conflict", "retry_budget_exhausted", "editorial_input_missing")
_NAMESPACE = """concat('sha256:', sha2(concat('{"provider":"', provider, '","adapterId":"', adapter_id, '","adapterVersion":"', adapter_version, '","stableConfigurationHash":"', configuration_hash, '"}'), 256))"""
_CONTROL_EVENT = "event_type IN ('run_paused', 'run_resumed', 'run_stopped')"
#: Checkpoints, events of runs, retries, breakers and summaries.
RULES |= {
    "checkpoint": {
        "schema_version": "schema_version = 1", "checkpoint_id": _form("checkpoint_id", "digest"), "provider": "regexp_like(provider, '^[a-z][a-z0-9_]*$')",
        "adapter_id": "regexp_like(adapter_id, '^[a-z][a-z0-9_]*$')", "adapter_version": "regexp_like(adapter_version, '^v[1-9][0-9]*$')",
        "configuration_hash": _form("configuration_hash", "digest"), "namespace": f"checkpoint_id = {_NAMESPACE}", "revision": "revision >= 1", "page": "page >= 0", "item_offset": "item_offset >= 0",
        "exhausted": "exhausted IS NOT NULL", "last_run_id": _optional("last_run_id", _form("last_run_id", "run")), "evidence_ref": _optional("evidence_ref", _text("evidence_ref")),
        "created_at": _time("created_at"), "updated_at": _time("updated_at"), "time_order": "try_cast(updated_at AS timestamp) >= try_cast(created_at AS timestamp)",
    },
    "run_event": {
        "schema_version": "schema_version = 1", "event_id": _form("event_id", "run_event"), "run_id": _form("run_id", "run"), "event_type": _one_of("event_type", RUN_EVENTS),
        "previous_revision": "previous_revision >= 0", "run_revision": "run_revision = previous_revision + 1", "occurred_at": _time("occurred_at"), "actor_type": _one_of("actor_type", ACTORS),
        "created_first": f"event_type <> 'run_created' OR (previous_revision = 0 AND phase = '{PHASES[0]}' AND disposition = 'completed')",
        "phase": f"event_type <> 'phase_completed' OR ({_one_of('phase', PHASES[1:])} AND {_one_of('disposition', DISPOSITION)})",
        "execution": "event_type <> 'provider_execution_recorded' OR (phase IS NULL AND disposition IS NULL AND " + _text("provider") + f" AND breaker_provider = provider AND {_one_of('breaker_state', BREAKER)})",
        "control": f"NOT ({_CONTROL_EVENT}) OR (phase IS NULL AND {_text('reason')})",
    },
    "retry": {
        "schema_version": "schema_version = 1", "candidate_id": _text("candidate_id"), "provider": _text("provider"), "operation": _text("operation"), "attempt_count": "attempt_count >= 1",
        "first_failure_at": _time("first_failure_at"), "last_failure_at": _time("last_failure_at"), "next_retry_at": _optional("next_retry_at", _time("next_retry_at")),
        "failure_category": _text("failure_category"), "evidence_refs": "evidence_refs IS NOT NULL", "exhausted": "exhausted IS NOT NULL",
    },
    "breaker": {
        "schema_version": "schema_version = 1", "provider": _text("provider"), "state": _one_of("state", BREAKER), "revision": "revision >= 0", "failure_count": "failure_count >= 0",
        "created_at": _time("created_at"), "updated_at": _time("updated_at"), "opened_at": _optional("opened_at", _time("opened_at")), "next_probe_at": _optional("next_probe_at", _time("next_probe_at")),
        "open_says_why": "state <> 'open' OR (opened_at IS NOT NULL AND next_probe_at IS NOT NULL AND length(reason) > 0)",
    },
    "daily_summary": {
        "schema_version": "schema_version = 1", "summary_type": "summary_type = 'daily_operational'", "day": "regexp_like(day, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')", "start": _time("start"), "end": _time("`end`"),
        "run_ids": "run_ids IS NOT NULL", "queue_before": "forall(map_values(queue_before), n -> n >= 0)", "queue_after": "forall(map_values(queue_after), n -> n >= 0)", "net_growth": "net_growth IS NOT NULL",
        **{r: _optional(r, f"{r} BETWEEN 0 AND 1") for r in RATES}, "median_hours": _optional("median_hours", "median_hours >= 0"), "review_only": "review_only AND NOT mutates_state",
    },
    "weekly_summary": {
        "schema_version": "schema_version = 1", "summary_type": "summary_type = 'weekly_human_review'", "start": _time("start"), "end": _time("`end`"),
        "groups": "size(array_except(array(" + ", ".join(repr(g) for g in GROUPS) + "), map_keys(`groups`))) = 0", "actionable": "actionable >= 0", "net_growth": "net_growth IS NOT NULL",
        "review_only": "review_only AND NOT mutates_state AND advisory",
    },
}


def record_violations(df: DataFrame, kind: str, key: str) -> DataFrame:
    """(key, rule) for each rule of its type that a record breaks; df has the flat columns that RULES[kind] names.

    computed_name is made here, of raw_name.
    """
    if "normalized_name" in RULES[kind]:
        df = df.withColumn("computed_name", name_key("raw_name"))
    return violations(df, key, {name: F.expr(condition) for name, condition in RULES[kind].items()})
