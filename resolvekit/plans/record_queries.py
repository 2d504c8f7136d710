"""Queries of the rules of checkpoints, run events, retries, breakers and summaries.

Records are made of the tables with faults where a number divides a row's key. The SQL doesn't read the rules: it says
by these numbers which row breaks which rule.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators import records
from .inputs import read
from .registry import query

_ZEROS = "sha256:" + "0" * 64
_RUN, _RUN_EVENT = "mr_discovery_run_00000000-0000-7000-8000-000000000000", "mr_discovery_run_event_00000000-0000-7000-8000-000000000000"


def _broken(table: str, key: str, faults: dict[str, str]) -> str:
    """SQL of the rows (key, rule) that break each rule, by conditions on k."""
    return " UNION ALL ".join(f"SELECT cast({key} AS string) AS key, '{rule}' AS rule FROM (SELECT {key}, {key} AS k FROM {table}) WHERE {where}" for rule, where in faults.items())


def _bad(k: Column, n: int, wrong, right) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(k % n == 0, lit(wrong)).otherwise(lit(right))


_CHECKPOINT = {
    "schema_version": "k % 43 = 0", "checkpoint_id": "k % 3 = 0 AND k % 2 = 0", "provider": "k % 41 = 0", "adapter_id": "k % 37 = 0", "adapter_version": "k % 31 = 0", "configuration_hash": "k % 29 = 0",
    "namespace": "k % 3 = 0", "revision": "k % 23 = 0", "page": "k % 19 = 0", "item_offset": "k % 17 = 0", "exhausted": "k % 13 = 0", "last_run_id": "k % 11 = 0", "evidence_ref": "k % 7 = 0",
    "created_at": "k % 47 = 0", "updated_at": "k % 53 = 0", "time_order": "k % 59 = 0 OR k % 47 = 0 OR k % 53 = 0",
}


@query(_broken("customer", "c_custkey", _CHECKPOINT))
def q1_checkpoint(spark, sf_dir):
    k = F.col("c_custkey")
    df = read(spark, sf_dir, "customer").select(
        k, _bad(k, 43, 2, 1).alias("schema_version"), _bad(k, 41, "Spotify", "spotify").alias("provider"), _bad(k, 37, "9x", "discovery").alias("adapter_id"), _bad(k, 31, "v0", "v2").alias("adapter_version"),
        _bad(k, 29, "hash", F.concat(F.lit("sha256:"), F.sha2(F.col("c_name"), 256))).alias("configuration_hash"), _bad(k, 23, 0, 4).alias("revision"), _bad(k, 19, -1, 0).alias("page"),
        _bad(k, 17, -2, 5).alias("item_offset"), _bad(k, 13, F.lit(None).cast("boolean"), False).alias("exhausted"), _bad(k, 11, "run 7", F.when(k % 2 == 0, _RUN)).alias("last_run_id"),
        _bad(k, 7, " ", F.lit(None).cast("string")).alias("evidence_ref"), _bad(k, 47, "soon", "2026-01-02").alias("created_at"), _bad(k, 53, "never", _bad(k, 59, "2026-01-01", "2026-01-03")).alias("updated_at"),
    )
    text = F.concat(*(x for name, key in (("provider", "provider"), ("adapterId", "adapter_id"), ("adapterVersion", "adapter_version"), ("stableConfigurationHash", "configuration_hash"))
        for x in (F.lit(f'"{name}":"'), F.col(key), F.lit('",' if key != "configuration_hash" else '"'))))
    own = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("{"), text, F.lit("}")), 256))
    return records.record_violations(df.withColumn("checkpoint_id", _bad(k, 3, F.when(k % 2 == 0, "sha256:0").otherwise(_ZEROS), own)), "checkpoint", "c_custkey")


_RUN_FAULTS = {
    "schema_version": "k % 43 = 0", "event_id": "k % 41 = 0", "run_id": "k % 37 = 0", "event_type": "k % 31 = 0", "previous_revision": "k % 29 = 0", "run_revision": "k % 23 = 0",
    "occurred_at": "k % 19 = 0", "actor_type": "k % 17 = 0", "created_first": "k % 31 > 0 AND k % 5 = 0 AND (k % 29 = 0 OR k % 13 = 0)", "phase": "k % 31 > 0 AND k % 5 = 1 AND (k % 13 = 0 OR k % 11 = 0)",
    "execution": "k % 31 > 0 AND k % 5 = 2 AND (k % 13 = 0 OR k % 11 = 0 OR k % 7 = 0)", "control": "k % 31 > 0 AND k % 5 > 2 AND (k % 13 = 0 OR k % 7 = 0)",
}


@query(_broken("events", "event_id", _RUN_FAULTS))
def q1_run_event(spark, sf_dir):
    k = F.col("k")
    kind = F.when(k % 5 == 0, "run_created").when(k % 5 == 1, "phase_completed").when(k % 5 == 2, "provider_execution_recorded").when(k % 5 == 3, "run_paused").otherwise("run_stopped")
    before = _bad(k, 29, -1, F.when(k % 5 == 0, 0).otherwise(k % 6))
    phase = F.when(k % 5 == 0, _bad(k, 13, "summary_complete", "created")).when(k % 5 == 1, _bad(k, 13, "created", "stage3_complete")).otherwise(F.when(k % 13 == 0, "created"))
    df = read(spark, sf_dir, "events").select(F.col("event_id").alias("k"), "ts").select(
        k, _bad(k, 43, 2, 1).alias("schema_version"), _bad(k, 41, "e", _RUN_EVENT).alias("event_id"), _bad(k, 37, "r", _RUN).alias("run_id"), _bad(k, 31, "noted", kind).alias("event_type"),
        before.alias("previous_revision"), (before + _bad(k, 23, 2, 1)).alias("run_revision"), _bad(k, 19, "then", F.col("ts").cast("string")).alias("occurred_at"), _bad(k, 17, "ghost", "worker").alias("actor_type"),
        phase.alias("phase"), F.when(k % 5 < 2, F.when((k % 5 == 1) & (k % 11 == 0), "done").otherwise("completed")).alias("disposition"), _bad(k, 7, " ", "spotify").alias("provider"),
        F.when(k % 7 == 0, " ").when(k % 11 == 0, "discogs").otherwise("spotify").alias("breaker_provider"), F.lit("half_open").alias("breaker_state"), _bad(k, 7, F.lit(None).cast("string"), "held").alias("reason"),
    )
    return records.record_violations(df, "run_event", "k").select("key", "rule")


_RETRY = {
    "schema_version": "k % 43 = 0", "candidate_id": "k % 41 = 0", "provider": "k % 37 = 0", "operation": "k % 31 = 0", "attempt_count": "k % 29 = 0", "first_failure_at": "k % 23 = 0", "last_failure_at": "k % 19 = 0",
    "next_retry_at": "k % 17 = 0", "failure_category": "k % 13 = 0", "evidence_refs": "k % 11 = 0", "exhausted": "k % 7 = 0",
}


@query(_broken("orders", "o_orderkey", _RETRY))
def q1_retry(spark, sf_dir):
    k = F.col("o_orderkey")
    df = read(spark, sf_dir, "orders").select(
        k, _bad(k, 43, 0, 1).alias("schema_version"), _bad(k, 41, "", "c").alias("candidate_id"), _bad(k, 37, " ", "spotify").alias("provider"), _bad(k, 31, F.lit(None).cast("string"), "get").alias("operation"),
        _bad(k, 29, 0, 2).alias("attempt_count"), _bad(k, 23, "x", "2026-01-01").alias("first_failure_at"), _bad(k, 19, F.lit(None).cast("string"), "2026-01-02").alias("last_failure_at"),
        _bad(k, 17, "x", F.when(k % 2 == 0, "2026-01-03")).alias("next_retry_at"), _bad(k, 13, " ", "transient").alias("failure_category"),
        _bad(k, 11, F.lit(None).cast("array<string>"), F.array(F.lit("r"))).alias("evidence_refs"), _bad(k, 7, F.lit(None).cast("boolean"), True).alias("exhausted"),
    )
    return records.record_violations(df, "retry", "o_orderkey")


_BREAKER = {
    "schema_version": "k % 43 = 0", "provider": "k % 41 = 0", "state": "k % 37 = 0", "revision": "k % 31 = 0", "failure_count": "k % 29 = 0", "created_at": "k % 23 = 0", "updated_at": "k % 19 = 0", "opened_at": "k % 17 = 0",
    "next_probe_at": "k % 13 = 0", "open_says_why": "k % 37 > 0 AND k % 3 = 1 AND (k % 11 = 0 OR (k % 17 > 0 AND k % 7 = 0))",
}


@query(_broken("part", "p_partkey", _BREAKER))
def q1_breaker(spark, sf_dir):
    k = F.col("p_partkey")
    state = F.when(k % 37 == 0, "ajar").when(k % 3 == 0, "closed").when(k % 3 == 1, "open").otherwise("half_open")
    df = read(spark, sf_dir, "part").select(
        k, _bad(k, 43, 0, 1).alias("schema_version"), _bad(k, 41, " ", "p").alias("provider"), state.alias("state"), _bad(k, 31, -1, 0).alias("revision"), _bad(k, 29, -1, 3).alias("failure_count"),
        _bad(k, 23, "x", "2026-01-01").alias("created_at"), _bad(k, 19, "y", "2026-01-01").alias("updated_at"), _bad(k, 17, "z", _bad(k, 7, F.lit(None).cast("string"), "2026-01-01")).alias("opened_at"),
        _bad(k, 13, "w", "2026-01-02").alias("next_probe_at"), _bad(k, 11, "", "failures").alias("reason"),
    )
    return records.record_violations(df, "breaker", "p_partkey")


_PRIMES = dict(zip(records.RATES, (11, 13, 17, 19, 23, 29, 31, 37, 41), strict=True))
_DAILY = {"schema_version": "k % 43 = 0", "summary_type": "k % 47 = 0", "day": "k % 53 = 0", "start": "k % 59 = 0", "end": "k % 61 = 0", "run_ids": "k % 67 = 0", "queue_before": "k % 71 = 0", "queue_after": "k % 73 = 0",
    "net_growth": "k % 79 = 0", **{r: f"k % {n} = 0" for r, n in _PRIMES.items()}, "median_hours": "k % 83 = 0", "review_only": "k % 7 = 0"}


@query(_broken("customer", "c_custkey", _DAILY))
def q1_daily_summary(spark, sf_dir):
    k = F.col("c_custkey")
    counts = lambda n: F.create_map(F.lit("a"), F.lit(1), F.lit("b"), _bad(k, n, -1, 0))
    df = read(spark, sf_dir, "customer").select(
        k, _bad(k, 43, 0, 1).alias("schema_version"), _bad(k, 47, "weekly", "daily_operational").alias("summary_type"), _bad(k, 53, "2026-1-1", "2026-01-01").alias("day"), _bad(k, 59, "x", "2026-01-01").alias("start"),
        _bad(k, 61, "x", "2026-01-02").alias("end"), _bad(k, 67, F.lit(None).cast("array<string>"), F.array(F.lit("r"))).alias("run_ids"), counts(71).alias("queue_before"), counts(73).alias("queue_after"),
        _bad(k, 79, F.lit(None).cast("int"), -3).alias("net_growth"), *(_bad(k, n, 1.5, F.when(k % 2 == 0, 0.25)).alias(r) for r, n in _PRIMES.items()), _bad(k, 83, -1.0, F.when(k % 2 == 0, 3.0)).alias("median_hours"),
        F.lit(True).alias("review_only"), (k % 7 == 0).alias("mutates_state"),
    )
    return records.record_violations(df, "daily_summary", "c_custkey")


_WEEKLY = {"schema_version": "k % 43 = 0", "summary_type": "k % 41 = 0", "start": "k % 37 = 0", "end": "k % 31 = 0", "groups": "k % 29 = 0", "actionable": "k % 23 = 0", "net_growth": "k % 19 = 0", "review_only": "k % 17 = 0"}


@query(_broken("supplier", "s_suppkey", _WEEKLY))
def q1_weekly_summary(spark, sf_dir):
    k = F.col("s_suppkey")
    every = F.map_from_arrays(F.array(*map(F.lit, records.GROUPS)), F.array(*(F.lit(i) for i in range(len(records.GROUPS)))))
    df = read(spark, sf_dir, "supplier").select(
        k, _bad(k, 43, 0, 1).alias("schema_version"), _bad(k, 41, "daily", "weekly_human_review").alias("summary_type"), _bad(k, 37, "x", "2026-01-01").alias("start"), _bad(k, 31, "x", "2026-01-08").alias("end"),
        _bad(k, 29, F.map_filter(every, lambda g, _: g != records.GROUPS[2]), every).alias("groups"), _bad(k, 23, -1, 9).alias("actionable"), _bad(k, 19, F.lit(None).cast("int"), 0).alias("net_growth"),
        F.lit(True).alias("review_only"), F.lit(False).alias("mutates_state"), (k % 17 != 0).alias("advisory"),
    )
    return records.record_violations(df, "weekly_summary", "s_suppkey")
