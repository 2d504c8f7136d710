"""State of candidates and runs from append-only event logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import content_id, reasons
from .numbering import numbered

#: States, what may follow each, and the classes that other operators use.
TRANSITIONS = {
    "discovered": ("identity_discovery_pending", "identity_pending", "duplicate", "needs_review", "failed"),
    "identity_discovery_pending": ("identity_discovering", "duplicate", "needs_review", "rejected"),
    "identity_discovering": ("identity_pending", "needs_review", "conflicting_identity", "duplicate", "retry_wait", "failed"),
    "identity_pending": ("identity_resolving", "duplicate", "needs_review", "rejected"),
    "identity_resolving": ("identity_coherent", "needs_review", "conflicting_identity", "failed_match", "retry_wait", "failed"),
    "identity_coherent": ("enrichment_pending", "validation_pending", "needs_review", "duplicate"),
    "enrichment_pending": ("enriching", "validation_pending", "needs_review", "retry_wait"),
    "enriching": ("validation_pending", "needs_review", "retry_wait", "failed"),
    "validation_pending": ("ready_for_live", "needs_review", "duplicate", "failed"),
    "needs_review": ("identity_discovery_pending", "identity_pending", "identity_coherent", "validation_pending", "approved", "duplicate", "rejected"),
    "conflicting_identity": ("identity_pending", "needs_review", "rejected"),
    "failed_match": ("identity_pending", "needs_review", "rejected"),
    "duplicate": ("needs_review", "rejected"),
    "retry_wait": ("identity_discovery_pending", "identity_pending", "enrichment_pending", "enriching", "validation_pending", "needs_review"),
    "ready_for_live": ("approved", "needs_review", "duplicate"),
    "approved": ("migration_pending", "needs_review"),
    "migration_pending": ("migrated", "approved", "failed"),
    "migrated": (),
    "rejected": (),
    "failed": ("identity_discovery_pending", "identity_pending", "enrichment_pending", "validation_pending", "rejected"),
}
EVENT_TYPES = ("candidate_discovered", "state_transition", "discovery_attached", "candidate_identifier_attached")
#: Minutes after the first, second and third failure, and hours after which retries end.
RETRY_MINUTES, RETRY_HOURS = (15, 120, 1440), 72
ROUTES = {
    "coherent_identity_evidence": "identity_coherent",
    "coherent_identity_with_same_name_ambiguity": "needs_review",
    "insufficient_corroboration": "needs_review",
    "provider_profile_multiplicity": "needs_review",
    "semantic_identity_conflict": "conflicting_identity",
    "unresolved_identity": "failed_match",
}
#: Reasons of these routes, and of several profiles that are closed.
ROUTE_REASONS = {
    "coherent_identity_evidence": "identity_evidence_coherent",
    "coherent_identity_with_same_name_ambiguity": "identity_same_name_ambiguity_requires_review",
    "insufficient_corroboration": "identity_corroboration_insufficient",
    "provider_profile_multiplicity": "identity_provider_multiplicity_requires_review",
    "semantic_identity_conflict": "semantic_identity_conflict_detected",
    "unresolved_identity": "no_safe_exact_identity_resolved",
}
CLOSED_REASON = "identity_provider_multiplicity_mechanically_closed"


def transition_table(spark) -> DataFrame:
    rows = [(None, "discovered"), *((a, b) for a, to in TRANSITIONS.items() for b in to)]
    return spark.createDataFrame(rows, "previous_state string, next_state string")


def latest_by(df: DataFrame, key: list[str], order: str, before=None, time: str = "updated_at") -> DataFrame:
    """The row of each key with the highest order value, among those before an instant if one is given."""
    if before is not None:
        df = df.where(F.col(time) < F.lit(before).cast("timestamp"))
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def replay(events: DataFrame) -> DataFrame:
    """The state of each candidate after all its events, in order of revision.

    events: candidate_id, candidate_revision, event_type, next_state, reason_code, occurred_at, occurrence_id,
    identifier. Values that an event sets are those of the last event that sets them; attachments are lists in
    order of revision, each once.
    """
    r = F.col("candidate_revision")
    attach = F.when((F.col("event_type") == "discovery_attached") | (F.col("event_type") == "candidate_discovered"), F.col("occurrence_id"))
    out = events.groupBy("candidate_id").agg(
        F.max(r).alias("revision"), F.max_by("next_state", r).alias("state"), F.min_by("occurred_at", r).alias("created_at"),
            F.max_by("occurred_at", r).alias("updated_at"),
        F.max_by("reason_code", r).alias("last_reason"), F.max_by("identifier", F.when(F.col("identifier").isNotNull(), r)).alias("external_id"),
        F.array_sort(F.collect_list(F.when(attach.isNotNull(), F.struct(r.alias("r"), attach.alias("o"))))).alias("_o"),
        F.count_if(F.col("event_type") == "state_transition").alias("transitions"),
    )
    return out.withColumn("occurrences", F.array_distinct(F.transform("_o", lambda x: x["o"]))).drop("_o")


def validate_log(events: DataFrame, transitions: DataFrame, key: str = "candidate_id", revision: str = "candidate_revision") -> DataFrame:
    """(key, revision, fault): every fault of a log, a row each; a log that begins late has a gap, it isn't an error here."""
    w = Window.partitionBy(key).orderBy(revision)
    df = events.withColumn("_before", F.lag("next_state").over(w)).withColumn("_rev", F.lag(revision).over(w))
    legal = transitions.select("previous_state", "next_state", F.lit(True).alias("_legal"))
    df = df.join(F.broadcast(legal) if _is_small(transitions) else legal,
        df["previous_state"].eqNullSafe(legal["previous_state"]) & (df["next_state"] == legal["next_state"]),
            "left").drop(legal["previous_state"]).drop(legal["next_state"])
    first = F.col("_rev").isNull()
    moves = F.col("event_type") == "state_transition"
    faults = reasons(
        ("revision_gap", (first & (F.col(revision) != 1)) | (~first & (F.col(revision) != F.col("_rev") + 1))),
        ("first_not_discovered", first & (F.col("event_type") != "candidate_discovered")),
        ("state_drift", ~first & ~F.col("previous_state").eqNullSafe(F.col("_before"))),
        ("illegal_transition", moves & F.col("_legal").isNull()),
        ("attachment_moves_state", F.col("event_type").isin(*EVENT_TYPES[2:]) & ~F.col("previous_state").eqNullSafe(F.col("next_state"))),
    )
    out = df.select(key, revision, F.explode(faults).alias("fault"))
    if "occurrence_id" in events.columns:
        again = events.where("event_type = 'discovery_attached' and occurrence_id is not null").groupBy(key,
            "occurrence_id").agg(F.max(revision).alias(revision), F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(again.select(key, revision, F.lit("repeated_attachment").alias("fault")))
    if "identifier" in events.columns:
        over = events.where("identifier is not null").groupBy(key).agg(F.max(revision).alias(revision), F.countDistinct("identifier").alias("n")).where("n > 1")
        out = out.unionByName(over.select(key, revision, F.lit("identifier_overwritten").alias("fault")))
    return out


def _is_small(table: DataFrame) -> bool:
    """Whether a table of legal steps, instants or types is small enough to broadcast: 10,000 rows at most."""
    return table.limit(10_001).count() <= 10_000


#: Instants of a time range, about; shares that the candidates of a range are dealt into.
PER_RANGE, SHARES = 64, 32


def states_as_of(events: DataFrame, instants: DataFrame, inclusive: bool = False, small: int | None = None) -> DataFrame:
    """(instant, candidate_id, state, created_at): the state of each candidate at each instant.

    Up to `small` instants (10,000) are broadcast. More of them are dealt into time ranges, and so are the intervals
    between a candidate's events, each with the state so far: an interval goes to the ranges that it touches, in the
    candidate's share, and meets the instants there by an equi-join.
    """
    instants = instants.select("instant").where("instant is not null").distinct()
    if _is_small(instants) if small is None else instants.limit(small + 1).count() <= small:
        at = F.col("occurred_at") <= F.col("instant") if inclusive else F.col("occurred_at") < F.col("instant")
        seen = events.join(F.broadcast(instants), at)
        return seen.groupBy("instant", "candidate_id").agg(F.max_by("next_state", "candidate_revision").alias("state"), F.min("occurred_at").alias("created_at"))
    w = Window.partitionBy("candidate_id").orderBy("occurred_at")  # events of one time are in each other's frame
    spans = events.where("occurred_at is not null").select(
        "candidate_id", F.max_by("next_state", "candidate_revision").over(w).alias("state"), F.min("occurred_at").over(w).alias("created_at"),
            "occurred_at", F.lead("occurred_at").over(w).alias("_until"),
    )
    since, until, now = F.col("occurred_at"), F.col("_until"), F.col("instant")
    within = (since <= now) & (until.isNull() | (now < until)) if inclusive else (since < now) & (until.isNull() | (now <= until))
    tick = F.unix_micros if instants.schema["instant"].dataType.typeName() == "timestamp" else lambda c: F.col(c).cast("long")  # times may be numbers too
    low, high, n = instants.agg(F.min(tick("instant")), F.max(tick("instant")), F.count("*")).first()
    if not n:
        return spans.select(F.lit(None).cast(instants.schema["instant"].dataType).alias("instant"), "candidate_id", "state", "created_at").limit(0)
    ranges = max(1, n // PER_RANGE)
    width = max(1, -(-(high - low + 1) // ranges))
    range_of = lambda t: F.least(F.greatest(F.floor((t - low) / width), F.lit(0)), F.lit(ranges - 1))
    touched = F.sequence(range_of(tick("occurred_at")), range_of(F.coalesce(tick("_until"), F.lit(high))))
    share = F.pmod(F.xxhash64("candidate_id"), F.lit(SHARES))
    spans = spans.where((tick("occurred_at") <= high) & (F.col("_until").isNull() | (tick("_until") >= low)))
    spans = spans.withColumn("_share", share).withColumn("_range", F.explode(touched))
    shares = F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))
    instants = instants.withColumn("_range", range_of(tick("instant"))).withColumn("_share", F.explode(shares))
    return spans.join(instants, ["_range", "_share"]).where(within).select("instant", "candidate_id", "state", "created_at")


def emit_events(decisions: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, refused) for decisions(candidate_id, expected_revision, event_type, next_state, reason_code, occurred_at, occurrence_id, identifier).

    An event has the next revision and an id made of its content. A decision that was made for another revision
    is refused as stale, one whose occurrence is attached already as inert, one with an illegal step as illegal.
    """
    now = candidates.select("candidate_id", "revision", "state", F.col("occurrences").alias("_have"))
    df = decisions.join(now, "candidate_id", "left")
    legal = transition_table(decisions.sparkSession).withColumn("_legal", F.lit(True))
    df = df.join(legal, df["state"].eqNullSafe(legal["previous_state"]) & (df["next_state"] == legal["next_state"]),
        "left").drop(legal["previous_state"]).drop(legal["next_state"])
    inert = (F.col("event_type") == "discovery_attached") & F.coalesce(F.array_contains("_have", F.col("occurrence_id")), F.lit(False))
    why = F.when(inert, "inert").when(F.col("revision").isNotNull() & (F.col("expected_revision") != F.col("revision")),
        "stale").when((F.col("event_type") == "state_transition") & F.col("_legal").isNull(), "illegal")
    df = df.withColumn("refused", why)
    keep = F.col("event_type").isin(*EVENT_TYPES[2:])
    events = df.where("refused is null").select(
        "candidate_id", "event_type", F.col("state").alias("previous_state"), F.when(keep, F.col("state")).otherwise(F.col("next_state")).alias("next_state"),
        F.coalesce("revision", F.lit(0)).alias("previous_revision"), (F.coalesce("revision", F.lit(0)) + 1).alias("candidate_revision"),
            "reason_code", "occurred_at", "occurrence_id", "identifier",
    )
    events = events.withColumn("event_id", content_id("candidate_id", "candidate_revision", "event_type", "next_state"))
    return events, df.where("refused is not null").select("candidate_id", "event_type", "expected_revision", "revision", "refused")


def verify_snapshot(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Rows in which a stored snapshot and the replay of its events differ, with the side they are on."""
    fresh = replay(events).select(*snapshot.columns)
    return snapshot.exceptAll(fresh).withColumn("side", F.lit("snapshot")).unionByName(fresh.exceptAll(snapshot).withColumn("side", F.lit("replay")))


def retry_schedule(failures: DataFrame) -> DataFrame:
    """failures(candidate_id, provider, operation, occurred_at, retry_after, evidence_refs) with the retry after each.

    retry_after is in seconds or an HTTP instant. Delays are 15 min, 2 h and 24 h, or retry_after if longer; it ends
    after three delays, or 72 h after the first failure.
    """
    w = Window.partitionBy("candidate_id", "provider", "operation").orderBy("occurred_at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = failures.withColumn("attempt", F.row_number().over(w)).withColumn("first_failure_at", F.first("occurred_at").over(upto))
    if "evidence_refs" in failures.columns:
        df = df.withColumn("evidence", F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_refs").over(upto)))))
    t = F.col("occurred_at").cast("double")
    elapsed = t - F.col("first_failure_at").cast("double")
    late = elapsed >= RETRY_HOURS * 3600
    wait = F.col("retry_after").try_cast("double")
    server = F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0))).otherwise(F.coalesce(F.greatest(F.lit(0.0),
        F.try_to_timestamp("retry_after").cast("double") - t), F.lit(0.0)))
    policy = F.element_at(F.array(*(F.lit(60.0 * m) for m in RETRY_MINUTES)), F.least(F.col("attempt"), F.lit(3)))
    exhausted = (F.col("attempt") > len(RETRY_MINUTES)) | late
    df = df.withColumn("exhausted", exhausted).withColumn("exhaustion_reason", F.when(late, "retry_elapsed_time_exhausted").when(exhausted, "retry_attempts_exhausted"))
    return df.withColumn("next_retry_at", F.when(~exhausted, F.timestamp_seconds(t + F.greatest(policy, server))))


def evaluate_retries(schedule: DataFrame, now) -> DataFrame:
    """The last row of each record of retry_schedule, as it stands at an instant: 72 h after its first failure it has ended, also without another one."""
    key, t = ["candidate_id", "provider", "operation"], F.lit(now).cast("timestamp").cast("double")
    last = latest_by(schedule, key, "attempt")
    old = t - F.col("first_failure_at").cast("double") >= RETRY_HOURS * 3600
    reason = F.when(F.col("exhausted"), F.col("exhaustion_reason")).when(old, "retry_elapsed_time_exhausted")
    return last.withColumn("exhaustion_reason", reason).withColumn("next_retry_at", F.when(~(F.col("exhausted") | old), F.col("next_retry_at"))).withColumn("exhausted", F.col("exhausted") | old)


def route_exhausted(candidates: DataFrame, retries: DataFrame) -> DataFrame:
    """Decisions that put candidates in retry_wait on review hold where a retry of theirs is exhausted."""
    done = retries.where("exhausted").groupBy("candidate_id").agg(F.max("occurred_at").alias("occurred_at"))
    out = candidates.where("state = 'retry_wait'").join(done, "candidate_id")
    return out.select("candidate_id", F.col("revision").alias("expected_revision"), F.lit("state_transition").alias("event_type"),
        F.lit("needs_review").alias("next_state"), F.lit("retry_budget_exhausted").alias("reason_code"), "occurred_at",
            F.lit(None).cast("string").alias("occurrence_id"), F.lit(None).cast("string").alias("identifier"))


#: Candidates of a state up to which a task may take all that are picked of it.
FEW_WORK = 10_000


def select_work(candidates: DataFrame, state: str | None, n: int, places: bool = True) -> DataFrame:
    """The n oldest candidates of a state (of each state if None) by (updated_at, candidate_id), with queue_place if places.

    For few, each task keeps the first n of a state before they meet. A larger batch is numbered by ranges, so that no
    task has a whole state. Without places a batch that takes all of each state is only counted: nothing is put in order.
    """
    df = candidates if state is None else candidates.where(F.col("state") == state)
    if not places:
        most = df.groupBy("state").count().agg(F.max("count")).first()[0] if n > FEW_WORK else None
        return df if n > FEW_WORK and (most or 0) <= n else select_work(candidates, state, n).drop("queue_place")
    if n <= FEW_WORK:
        w = Window.partitionBy("state").orderBy("updated_at", "candidate_id")
        return df.withColumn("queue_place", F.row_number().over(w)).where(F.col("queue_place") <= n)
    df = numbered(df, [F.col(c).asc_nulls_first() for c in ("state", "updated_at", "candidate_id")], "_place")
    # one row a state
    before = df.groupBy("state").agg((F.min("_place") - 1).alias("_before")).withColumnRenamed("state", "_state")
    df = df.join(F.broadcast(before), F.col("state").eqNullSafe(F.col("_state"))).withColumn("queue_place", (F.col("_place") - F.col("_before")).cast("int"))
    return df.where(F.col("queue_place") <= n).drop("_place", "_before", "_state")


def failure_class(code: str = "status_code"):
    c = F.col(code)
    return F.when(c.isin(401, 403), "authentication_or_configuration").when(c.isin(404, 409, 410, 422),
        "permanent_absence").when(c.isNull() | c.isin(408, 425, 429, 500, 502, 503, 504), "transient").otherwise("permanent")


def failure_metrics(calls: DataFrame) -> DataFrame:
    """Calls, failures by class and waits of each provider of calls(provider, status_code, retry_after); 2xx and 3xx are successes."""
    ok = F.col("status_code").between(200, 399)
    kind = F.when(~F.coalesce(ok, F.lit(False)), failure_class())
    df = calls.withColumn("kind", kind)
    return df.groupBy("provider").agg(
        F.count("*").alias("requests"), F.count_if(F.col("kind").isNull()).alias("successes"),
        *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("authentication_or_configuration", "authentication_failures"),
            ("permanent_absence", "permanent_absences"), ("transient", "transient_failures"), ("permanent", "permanent_failures"))),
    )


#: A closed breaker: state, failures, time of the next probe, kind and run of the failure that opened it.
CLOSED = ("closed", 0, None, None, None)


def breaker_step(breaker: tuple, at: float, kind: str | None, retry_after: float, run: str | None, threshold: int, probe_seconds: float) -> tuple[tuple, bool]:
    """(the breaker after a call, whether the call was skipped); kind is None for a success.

    An open breaker lets a call through as a probe once its time has come. After an authentication failure it stays
    shut for the run that had it, whatever the time, and another run probes at once.
    """
    state, count, probe, cause, owner = breaker
    if state == "open":
        bound = cause == "authentication_or_configuration" and run is not None
        if (run == owner) if bound else at < probe:
            return breaker, True
        state = "half_open"
    if kind is None:
        return CLOSED, False
    if kind not in ("authentication_or_configuration", "transient"):
        return (state, count, probe, cause, owner), False
    if kind != "transient" or state == "half_open" or count + 1 >= threshold:
        return ("open", count + 1, at + max(probe_seconds, retry_after), kind, run if run is not None else owner), False
    return (state, count + 1, probe, kind, run if run is not None else owner), False


def breaker_history(calls: DataFrame, threshold: int = 2, probe_seconds: float = 900.0) -> DataFrame:
    """The breaker after each call of calls(provider, call_id, occurred_at double, kind, retry_after double, run_id if there is one).

    kind is null for a success. A breaker depends on all calls before, so a provider's calls are folded in order; they
    come sorted, a batch at a time, and only the breaker is carried over.
    """
    schema = "provider string, call_id long, state string, failure_count int, skipped boolean, next_probe_at double"

    def run(batches):
        at, breaker = None, CLOSED
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.provider != at:
                    at, breaker = r.provider, CLOSED
                text = lambda x: x if isinstance(x, str) else None
                breaker, skipped = breaker_step(breaker, r.occurred_at, text(r.kind), 0.0 if pd.isna(r.retry_after) else r.retry_after,
                    text(r.run_id), threshold, probe_seconds)
                out.append((r.provider, r.call_id, breaker[0], breaker[1], skipped, breaker[2]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    run_id = F.col("run_id") if "run_id" in calls.columns else F.lit(None).cast("string").alias("run_id")
    df = calls.select("provider", "call_id", "occurred_at", "kind", "retry_after", run_id)
    return df.repartition("provider").sortWithinPartitions("provider", "occurred_at", "call_id").mapInPandas(run, schema)


#: Phases of a run in order, and the events of its journal.
PHASES = (
    "created",
    "spotify_discovery_complete_or_skipped",
    "ticketmaster_discovery_complete_or_skipped",
    "convergence_complete",
    "stage3_complete",
    "identity_discovery_complete",
    "summary_complete",
)
RUN_EVENTS = ("run_created", "phase_completed", "provider_execution_recorded", "run_paused", "run_resumed", "run_stopped")


def replay_runs(run_events: DataFrame) -> DataFrame:
    """The state of each run after its journal.

    run_events: run_id, revision, event_type, phase, disposition (completed or skipped), reason (of a pause or stop),
    provider, requests (the budget used so far), checksum (of what must not change: at the start and at the end).
    Columns: run_id, revision, phases_done, skipped_phases, last_phase, first_open_phase, status, pause_reason,
    stop_reason, requests, providers (the last budget of each), checksum_changed, faults (names, with repetitions).
    """
    kind, r = F.col("event_type"), F.col("revision")
    place = F.when(kind == "run_created", 1).when(kind == "phase_completed", F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")))
    ends = (kind == "phase_completed") & (F.col("phase") == PHASES[-1])
    control = F.when(kind.isin("run_created", "run_resumed"), "running").when(kind == "run_paused", "paused").when(kind == "run_stopped",
        "stopped").when(ends, "completed")
    w = Window.partitionBy("run_id").orderBy("revision")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = run_events.withColumn("_place", place).withColumn("_control", control)
    df = df.withColumn("_prev", F.lag("revision").over(w)).withColumn("_before", F.last("_place", True).over(past)).withColumn("_was",
        F.last("_control", True).over(past))
    was, first = F.coalesce("_was", F.lit("none")), F.col("_prev").isNull()
    faults = reasons(
        ("revision_gap", F.when(first, r != 1).otherwise(r != F.col("_prev") + 1)),
        ("not_created_first", first != (kind == "run_created")),
        ("phase_out_of_order", (kind == "phase_completed") & ~F.coalesce(F.col("_place") == F.col("_before") + 1, F.lit(False))),
        ("paused_while_not_running", (kind == "run_paused") & (was != "running")),
        ("resumed_while_not_paused", (kind == "run_resumed") & (was != "paused")),
        ("stopped_while_not_active", (kind == "run_stopped") & ~was.isin("running", "paused")),
    )
    df = df.withColumn("_faults", faults)
    last = lambda c, when=None: F.max_by(c, F.when(when if when is not None else F.col(c).isNotNull(), r))
    by_provider = F.map_from_entries(F.transform(F.array_sort(F.collect_set(F.struct("provider", "_last"))), lambda x: F.struct(x["provider"], x["_last"])))
    runs = df.groupBy("run_id").agg(
        F.max(r).alias("revision"), F.coalesce(last("_place"), F.lit(0)).cast("long").alias("phases_done"),
            F.count_if(F.col("disposition") == "skipped").alias("skipped_phases"),
        last("_control").alias("status"), last(F.when(kind == "run_paused", F.col("reason")),
            kind.isin("run_created", "run_paused", "run_resumed") | ends).alias("pause_reason"),
        last(F.when(kind == "run_stopped", F.col("reason")), kind.isin("run_created", "run_stopped", "run_resumed") | ends).alias("stop_reason"),
        last("requests").alias("requests"), (F.min_by("checksum", r) != last("checksum")).alias("checksum_changed"),
            F.array_sort(F.flatten(F.collect_list("_faults"))).alias("faults"),
    )
    lanes = run_events.where(kind == "provider_execution_recorded").groupBy("run_id",
        "provider").agg(F.max_by("requests", "revision").alias("_last")).groupBy("run_id").agg(by_provider.alias("providers"))
    phase = lambda k: F.try_element_at(F.array(*map(F.lit, PHASES)), (F.col("phases_done") + k).cast("int"))
    out = runs.join(lanes, "run_id", "left").withColumn("last_phase", F.when(F.col("phases_done") > 0, phase(0))).withColumn("first_open_phase", phase(1))
    return out.select("run_id", "revision", "phases_done", "skipped_phases", "last_phase", "first_open_phase", "status", "pause_reason",
        "stop_reason", "requests", "providers", "checksum_changed", "faults")


def run_identity_batch(candidates: DataFrame, outcomes: DataFrame, now, n: int = 25, lease_minutes: int = 5) -> DataFrame:
    """Decisions of one batch of the identity worker over candidates(candidate_id, state, revision, updated_at, retry_at, resume_state).

    Work whose lease ran out waits for a retry, retries that are due resume, and of the n oldest pending candidates
    those with an outcome are routed by it; without one they stay as they are. An outcome that isn't known goes to review
    as unrouted_outcome.
    """
    from .resolution import route_outcome

    t = F.lit(now).cast("timestamp")
    row = lambda df, state, why: df.select("candidate_id", F.col("revision").alias("expected_revision"),
        F.lit("state_transition").alias("event_type"), state.alias("next_state"), why.alias("reason_code"), t.alias("occurred_at"),
            F.lit(None).cast("string").alias("occurrence_id"), F.lit(None).cast("string").alias("identifier"))
    expired = candidates.where(F.col("state").isin("identity_resolving",
        "identity_discovering") & (F.col("updated_at") <= t - F.expr(f"interval {lease_minutes} minutes")))
    due = candidates.where((F.col("state") == "retry_wait") & (F.col("retry_at") <= t))
    picked = select_work(candidates, "identity_pending", n, places=False).join(outcomes, "candidate_id")
    picked = route_outcome(picked.where("outcome is not null"))
    route, why = F.coalesce("next_state", F.lit("needs_review")), F.coalesce("reason_code", F.lit("unrouted_outcome"))
    # fixed values: reasons of the two workers
    late = F.when(F.col("state") == "identity_resolving", "identity_worker_lease_expired").otherwise("identity_discovery_lease_expired")
    resume = F.coalesce("resume_state", F.lit("identity_pending"))
    again = F.when(resume == "identity_pending", "identity_retry_became_eligible").otherwise("identity_discovery_retry_became_eligible")
    return row(expired, F.lit("retry_wait"), late).unionByName(row(due, resume, again)).unionByName(row(picked, route, why))


def run_bridge_batch(candidates: DataFrame, bridges: DataFrame, now, n: int = 25, known: DataFrame | None = None) -> DataFrame:
    """Decisions of one batch of the bridge worker: a unique bridge attaches its id, a conflict or several go to review; without a bridge row a candidate stays.

    bridges: candidate_id, status, external_id, as classify_bridges has them.
    known(external_id, holder, live) says who has an id already; live: an artist that is published. A bridge attaches its id first; then, by what is known and by
    the batch's own earlier bridges, the candidate is a duplicate of a holder, or its identity is pending.
    """
    t = F.lit(now).cast("timestamp")
    work = select_work(candidates, "identity_discovery_pending", n).join(bridges, "candidate_id")
    unique, conflict = F.col("status") == "unique_exact_bridge", F.col("status") == "conflicting_identity"
    nothing = F.lit(None).cast("string")
    decision = lambda revision, kind, state, why, identifier: ("candidate_id", revision.alias("expected_revision"), kind.alias("event_type"),
        state.alias("next_state"), why.alias("reason_code"), t.alias("occurred_at"), nothing.alias("occurrence_id"), identifier.alias("identifier"))
    out = work.select(*decision(F.col("revision"), F.when(unique, "candidate_identifier_attached").otherwise("state_transition"),
        F.when(unique, F.col("state")).when(conflict, "conflicting_identity").otherwise("needs_review"),
        # fixed values
        F.when(unique, "exact_spotify_bridge_discovered").when(conflict, "identity_discovery_semantic_or_exact_conflict").otherwise("identity_discovery_requires_review"),
        F.when(unique, F.col("external_id"))))
    if known is None:
        return out
    held = known.where("external_id is not null").groupBy("external_id").agg(F.collect_set("holder").alias("_holders"), F.max(F.coalesce("live", F.lit(False))).alias("_live"))
    first = F.min(F.struct("queue_place", "candidate_id")).over(Window.partitionBy("external_id"))["candidate_id"]
    found = work.where(unique).withColumn("_first", first).join(held, "external_id", "left")
    other = (F.size(F.array_remove(F.coalesce("_holders", F.array().cast("array<string>")), F.col("candidate_id"))) > 0) | (F.col("_first") != F.col("candidate_id"))
    after = found.select(*decision(F.col("revision") + 1, F.lit("state_transition"), F.when(other, "duplicate").otherwise("identity_pending"),
        F.when(other & F.coalesce("_live", F.lit(False)), "existing_live_spotify_binding_reused").when(other, "queued_spotify_duplicate_detected").otherwise("exact_spotify_bridge_ready_for_corroboration"), nothing))
    return out.unionByName(after)
