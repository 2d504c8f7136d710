"""Operational metrics over event logs, runs and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lifecycle import states_as_of
from .ranks import nearest_ranks

#: States that wait, that end identity work, and that a person reviews.
PENDING = ("identity_pending", "identity_discovery_pending", "retry_wait")
TERMINAL = ("identity_coherent", "needs_review", "conflicting_identity", "failed_match")
REVIEW = ("needs_review", "conflicting_identity", "failed_match", "retry_wait", "identity_coherent", "validation_pending")
COUNTERS = ("requests", "successes", "cache_hits", "retries", "errors", "retry_after_waits", "permanent_absences", "authentication_failures",
    "transient_failures", "skipped_lane_open")


def in_period(df: DataFrame, column: str, start, end) -> DataFrame:
    """start <= column < end, as a range that a scan can prune by."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp")))


def rate(a, b):
    """a / b to four decimals; null where b is 0."""
    return F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)


def queue_growth(events: DataFrame, start, end) -> DataFrame:
    """(state, before, after, growth): candidates of each state just before two instants."""
    spark = events.sparkSession
    at = spark.sql("select cast(:a as timestamp) instant union all select cast(:b as timestamp)", {"a": start, "b": end})
    states = states_as_of(events, at)
    is_ = lambda t: F.col("instant") == F.lit(t).cast("timestamp")
    out = states.groupBy("state").agg(F.count_if(is_(start)).alias("before"), F.count_if(is_(end)).alias("after"))
    return out.withColumn("growth", F.col("after") - F.col("before"))


def queue_ages(candidates: DataFrame, as_of, by: str | None = None) -> DataFrame:
    """Nearest-rank percentiles of candidates' age in hours, and the largest (0 for none). No task holds the ages of a state."""
    age = F.greatest(F.lit(0.0), (F.lit(as_of).cast("timestamp").cast("double") - F.col("created_at").cast("double")) / 3600)
    df = candidates.withColumn("age", age)
    group = by or "_all"
    df = df if by else df.withColumn(group, F.lit(0))
    total = df.groupBy(group).agg(F.round(F.coalesce(F.max("age"), F.lit(0.0)), 4).alias("max_hours"), F.count("*").alias("candidates"))
    if not by:  # a row also where there are no candidates
        total = total.select(group, "max_hours", "candidates").unionByName(df.sparkSession.sql("select 0 as _all, 0.0d as max_hours, 0L as candidates")).groupBy(group).agg(
            F.max("max_hours").alias("max_hours"), F.max("candidates").alias("candidates"))
    names = {q: f"p{int(q * 100)}_hours" for q in (0.5, 0.75, 0.9, 0.95)}
    ranks = nearest_ranks(df, "age", group, tuple(names))
    wide = ranks.groupBy(F.col(group).alias("_g")).agg(*(F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 4).alias(n) for q, n in names.items()))
    out = total.join(wide, total[group].eqNullSafe(wide["_g"]), "left").drop("_g")
    return out.select(*([by] if by else []), *names.values(), "max_hours", "candidates")


def time_to_terminal(events: DataFrame, start, end) -> DataFrame:
    """Median hours from discovery to the first terminal state, for those that fall into a period."""
    r = F.col("candidate_revision")
    ends = (F.col("event_type") == "state_transition") & F.col("next_state").isin(*TERMINAL)
    per = events.groupBy("candidate_id").agg(F.min_by("occurred_at", r).alias("born"), F.min_by("occurred_at", F.when(ends, r)).alias("done"))
    hours = (F.col("done").cast("double") - F.col("born").cast("double")) / 3600
    return in_period(per, "done", start, end).agg(F.round(F.median(hours), 4).alias("median_hours"), F.count("*").alias("candidates"))


def provider_rollup(runs: DataFrame) -> DataFrame:
    """Sums of each provider's counters over runs(run_id, updated_at, providers map<string, struct<metrics map<string,bigint>, breaker string, stop_reason string>>), its last breaker and its stop reasons."""
    df = runs.select("updated_at", F.explode("providers").alias("provider", "x"))
    sums = (F.coalesce(F.sum(F.coalesce(F.try_element_at("x.metrics", F.lit(c)), F.lit(0))), F.lit(0)).alias(c) for c in COUNTERS)
    return df.groupBy("provider").agg(*sums, F.max_by("x.breaker", F.when(F.col("x.breaker").isNotNull(), F.col("updated_at"))).alias("breaker"),
        F.array_sort(F.collect_set("x.stop_reason")).alias("stop_reasons"))


def budget_rollup(runs: DataFrame) -> DataFrame:
    """(lane, counter, used) of runs(budget map<string, map<string, bigint>>)."""
    lanes = runs.select(F.explode("budget").alias("lane", "used"))
    return lanes.select("lane", F.explode("used").alias("counter", "n")).groupBy("lane", "counter").agg(F.sum("n").alias("used"))


def worker_metrics(events: DataFrame, start, end) -> DataFrame:
    """One row of worker counts in a period: selections, outcomes, retries and exact bridges.

    An exact bridge is an identifier attached to a candidate that was discovered by an event listing (source_type
    ticketmaster_event of its discovery), whenever that was.
    """
    df = mark_listed(events)
    df = in_period(df, "occurred_at", start, end)
    move = F.col("event_type") == "state_transition"
    to, of = lambda *s: move & F.col("next_state").isin(*s), lambda *s: move & F.col("previous_state").isin(*s)
    entry, back, out = to("retry_wait"), of("retry_wait") & (F.col("next_state") != "needs_review"), F.col("reason_code") == "retry_budget_exhausted"
    return df.agg(
        F.count_if(to("identity_resolving")).alias("identity_selections"), F.count_if(to("identity_discovering")).alias("bridge_selections"),
        F.count_if(of("identity_resolving") & to("identity_coherent")).alias("coherent"), F.count_if(of("identity_resolving") & to("failed_match")).alias("failed_match"),
        F.count_if(of("identity_resolving", "identity_discovering") & to("needs_review", "conflicting_identity")).alias("review"),
        F.count_if(entry).alias("retry_entries"), F.count_if(back).alias("retry_recoveries"), F.count_if(out).alias("retry_exhaustions"),
        F.countDistinct(F.when(entry | back | out, F.col("candidate_id"))).alias("retry_candidates"),
            F.count_if(F.col("_listed") & (F.col("event_type") == "candidate_identifier_attached")).alias("exact_bridges"),
    )


def mark_listed(events: DataFrame) -> DataFrame:
    """events with _listed: whether the candidate was discovered by an event listing (a fixed value of source_type)."""
    found = events.where("event_type = 'candidate_discovered' and source_type = 'ticketmaster_event'").select("candidate_id").distinct().withColumn("_listed", F.lit(True))
    return events.join(found, "candidate_id", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))


def outcome_counts(events: DataFrame, start, end) -> DataFrame:
    """(worker, item, name, n) of a period: what left the two workers' states by state and by outcome, and candidates that newly entered a review state.

    events also has identity_outcome and bridge_outcome, each null where an event has none.
    """
    df = in_period(events, "occurred_at", start, end)
    move, out = df.where("event_type = 'state_transition'"), []
    for worker, state, column in (("identity", "identity_resolving", "identity_outcome"), ("bridge", "identity_discovering", "bridge_outcome")):
        left = move.where(F.col("previous_state") == state)
        for item, name in (("by_state", "next_state"), ("by_outcome", column)):
            out.append(left.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).select(F.lit(worker).alias("worker"), F.lit(item).alias("item"), F.col(name).alias("name"), "n"))
    entered = df.where(F.col("next_state").isin("needs_review", "conflicting_identity", "failed_match", "retry_wait"))
    entered = entered.groupBy("next_state").agg(F.countDistinct("candidate_id").alias("n")).select(F.lit("all").alias("worker"), F.lit("newly_entered").alias("item"), F.col("next_state").alias("name"), "n")
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(entered)


def outcomes_by_state(events: DataFrame, start, end) -> DataFrame:
    """(previous_state, next_state, events, candidates) of transitions in a period."""
    df = in_period(events, "occurred_at", start, end).where("event_type = 'state_transition'")
    return df.groupBy("previous_state", "next_state").agg(F.count("*").alias("events"), F.countDistinct("candidate_id").alias("candidates"))


def daily_summary(events: DataFrame, occurrences: DataFrame, associations: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """A row for each UTC day: counts, all rates (null on a zero denominator), and the median hours to a terminal state.

    events: those of worker_metrics. occurrences: discovered_at. associations: target_type, created_at. actions: what
    convergence recorded (created_at, action); on a day that has such rows they count, not events and associations.
    """
    day = lambda c: F.date_format(F.date_trunc("day", F.col(c)), "yyyy-MM-dd").alias("day")
    is_, move = lambda t: F.col("event_type") == t, F.col("event_type") == "state_transition"
    to, of = lambda *s: move & F.col("next_state").isin(*s), lambda *s: move & F.col("previous_state").isin(*s)
    entry, back, spent = to("retry_wait"), of("retry_wait") & (F.col("next_state") != "needs_review"), F.col("reason_code") == "retry_budget_exhausted"
    a = mark_listed(events).groupBy(day("occurred_at")).agg(
        F.count_if(is_("candidate_discovered")).alias("found"), F.count_if(is_("discovery_attached")).alias("attached"),
        F.count_if(to("identity_resolving")).alias("selections"), F.count_if(to("identity_discovering")).alias("bridge_selections"),
        F.count_if(of("identity_resolving") & to("identity_coherent")).alias("coherent"), F.count_if(of("identity_resolving") & to("failed_match")).alias("failed"),
        F.count_if(of("identity_resolving", "identity_discovering") & to("needs_review", "conflicting_identity")).alias("review"),
        F.count_if(back).alias("recoveries"), F.count_if(spent).alias("exhaustions"), F.countDistinct(F.when(entry | back | spent, F.col("candidate_id"))).alias("retried"),
        F.count_if(F.col("_listed") & is_("candidate_identifier_attached")).alias("bridges"),
    )
    b = occurrences.groupBy(day("discovered_at")).agg(F.count("*").alias("occurrences"))
    c = associations.where("target_type = 'live_artist'").groupBy(day("created_at")).agg(F.count("*").alias("known"))
    df = a.join(b, "day", "full").join(c, "day", "full")
    if actions is not None:
        said = lambda *names: F.count_if(F.col("action").isin(*names))
        df = df.join(actions.groupBy(day("created_at")).agg(
            said("create_new_candidate", "create_identity_discovery_candidate").alias("said_new"), said("attach_existing_candidate").alias("said_attached"),
            said("associate_existing_live_artist").alias("said_known")), "day", "full")
    of_either = lambda said, seen: F.coalesce(*([said] if actions is not None else []), F.coalesce(F.col(seen), F.lit(0)))
    df = df.select("*", of_either("said_new", "found").alias("new_candidates"), of_either("said_attached", "attached").alias("attachments"), of_either("said_known", "known").alias("rediscoveries"))
    r = F.col("candidate_revision")
    ends = F.when(move & F.col("next_state").isin(*TERMINAL), r)
    lives = events.groupBy("candidate_id").agg(F.min_by("occurred_at", r).alias("born"), F.min_by("occurred_at", ends).alias("done")).where("done is not null")
    hours = lives.select(day("done"), ((F.col("done").cast("double") - F.col("born").cast("double")) / 3600).alias("hours"))
    middle = nearest_ranks(hours, "hours", "day", (0.5,)).unionByName(nearest_ranks(hours, "hours", "day", (0.5,), above=True))
    df = df.join(middle.groupBy("day").agg(F.round(F.avg("value"), 4).alias("median_hours")), "day", "left")
    counts = ["occurrences", "new_candidates", "attachments", "rediscoveries", "selections", "bridge_selections", "coherent", "review", "failed", "bridges", "recoveries", "exhaustions", "retried"]
    df = df.fillna(0, counts).withColumn("prevented", F.col("rediscoveries") + F.col("attachments")).withColumn("worked", F.col("selections") + F.col("bridge_selections"))
    rates = {"discovery_yield": ("new_candidates", "occurrences"), "rediscovery_rate": ("rediscoveries", "occurrences"), "duplicate_prevention_rate": ("prevented", "occurrences"),
        "coherent_rate": ("coherent", "selections"), "review_rate": ("review", "worked"), "failed_match_rate": ("failed", "selections"), "exact_bridge_rate": ("bridges", "bridge_selections"),
        "retry_recovery_rate": ("recoveries", "retried"), "retry_exhaustion_rate": ("exhaustions", "retried")}
    return df.select("day", *counts, *(rate(*x).alias(n) for n, x in rates.items()), "median_hours")


def blockers(candidates: DataFrame, events: DataFrame, loose_same_name: bool = True) -> DataFrame:
    """candidates(candidate_id, state, outcome, same_name, external_id, stage) with what blocks each, by fixed precedence.

    loose_same_name keeps the rule that any stored audit counts as an ambiguity.
    """
    why = events.groupBy("candidate_id").agg(F.collect_set("reason_code").alias("_why"))
    df = candidates.join(why, "candidate_id", "left")
    has = lambda f: F.coalesce(F.exists("_why", f), F.lit(False))
    same = (F.col("same_name").isNotNull() if loose_same_name else F.coalesce(F.col("same_name") > 0,
        F.lit(False))) | F.coalesce(F.col("outcome") == "coherent_identity_with_same_name_ambiguity", F.lit(False))
    group = (
        F.when(has(lambda r: r == "retry_budget_exhausted"), "retry_budget_exhausted")
        .when(F.coalesce(F.col("outcome") == "semantic_identity_conflict", F.lit(False)) | (F.col("state") == "conflicting_identity"), "semantic_identity_conflict")
        .when(same, "same_name_ambiguity").when(F.col("outcome") == "provider_profile_multiplicity", "provider_profile_multiplicity")
        .when(F.col("external_id").isNull() | has(lambda r: r.contains("bridge") & r.rlike("missing|not_found|no_safe")), "missing_exact_bridge")
        .when(F.col("state").isin("identity_coherent", "validation_pending") & F.col("stage").isNull(), "editorial_input_missing").otherwise("unresolved_identifiers")
    )
    return df.withColumn("blocker", group).drop("_why")


def weekly_entries(candidates: DataFrame, events: DataFrame, as_of, discoveries: DataFrame | None = None, identities: DataFrame | None = None) -> DataFrame:
    """An entry for each candidate in a review state: what blocks it, and all that a person needs to decide.

    blocker, candidate_id, state, outcome, age_hours; with discoveries (candidate_id, source_type, source_name,
    source_record_id, discovered_at) provenance, an array of these in order; with identities (candidate_id, kind, value)
    ids, a map of sorted values by kind; evidence_refs, those of the candidate's events (evidence_refs, array), sorted,
    each once; conflicts, as candidates has them (array), and summary, which counts both.
    """
    none = F.array().cast("array<string>")
    df = blockers(candidates.where(F.col("state").isin(*REVIEW)), events)
    age = F.greatest(F.lit(0.0), (F.lit(as_of).cast("timestamp").cast("double") - F.col("created_at").cast("double")) / 3600)
    df = df.withColumn("age_hours", age)
    keep = ["blocker", "candidate_id", "state", "outcome", "age_hours"]
    if "evidence_refs" in events.columns:
        refs = events.groupBy("candidate_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence_refs", none))))).alias("evidence_refs"))
        df = df.join(refs, "candidate_id", "left").withColumn("evidence_refs", F.coalesce("evidence_refs", none))
        conflicts = F.coalesce(F.size("conflicts"), F.lit(0)) if "conflicts" in candidates.columns else F.lit(0)
        n = F.concat(F.size("evidence_refs"), F.lit(" evidence reference(s)"))
        df = df.withColumn("summary", F.when(conflicts > 0, F.concat(conflicts, F.lit(" conflict(s); "), n, F.lit("."))).otherwise(F.concat(n, F.lit("; outcome "), F.coalesce("outcome", F.lit("null")), F.lit("."))))
        keep += ["evidence_refs", "summary"]
    if discoveries is not None:
        own = F.struct("discovered_at", "source_type", "source_name", "source_record_id")
        df = df.join(discoveries.groupBy("candidate_id").agg(F.array_sort(F.collect_list(own)).alias("provenance")), "candidate_id", "left")
        keep += ["provenance"]
    if identities is not None:
        by_kind = identities.where("value is not null").groupBy("candidate_id", "kind").agg(F.array_sort(F.collect_set("value")).alias("v"))
        df = df.join(by_kind.groupBy("candidate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "v")))).alias("ids")), "candidate_id", "left")
        keep += ["ids"]
    return df.select(*keep)


def weekly_review(candidates: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """(blocker, entries, oldest_hours) of candidates in a review state; weekly_entries has the candidates."""
    return weekly_entries(candidates, events, as_of).groupBy("blocker").agg(F.count("*").alias("entries"), F.round(F.max("age_hours"), 4).alias("oldest_hours"))


def action_metrics(results: DataFrame) -> DataFrame:
    """(action, results, targets, cross_source) of results(action, target_id, provider); cross_source are targets that several providers lead to."""
    # a row for each target and action, of which a target has few; several providers lead to it if its least and greatest differ
    each = results.where("target_id is not null").groupBy("target_id", "action").agg(F.count("*").alias("n"), F.min("provider").alias("low"), F.max("provider").alias("high"))
    one = Window.partitionBy("target_id")
    each = each.withColumn("cross", F.min("low").over(one) < F.max("high").over(one))
    return each.groupBy("action").agg(F.sum("n").alias("results"), F.count("*").alias("targets"), F.count_if("cross").alias("cross_source"))


def oldest_pending(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k candidates that wait longest."""
    return candidates.where(F.col("state").isin(*PENDING)).orderBy("created_at", "candidate_id").limit(k)


def ops_status(runs: DataFrame, candidates: DataFrame, oldest: int = 10) -> DataFrame:
    """(item, name, value) of runs(run_id, status, completed_at, providers) and candidates: how things stand.

    last_run: the last completed run. last_provider_run: of each provider, the last completed run that made requests.
    open_breaker: providers whose last known breaker is open. queue: candidates by state. open_candidate: those that
    wait longest, neither coherent nor approved nor migrated, with their state.
    """
    done = runs.where("status = 'completed'")
    item = lambda df, kind, name, value: df.select(F.lit(kind).alias("item"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    last = done.agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id")).where("run_id is not null")
    lanes = done.select("run_id", "completed_at", F.explode("providers").alias("provider", "x"))
    asked = lanes.where(F.coalesce(F.try_element_at("x.metrics", F.lit("requests")), F.lit(0)) > 0)
    asked = asked.groupBy("provider").agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))
    breakers = lanes.where("x.breaker is not null").groupBy("provider").agg(F.max_by("x.breaker", F.struct("completed_at", "run_id")).alias("breaker")).where("breaker = 'open'")
    queue = candidates.groupBy("state").agg(F.count("*").alias("n"))
    waiting = candidates.where(~F.col("state").isin("migrated", "approved", "identity_coherent")).orderBy("created_at", "candidate_id").limit(oldest)
    parts = [item(asked, "last_provider_run", F.col("provider"), F.col("run_id")), item(breakers, "open_breaker", F.col("provider"), F.col("breaker")),
        item(queue, "queue", F.col("state"), F.col("n")), item(waiting, "open_candidate", F.col("candidate_id"), F.col("state"))]
    out = item(last, "last_run", F.lit("run"), F.col("run_id"))
    for part in parts:
        out = out.unionByName(part)
    return out
