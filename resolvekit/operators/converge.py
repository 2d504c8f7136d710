"""Discovery convergence: which target each occurrence belongs to, by exact keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import content_id, entity_key, name_key
from .metrics import REVIEW
from .numbering import shared_folder

#: States whose candidates no longer take duplicates.
INACTIVE = ("duplicate", "migrated", "rejected")
#: Actions.
AMBIGUOUS, LIVE, ATTACH = "route_ambiguous_exact_convergence_to_review", "associate_existing_live_artist", "attach_existing_candidate"
CREATE, DISCOVER = "create_new_candidate", "create_identity_discovery_candidate"
#: Codes for an asserted id. Those of the format name a product, so these words stand for them; all other codes are fixed values.
ASSERTED_UNKNOWN, ASSERTED_ELSEWHERE, ASSERTED_LIVE = "asserted_id_not_found", "asserted_binding_conflict", "asserted_binding_reused"


def duplicate_preflight(candidates: DataFrame, registry: DataFrame, queue: DataFrame, directory: DataFrame) -> DataFrame:
    """(candidate_id, next_state, reason_code, duplicate_of, live_id, name_warning) for candidates(candidate_id, name, external_id, asserted_id).

    registry: artist_id, external_id. queue: candidate_id, state, name, external_id, position. directory: name,
    external_id. The first rule that holds decides: an asserted id that is unknown or bound elsewhere, a live artist
    by asserted or external id, an active candidate with the external id (the first by position). A name alone warns.
    """
    asserted = registry.select(F.col("artist_id").alias("asserted_id"), F.col("external_id").alias("bound"), F.lit(True).alias("known")).dropDuplicates(["asserted_id"])
    live = registry.where("external_id is not null").groupBy("external_id").agg(F.max("artist_id").alias("by_external"))
    active = queue.where(~F.col("state").isin(*INACTIVE))
    # the first two by position are enough, as a candidate leaves out at most itself
    place = Window.partitionBy("external_id").orderBy("position", "candidate_id")
    same = active.where("external_id is not null").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= 2)
    same = same.groupBy("external_id").agg(F.array_sort(F.collect_list(F.struct("position", "candidate_id"))).alias("queued"))
    names = active.select(name_key("name").alias("k"), F.col("external_id").alias("e"),
        F.col("candidate_id").alias("c")).unionByName(directory.select(name_key("name").alias("k"), F.col("external_id").alias("e"),
            F.lit(None).cast("string").alias("c")))
    # of a name: how many rows, how many with each external id, so that a candidate can leave out itself and its id
    counts = names.groupBy("k").agg(F.count("*").alias("n"))
    own = names.where("e is not null").groupBy(F.col("k").alias("k_own"), "e").agg(F.count("*").alias("n_own"))
    alone = names.where("c is not null and e is null").groupBy(F.col("k").alias("k_self"), "c").agg(F.count("*").alias("n_self"))
    df = candidates.withColumn("k", name_key("name")).join(asserted, "asserted_id", "left").join(live, "external_id", "left").join(same,
        "external_id", "left").join(counts, "k", "left")
    df = df.join(own, (F.col("k") == F.col("k_own")) & (F.col("external_id") == F.col("e")), "left")
    df = df.join(alone, (F.col("k") == F.col("k_self")) & (F.col("candidate_id") == F.col("c")) & F.col("external_id").isNull(), "left")
    queued = F.filter("queued", lambda q: q["candidate_id"] != F.col("candidate_id"))
    df = df.withColumn("queued_id", F.try_element_at(queued, F.lit(1))["candidate_id"])
    clash = F.coalesce("n", F.lit(0)) - F.coalesce("n_own", F.lit(0)) - F.coalesce("n_self", F.lit(0)) > 0
    has, id_ = F.col("asserted_id").isNotNull(), F.col("external_id").isNotNull()
    unknown, bound = has & F.col("known").isNull(), has & id_ & (F.col("bound") != F.col("external_id"))
    decided = F.when(unknown, ASSERTED_UNKNOWN).when(bound, ASSERTED_ELSEWHERE).when(has,
        ASSERTED_LIVE).when(F.col("by_external").isNotNull(), "existing_live_spotify_binding_reused").when(F.col("queued_id").isNotNull(), "queued_spotify_duplicate_detected")
    warn = decided.isNull() & clash
    reason = F.coalesce(decided, F.concat(F.when(id_, "identity_queued").otherwise("identity_discovery_queued"), F.when(warn, "_with_name_warning").otherwise("")))
    state = F.when(unknown | bound, "needs_review").when(decided.isNotNull(), "duplicate").when(id_, "identity_pending").otherwise("identity_discovery_pending")
    return df.select("candidate_id", state.alias("next_state"), reason.alias("reason_code"),
        F.when(reason == "queued_spotify_duplicate_detected", F.col("queued_id")).alias("duplicate_of"),
            F.when(reason == ASSERTED_LIVE, F.col("asserted_id")).when(reason == "existing_live_spotify_binding_reused",
                F.col("by_external")).alias("live_id"), warn.alias("name_warning"))


def converge(occurrences: DataFrame, associations: DataFrame, candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """(occurrence_id, action, target_type, target_id) for a batch of occurrences.

    occurrences: occurrence_id, provider, entity_type, entity_id, external_ids (array), asserted_id, discovered_at.
    associations: occurrence_id, target_type, target_id, key (the occurrence's entity key). candidates: candidate_id,
    external_id. registry: artist_id, external_id.

    The result is that of routing one occurrence after another by (discovered_at, occurrence_id): a candidate that
    one creates is a target for later ones that share its entity key or external id. A new candidate's id is made of the
    id of the occurrence that creates it.

    Order is kept without a loop, as only three occurrences of a kind decide for all others: the first of each key (any
    later one has a target and creates nothing), of these the first with an external id that nothing is known of (it
    makes the only candidate that this id ever gets), and of each key the first later one that has another target than the
    key's first (it adds a second target, so all after it are ambiguous). These are minima by group, and the rest are
    joins, so a key or id that a third of the batch has is no task of its own.

    Of known targets the least and the greatest are enough, as all that counts is whether there is none, one or several.
    An occurrence with several external ids is ambiguous whatever they lead to, so only single ones are looked up, and
    occurrences without one take no part in joins by it.
    """
    target = lambda kind, id_: F.struct(kind.alias("t"), F.col(id_).alias("i"))
    given = target(F.col("target_type"), "target_id")
    known = associations.groupBy("occurrence_id").agg(*_ends(F.when(F.col("target_type").isNotNull() & F.col("target_id").isNotNull(), given)))
    one = F.col("low") == F.col("high")
    done = known.join(occurrences, "occurrence_id", "left_semi").select("occurrence_id", F.when(one, "idempotent_existing_occurrence").otherwise("error_several_targets").alias("action"),
        F.when(one, F.col("low")).alias("target"))
    ids = F.array_distinct(F.coalesce("external_ids", F.array().cast("array<string>")))
    new = occurrences.dropDuplicates(["occurrence_id"]).join(known.select("occurrence_id"), "occurrence_id", "left_anti")
    new = new.select("occurrence_id", entity_key("provider", "entity_type", "entity_id").alias("key"), ids.alias("ids"), "asserted_id", "discovered_at")
    live = registry.select("artist_id").distinct().withColumn("ok", F.lit(True))
    claimed = new.where("asserted_id is not null").join(live, F.col("asserted_id") == F.col("artist_id"), "left").select("occurrence_id",
        F.when(F.col("ok"), target(F.lit("live_artist"), "asserted_id")).alias("claimed"), F.col("ok").isNull().alias("wrong"))
    new = new.join(claimed, "occurrence_id", "left").withColumn("external_id", F.when(F.size("ids") == 1, F.col("ids")[0]))
    by_id = candidates.select("external_id", target(F.lit("candidate"), "candidate_id").alias("x")).unionByName(registry.select("external_id", target(F.lit("live_artist"), "artist_id").alias("x")))
    by_id = by_id.where("external_id is not null").groupBy("external_id").agg(*_ends(F.col("x")))
    new = new.select(
        "key", F.struct(F.col("discovered_at").alias("at"), F.col("occurrence_id").alias("id")).alias("place"), "external_id",
        ((F.size("ids") > 1) | F.coalesce("wrong", F.lit(False))).alias("several"), F.col("claimed").alias("low"), F.col("claimed").alias("high"),
    )
    shared_folder(new.sparkSession)
    new = _with_targets(new.checkpoint(), by_id.withColumnsRenamed({"low": "id_low", "high": "id_high"}), F.col("id_low"), F.col("id_high"))
    resolved = F.col("target_type") != "unresolved"
    by_key = associations.groupBy("key").agg(*_ends(F.when(resolved, given)), F.max(F.coalesce(~resolved, F.lit(False))).alias("wrong"))
    by_key = by_key.select("key", F.col("low").alias("key_low"), F.col("high").alias("key_high"), "wrong")
    own = target(F.lit("candidate"), "own")
    differ = F.coalesce(F.col("low") != F.col("high"), F.lit(False))

    def with_key(rows: DataFrame) -> DataFrame:
        """rows with what is known of their key added to what is known of themselves."""
        rows = rows.withColumn("low", F.least("low", "key_low")).withColumn("high", F.greatest("high", "key_high"))
        return rows.withColumn("several", F.col("several") | F.coalesce("wrong", F.lit(False)) | differ)

    def known_to(rows: DataFrame) -> DataFrame:
        """rows with the targets of before the batch and that of their external id, if it was made earlier."""
        made = F.when(F.col("since") < F.col("place"), F.col("made"))
        return _with_targets(rows, creators, made, made)

    # the first occurrence of a key that nothing is known of makes the candidate of its external id
    head = new.groupBy("key").agg(F.min(F.struct("place", "external_id", "several", "low", "high")).alias("first")).select("key", "first.*")
    head = with_key(head.join(by_key, "key", "left")).checkpoint()
    free = head.where(F.col("low").isNull() & ~F.col("several") & F.col("external_id").isNotNull())
    creators = free.groupBy("external_id").agg(F.min("place").alias("since"))
    creators = creators.withColumn("own", F.concat(F.lit("candidate:"), "since.id")).select("external_id", "since", own.alias("made"))
    head = known_to(head).withColumn("several", F.col("several") | differ).withColumn("own", F.concat(F.lit("candidate:"), "place.id"))
    has = F.col("low").isNotNull()
    action = F.when(F.col("several"), AMBIGUOUS).when(has, F.when(F.col("low.t") == "live_artist", LIVE).otherwise(ATTACH))
    action = action.when(F.col("external_id").isNotNull(), CREATE).otherwise(DISCOVER)
    head = head.select("key", "place", action.alias("action"), F.when(~F.col("several") & has, F.col("low")).otherwise(own).alias("target"), "key_low", "key_high", "wrong").checkpoint()
    # later ones of a key go to its target, up to the first that something else is known of; from there on the key is ambiguous
    rest = known_to(new).join(head.select("key", F.col("place").alias("first"), F.col("target").alias("held"), "key_low", "key_high", "wrong"), "key").where(F.col("place") > F.col("first"))
    rest = with_key(rest).withColumn("breaks", F.col("several") | F.coalesce(F.col("low") != F.col("held"), F.lit(False))).select("key", "place", "held", "breaks").checkpoint()
    broken = rest.where("breaks").groupBy("key").agg(F.min("place").alias("broken"))
    rest = rest.join(broken, "key", "left").withColumn("lost", F.coalesce(F.col("place") >= F.col("broken"), F.lit(False))).withColumn("own", F.concat(F.lit("candidate:"), "place.id"))
    later = F.when(F.col("lost"), AMBIGUOUS).when(F.col("held.t") == "live_artist", LIVE).otherwise(ATTACH)
    rest = rest.select("place", later.alias("action"), F.when(F.col("lost"), own).otherwise(F.col("held")).alias("target"))
    routed = head.select("place", "action", "target").unionByName(rest).select(F.col("place.id").alias("occurrence_id"), "action", "target")
    return done.unionByName(routed).select("occurrence_id", "action", F.col("target.t").alias("target_type"), F.col("target.i").alias("target_id"))


def _ends(x: Column) -> tuple[Column, Column]:
    return F.min(x).alias("low"), F.max(x).alias("high")


def _with_targets(rows: DataFrame, found: DataFrame, low: Column, high: Column) -> DataFrame:
    """rows with the targets that are found(external_id, ...) of their external id among theirs; those without one meet nothing."""
    met = rows.where("external_id is not null").join(found, "external_id", "left").withColumn("low", F.least("low", low)).withColumn("high", F.greatest("high", high))
    return met.select(*rows.columns).unionByName(rows.where("external_id is null"))


def intake(discoveries: DataFrame, known: DataFrame, registry: DataFrame, queue: DataFrame, directory: DataFrame) -> DataFrame:
    """Preflight of discoveries(source_type, source_name, source_record_id, name, external_id, asserted_id, discovered_at) that aren't in known(discovery_id).

    A discovery's id is made of its source and record; of those with one id in a batch the first counts, and a batch's
    own earlier candidates take duplicates of later ones.
    """
    df = discoveries.withColumn("discovery_id", content_id("source_name", "source_record_id", "source_type"))
    first = Window.partitionBy("discovery_id").orderBy("discovered_at", "name")
    df = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").join(known, "discovery_id", "left_anti")
    df = df.withColumn("candidate_id", F.concat(F.lit("candidate:"), F.col("discovery_id")))
    out = duplicate_preflight(df.select("candidate_id", "name", "external_id", "asserted_id"), registry, queue, directory)
    earlier = Window.partitionBy("external_id").orderBy("discovered_at", "candidate_id")
    own = df.where("external_id is not null").select("candidate_id", F.first("candidate_id").over(earlier).alias("first_id"))
    out = out.join(own, "candidate_id", "left")
    late = out["next_state"].isin("identity_pending") & (F.col("first_id") != F.col("candidate_id"))
    return out.select("candidate_id", F.when(late, "duplicate").otherwise(F.col("next_state")).alias("next_state"),
        F.when(late, "queued_spotify_duplicate_detected").otherwise(F.col("reason_code")).alias("reason_code"),
            F.when(late, F.col("first_id")).otherwise(F.col("duplicate_of")).alias("duplicate_of"), "live_id", "name_warning")


def build_indexes(associations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by entity key, by target) of associations(occurrence_id, key, target_type, target_id).

    A key has a sorted list of its few targets. A target may have any number of occurrences: they are rows, each once,
    a target's together and in order.
    """
    by_key = associations.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("target_type", "target_id"))).alias("targets"))
    by_target = associations.select("target_type", "target_id", "occurrence_id").distinct()
    return by_key, by_target.repartitionByRange("target_type", "target_id", "occurrence_id").sortWithinPartitions("target_type", "target_id", "occurrence_id")


def queue_index(candidates: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries, counts) of candidates(candidate_id, state, columns): the queue, whether an entry is for review, and how many there are by state."""
    entries = candidates.select("candidate_id", "state", *columns, F.col("state").isin(*REVIEW).alias("for_review"))
    counts = entries.groupBy("state").agg(F.count("*").alias("candidates"), F.count_if("for_review").alias("for_review"))
    return entries, counts
