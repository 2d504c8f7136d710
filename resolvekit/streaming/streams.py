"""Structured Streaming forms of the keyed-state operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.lifecycle import CLOSED, breaker_step
from .keyed import backward_positions, candidate_states, first_of_each, retry_timers

__all__ = ["behaviour_counts", "backward_moves", "backward_positions", "breaker_states", "candidate_states", "ingest", "period_counts", "retry_timers", "run_now", "stalled_work"]

#: Behaviour events that count.
BEHAVIOUR_TYPES = ("artist_impression", "artist_saved", "artist_unsaved", "spotify_clicked", "roll_again", "artist_skipped")


def stalled_work(events: DataFrame, working: tuple[str, ...], minutes: int = 5, delay: str = "2 days") -> DataFrame:
    """(item, since) of items of a stream (item, state, occurred_at) that entered a working state and had no event for so many minutes of event time.

    An event that is older than the last one of its item changes nothing.
    """
    stream = events.withWatermark("occurred_at", delay)

    def run(key, batches, state):
        if state.hasTimedOut:
            at, busy = state.get
            state.remove()
            if busy:
                yield pd.DataFrame({"item": [key[0]], "since": [pd.Timestamp(at, unit="ms")]})
            return
        now, busy = state.get if state.exists else (None, False)
        last = max(((r.occurred_at, r.state) for pdf in batches for r in pdf.itertuples(index=False)), default=None)
        if last is None or (now is not None and last[0].value // 1_000_000 < now):
            return
        at = last[0].value // 1_000_000
        state.update((at, last[1] in working))
        state.setTimeoutTimestamp(max(at + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"item": pd.Series([], dtype=str), "since": pd.Series([], dtype="datetime64[ns]")})

    return stream.groupBy("item").applyInPandasWithState(run, "item string, since timestamp", "at long, busy boolean", "append", GroupStateTimeout.EventTimeTimeout)


def breaker_states(calls: DataFrame, threshold: int = 2, probe_seconds: float = 900.0) -> DataFrame:
    """(provider, state, failures, next_probe_at) after each batch of a stream of calls(provider, occurred_at double, kind, retry_after double, run_id).

    kind is null for a success. Within a batch calls apply in order of time; one that is older than the last call
    applied comes too late to change the breaker.
    """

    def run(key, batches, state):
        *breaker, seen = state.get if state.exists else (*CLOSED, float("-inf"))
        breaker = tuple(breaker)
        text = lambda x: x if isinstance(x, str) else None
        for r in sorted((r for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r.occurred_at):
            if r.occurred_at >= seen:
                breaker, _ = breaker_step(breaker, r.occurred_at, text(r.kind), 0.0 if pd.isna(r.retry_after) else r.retry_after, text(r.run_id),
                    threshold, probe_seconds)
                seen = r.occurred_at
        state.update((*breaker, seen))
        yield pd.DataFrame({"provider": [key[0]], "state": [breaker[0]], "failures": [breaker[1]], "next_probe_at": pd.Series([breaker[2]], dtype="float64")})

    return calls.groupBy("provider").applyInPandasWithState(run, "provider string, state string, failures long, next_probe_at double",
        "state string, failures long, probe double, cause string, run string, seen double", "update", GroupStateTimeout.NoTimeout)


def behaviour_counts(events: DataFrame, types: tuple[str, ...] = BEHAVIOUR_TYPES, id_pattern: str = ".*", delay: str = "2 days") -> DataFrame:
    """(day, artist_id, type, events) of a stream of events(ts, artist_id, type); other types and ids that don't match are ignored."""
    good = events.where(F.col("type").isin(*types) & F.col("artist_id").rlike(f"^(?:{id_pattern})$"))
    return good.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "artist_id",
        "type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("day"), "artist_id", "type", "events")


def period_counts(events: DataFrame, length: str = "7 days", offset: str = "0 days", delay: str = "2 days") -> DataFrame:
    """(start, state, events) of a stream of events(occurred_at, next_state) by half-open periods."""
    return events.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", length, length, offset),
        "next_state").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), F.col("next_state").alias("state"), "events")


def ingest(occurrences: DataFrame, path: str, checkpoint: str, key: str = "occurrence_id", time: str = "discovered_at", horizon_seconds: float = 30 * 86400.0, delay: str = "2 days"):
    """Append a stream of occurrences to parquet tables: path/table has each key once, path/collisions what came later under a key with other content.

    Also over restarts from the checkpoint. A repeat is inert; a key is known for so many seconds of event time. A batch
    has a folder of its own, which a repeated attempt writes anew, and no batch reads the tables.
    """

    def append(batch: DataFrame, n: int) -> None:
        batch.persist()
        for name, rows in (("table", batch.where("not collision")), ("collisions", batch.where("collision"))):
            rows.drop("collision").write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        batch.unpersist()

    stream = first_of_each(occurrences, key, time, horizon_seconds, delay)
    return stream.writeStream.foreachBatch(append).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backward_moves(positions: DataFrame) -> DataFrame:
    """(checkpoint_id, revision) of positions(checkpoint_id, revision, page, item_offset) that are behind those of a lower revision."""
    from pyspark.sql import Window

    w = Window.partitionBy("checkpoint_id").orderBy("revision").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("page", "item_offset")
    return positions.withColumn("_before", F.max(place).over(w)).where(F.col("_before").isNotNull() & (place < F.col("_before"))).select("checkpoint_id", "revision")


def run_now(stream: DataFrame, keys: list[str], folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now and return the last row of each key."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    out = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r")).select(*keys, "_r.*")
