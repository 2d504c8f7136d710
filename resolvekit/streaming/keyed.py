"""State by key with timers and an end: retries, attached occurrences, and the log of a candidate.

They need the RocksDB state store, which keeps state on disk and changes only what a batch touches; see with_state_store.
"""

from __future__ import annotations

from itertools import islice
from math import isnan

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.lifecycle import RETRY_HOURS, RETRY_MINUTES

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SECOND = 1_000_000


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _millis(micros: int) -> int:
    """The first millisecond at which that time has come."""
    return -(-micros // 1000)


#: Fixed value: how long a retry record lives, in microseconds.
_LIFE = RETRY_HOURS * 3600 * _SECOND
#: What a failure without a time counts as, in microseconds: older than any other.
_OLDEST = -9_223_372_036_854_776


class RetryTimers(StatefulProcessor):
    """The open record of one candidate: failures so far, the first of them, the retry that is due, and its end.

    A batch's failures are counted in memory: state is read and written once a batch, and only timers that are left at
    its end are set.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "attempt long, first long, due long")

    def _row(self, key, kind, attempt, at, due=None, why=None) -> Row:
        return Row(candidate_id=key[0], kind=kind, attempt=attempt, at=at, due_at=due, exhausted=why)

    def _passed(self, key, record, now: int, out: list):
        """The record after what its timers say up to a time; they count whether or not they have fired yet."""
        if record is None:
            return None
        attempt, first, due = record
        end = first + _LIFE
        if due is not None and due < end and due <= now:
            out.append(self._row(key, "due", attempt, due))
            due = None
        if end <= now:
            out.append(self._row(key, "ended", attempt, end, why="retry_elapsed_time_exhausted"))
            return None
        return attempt, first, due

    def _timers(self, record) -> set[int]:
        if record is None:
            return set()
        _, first, due = record
        end = first + _LIFE
        return {_millis(end)} | ({_millis(due)} if due is not None and due < end else set())

    def _put(self, old, record) -> None:
        if record is not None:
            self.record.update(record)
        elif old is not None:
            self.record.clear()

    def handleInputRows(self, key, rows, timerValues):
        out = []
        record = old = self.record.get()
        for t, wait in sorted((r.at, 0.0 if r.retry_after is None or isnan(r.retry_after) else r.retry_after) for r in rows):
            record = self._passed(key, record, t, out)
            attempt, first, _ = record or (0, t, None)
            attempt += 1
            spent = attempt > len(RETRY_MINUTES)
            due = None if spent else t + round(max(60.0 * RETRY_MINUTES[attempt - 1], wait) * _SECOND)
            record = attempt, first, due
            out.append(self._row(key, "failure", attempt, t, due, "retry_attempts_exhausted" if spent else None))
        self._put(old, record)
        before, after = self._timers(old), self._timers(record)
        for t in before - after:
            self.handle.deleteTimer(t)
        for t in after - before:
            self.handle.registerTimer(t)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the timer itself is gone afterwards; a retry that is due before the record's end has fired before it
        out = []
        old = self.record.get()
        record = self._passed(key, old, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        if record != old:
            self._put(old, record)
        yield from out

    def close(self) -> None:
        pass


def retry_timers(failures: DataFrame, delay: str = "2 days") -> DataFrame:
    """(candidate_id, kind, attempt, at, due_at, exhausted) of a stream of failures (candidate_id, occurred_at, retry_after seconds).

    kind failure: the retry that it schedules (due_at, by the fixed delays or retry_after if that is longer; after the
    third none, exhausted). kind due: a retry whose time has come without another failure. kind ended: 72 hours since
    the first failure, by event time and without any event; the record and its state are gone then, and a later failure
    begins a new one. A row that a timer makes is the same, whether the timer fires or a later failure comes first.
    Within a batch failures count in order of time; batches count as they come.
    """
    with_state_store(failures.sparkSession)
    rows = failures.select("candidate_id", "occurred_at", F.coalesce(F.unix_micros("occurred_at"), F.lit(_OLDEST)).alias("at"), F.col("retry_after").cast("double").alias("retry_after"))
    schema = "candidate_id string, kind string, attempt long, at long, due_at long, exhausted string"
    out = rows.withWatermark("occurred_at", delay).groupBy("candidate_id").transformWithState(RetryTimers(), schema, "Append", "EventTime")
    return out.select("candidate_id", "kind", "attempt", F.timestamp_micros("at").alias("at"), F.timestamp_micros("due_at").alias("due_at"), "exhausted")


class FirstContent(StatefulProcessor):
    """The content that a key came with first, until its horizon passes."""

    def __init__(self, columns: list[str], horizon_seconds: float):
        self.columns, self.horizon = columns, int(horizon_seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "content string")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows)).sort_values(["first_at", "content_hash"], kind="stable")
        known = self.first.get()[0] if self.first.exists() else None
        if known is None:
            known = rows["content_hash"].iloc[0]
            self.first.update((known,))
            self.handle.registerTimer(max(int(rows["first_at"].iloc[0].value // 1_000_000), timerValues.getCurrentWatermarkInMs()) + self.horizon)
            new = rows.iloc[:1].assign(collision=False)
        else:
            new = rows.iloc[:0].assign(collision=False)
        other = rows[rows["content_hash"] != known].drop_duplicates("content_hash").assign(collision=True)
        yield pd.concat([new, other])[[*self.columns, "collision"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_of_each(rows: DataFrame, key: str, time: str, horizon_seconds: float, delay: str) -> DataFrame:
    """A stream's rows with `collision`: the first of each key, and those whose content differs from it (true).

    Rows that repeat a key's content are inert. A key is kept for so many seconds of event time after its first row, so
    state is bounded by what comes within that time. Of rows in one batch the first by time, then by content counts.
    """
    with_state_store(rows.sparkSession)
    named = rows.withColumn("first_at", F.col(time)).withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != time)), {"ignoreNullFields": "false"}), 256))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return named.withWatermark("first_at", delay).groupBy(key).transformWithStateInPandas(FirstContent(rows.columns, horizon_seconds), f"{fields}, collision boolean", "Append", "EventTime")


#: So many revisions of a candidate wait in one entry of its state, and so many of a batch's rows are held at a time.
BLOCK, ROWS = 64, 10_000


class CandidateLog(StatefulProcessor):
    """Revision and state of a candidate, and events that came before their turn, BLOCK revisions to an entry.

    `blocks` is how many entries there are. A batch reads and writes an entry once for each ROWS of its rows.
    """

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "revision long, state string, blocks long")
        self.waiting = handle.getMapState("waiting", "block long", "revisions array<long>, states array<string>")

    def _entry(self, held: dict, block: int, blocks: int) -> list:
        """[what waits in an entry, whether the state has it, whether it changed]; read once."""
        if block not in held:
            found = self.waiting.getValue((block,)) if blocks else None
            held[block] = [dict(zip(*found, strict=True)) if found is not None else {}, found is not None, False]
        return held[block]

    def handleInputRows(self, key, rows, timerValues):
        revision, state, blocks = self.now.get() or (0, None, 0)
        rows = iter(rows)
        while some := list(islice(rows, ROWS)):
            held = {}
            for row in some:
                r = row.candidate_revision
                if r is None:
                    continue
                if r == revision + 1:
                    revision, state = r, row.next_state
                elif r > revision:
                    entry = self._entry(held, r // BLOCK, blocks)
                    entry[0][r], entry[2] = row.next_state, True
                while (entry := self._entry(held, (revision + 1) // BLOCK, blocks)) and revision + 1 in entry[0]:
                    revision += 1
                    state, entry[2] = entry[0].pop(revision), True
            for block, (waits, known, changed) in held.items():
                if changed and waits:
                    self.waiting.updateValue((block,), (list(waits), list(waits.values())))
                elif changed and known:
                    self.waiting.removeKey((block,))
                blocks += changed * (bool(waits) - known)
        self.now.update((revision, state, blocks))
        yield Row(candidate_id=key[0], revision=revision, state=state)

    def close(self) -> None:
        pass


def candidate_states(events: DataFrame) -> DataFrame:
    """(candidate_id, revision, state) after each batch, from a stream of events(candidate_id, candidate_revision, next_state).

    Events apply in order of revision; one that comes early waits in the state until those before it are there, and a
    batch reads only entries that its events or their turn fall into. One that comes again is inert. State is one row for
    each candidate, and entries of what waits.
    """
    with_state_store(events.sparkSession)
    return events.select("candidate_id", "candidate_revision", "next_state").groupBy("candidate_id").transformWithState(
        CandidateLog(), "candidate_id string, revision long, state string", "Update", "None")


class Furthest(StatefulProcessor):
    """The furthest position that a checkpoint has had."""

    def init(self, handle) -> None:
        self.furthest = handle.getValueState("furthest", "revision long, page double, item_offset long")

    def handleInputRows(self, key, rows, timerValues):
        known, out = self.furthest.get() if self.furthest.exists() else None, []
        moves = sorted(x for pdf in rows for x in zip(pdf["revision"].tolist(), pdf["page"].tolist(), pdf["item_offset"].tolist(), strict=True))
        for revision, page, offset in moves:
            if known is not None and (page, offset) < tuple(known[1:]):
                out.append(revision)
            else:
                known = (revision, page, offset)
        self.furthest.update(known)
        yield pd.DataFrame({"checkpoint_id": pd.Series([key[0]] * len(out), dtype="object"), "revision": pd.Series(out, dtype="int64")})

    def close(self) -> None:
        pass


def backward_positions(positions: DataFrame) -> DataFrame:
    """(checkpoint_id, revision) of a stream of positions(checkpoint_id string, revision, page, item_offset) that are behind an earlier one.

    Within a batch positions count in order of revision, batches as they come. State is one row for each checkpoint.
    """
    with_state_store(positions.sparkSession)
    rows = positions.select("checkpoint_id", F.col("revision").cast("long"), F.col("page").cast("double"), F.col("item_offset").cast("long"))
    return rows.groupBy("checkpoint_id").transformWithStateInPandas(Furthest(), "checkpoint_id string, revision long", "Append", "None")
