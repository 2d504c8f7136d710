"""Keyed streams over several batches and restarts."""

import datetime as dt
import os
from pathlib import Path

from pyspark.sql import Row, functions as F

from resolvekit.streaming import keyed, streams


def _add(spark, folder, i, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    os.utime(next(Path(f"{folder}/in/{i}").glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def at(hours, minutes=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours, minutes=minutes)


FAILURES = [[("a", at(0), None), ("b", at(0), 5000.0)], [("a", at(0, 5), None)], [("z", at(10), None)], [("z", at(80), None)], [("z", at(200), None)], [("z", at(300), None)]]
#: A retry that another failure replaces isn't due; records end 72 hours after their first failure.
RECORDS = [
    ("a", "failure", 1, at(0), at(0, 15), None), ("a", "failure", 2, at(0, 5), at(2, 5), None), ("a", "due", 2, at(2, 5), None, None), ("a", "ended", 2, at(72), None, "retry_elapsed_time_exhausted"),
    ("b", "failure", 1, at(0), at(0) + dt.timedelta(seconds=5000), None), ("b", "due", 1, at(0) + dt.timedelta(seconds=5000), None, None), ("b", "ended", 1, at(72), None, "retry_elapsed_time_exhausted"),
    ("z", "failure", 1, at(10), at(10, 15), None), ("z", "due", 1, at(10, 15), None, None), ("z", "failure", 2, at(80), at(82), None), ("z", "ended", 2, at(82), None, "retry_elapsed_time_exhausted"),
    ("z", "failure", 1, at(200), at(200, 15), None), ("z", "due", 1, at(200, 15), None, None), ("z", "ended", 1, at(272), None, "retry_elapsed_time_exhausted"), ("z", "failure", 1, at(300), at(300, 15), None),
]


def test_timers_fire_without_an_event(spark, tmp_path):
    schema = "candidate_id string, occurred_at timestamp, retry_after double"
    for name, batches in (("many", FAILURES), ("one", [sum(FAILURES, [])])):
        for i, rows in enumerate(batches):
            _add(spark, tmp_path / name, i, rows, schema)
        out = streams.run_now(streams.retry_timers(_stream(spark, tmp_path / name, schema), "1 hour"), ["candidate_id", "kind", "attempt", "at"], f"{tmp_path}/{name}/run", "append")
        assert sorted(map(tuple, out.collect()), key=str) == sorted(RECORDS, key=str)


def test_ended_records_leave_no_state(spark, tmp_path):
    schema = "candidate_id string, occurred_at timestamp, retry_after double"
    for i, rows in enumerate(FAILURES):
        _add(spark, tmp_path, i, rows, schema)
    stream = streams.retry_timers(_stream(spark, tmp_path, schema), "1 hour").writeStream.outputMode("append").format("noop").option("checkpointLocation", f"{tmp_path}/run").trigger(availableNow=True).start()
    stream.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "record").load(f"{tmp_path}/run")
    assert [r[0] for r in held.select("key.candidate_id").collect()] == ["z"]


def test_ingest_over_a_restart(spark, tmp_path):
    schema = "occurrence_id string, name string, discovered_at timestamp"
    rows = [("o1", "A", at(0)), ("o1", "A", at(1)), ("o2", None, at(0)), ("o3", "C", at(1)), ("o3", "D", at(0))]
    _add(spark, tmp_path, 0, rows, schema)
    run = lambda: streams.ingest(_stream(spark, tmp_path, schema), f"{tmp_path}/out", f"{tmp_path}/run", horizon_seconds=100 * 3600.0, delay="1 hour").awaitTermination()
    both = lambda: tuple(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/{k}").select("occurrence_id", "name").collect()), key=str) for k in ("table", "collisions"))
    run()
    assert both() == ([("o1", "A"), ("o2", None), ("o3", "D")], [("o3", "C")])
    run()
    _add(spark, tmp_path, 1, [("o1", "A", at(2)), ("o2", "B", at(2)), ("o4", "E", at(3))], schema)
    run()
    assert both() == ([("o1", "A"), ("o2", None), ("o3", "D"), ("o4", "E")], [("o2", "B"), ("o3", "C")])
    for i, hours in enumerate((300, 301, 302)):  # beyond the horizon a key is new again
        _add(spark, tmp_path, 2 + i, [("o1", "A", at(hours))], schema)
        run()
    assert both()[0].count(("o1", "A")) == 2


def test_early_events_wait(spark, tmp_path):
    schema = "candidate_id string, candidate_revision long, next_state string"
    batches = [[("c", 3, "s3"), ("c", 1, "s1")], [("c", 5, "s5"), ("c", 1, "again")], [("c", 2, "s2")], [("c", 4, "s4"), ("d", 2, "t2")]]
    for i, rows in enumerate(batches):
        _add(spark, tmp_path, i, rows, schema)
        out = streams.run_now(streams.candidate_states(_stream(spark, tmp_path, schema)), ["candidate_id"], f"{tmp_path}/run").where(F.col("candidate_id") == "c").first()
        assert (out.revision, out.state) == [(1, "s1"), (1, "s1"), (3, "s3"), (5, "s5")][i]


def test_positions_that_go_back(spark, tmp_path):
    schema = "checkpoint_id string, revision long, page double, item_offset long"
    for i, rows in enumerate([[("c", 1, 1.0, 5), ("c", 3, 1.0, 4), ("c", 2, 2.0, 0)], [("c", 4, 2.0, 0), ("c", 5, 1.9, 9), ("d", 1, 0.0, 0)], [("c", 6, 3.0, 0), ("d", 2, 0.0, 1), ("d", 3, 0.0, 0)]]):
        _add(spark, tmp_path, i, rows, schema)
    out = streams.run_now(streams.backward_positions(_stream(spark, tmp_path, schema)).withColumn("seen", F.lit(True)), ["checkpoint_id", "revision"], f"{tmp_path}/run", "append")
    assert sorted((r.checkpoint_id, r.revision) for r in out.collect()) == [("c", 3), ("c", 5), ("d", 3)]


class _Calls:
    """A handle and its states in memory, which count what goes to the store."""

    def __init__(self):
        self.n, self.value, self.entries, self.timers = 0, None, {}, set()

    def _count(self, out=None):
        self.n += 1
        return out

    getValueState = getMapState = lambda self, *_: self
    exists = lambda self: self._count(self.value is not None)
    get = lambda self: self._count(self.value)
    update = lambda self, value: self._count(setattr(self, "value", value))
    clear = lambda self: self._count(setattr(self, "value", None))
    containsKey = lambda self, key: self._count(key in self.entries)
    getValue = lambda self, key: self._count(self.entries.get(key))
    updateValue = lambda self, key, value: self._count(self.entries.update({key: value}))
    removeKey = lambda self, key: self._count(self.entries.pop(key))
    listTimers = lambda self: self._count(sorted(self.timers))
    registerTimer = lambda self, t: self._count(self.timers.add(t))
    deleteTimer = lambda self, t: self._count(self.timers.discard(t))


def test_a_batch_of_failures_is_one_visit_to_the_state():
    calls, processor = _Calls(), keyed.RetryTimers()
    processor.init(calls)
    hour = 3600 * 1_000_000
    out = list(processor.handleInputRows(("a",), iter([Row(at=i * hour, retry_after=None) for i in range(1000)]), None))
    assert calls.n <= 6
    assert [r.kind for r in out].count("failure") == 1000 and [r.kind for r in out].count("ended") == 999 // 72
    assert calls.value == (1000 - 72 * 13, 72 * 13 * hour, None) and calls.timers == {72 * 14 * 3_600_000}


def test_a_batch_of_early_events_is_few_visits_to_the_state():
    calls, processor = _Calls(), keyed.CandidateLog()
    processor.init(calls)
    step = lambda revisions: [tuple(x) for x in processor.handleInputRows(("c",), iter([Row(candidate_revision=r, next_state=f"s{r}" if r % 5 else None) for r in revisions]), None)]
    assert step([*range(1000, 1, -1), 1002]) == [("c", 0, None)] and calls.n <= 20
    assert step([5000, 7]) == [("c", 0, None)] and step([2000, 1001]) == [("c", 0, None)]
    calls.n = 0
    assert step([1]) == [("c", 1002, "s1002")] and calls.n <= 40
    assert calls.value == (1002, "s1002", 2) and sorted(calls.entries) == [(2000 // 64,), (5000 // 64,)]
    assert step(range(4999, 1002, -1)) == [("c", 5000, None)] and calls.value == (5000, None, 0) and calls.entries == {}


def test_early_events_without_a_state_wait(spark, tmp_path):
    schema = "candidate_id string, candidate_revision long, next_state string"
    for i, rows in enumerate([[("c", 130, None), ("c", None, "none"), ("c", 2, None), ("c", 129, "b")], [("c", r, "x") for r in range(3, 129)], [("c", 1, "a")]]):
        _add(spark, tmp_path, i, rows, schema)
        out = streams.run_now(streams.candidate_states(_stream(spark, tmp_path, schema)), ["candidate_id"], f"{tmp_path}/run").first()
        assert (out.revision, out.state) == [(0, None), (0, None), (130, None)][i]
