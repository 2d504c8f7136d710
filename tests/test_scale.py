"""Operators that no group may overload: against plain versions, with groups far larger than the others."""

import datetime as dt
import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from resolvekit.operators import admission, catalog, claims, converge, lifecycle, metrics, ranking, ranks

from test_operators import _sequential


def test_nearest_ranks(spark):
    r = random.Random(6)
    values = {"a": [r.choice([1.0, 2.0, 2.0, r.random() * 1e6, -r.random()]) for _ in range(3000)], "b": [5.0] * 500, "c": [7.0], None: [r.gauss(0, 1) for _ in range(999)], "d": [1e-300, 1e300, 3.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("none", None)]
    shares = (0.01, 0.5, 0.75, 0.9, 0.95, 1.0)
    want = {(g, q): sorted(vs)[max(1, math.ceil(q * len(vs) - 1e-9)) - 1] for g, vs in values.items() for q in shares}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for few in (10, 10_000):
        assert {(x.g, x.q): x.value for x in ranks.nearest_ranks(df, "v", "g", shares, few).collect()} == want
    assert ranks.nearest_ranks(df.limit(0), "v", "g", shares).count() == 0


def test_queue_ages_of_nothing(spark):
    none = spark.createDataFrame([], "candidate_id string, state string, created_at timestamp")
    assert [tuple(x) for x in metrics.queue_ages(none, "2024-01-01").collect()] == [(None, None, None, None, 0.0, 0)]
    assert metrics.queue_ages(none, "2024-01-01", "state").count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_states_by_time_range(spark, inclusive):
    r = random.Random(9)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.choice([r.randrange(40), r.randrange(20_000)]))
    events = []
    for c in range(40):
        times = sorted(at() for _ in range(r.randrange(1, 12)))
        events += [(f"c{c}", i + 1, f"s{r.randrange(5)}", t) for i, t in enumerate(times)]
    instants = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i),) for i in range(-20, 2020)] + [(None,), events[0][3:], events[0][3:]]
    log = spark.createDataFrame(events, "candidate_id string, candidate_revision int, next_state string, occurred_at timestamp")
    times = spark.createDataFrame(instants, "instant timestamp")
    by = {n: sorted(map(tuple, lifecycle.states_as_of(log, times, inclusive, small=n).collect())) for n in (0, 10_000)}
    assert by[0] == by[10_000] and len(by[0]) > 40_000
    plan = lifecycle.states_as_of(log, times, inclusive, small=0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert lifecycle.states_as_of(log, times.limit(0), small=0).count() == 0


def test_converge_of_a_hot_key(spark):
    """Most occurrences of the batch have one key, many one external id; what breaks the key comes late."""
    r = random.Random(3)
    t = dt.datetime(2026, 1, 1)
    occ = [(f"o{i:06}", "p", "artist", "hot" if i % 3 else f"k{r.randrange(2000)}", r.choice([[], ["s1"], ["s1"], [f"s{r.randrange(500)}"]]) if i % 3 == 0 else [], None, t + dt.timedelta(seconds=r.randrange(9000))) for i in range(12_000)]
    last = max(x[6] for x in occ if x[3] == "hot")
    occ += [("late1", "p", "artist", "hot", ["s2"], None, last - dt.timedelta(seconds=600)), ("late2", "p", "artist", "hot", ["a", "b"], None, last)]
    df = spark.createDataFrame(occ, "occurrence_id string, provider string, entity_type string, entity_id string, external_ids array<string>, asserted_id string, discovered_at timestamp")
    none = spark.createDataFrame([], "occurrence_id string, target_type string, target_id string, key string")
    got = converge.converge(df, none, spark.createDataFrame([], "candidate_id string, external_id string"), spark.createDataFrame([("live", "s7")], "artist_id string, external_id string"))
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == _sequential(occ, [], [], [("live", "s7")])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "pandas" not in Path(converge.__file__).read_text()


def test_overlap_of_a_title_that_all_have(spark):
    many = spark.range(50_000).select(F.lit(1).alias("group_id"), F.col("id").alias("profile_id"))
    own = many.withColumn("title", F.concat(F.lit("t"), F.floor(F.col("profile_id") / 2).cast("string"))).where("profile_id < 600 or profile_id % 2 = 0")
    titles = many.withColumn("title", F.lit("all")).unionByName(own).unionByName(own)
    got = sorted(map(tuple, catalog.pairwise_overlap(titles, least=2).collect()))
    assert got == [(1, 2 * i, 2 * i + 1, 2) for i in range(300)]


def test_overlap_in_panels(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PANEL", 3)
    r = random.Random(4)
    sets = {(g, p): {r.choice("abcdefg") for _ in range(r.randrange(6))} for g in (1, 2) for p in range(25)}
    rows = [(g, p, t) for (g, p), x in sets.items() for t in x] + [(1, 1, ""), (1, 2, None)]
    df = spark.createDataFrame(rows, "group_id int, profile_id int, title string")
    for least in (1, 2, 3):
        want = sorted((g, p, q, len(sets[g, p] & sets[g, q])) for g, p in sets for q in range(p + 1, 25) if len(sets[g, p] & sets[g, q]) >= least)
        assert sorted(map(tuple, catalog.pairwise_overlap(df, least=least).collect())) == want


def test_overlap_of_profiles_that_are_alike(spark, monkeypatch):
    """Of 1,500 profiles with the same titles one is compared; the others have what it has."""
    meeting, compared = catalog._meeting, []
    monkeypatch.setattr(catalog, "_meeting", lambda df, least: compared.append(df.count()) or meeting(df, least))
    titles = spark.range(1500).selectExpr("1 as group_id", "id * 2 as profile_id", "explode(array('a', 'b', 'c')) as title")
    titles = titles.unionByName(spark.createDataFrame([(1, 701, "a"), (1, 701, "b"), (2, 1, "a")], "group_id int, profile_id long, title string"))
    got = catalog.pairwise_overlap(titles, least=2)
    assert got.where("left_id < right_id").distinct().groupBy("overlap").count().orderBy("overlap").collect() == [(2, 1500), (3, 1500 * 1499 // 2)]
    assert got.count() == 1500 + 1500 * 1499 // 2 and compared == [6]


def test_admission_of_a_hot_provider(spark):
    """Windows see the first rows alone; the rest of a provider is refused by the same reason."""
    items = spark.range(40_000).select(F.floor(F.col("id") / 40_000).cast("string").alias("provider"), F.col("id").alias("position"), F.floor(F.col("id") / 100).alias("page"), F.lit(False).alias("creates_candidate"), F.lit("x").alias("target_state"))
    got = admission.admit_with_budget(items, spark.createDataFrame([], "state string, n long"))
    assert [tuple(x) for x in got.groupBy("admitted", "stop_reason").count().orderBy("admitted").collect()] == [(False, "occurrence_budget_reached", 39_985), (True, "occurrence_budget_reached", 15)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_acquire_goes_on_where_it_stopped(spark):
    """Turns of a bounded number of items, in the middle of pages too: every item once, in order."""
    from resolvekit.operators import positions

    pages = {"a": [3, 4, 1, 5], "b": [2], "c": []}
    items = spark.createDataFrame([(p, k, i, f"{p}{k}.{i}") for p, sizes in pages.items() for k, n in enumerate(sizes) for i in range(n)], "provider string, page long, item_offset long, name string")
    schema = "checkpoint_id string, provider string, configuration_hash string, revision long, page long, item_offset long, exhausted boolean"
    now = spark.createDataFrame([(p, "h") for p in "abcd"], "provider string, configuration_hash string")
    state = spark.createDataFrame([(p, p, "h", 1, 0, 0, False) for p in "ab"], schema)
    seen, places = {"a": [], "b": []}, []
    for _ in range(4):
        taken, state, refused = positions.acquire(items, state, now, 5)
        for r in sorted(taken.collect(), key=lambda r: (r.page, r.item_offset)):
            seen[r.checkpoint_id].append(r.name)
        state = spark.createDataFrame(state.collect(), state.schema)
        places.append({r.checkpoint_id: (r.revision, r.page, r.item_offset, r.exhausted) for r in state.collect()})
        assert refused.count() == 0
    assert seen == {p: [f"{p}{k}.{i}" for k, n in enumerate(pages[p]) for i in range(n)] for p in "ab"}
    assert [x["a"] for x in places] == [(2, 1, 2, False), (3, 3, 2, False), (4, 4, 0, True), (5, 4, 0, True)] and places[0]["b"] == (2, 1, 0, True)
    odd = [("old", "a", "g", 1, 0, 0, False), ("far", "a", "h", 1, 9, 0, False), ("done", "a", "h", 1, 9, 0, True), ("empty", "c", "h", 1, 0, 0, False), ("unknown", "z", "h", 1, 0, 0, False)]
    taken, after, refused = positions.acquire(items, spark.createDataFrame(odd, schema), now, 5)
    assert taken.count() == 0 and [r.checkpoint_id for r in after.collect()] == ["done"]
    assert {r.checkpoint_id: r.reason for r in refused.collect()} == {"old": positions.STALE, "far": positions.AHEAD, "empty": positions.AHEAD, "unknown": positions.STALE}
    assert positions.acquire(items.limit(0), state.limit(0), now, 5)[1].count() == 0


def test_a_large_batch_of_work_is_numbered_by_ranges(spark, monkeypatch):
    """More than a task may take: the same places, and no window over a whole state."""
    r = random.Random(1)
    rows = [(f"c{i}", r.choice(["a", "b", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(50)) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "candidate_id string, state string, updated_at timestamp").repartition(5)
    want = {(s, n): sorted(map(str, lifecycle.select_work(df, s, n).collect())) for s in (None, "b", "none") for n in (40, 1000)}
    monkeypatch.setattr(lifecycle, "FEW_WORK", 30)
    for (s, n), rows in want.items():
        got = lifecycle.select_work(df, s, n)
        assert sorted(map(str, got.collect())) == rows
        assert "row_number" not in got._jdf.queryExecution().executedPlan().toString()


def test_evidence_of_a_name_that_many_have(spark):
    """100,000 artists and 100,000 authorities of one name make no pairs; artists with several names against a plain version."""
    many = spark.range(100_000)
    names = many.selectExpr("id as artist_id", "'One Name' as name", "concat('s', id % 1000) as external_id")
    auth = many.selectExpr("concat('a', id) as authority_id", "'one  name' as name", "cast(null as string) as alias", "concat('s', id % 500) as linked_id", "cast(1990 + id % 12 as int) as begin_year")
    got = claims.build_evidence(names, many.selectExpr("id as artist_id", "cast(1995 + id % 9 as int) as year"), auth)
    want = Counter((100_000, 200 * (i % 1000 < 500), 100_000 - 200 * (i % 1000 < 500), 1995 + i % 9 < 2001, 1) for i in range(100_000))
    counts = got.groupBy("authority_ids", "linked", "conflicting_links", "chronology_conflict", "releases").count().collect()
    assert {tuple(x)[:5]: x[5] for x in counts} == want
    r = random.Random(5)
    few = [(r.randrange(12), r.choice(["a", "B", "c", None]), r.choice(["s1", "s2", None])) for _ in range(30)]
    known = [(f"a{r.randrange(6)}", r.choice(["A", "b", None]), r.choice(["c", "a", None]), r.choice(["s1", "s2", None]), r.choice([1990, 2000, None])) for _ in range(20)]
    years = [(r.randrange(12), r.choice([1985, 1995, 2005, None])) for _ in range(20)]
    got = claims.build_evidence(spark.createDataFrame(few, "artist_id int, name string, external_id string"), spark.createDataFrame(years, "artist_id int, year int"),
        spark.createDataFrame(known, "authority_id string, name string, alias string, linked_id string, begin_year int"))
    want = {}
    for a in {x[0] for x in few}:
        met = [(e, y) for i, n, e in few if i == a and n for y in known if n.lower() in {(y[1] or "").lower(), (y[2] or y[1] or "").lower()}]
        since = min((y for i, y in years if i == a and y), default=None)
        want[a] = (len({y[0] for _, y in met}), sum(e is not None and e == y[3] for e, y in met), sum(None not in (e, y[3]) and e != y[3] for e, y in met),
            since is not None and any(y[4] is not None and since < y[4] for _, y in met), sum(i == a for i, _ in years))
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == want


def test_review_of_a_name_that_many_have(spark):
    many = spark.range(100_000).selectExpr("id", "'x' as external_id", "'One Name' as name")
    got = ranking.identity_review(many, many.selectExpr("external_id", "name", "id as candidate_id", "id as position", "cast(null as string) as image"))
    assert [tuple(x) for x in got.groupBy("exact_count", "match.candidate_id", "review_status").count().collect()] == [(100_000, 0, "needs_review", 100_000)]


def test_occurrences_without_an_external_id_are_spread(spark):
    """Nine of ten occurrences have no external id or two: they take part in no join by it, and no task gets them all."""
    o = spark.range(40_000).selectExpr("concat('o', id) as occurrence_id", "'p' as provider", "'artist' as entity_type", "cast(id as string) as entity_id",
        "case when id % 10 = 0 then array(concat('s', id % 3000)) when id % 10 < 5 then array('s1', 's2') end as external_ids", "cast(null as string) as asserted_id",
        "timestamp_seconds(id) as discovered_at")
    none = spark.createDataFrame([], "occurrence_id string, target_type string, target_id string, key string")
    known = spark.createDataFrame([("c", "s30")], "candidate_id string, external_id string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = converge.converge(o, none, known, spark.createDataFrame([], "artist_id string, external_id string"))
        rows = got.select("action", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert Counter(r.action for r in rows) == {converge.CREATE: 299, converge.ATTACH: 3701, converge.AMBIGUOUS: 16_000, converge.DISCOVER: 20_000}
    assert max(Counter(r.task for r in rows).values()) < 20_000


def test_actions_of_a_hot_target(spark):
    """A third of the results has one target and every result another target otherwise; no result is copied or joined for a distinct count."""
    r = random.Random(9)
    given = [(r.choice(["attach", "create", None]), None if i % 50 == 7 else "hot" if i % 3 == 0 else f"t{r.randrange(3000)}", r.choice(["a", "a", "b", None])) for i in range(9000)]
    got = metrics.action_metrics(spark.createDataFrame(given, "action string, target_id string, provider string"))
    by = {}
    for _, t, p in given:
        by.setdefault(t, set()).update({p} - {None})
    want = {}
    for a in {x[0] for x in given}:
        targets = [t for b, t, _ in given if b == a and t is not None]
        want[a] = (len(targets), len(set(targets)), sum(len(by[t]) > 1 for t in set(targets)))
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan


def test_a_batch_of_the_whole_queue_is_not_ordered(spark, monkeypatch):
    """The same candidates without places; where all are taken nothing is numbered or shuffled."""
    r = random.Random(2)
    rows = [(f"c{i % 380}", r.choice(["a", "identity_pending", None]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(50)) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "candidate_id string, state string, updated_at timestamp").repartition(5)
    monkeypatch.setattr(lifecycle, "FEW_WORK", 30)
    for state in (None, "a", "none"):
        for n in (0, 20, 40, 100, 1000):
            want = sorted(map(str, lifecycle.select_work(df, state, n).drop("queue_place").collect()))
            assert sorted(map(str, lifecycle.select_work(df, state, n, places=False).collect())) == want
    queue = df.selectExpr("*", "1L as revision", "cast(null as timestamp) as retry_at", "cast(null as string) as resume_state")
    outcomes = spark.createDataFrame([(f"c{i}", "coherent_identity_evidence", False) for i in range(380)], "candidate_id string, outcome string, mechanically_closed boolean")
    numbered, calls = lifecycle.numbered, []
    monkeypatch.setattr(lifecycle, "numbered", lambda *a: calls.append(a) or numbered(*a))
    whole = lifecycle.run_identity_batch(queue, outcomes, "2024-02-01", n=1000)
    assert not calls and whole.count() == sum(x[1] == "identity_pending" for x in rows)
    assert lifecycle.run_identity_batch(queue, outcomes, "2024-02-01", n=50).count() == 50 and len(calls) == 1
