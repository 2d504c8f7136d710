"""Small cases with known results."""

import datetime as dt
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from resolvekit.functions import exprs
from resolvekit.functions.exprs import content_id
from resolvekit.operators import admission, catalog, claims, converge, directory, lifecycle, metrics, numbering, quality, ranking
from resolvekit.sources import cache, html, listings, readers
from resolvekit.streaming import streams


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_expressions(spark):
    df = spark.createDataFrame([("  Ｂｅｙｏｎｃé  X ", "Night Drive (Deluxe Edition)"), (None, None)], "n string, t string")
    assert rows(df.select(exprs.name_key("n"), exprs.title_key("t"))) == [("beyoncé x", "night drive"), (None, "")]
    d = spark.createDataFrame([("1981", "year"), ("2024-02", "month"), ("2024-13-01", None), (None, None)], "v string, p string").select(exprs.partial_date("v", "p").alias("d"))
    got = rows(d.select(F.date_format("d.start", "yyyy-MM-dd"), F.date_format("d.end", "yyyy-MM-dd"), "d.precision"))
    assert got == [("1981-01-01", "1981-12-31", "year"), ("2024-02-01", "2024-02-29", "month"), (None, None, None), (None, None, None)]
    assert rows(spark.createDataFrame([("1,234",), ("x",)], "v string").select(exprs.int_with_commas("v"))) == [(1234,), (None,)]
    assert rows(spark.createDataFrame([("<b>A &amp; B</b><i>c</i>",)], "v string").select(exprs.html_text("v"))) == [("A & B c",)]


RELEASE = "artist_id long, id string, name string, release_date string, release_date_precision string, album_type string, total_tracks int, position long"


def test_catalog(spark):
    two = spark.createDataFrame([(1, "a", "Night Drive", "2020-01-01", "day", "album", 10, 1), (1, "b", "Night Drive (Deluxe Edition)", "2020-06-01", "day", "album", 14, 2), (1, "c", "Old Soul", "1970", "year", "album", 9, 3), (1, "d", "Old Soul (2020 Remaster)", "1970", "year", "album", 9, 4), (1, "a", "again", "2001", "year", "album", 1, 5), (1, None, "no id", "2001", "year", "album", 1, 6)], RELEASE)
    v = catalog.release_variants(two)
    assert sorted(r.id for r in v.where("kept").collect()) == ["a", "c"]
    m = catalog.catalog_metrics(spark.createDataFrame([(1, "a", "One", "2020", "year", "album", 12, 1), (1, "b", "Two", "2026-08-01", "day", "single", 1, 2)], RELEASE), "2026-08-12").first()
    assert (m.album_count, m.single_count, m.track_count, m.releases_90) == (1, 1, 13, 1)
    none = catalog.catalog_metrics(spark.createDataFrame([(1, "a", "One", None, None, "album", None, 1)], RELEASE), "2026-08-12").first()
    assert none.days_since_latest is None and none.maturity_score == 0


def test_first_stage(spark):
    schema = "n int, name string, match_name string, exact_count long, image boolean, verified boolean, duplicate boolean, ambiguity array<string>"
    data = [(1, "SZA", "SZA", 1, True, True, False, ["short_or_single_token_name"]), (2, "Two Words", "Two Words", 1, False, False, False, []), (3, "Single", "Single", 1, True, False, False, ["short_or_single_token_name"]), (4, "Two Words", "Two Words", 1, True, False, True, []), (5, "Gone", None, None, None, None, None, None)]
    got = ranking.review_priority(ranking.first_stage(spark.createDataFrame(data, schema))).orderBy("n").collect()
    assert [(r.status, r.confidence) for r in got] == [("verified_existing", 100), ("high_confidence_candidate", 95), ("manual_review_required", 79), ("conflicting_identity", 49), ("unresolved", 0)]
    assert [r.priority for r in got] == [0, 0, 55, 100, 95]


def test_retry_schedule(spark):
    t = datetime(2026, 1, 1)
    times = [0, 15, 135, 200]
    df = spark.createDataFrame([("c", "p", "o", t + timedelta(minutes=m), None, ["e"]) for m in times] + [("d", "p", "o", t, "60", []), ("d", "p", "o", t + timedelta(hours=72), None, [])], "candidate_id string, provider string, operation string, occurred_at timestamp, retry_after string, evidence_refs array<string>")
    got = lifecycle.retry_schedule(df).orderBy("candidate_id", "attempt").collect()
    waits = [None if r.next_retry_at is None else (r.next_retry_at - r.occurred_at).total_seconds() / 60 for r in got]
    assert waits == [15, 120, 1440, None, 15, None]
    assert [r.exhaustion_reason for r in got] == [None, None, None, "retry_attempts_exhausted", None, "retry_elapsed_time_exhausted"]


def test_breaker(spark):
    calls = [("p", 1, 0.0, "transient", None), ("p", 2, 1.0, "transient", None), ("p", 3, 2.0, None, None), ("p", 4, 1000.0, None, None), ("q", 5, 0.0, "authentication_or_configuration", 2000.0), ("q", 6, 1500.0, None, None), ("q", 7, 2001.0, "transient", None), ("r", 8, 0.0, "permanent_absence", None)]
    got = lifecycle.breaker_history(spark.createDataFrame(calls, "provider string, call_id long, occurred_at double, kind string, retry_after double")).orderBy("call_id").collect()
    assert [(r.state, r.skipped) for r in got] == [("closed", False), ("open", False), ("open", True), ("closed", False), ("open", False), ("open", True), ("open", False), ("closed", False)]


def test_replay_is_order_free(spark):
    schema = "candidate_id string, candidate_revision long, event_type string, next_state string, reason_code string, occurred_at timestamp, occurrence_id string, identifier string"
    t = datetime(2026, 1, 1)
    events = [("a", 1, "candidate_discovered", "discovered", "x", t, "o1", None), ("a", 2, "state_transition", "identity_pending", "y", t, None, None), ("a", 3, "discovery_attached", "identity_pending", "z", t, "o2", None), ("a", 4, "candidate_identifier_attached", "identity_pending", "w", t, None, "s1")]
    want = rows(lifecycle.replay(spark.createDataFrame(events, schema)))
    for _ in range(2):
        random.shuffle(events)
        assert rows(lifecycle.replay(spark.createDataFrame(events, schema))) == want
    assert want[0][1:3] == (4, "identity_pending") and want[0][-1] == ["o1", "o2"]


def _sequential(occ, links, candidates, registry):
    """The rule, one occurrence after another."""
    by_key, by_ext, out = {}, {}, {}
    for o, t, i, k in links:
        by_key.setdefault(k, set()).add((t, i))
    for c, e in candidates:
        by_ext.setdefault(e, set()).add(("candidate", c))
    reg = dict((e, a) for a, e in registry)
    done = {}
    for o, t, i, k in links:
        done.setdefault(o, set()).add((t, i))
    for o, p, et, ei, ext, asserted, at in sorted(occ, key=lambda r: (r[6], r[0])):
        if o in done:
            out[o] = ("idempotent_existing_occurrence", *next(iter(done[o])))
            continue
        key = f"{p}:{et}:{ei}"
        targets = set(by_key.get(key, ()))
        for e in ext:
            targets |= by_ext.get(e, set())
            if e in reg:
                targets.add(("live_artist", reg[e]))
        wrong = False
        if asserted is not None:
            if asserted in reg.values():
                targets.add(("live_artist", asserted))
            else:
                wrong = True
        made = ("candidate", f"candidate:{o}")
        if len(set(ext)) > 1 or len(targets) > 1 or wrong:
            out[o], t = ("route_ambiguous_exact_convergence_to_review", *made), made
        elif targets:
            t = next(iter(targets))
            out[o] = ("associate_existing_live_artist" if t[0] == "live_artist" else "attach_existing_candidate", *t)
        else:
            out[o], t = ("create_new_candidate" if ext else "create_identity_discovery_candidate", *made), made
            for e in ext:
                by_ext.setdefault(e, set()).add(made)
        by_key.setdefault(key, set()).add(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_converge_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    t = datetime(2026, 1, 1)
    occ = [(f"o{i:03}", "p", "artist", f"k{r.randrange(30)}", sorted({f"s{r.randrange(25)}" for _ in range(r.choice([0, 0, 1, 1, 1, 2]))}), r.choice([None] * 9 + ["live1", "nobody"]), t + timedelta(minutes=r.randrange(40))) for i in range(80)]
    links = [("o001", "candidate", "old1", f"p:artist:{occ[1][3]}"), ("x", "live_artist", "live3", "p:artist:k2")]
    candidates, registry = [("old2", "s3"), ("old3", "s4")], [("live1", "s5"), ("live2", "s6")]
    df = spark.createDataFrame(occ, "occurrence_id string, provider string, entity_type string, entity_id string, external_ids array<string>, asserted_id string, discovered_at timestamp")
    got = converge.converge(df, spark.createDataFrame(links, "occurrence_id string, target_type string, target_id string, key string"), spark.createDataFrame(candidates, "candidate_id string, external_id string"), spark.createDataFrame(registry, "artist_id string, external_id string"))
    assert {x[0]: x[1:] for x in rows(got)} == _sequential(occ, links, candidates, registry)


def test_admission_stops_at_the_first_cap(spark):
    items = [("p", i, (i - 1) // 4, True, "needs_review") for i in range(1, 21)] + [("q", i, 0, False, None) for i in range(1, 21)]
    got = admission.admit_with_budget(spark.createDataFrame(items, "provider string, position long, page long, creates_candidate boolean, target_state string"), spark.createDataFrame([("needs_review", 97)], "state string, n long"))
    n = {r.provider: (r.n, r.why) for r in got.groupBy("provider").agg(F.count_if("admitted").alias("n"), F.max("stop_reason").alias("why")).collect()}
    assert n == {"p": (3, "queue_high_water_reached:needs_review"), "q": (15, "occurrence_budget_reached")}


def test_quality_and_sources(spark, tmp_path):
    a = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k2", "y"), ("k3", "z"), ("k3", "other")], "k string, v string")
    new, bad = readers.append_new(spark.createDataFrame([("k1", "x")], a.schema), a, "k")
    assert sorted(rows(new)) == [("k2", "y")] and rows(bad) == [("k3",)]
    assert rows(quality.unchanged(a, a.repartition(3)))[0][0] is True and rows(quality.unchanged(a, a.limit(4)))[0][0] is False
    (tmp_path / "r.csv").write_text('﻿Ranking,Artist,Listeners\n1,"A, B","1,000"\n2,C,\n')
    assert [(r.rank, r.name, r.value) for r in readers.read_ranking_csv(spark, str(tmp_path / "r.csv")).orderBy("rank").collect()] == [(1, "A, B", 1000), (2, "C", None)]
    (tmp_path / "d.json").write_text('{"discoveries": [{"sourceType": "manual", "sourceName": "n", "sourceRecordId": "1", "rawArtistName": " A ", "spotifyArtistUrl": "https://open.spotify.com/artist/0123456789012345678901", "discoveredAt": "2026-01-01T00:00:00Z"}, {"rawArtistName": ""}]}')
    good, rejected = readers.read_discoveries(spark, str(tmp_path / "d.json"))
    assert [(r.raw_name, r.spotify_id) for r in good.collect()] == [("A", "0123456789012345678901")] and rejected.count() == 1
    page = "<table><tr><th>x</th></tr></table><table><tr><th>#</th><th>Artist</th></tr><tr><td>1</td><td><a>A &amp; B</a></td></tr></table>"
    t = html.extract_html_table(spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id long, html string"), ["Artist"])
    assert sorted((r.page_id, r.cells, r.error) for r in t.collect()) == [(1, {"#": "1", "Artist": "A & B"}, None), (2, None, "no_table_with_required_headers"), (3, None, "no_table_with_required_headers")]
    c = spark.createDataFrame([("p", "o", "1", datetime(2026, 1, 1), "v", None), ("p", "o", "2", datetime(2026, 1, 1), None, 404), ("p", "o", "3", datetime(2026, 1, 1), None, 503)], "provider string, operation string, identifier string, retrieved_at timestamp, value string, status_code int")
    q = spark.createDataFrame([("p", "o", str(i)) for i in range(1, 5)], "provider string, operation string, identifier string")
    assert [r.status for r in cache.lookup_cached(q, c).orderBy("identifier").collect()] == ["hit", "negative", "miss", "miss"]


def test_listings(spark):
    p = spark.createDataFrame([("r", [("a1", "Album", [("x", "X"), ("y", "Y")])])], "ref string, albums array<struct<id: string, name: string, artists: array<struct<id: string, name: string>>>>")
    assert [(r.record_id, r.entity_id) for r in listings.flatten_listing(p, "albums").collect()] == [("a1:x", "x"), ("a1:y", "y")]
    a = spark.createDataFrame([("1", "n", [("4_3", "wide", 900), ("16_9", "small", 100), ("16_9", "big", 300)], [(False, "a", "b"), (True, "Music", "R&B")], {"_total": 4})], "id string, name string, images array<struct<ratio: string, url: string, width: int>>, classifications array<struct<is_primary: boolean, segment: string, genre: string>>, upcoming map<string, bigint>")
    assert rows(listings.normalise_attractions(a)) == [("1", "n", "big", "Music", "R&B", 4)]
    b = spark.createDataFrame([("l1", "Q1", "t1", "x/NormalRank"), ("l1", "Q1", "t2", "x/NormalRank"), ("l2", "Q1", "t1", "x/DeprecatedRank"), ("l2", "Q2", "t1", "x/NormalRank")], "lookup string, qid string, external_id string, rank string")
    assert [(r.lookup, r.status, r.external_ids) for r in listings.collapse_bindings(b).orderBy("lookup").collect()] == [("l1", 200, ["t1", "t2"]), ("l2", 409, ["t1"])]


def test_empty_tables(spark):
    none = spark.createDataFrame([], RELEASE)
    assert catalog.catalog_metrics(none, "2026-01-01").count() == 0
    assert metrics.queue_ages(spark.createDataFrame([], "created_at timestamp"), "2026-01-01").first().max_hours == 0
    assert claims.claim_agreement(spark.createDataFrame([], "entity string, identifier_type string, value string, origin string")).count() == 0
    assert directory.parity(spark.createDataFrame([], "k int, v int"), spark.createDataFrame([], "k int, v int"), "k", ["v"]).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_states_at_many_instants(spark, inclusive):
    events = [("a", 1, "x", 5), ("a", 2, "y", 7), ("a", 3, "z", 7), ("a", 4, "w", 6), ("b", 1, "x", 10_400), ("c", 1, "x", None)]
    df = spark.createDataFrame(events, "candidate_id string, candidate_revision int, next_state string, occurred_at long")
    want = set()
    for t in range(10_500):
        for c in "ab":
            seen = [e for e in events if e[0] == c and (e[3] <= t if inclusive else e[3] < t)]
            if seen:
                want.add((t, c, max(seen, key=lambda e: e[1])[2], min(e[3] for e in seen)))
    got = [tuple(r) for r in lifecycle.states_as_of(df, spark.range(10_500).withColumnRenamed("id", "instant"), inclusive).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("n", [1_200, 10_100])
def test_agreement_on_many_types(spark, n):
    df = spark.createDataFrame([("e", "t7", "v", "o"), ("f", "t8", "v", "o"), ("f", "t8", "w", "o")], "entity string, identifier_type string, value string, origin string")
    got = claims.claim_agreement(df, spark.range(n).selectExpr("concat('t', id) as identifier_type")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"agreement": 1, "conflict": 1, "not_observed": 2 * n - 2}


def test_unknown_outcome_goes_to_review(spark):
    c = spark.createDataFrame([("a", "identity_pending", 3), ("b", "identity_pending", 4), ("c", "identity_pending", 5)], "candidate_id string, state string, revision long")
    c = c.withColumns({"updated_at": F.lit("2024-01-01").cast("timestamp"), "retry_at": F.lit(None).cast("timestamp"), "resume_state": F.lit(None).cast("string")})
    o = spark.createDataFrame([("a", "coherent_identity_evidence", False), ("b", "never_heard_of", False), ("c", None, False)], "candidate_id string, outcome string, mechanically_closed boolean")
    got = {r.candidate_id: (r.next_state, r.reason_code) for r in lifecycle.run_identity_batch(c, o, "2024-01-02").collect()}
    assert got == {"a": ("identity_coherent", "identity_evidence_coherent"), "b": ("needs_review", "unrouted_outcome")}


def test_numbers_are_consecutive(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("p"), F.col("id").alias("r")).repartition(11)
    got = numbering.numbered(df, [F.desc("p"), F.asc("r")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [(r.p, r.r) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


def test_titles_of_two_sources(spark):
    df = spark.createDataFrame([(["Caf\u00e9 (Deluxe Edition)", "Live", "One [Explicit]", None], ["cafe", "one explicit", "live"]), (["A", "A!"], ["a"]), (None, ["a"]), ([], [])], "a array<string>, b array<string>")
    # "explicit" stays, also in brackets; generic titles and nulls don't count
    assert [r.n for r in df.select(claims.distinctive_overlap("a", "b").alias("n")).collect()] == [2, 1, 0, 0]


def test_breaker_of_a_run(spark):
    auth, slow = "authentication_or_configuration", "transient"
    step = lambda b, t, kind, run: lifecycle.breaker_step(b, t, kind, 0.0, run, 2, 900.0)
    opened, _ = step(lifecycle.CLOSED, 0.0, auth, "r1")
    assert opened[:3] == ("open", 1, 900.0) and step(opened, 5000.0, None, "r1") == (opened, True) and step(opened, 1.0, None, "r2") == (lifecycle.CLOSED, False)
    once, _ = step(lifecycle.CLOSED, 0.0, slow, "r1")
    twice, _ = step(once, 1.0, slow, "r1")
    assert once[:2] == ("closed", 1) and twice[:3] == ("open", 2, 901.0) and step(twice, 900.0, None, "r2")[1]
    assert step(twice, 901.0, slow, "r1")[0][:3] == ("open", 3, 1801.0) and step(twice, 901.0, "permanent", "r1")[0][0] == "half_open"


def _batches(spark, tmp_path, rows, schema):
    """A stream whose micro-batches are the given lists of rows."""
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        os.utime(next((tmp_path / "in" / str(i)).glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_late_events_change_nothing(spark, tmp_path):
    calls = _batches(spark, tmp_path / "a", [[("p", 10.0, "transient", 0.0, "r"), ("p", 20.0, "transient", 0.0, "r")], [("p", 15.0, None, 0.0, "r")]], "provider string, occurred_at double, kind string, retry_after double, run_id string")
    out = streams.run_now(streams.breaker_states(calls), ["provider"], f"{tmp_path}/a/run").first()
    assert (out.state, out.failures, out.next_probe_at) == ("open", 2, 920.0)
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    work = _batches(spark, tmp_path / "b", [[("i", "busy", at(20)), ("j", "busy", at(1))], [("i", "done", at(10)), ("j", "done", at(5))], [("k", "done", at(59))], [("k", "done", at(59))]], "item string, state string, occurred_at timestamp")
    out = streams.run_now(streams.stalled_work(work, ("busy",), 5, "30 minutes"), ["item"], f"{tmp_path}/b/run", "append").collect()
    assert [(r.item, r.since) for r in out] == [("i", at(20))]


def test_intake(spark):
    row = lambda record, name, x, asserted, day: ("chart", "n", record, name, x, asserted, dt.datetime(2026, 1, day))
    d = spark.createDataFrame([row("1", "A", "x1", None, 1), row("1", "A again", "x1", None, 2), row("2", "B", "x1", None, 3), row("3", "C", "x2", None, 4), row("4", "D", "x3", None, 5), row("5", "E", None, None, 6)], "source_type string, source_name string, source_record_id string, name string, external_id string, asserted_id string, discovered_at timestamp")
    known = d.where("source_record_id = '4'").select(content_id("source_name", "source_record_id", "source_type").alias("discovery_id"))
    registry = spark.createDataFrame([("artist_1", "x2")], "artist_id string, external_id string")
    queue = spark.createDataFrame([], "candidate_id string, state string, name string, external_id string, position long")
    directory = spark.createDataFrame([("C", "x2")], "name string, external_id string")
    ids = {r.source_record_id: "candidate:" + r.i for r in d.select("source_record_id", content_id("source_name", "source_record_id", "source_type").alias("i")).collect()}
    got = {r.candidate_id: r for r in converge.intake(d, known, registry, queue, directory).collect()}
    assert set(got) == {ids[k] for k in "1235"}
    assert (got[ids["2"]].next_state, got[ids["2"]].reason_code, got[ids["2"]].duplicate_of) == ("duplicate", "queued_spotify_duplicate_detected", ids["1"])
    assert got[ids["1"]].next_state == "identity_pending" and got[ids["3"]].next_state == "duplicate" and got[ids["3"]].live_id == "artist_1"
