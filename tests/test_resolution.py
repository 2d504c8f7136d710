"""Bridges, interpretation, closure and strict review on small tables, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from resolvekit.operators import bridges, resolution


def test_follow_ends_on_loops(spark):
    r = random.Random(4)
    nodes = [f"n{i}" for i in range(12)]
    edges = [(r.choice(nodes), r.choice(nodes), r.choice("ab")) for _ in range(30)] + [("n0", None, "a"), (None, "n1", "a")]
    starts = [("x", "n0"), ("x", "n1"), ("y", "n5"), ("z", "far"), ("z", None)]
    got = bridges.follow(spark.createDataFrame(starts, "candidate_id string, node string"), spark.createDataFrame(edges, "node string, to_node string, origin string"))
    want, front = {}, [(c, n, (), (n,)) for c, n in starts if n]
    while front:
        new = {}
        for c, n, o, p in front:
            if (c, n, o) not in want:
                new[c, n, o] = min(new.get((c, n, o), p), p)
        want |= new
        front = [(c, t, tuple(sorted({*o, s})), (*p, t)) for (c, n, o), p in new.items() for f, t, s in edges if f == n and t]
    assert {(x.candidate_id, x.node, tuple(x.origins)): (x.hops, tuple(x.path)) for x in got.collect()} == {k: (len(p) - 1, p) for k, p in want.items()}


def test_bridge_outcomes(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    ids = lambda *v: [("discovery", x) for x in v]
    occurrences = df([("local", "o1", ids("d1"), []), ("hop", "o2", ids("d2"), ["u9", None]), ("dead", "o3", ids("d3"), []), ("mixed", "o4", ids("d4"), ["u4"]), ("two", "o5", ids("d5"), []),
        ("lost", "o6", [], ["u6"]), ("apart", "o7", ids("d7"), ["u7"]), ("many", "o8", [], ["u8"])], "candidate_id string, occurrence_id string, ids array<struct<kind:string,value:string>>, urls array<string>")
    local = df([("o1", "x1", "ticketmaster"), ("o1", "x1", "setlist"), ("o9", "x0", "setlist")], "occurrence_id string, external_id string, asserted_by string")
    ok, gone = ["normal"], ["deprecated", "deprecated"]
    statements = df([("discovery", "d1", "Q1", ok, [], [], ["zz"]), ("discovery", "d2", "Q2", ["deprecated", "normal"], [], ["m2"], []), ("discovery", "d3", "Q3", gone, [], [], ["x3"]),
        ("discovery", "d3", "Q33", [], [], [], ["x3"]), ("discovery", "d4", "Q4", ok, ["person"], ["m4"], ["x4"]), ("discovery", "d5", "Q5", ok, [], [], ["x5"]),
        ("discovery", "d5", "Q55", ok, [], [], ["x5"]), ("discovery", "d7", "Q7", ok, [], [], ["x7"])],
        "kind string, value string, entity_id string, ranks array<string>, types array<string>, authority_ids array<string>, external_ids array<string>")
    lookups = df([("u4", "m4"), ("u6", "m6"), ("u7", "m7"), ("u8", "m81"), ("u8", "m82"), ("u9", None)], "url string, authority_id string")
    records = df([("m2", "Person", ["x2"]), ("m4", "Choir", ["x4"]), ("m7", None, ["x77"]), ("m81", None, ["q"])], "authority_id string, artist_type string, external_ids array<string>")
    asked = df([(c,) for c in ("local", "hop", "dead", "mixed", "two", "lost", "apart", "many", "none")], "candidate_id string")
    found, paths = bridges.discover_bridges(asked, occurrences, local, statements, lookups, records)
    got = {r.candidate_id: (r.status, r.external_id, r.alternates, r.contradictions) for r in found.collect()}
    assert got == {
        "local": (bridges.UNIQUE, "x1", [], []), "hop": (bridges.UNIQUE, "x2", [], []), "dead": (bridges.REVIEW, None, [], []), "mixed": (bridges.CONFLICT, None, [], [bridges.MISMATCH]),
        "two": (bridges.REVIEW, None, [bridges.SEVERAL_ENTITIES], []), "lost": (bridges.REVIEW, None, [bridges.NO_RECORD], []), "apart": (bridges.CONFLICT, None, [], [bridges.DISAGREE]),
        "many": (bridges.REVIEW, None, [bridges.SEVERAL_BY_URL, bridges.SEVERAL_AUTHORITIES], []), "none": (bridges.REVIEW, None, [bridges.NO_OCCURRENCE], []),
    }
    hop = paths.where("candidate_id = 'hop'").first()
    assert hop.path == ["id:discovery:d2", "entity:Q2", "authority:m2", "external:x2"] and hop.origins == ["musicbrainz", "wikidata"] and hop.origin == "musicbrainz"
    nothing = [t.limit(0) for t in (asked, occurrences, local, statements, lookups, records)]
    assert bridges.discover_bridges(*nothing)[0].count() == 0


def test_bridges_of_an_id_that_many_ask(spark, monkeypatch):
    """2,000 candidates ask an id that 2,000 entities state: a decision each, and ways are followed from the id once."""
    follow, followed = bridges.follow, []
    monkeypatch.setattr(bridges, "follow", lambda starts, edges: followed.append(starts.count()) or follow(starts, edges))
    many = spark.range(2000)
    asked = many.select(F.col("id").cast("string").alias("candidate_id"))
    occurrences = asked.select("candidate_id", F.concat(F.lit("o"), "candidate_id").alias("occurrence_id"), F.expr("array(named_struct('kind', 'legacy', 'value', 'l'))").alias("ids"), F.expr("array('u')").alias("urls"))
    statements = many.selectExpr("'legacy' as kind", "'l' as value", "concat('Q', id) as entity_id", "array('normal') as ranks", "array(if(id = 7, 'person', 'group')) as types",
        "array(concat('m', id)) as authority_ids", "array(concat('x', id)) as external_ids")
    none = spark.createDataFrame([], "occurrence_id string, external_id string, asserted_by string")
    lookups = spark.createDataFrame([("u", "m1")], "url string, authority_id string")
    found, paths = bridges.discover_bridges(asked, occurrences, none, statements, lookups, spark.createDataFrame([], "authority_id string, artist_type string, external_ids array<string>"))
    assert [tuple(x) for x in found.groupBy("status", "alternates").count().collect()] == [(bridges.REVIEW, sorted([bridges.SEVERAL_ENTITIES, bridges.SEVERAL_AUTHORITIES]), 2000)]
    assert followed == [2] and paths.where("candidate_id = '5'").count() == 2000


def test_mutual_links(spark):
    r = random.Random(2)
    rows = []
    for e in range(60):
        ids = [f"p{i}" for i in range(r.randrange(1, 4))]
        for i in ids:
            others = [j for j in [*ids, "else"] if r.random() < 0.85]
            rows += [(e, i, others or None)] * r.choice([1, 1, 2])
    got = {x.entity: x.mutual for x in resolution.mutual_links(spark.createDataFrame(rows, "entity int, id string, others array<string>")).collect()}
    links = {}
    for e, i, o in rows:
        links.setdefault(e, {}).setdefault(i, set()).update(o or [])
    assert got == {e: len(x) > 1 and all(b in x[a] for a, b in itertools.permutations(x, 2)) for e, x in links.items()} and True in got.values()


CODES = ["mutually_linked_discogs_alias_profiles", "compatible_alias_chronology", "musicbrainz_catalog_overlap"]


def strict(rep, cats, auth, prof):
    """The reasons against a report, one after another."""
    out = []
    say = lambda name, bad: out.append(name) if bad else None
    say("not_review_only", rep[1] is not True)
    say("not_multiplicity_interpretation", rep[2] != "provider_profile_multiplicity")
    say("semantic_contradiction_present", rep[3])
    say("unresolved_identifier_present", rep[4])
    say("no_positive_multiplicity_evidence", not rep[5])
    say("missing_provenance", not rep[6])
    say("unsafe_side_effect_flag", rep[7] is not False)
    say("no_positive_catalog_anchor", not any(c[4] > 0 for c in cats))
    own = [c for c in cats if c[1] == "spotify"]
    full = [c for c in own if c[4] > 0]
    dated = [c for c in own if c[5] is not None]
    say("incompatible_active_catalogs", len(full) > 1 and any(not set(a[3]) & set(b[3]) for a, b in itertools.combinations(dated, 2)))
    named = [a for a in auth if a[1]]
    say("incompatible_artist_types", len({a[2] for a in named if a[2]}) > 1)
    say("incompatible_chronology", len({a[3] for a in named if a[3]}) > 1 and CODES[1] not in rep[5])
    known = [p for p in prof if p[1]]
    say("uncorroborated_discogs_multiplicity", len(known) > 1 and CODES[0] not in rep[5] and len({p[2] for p in known if p[2]}) != 1)
    say("empty_catalogs_cannot_establish_identity", len(own) > 1 and not full)
    return out


def test_review_multiplicity(spark):
    r = random.Random(8)
    reports, catalogs, authorities, profiles = [], [], [], []
    for e in range(150):
        reports.append((e, r.choice([True, True, True, False, None]), r.choice(["provider_profile_multiplicity"] * 3 + [None]), r.choice([[], [], ["x"]]), r.choice([[], [], ["y"]]),
            r.sample(CODES, r.randrange(3)), r.choice([0, 2, 2, None]), r.choice([False, False, True, None])))
        catalogs += [(e, r.choice(["spotify", "spotify", "musicbrainz"]), f"c{i}", r.sample(["a", "b", "c"], r.randrange(3)), r.choice([0, 3]), r.choice([None, 1990])) for i in range(r.randrange(4))]
        authorities += [(e, r.choice(["n", "", None]), r.choice(["Person", "Group", None]), r.choice(["1", "2", None])) for _ in range(r.randrange(3))]
        profiles += [(e, r.choice(["n", "n", None]), r.choice(["A", "A", "B", "", None])) for _ in range(r.randrange(3))]
    got = resolution.review_multiplicity(
        spark.createDataFrame(reports, "entity int, review_only boolean, interpretation string, contradictions array<string>, unresolved array<string>, multiplicity_evidence array<string>, provenance int, unsafe boolean"),
        spark.createDataFrame(catalogs, "entity int, provider string, id string, titles array<string>, releases int, earliest_year int"),
        spark.createDataFrame(authorities, "entity int, name string, artist_type string, begin string"), spark.createDataFrame(profiles, "entity int, name string, real_name string"),
    )
    of = lambda rows, e: [x for x in rows if x[0] == e]
    want = {rep[0]: strict(rep, of(catalogs, rep[0]), of(authorities, rep[0]), of(profiles, rep[0])) for rep in reports}
    assert {x.entity: x.review_reasons for x in got.collect()} == want
    assert len({y for x in want.values() for y in x}) == 13


@pytest.mark.parametrize("audit, records, outcome", [(True, True, "coherent_identity_evidence"), (False, True, "insufficient_corroboration"), (True, False, "insufficient_corroboration")])
def test_batch_outcome_needs_evidence(spark, audit, records, outcome):
    agreement = spark.createDataFrame([(1, "a", "agreement"), (1, "b", "agreement")], "entity int, identifier_type string, status string")
    keep = lambda rows, schema, given=True: spark.createDataFrame(rows if given else [], schema)
    got = resolution.batch_outcome(agreement, keep([(1, "m", "d")], "entity int, authority_id string, profile_id string"),
        keep([(1, "musicbrainz"), (1, "discogs")], "entity int, provider string", records), keep([(1, 0)], "entity int, competitors int", audit),
        keep([], "entity int, provider string"), ("a", "b")).first()
    assert got.outcome == outcome and (got.missing_evidence == []) == (outcome == "coherent_identity_evidence")


def test_stored_ids_without_anything(spark):
    """An entity of which only the stored id is known, and empty tables."""
    schema = {
        "stored": "entity string, external_id string", "claims": "entity string, identifier_type string, value string, source string, asserted_by string, position long",
        "authorities": "entity string, id string, artist_type string, begin string, homepages array<string>, urls array<string>", "profiles": "entity string, id string, real_name string, aliases array<string>",
        "catalogs": "entity string, id string, titles array<string>, releases long", "retired": "entity string, provider string, id string, state string", "lookups": "entity string, id string",
        "audit": "entity string, competitors long, linked_ids array<string>", "errors": "entity string, provider string", "blocked": "entity string, code string",
    }
    legal = spark.createDataFrame([], "entity string, relationship_type string, ids array<string>, source string, evidence_ref string, corroborations array<struct<source:string,evidence_ref:string>>")
    t = {n: spark.createDataFrame([("e", "x")] if n == "stored" else [], s) for n, s in schema.items()}
    row = resolution.resolve_identities(t, legal).first()
    assert (row.outcome, row.next_state, row.mechanically_closed) == ("unresolved_identity", "failed_match", False)
    assert row.missing_evidence == ["wikidata_qid", "musicbrainz_artist_id", "discogs_artist_id", "musicbrainz_same_name_audit"]
    assert resolution.resolve_identities(t | {"stored": t["stored"].where(F.lit(False))}, legal).count() == 0


def test_facts_need_no_joins(spark):
    """Three catalogs of which no two share two titles, and two that do; whatever the tables are, they are added up."""
    schema = {
        "stored": "entity string, external_id string", "claims": "entity string, identifier_type string, value string, source string, asserted_by string, position long",
        "authorities": "entity string, id string, artist_type string, begin string, homepages array<string>, urls array<string>", "profiles": "entity string, id string, real_name string, aliases array<string>",
        "catalogs": "entity string, id string, titles array<string>, releases long", "retired": "entity string, provider string, id string, state string", "lookups": "entity string, id string",
        "audit": "entity string, competitors long, linked_ids array<string>", "errors": "entity string, provider string", "blocked": "entity string, code string",
    }
    rows = {
        "stored": [(e, "x") for e in "abc"],
        "claims": [("c", "discogs", "p1", "musicbrainz", "m1", 1), ("c", "discogs", "p1", "musicbrainz", "m1", 2), ("c", "discogs", "p2", "musicbrainz", "m1", 3), ("c", "musicbrainz", "m2", "wikidata", None, 1)],
        "authorities": [("c", "m1", "Person", "1990", ["h", "g"], []), ("c", "m2", "Person", "1990", ["g"], []), ("c", "m2", None, None, [], [])],
        "profiles": [("c", "p1", "Ann", ["p2", "p2", None, "p1"]), ("c", "p1", "", []), ("c", "p2", "Ann", ["p1"])],
        "catalogs": [("a", "1", ["s", "t"], 0), ("a", "2", ["s", "u"], 0), ("a", "3", ["t", "u"], 0), ("b", "1", ["s", "t", "s"], 1), ("b", "2", ["t", "s"], 0), ("c", "1", None, None)],
    }
    t = {n: spark.createDataFrame(rows.get(n, []), s) for n, s in schema.items()}
    got = resolution.interpret(t, resolution.gather_claims(t["stored"], t["claims"], t["authorities"], t["profiles"], t["lookups"]))
    found = {x.entity: (x.multiplicity_evidence, x.contradictions, x.unresolved, x.anchored, x.mutual) for x in got.collect()}
    assert found["a"] == ([], [], [], False, False) and found["b"] == (["musicbrainz_catalog_overlap"], [], [], True, False)
    assert found["c"] == (["mutually_linked_discogs_alias_profiles", "compatible_alias_chronology", "multiple_discogs_profiles_asserted_by_one_musicbrainz_entity", "shared_discogs_real_name"], [], [], False, True)
    small = t | {"catalogs": t["catalogs"].where("entity = 'b'")}
    plan = resolution.identity_facts(small, t["claims"].withColumn("position", F.struct(F.lit(1), F.col("position"), F.lit("")))).select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def _plain(claims, auth, prof, retired, catalogs, relations):
    """Facts of one entity, one after another."""
    ids = {p: {c[1] for c in claims if c[0] == p} for p in ("musicbrainz", "discogs", "wikidata", "spotify")}
    mb, dg = ids["musicbrainz"], ids["discogs"]
    low = lambda v: (v is not None, v or 0)
    lead = lambda p: min(((c[4][0], low(c[4][1]), (c[4][2] is not None, c[4][2] or "")), c[1]) for c in claims if c[0] == p)[1] if ids[p] else None
    gone = {(p, i) for p, i, _ in retired}
    known = {p[0] for p in prof}
    names = lambda of, some: {of(p) for p in prof if p[0] in some and of(p)}
    key = lambda p: " ".join((p[1] or "").lower().split())
    links = {(p[0], x) for p in prof for x in p[2] or [] if x and x != p[0]}
    pages = {(a[0], h) for a in auth for h in a[3] or [] if a[0] in mb}
    both = {(i, h) for i, h in pages if any(j != i and g == h for j, g in pages)}
    begins = {(a[0], a[2]) for a in auth if a[2] is not None}
    titles = {(i, x) for i, ts, _ in catalogs for x in ts or [] if x}
    of_title = {x: {i for i, y in titles if y == x} for _, x in titles}
    stored = {c[1] for c in claims if c[0] == "spotify" and c[2] == "stored"}
    says = lambda p: {(c[3], c[1]) for c in claims if c[0] == p and c[2] == "musicbrainz" and c[3]}
    lost = [("discogs", i) for i in sorted(dg - known)] + [("musicbrainz", i) for i in sorted(mb - {a[0] for a in auth})]
    named = {i for i in known if all(key(p) for p in prof if p[0] == i)}
    pairs = [len({x for x in of_title if {i, j} <= of_title[x]}) for i, j in itertools.combinations(sorted({c[0] for c in catalogs}), 2)]
    return {
        "mb": len(mb), "dg": len(dg), "wd": len(ids["wikidata"]), "sp": len(ids["spotify"]), "mb_records": len(mb & {a[0] for a in auth}), "dg_records": len(dg & known), "begins": len({b for _, b in begins}),
        "with_pages": len({i for i, _ in pages}), "most_profiles": max((len({v for b, v in says("discogs") if b == a}) for a, _ in says("discogs")), default=0),
        "agreeing": max((len({b for b, v in says("spotify") if v == s and b in mb}) for s in stored), default=0) if len(stored) == 1 else 0,
        "active_others": len([i for i in ids["wikidata"] if ("wikidata", i) not in gone]) - (1 if ids["wikidata"] and ("wikidata", lead("wikidata")) not in gone else 0),
        "mutual": len(known) > 1 and all((a, b) in links for a, b in itertools.permutations(known, 2)), "linked": len(dg) > 1 and all(a in known and (a, b) in links for a, b in itertools.permutations(dg, 2)),
        "kinds": len({a[1] for a in auth if a[1]}) > 1, "same_begin": any(len({i for i, c in begins if c == b}) > 1 for _, b in begins), "joint": any(n > 1 for n in pairs),
        "linked_pages": bool(mb) and any(i == lead("musicbrainz") for i, _ in both), "one_name": len(names(lambda p: p[1], dg)) == 1, "every_name": bool(dg) and dg <= named,
        "shared_name": bool(dg) and dg <= named and len(names(key, dg)) == 1, "corroborated": any(set(r) == dg for r in relations), "redirected": any(r[2] == "redirected" for r in retired),
        "anchored": any((c[2] or 0) > 0 for c in catalogs), "confirmed": any(c[0] == "spotify" and c[1] in stored and c[2] == "musicbrainz" for c in claims),
        "graph_says": any(c[0] == "wikidata" and c[2] == "wikidata" for c in claims),
        "lost_ids": [f"{p}:{i}" for p, i in lost if (p, i) not in gone], "lost_records": [f"missing_{p}_record:{i}" for p, i in sorted(lost, key=lambda x: (x[0] == "discogs", x[1]))],
    }


def _random_tables(spark, n=120):
    r = random.Random(11)
    some = lambda f, most: [f() for _ in range(r.randrange(most))]
    mbid, dgid, page = lambda: r.choice(["m1", "m2", "m3"]), lambda: r.choice(["p1", "p2", "p3"]), lambda: r.choice(["h", "g", "i", None])
    pick = lambda: r.choice([("musicbrainz", mbid()), ("discogs", dgid()), ("wikidata", r.choice(["Q1", "Q2"])), ("spotify", r.choice(["x", "y"])), ("else", "z")])
    place = lambda: (r.choice([0, 1, 2, 90]), r.choice([None, 0, 1, 2, -1, 1 << 50]), r.choice(["", "a", "m1", "m2", None]))
    claim = lambda: (*pick(), r.choice(["stored", "musicbrainz", "musicbrainz", "wikidata", "discogs", None]), r.choice([None, mbid()]), place())
    given = {e: {
        "claims": some(claim, 12), "authorities": some(lambda: (mbid(), r.choice(["Person", "Group", None]), r.choice(["1990", "1991", None]), r.choice([None, some(page, 3)])), 4),
        "profiles": some(lambda: (dgid(), r.choice(["Ann Lee", "ann  lee", "Bob", "", None]), r.choice([None, some(lambda: r.choice([dgid(), None]), 4)])), 5),
        "retired": some(lambda: (*pick(), r.choice(["redirected", "deprecated", None])), 3), "catalogs": some(lambda: (mbid(), r.choice([None, some(lambda: r.choice(["s", "t", "u", "", None]), 4)]), r.choice([0, 2, None])), 5),
        "relations": some(lambda: sorted({dgid(), dgid()}), 3)} for e in range(n)}
    schema = {
        "claims": "identifier_type string, value string, source string, asserted_by string, position struct<a:int,b:bigint,c:string>", "authorities": "id string, artist_type string, begin string, homepages array<string>",
        "profiles": "id string, real_name string, aliases array<string>", "retired": "provider string, id string, state string", "catalogs": "id string, titles array<string>, releases long",
    }
    t = {k: spark.createDataFrame([(f"e{e}", *x) for e, tables in given.items() for x in tables[k]], f"entity string, {s}") for k, s in schema.items()}
    t |= {"stored": spark.createDataFrame([(f"e{e}", "x") for e in given], "entity string, external_id string"), "lookups": spark.createDataFrame([("e1", "m1"), ("e1", "m2"), ("e1", "m2"), ("e2", None)], "entity string, id string"),
        "audit": spark.createDataFrame([("e1", 2, ["b", None, "a"]), ("e1", None, ["c"]), ("e2", -(1 << 60), None), ("e3", None, [])], "entity string, competitors long, linked_ids array<string>"),
        "errors": spark.createDataFrame([("e1", "p"), ("e1", "p")], "entity string, provider string"), "blocked": spark.createDataFrame([("e1", "u"), ("e1", "t"), (None, "n")], "entity string, code string")}
    told = [(f"e{e}", "legal_name_alias", x, "discogs", "ref", [("wikidata", "ref")]) for e, tables in given.items() for x in tables["relations"]]
    relations = spark.createDataFrame(told, "entity string, relationship_type string, ids array<string>, source string, evidence_ref string, corroborations array<struct<source:string,evidence_ref:string>>")
    return given, t, relations


def test_facts_against_a_plain_version(spark):
    given, t, relations = _random_tables(spark)
    got = {x.entity: x for x in resolution.entity_facts(t, t["claims"], relations).collect()}
    assert set(got) == {*(f"e{e}" for e in given), None} and got[None].blocked == "n" and got[None].own == []
    for e, tables in given.items():
        want = _plain(*(tables[k] for k in ("claims", "authorities", "profiles", "retired", "catalogs", "relations")))
        assert {k: got[f"e{e}"][k] for k in want} == want, e
    a, b, c = (got[f"e{e}"] for e in (1, 2, 3))
    assert (a.url_entities, a.competitors, a.audited, a.linked_lo, a.linked_hi, a.errors, a.blocked, [x.id for x in a.own]) == (2, 2, True, "a", "c", 2, "t", ["x"])
    assert (b.url_entities, b.competitors, b.audited, b.linked_lo) == (0, -(1 << 60), True, None) and (c.competitors, c.audited, c.blocked) == (None, True, None)


def test_rows_are_dealt_by_entity_once(spark):
    """One exchange and no aggregation by id; what a task takes at once doesn't tell in the facts."""
    _, t, relations = _random_tables(spark, 40)
    t |= {"catalogs": t["catalogs"].where(F.lit(False))}
    plan = resolution.entity_facts(t, t["claims"], relations)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(entity" in plan and "Aggregate" not in plan


def test_facts_of_few_rows_at_once(spark, monkeypatch):
    from resolvekit.operators import facts

    _, t, relations = _random_tables(spark, 40)
    rows = resolution._union(resolution._fact_rows(t, t["claims"], relations)).sort("entity").select("entity", "code", "id", "more").toArrow()
    rows = rows.replace_schema_metadata(None).combine_chunks()
    whole = [x for b in facts.gathered(iter(rows.to_batches())) for x in b.to_pylist()]
    assert len(whole) == 41
    for taken, size in ((1, 7), (50, 1), (64, 100)):
        monkeypatch.setattr(facts, "TAKEN", taken)
        assert [x for b in facts.gathered(iter(rows.to_batches(max_chunksize=size))) for x in b.to_pylist()] == whole


@pytest.mark.parametrize("many, block", [(0, 2), (2, 3), (8, 2048), (1 << 30, 1)])
def test_ways_of_starts_with_many_ends(spark, monkeypatch, many, block):
    """Ways of the result aren't grouped after they met; the same ways whichever starts count as those with many ends."""
    monkeypatch.setattr(bridges, "MANY", many)
    monkeypatch.setattr(bridges, "BLOCK", block)
    r = random.Random(12)
    kinds = ["discovery", "legacy"]
    ids = {f"c{i}": [(r.choice(kinds), f"v{r.randrange(6)}") for _ in range(r.randrange(4))] for i in range(30)}
    urls = {c: [f"u{r.randrange(3)}" for _ in range(r.randrange(2))] for c in ids}
    statements = [(k, f"v{v}", f"Q{r.randrange(25)}", ["normal"], [], [f"m{r.randrange(4)}" for _ in range(r.randrange(2))], [f"x{r.randrange(12)}" for _ in range(r.randrange(3))]) for k in kinds for v in range(6) for _ in range(r.choice([1, 2, 14]))]
    lookups, local, records = [("u0", "m0"), ("u1", "m1"), ("u1", "m2")], [("oc3", "x1", "setlist"), ("oc3", "x1", "wikidata")], [(f"m{i}", None, [f"x{i}", f"y{i}", None]) for i in range(3)]
    df = spark.createDataFrame
    _, paths = bridges.discover_bridges(df([(c,) for c in ids], "candidate_id string"),
        df([(c, f"o{c}", ids[c], urls[c]) for c in ids] * 2, "candidate_id string, occurrence_id string, ids array<struct<kind:string,value:string>>, urls array<string>"),
        df(local, "occurrence_id string, external_id string, asserted_by string"),
        df(statements, "kind string, value string, entity_id string, ranks array<string>, types array<string>, authority_ids array<string>, external_ids array<string>"),
        df(lookups, "url string, authority_id string"), df(records, "authority_id string, artist_type string, external_ids array<string>"))
    edges = {(f"id:{k}:{v}", f"entity:{q}", "wikidata") for k, v, q, *_ in statements} | {(f"entity:{s[2]}", f"{n}:{x}", "wikidata") for s in statements for n, xs in (("authority", s[5]), ("external", s[6])) for x in xs}
    edges |= {(f"url:{u}", f"authority:{m}", "musicbrainz") for u, m in lookups}
    want = {("c3", "x1", o, (o,)): (1, ("occurrence:oc3", "external:x1")) for _, _, o in local}
    for c in ids:
        front = [] if c == "c3" else [((), (n,)) for n in {*(f"id:{k}:{v}" for k, v in ids[c]), *(f"url:{u}" for u in urls[c])}]
        ways = []
        while front:
            front = [(tuple(sorted({*o, by})), (*p, to)) for o, p in front for at, to, by in edges if p[-1] == at]
            ways += front
        heads = {p[-1] for _, p in ways if p[-1].startswith("authority:")}
        further = [(tuple(sorted({*o, "musicbrainz"})), (*p, f"external:{x}")) for o, p in ways for m, _, xs in records if heads == {p[-1]} == {f"authority:{m}"} for x in xs if x]
        for origin, found in (("wikidata", [w for w in ways if w[1][-1].startswith("external:")]), ("musicbrainz", further)):
            for o, p in found:
                k, way = (c, p[-1][9:], origin, o), (len(p) - 1, p)
                want[k] = min(want.get(k, way), way)
    got = [((x.candidate_id, x.external_id, x.origin, tuple(x.origins)), (x.hops, tuple(x.path))) for x in paths.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert paths._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")
