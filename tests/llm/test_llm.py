"""The llm operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolvekit.llm import decontaminate, filters, langid, lm_score, ngram_join, packing, pii, quality, quality_rules, substring, text, warc
from resolvekit.llm.queries import tokenizer_paths
from resolvekit.operators import graph

DOCS = "doc_id long, text string, lang string, key string, row string, score string"


@pytest.fixture(scope="module")
def corpus():
    """Rows (doc_id, text): near and exact copies, shared passages, nulls, blanks, a long text, a repeated row."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)] + ["é" * 3, "Ünder", "THE", "<|endoftext|>"]
    make = lambda n: [r.choice(words) for _ in range(n)]
    out = []
    base, passage = make(300), make(70)
    for i in range(6):
        w = list(base)
        for k in r.sample(range(300), i * 2):
            w[k] = r.choice(words)
        out.append(" ".join(w))
    out += [out[0], out[0].upper(), " ".join(make(40) + passage + make(30)), " ".join(make(10) + passage), "\n".join(make(55)), "one", "one", "one two", "", None, " \t\n ", " ".join(make(4000)), " ".join(base * 6)]
    out += [" ".join(make(r.randrange(1, 120))) for _ in range(12)]
    rows = [(3 * i + 1, t) for i, t in enumerate(out)]
    return rows + [rows[2], rows[2], (None, out[0])]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "k", "r", "s") for i, t in corpus], DOCS).repartition(3)


def split(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_words(corpus):
    import pyarrow as pa

    w = text.Words(pa.array([t for _, t in corpus], pa.string()))
    assert [w.bytes_of(i) for i in range(len(w.start))] == [x for _, t in corpus for x in split(t)]
    h = dict(zip((w.bytes_of(i) for i in range(len(w.start))), w.hashes().tolist(), strict=True))
    assert len(set(h.values())) == len(h)


def test_packing(spark, corpus, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_paths()[0])
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [0] for i, t in corpus}
    got = packing.pack(docs, *tokenizer_paths(), capacity=64).collect()
    seen, place = collections.Counter(), collections.defaultdict(list)
    for r in got:
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == struct.pack(f"<{len(want)}I", *want) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id, r.start] += 1
        place[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(i for i, _ in corpus)
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in corpus) and all(n == copies[i] for (i, _), n in seen.items())
    for spans in place.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert sum(64 * len(place) - sum(n for s in place.values() for _, n in s) for _ in [0]) <= 0.05 * 64 * len(place)
    assert packing.pack(docs.limit(0), *tokenizer_paths()).count() == 0
    crc = packing.pack(docs, *tokenizer_paths(), with_ids=False).where("doc_id = 34").first()
    assert crc.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids[34])}I", *ids[34]))


def test_best_fill():
    r = random.Random(1)
    for _ in range(50):
        counts = collections.Counter(r.randrange(1, 40) for _ in range(8))
        room = r.randrange(1, 100)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= room}
        taken = packing.best_fill(counts, sorted(counts, reverse=True), room)
        assert sum(n * k for n, k in taken.items()) == max(sums) and all(k <= counts[n] for n, k in taken.items())


def _near(corpus, n, num, den):
    sets = []
    for i, t in corpus:
        w = split((t or "").encode().lower().decode())
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}))
    root = {i: i for i, _ in sets if i is not None}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("n,num,den,panel", [(3, 9, 10, 2000), (5, 8, 10, 2), (2, 1, 1, 2000)])
def test_ngram_join(spark, corpus, docs, n, num, den, panel, monkeypatch):
    monkeypatch.setattr(ngram_join, "PANEL", panel)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    got = sorted((tuple(r) for r in ngram_join.ngram_jaccard_join(docs, n, num, den).collect()), key=str)
    assert got == _near(corpus, n, num, den)


@pytest.mark.parametrize("few,columns,products", [(48, 2048, 1 << 20), (2, 16, 50), (0, 7, 1)])
def test_join_block(few, columns, products, monkeypatch):
    for k, v in (("FEW_ROWS", few), ("COLUMNS", columns), ("PRODUCTS", products), ("ROWS", 5)):
        monkeypatch.setattr(ngram_join, k, v)
    r = np.random.default_rng(few)
    base = [r.choice(500, 60, False) for _ in range(3)]
    sets = [np.unique(np.concatenate([r.choice(b, 56, False), r.choice(500, int(r.integers(0, 8)), False)])).astype(np.uint64) for b in base for _ in range(9)] + [np.array([7], np.uint64)] * 2
    node = r.permutation(len(sets)) * 10
    for side, label in ((None, None), (r.integers(1, 3, len(sets)), None), (None, r.integers(0, 20, len(sets))), (r.integers(1, 3, len(sets)), r.integers(0, 20, len(sets)))):
        root = {i: i if label is None else -1 - int(label[i]) for i in range(len(sets))}
        had = dict(root)

        def join(of, i, j):
            a, b = of[i], of[j]
            for k in of:
                of[k] = a if of[k] == b else of[k]

        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 10 * o >= 8 * (len(sets[i]) + len(sets[j]) - o) and (side is None or side[i] != side[j]):
                    join(root, i, j)
        place = {int(x): i for i, x in enumerate(node)}
        for a, b in ngram_join.join_block(node, sets, 8, 10, side, label):
            join(had, place[a], place[b])
        same = lambda of: {frozenset(k for k in of if of[k] == v) for v in of.values()}
        assert same(root) == same(had)


def test_large_block_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PANEL", 40)
    monkeypatch.setattr(ngram_join, "PIVOTS", 8)
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{r.randrange(10**6)}" if k in hit else w for k, w in enumerate(base))) for i in range(260) for hit in [set(r.sample(range(120), 2))]]
    rows += [(2000 + i, " ".join(base[:60] + [f"y{i}" if k == 50 else f"z{i // 2}-{k}" for k in range(60)])) for i in range(40)]
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert sorted(got.items()) == [(i, c) for i, _, c in sorted(_near_fast(rows))]


def _near_fast(rows):
    sets = [(i, {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}) for i, t in rows]
    where, root = collections.defaultdict(list), {i: i for i, _ in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    at = dict(sets)
    for i, s in sets:
        for x in s:
            where[x].append(i)
    for i, s in sets:
        for j, o in collections.Counter(j for x in s for j in where[x] if j < i).items():
            if find(i) != find(j) and 100 * o >= 90 * (len(s) + len(at[j]) - o):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in sets]


def test_near_duplicates_leave_one(spark, corpus, docs):
    kept = ngram_join.drop_near_duplicates(docs, 5, 8, 10)
    assert kept.columns == docs.columns
    want = sorted({i for i, n, c in _near(corpus, 5, 8, 10) if i == c and i is not None})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert ngram_join.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: find(x) for x in got}


@pytest.mark.parametrize("shard", [1_000_000, 300, 60])
def test_substring(spark, corpus, docs, shard, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", shard)
    first = {}
    for i, t in corpus:
        w = split(t)
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, t in corpus:
        w = split(t)
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert sorted((tuple(r) for r in substring.remove_repeats(docs).collect()), key=str) == sorted(want, key=str)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [2, 5, 8, 33])
def test_matching_statistics(depth):
    r = np.random.default_rng(depth)
    for sigma in (2, 4, 40):
        t = np.append(r.integers(1, sigma + 1, 400), 0)
        t[[90, 200, 201]] = 0
        owner = r.integers(0, 50, 401)
        index = substring.FMIndex(t, owner, depth)
        own = [t[a:b] for a, b in ((0, 90), (91, 200), (202, 400))]
        other = r.integers(1, sigma + 1, 150)
        other[[3, 70]] = -1  # a word that the index doesn't have
        lanes = [*own, other, np.concatenate([own[0][10:60], other[:20], own[2][:80]])]
        size = np.array([len(x) for x in lanes])
        flat, first = np.concatenate(lanes), np.cumsum(size) - size
        length, low = index.matches(flat, first, first + size)
        for a, n in zip(first.tolist(), size.tolist(), strict=True):
            for i in range(a, a + n):
                w = flat[i : min(i + depth, a + n)]
                places = [k for k in range(401 - depth) if len(w) == depth and (t[k : k + depth] == w).all()]
                assert (length[i] == depth) == bool(places) and low[i] == (min(owner[places]) if len(places) > 1 else substring.NONE)
                has = lambda m: any((t[k : k + m] == flat[i : i + m]).all() for k in range(402 - m))  # noqa: B023, E731
                m = int(length[i])
                assert (m == 0 or has(m)) and (m == len(w) or not has(m + 1))


def test_substring_of_periodic_texts(spark):
    rows = [(i, "x " * (2000 + i)) for i in range(40)] + [(100, "y x " * 900), (101, "y x " * 500 + "z")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), text=False).collect()}
    assert got == {0: (2000, 0), **{i: (2000 + i, 2000 + i) for i in range(1, 40)}, 100: (1800, 0), 101: (1001, 1000)}


@pytest.mark.parametrize("place", [8 << 20, 500])
def test_lm_score(spark, corpus, docs, place, monkeypatch):
    monkeypatch.setattr(lm_score, "PLACE", place)
    df = docs.withColumn("target", F.when(F.col("doc_id") % 2 == 1, True))
    got = collections.defaultdict(list)
    for r in lm_score.cross_entropy_difference(df).collect():
        got[r.doc_id].append(tuple(r)[1:])
    c, h, v = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], set()
    for i, t in corpus:
        w = split(t)
        v |= set(w)
        for a, b in zip([None, *w], w):
            for k in (0, 1) if i is not None and i % 2 == 1 else (0,):
                c[k][a, b] += 1
                h[k][a] += 1
    ln = lambda x: round(math.log(x) * 1e6)
    for i, t in corpus:
        w = split(t)
        both, before = collections.Counter(zip([None, *w], w)), collections.Counter([None, *w][: len(w)])
        mine = (1, 1 if i is not None and i % 2 == 1 else 0)  # a document's own counts are left out
        s = [sum(ln(c[k][a, b] - mine[k] * both[a, b] + 0.05) - ln(h[k][a] - mine[k] * before[a] + 0.05 * len(v)) for a, b in zip([None, *w], w)) for k in (0, 1)]
        want = (len(w), -(s[1] / 1e6) / len(w), -(s[0] / 1e6) / len(w), -((s[1] - s[0]) / 1e6) / len(w)) if w else (0, None, None, None)
        assert any(g == pytest.approx(want) if w else g == want for g in got[i])
    assert sum(map(len, got.values())) == len(corpus)
    assert lm_score.cross_entropy_difference(df.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(2)
    syllables = {"aa": ["ka", "mo", "ti"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "que", "ou"]}
    rows = [(i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang) for i, lang in enumerate(list(syllables) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 60"))
    more = df.select("doc_id", "text").unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 34 !"), (1003, "x" * 300_000)], "doc_id long, text string"))
    got = {x.doc_id: x for x in langid.identify(more, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= x.score <= 1 for x in got.values()) and got[1003].lang_pred in syllables
    assert langid.identify(more, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_against_a_plain_kernel(spark):
    r = random.Random(12)
    rows = [(i, " ".join(r.choice(w) for _ in range(r.randrange(3, 40))), lang) for i, (lang, w) in enumerate([("aa", ["kato", "mote", "time", "la"]), ("bb", ["schung", "eiten", "lach", "time"]), ("cc", ["ção", "que", "mote", "ou"])] * 12)]
    rows += [(100, None, "aa"), (101, "", "bb"), (3, rows[3][1], "aa"), (102, "über " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df.select("doc_id", "text"), langid.fit(df)).collect()}

    def places(t):  # hashed byte n-grams that occur
        b = bytes(x + 32 if 65 <= x < 91 else x for x in (t or "").encode())
        return {((int.from_bytes(b[k : k + n], "big") * 2654435761 + n * 40503) % 2**32) >> 19 for n in (1, 2, 3) for k in range(len(b) - n + 1)}

    def kernel(a, b):
        return len(a & b) / math.sqrt(max(len(a), 1)) / math.sqrt(max(len(b), 1))

    train = [(places(t), lang) for i, t, lang in rows if t is not None and lang and (i != 3 or lang == "aa")]  # one label of an id, and fewer texts than LANDMARKS
    names = sorted({lang for _, lang in train})
    found = {}
    for label in ("aa", "bb"):  # id 3 has two rows; either may be taken
        train_ = [(x, label if x == places(rows[3][1]) else lang) for x, lang in train]
        k = np.array([[kernel(a, b) for b, _ in train_] for a, _ in train_])
        y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in train_])
        weight = np.array([1 / sum(q == lang for _, q in train_) for _, lang in train_])
        coef = np.linalg.solve(k.T @ (weight[:, None] * k) + langid.RIDGE * k + 1e-8 * np.eye(len(k)), k.T @ (weight[:, None] * y))
        found[label] = {i: np.array([kernel(places(t), b) for b, _ in train_]) @ coef for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)}
    for i, x in got.items():
        if i not in found["aa"]:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        fits = []
        for f in found.values():
            e = np.exp(4 * (f[i] - f[i].max()))
            fits.append(names[int(f[i].argmax())] == x.lang_pred and abs(x.score - (e / e.sum()).max()) < 5e-3)
        assert any(fits), (i, x)


def test_quality_against_plain_ftrl(spark):
    r = random.Random(6)
    words = ["the", "river", "is", "wide", "BUY", "now", "***", "über", "4711"]
    rows = [(i, " ".join(r.choice(words[: 5 + 4 * (i % 2)]) for _ in range(r.randrange(1, 30)))) for i in range(60)] + [(70, None), (71, ""), (72, "x, " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = {i: 1 - i % 2 for i in range(40)}
    labels = spark.createDataFrame([*marks.items(), (5, 1), (None, 1), (900, 0)], "doc_id long, quality int")
    marks[5] = 1  # of several labels the larger
    got = {x.doc_id: x.score for x in quality.score(df, quality.fit(df, labels)).collect()}
    key = {x.doc_id: x.key for x in df.select("doc_id", F.xxhash64("doc_id").alias("key")).collect()}

    def values(t):
        places, _ = quality.features(pa_array([t]))
        c = collections.Counter(places.tolist())
        return {k: n * quality.SCALE / max(len(places), 1) for k, n in c.items()} | {quality.DIM: 1.0}

    texts = dict(rows)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    w = lambda k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)
    rare = {y: min(4.0, len(marks) / (2 * sum(v == y for v in marks.values()))) for y in (0, 1)}
    for _ in range(quality.PASSES):
        for i in sorted(marks, key=key.get):
            x = values(texts[i])
            p = 1 / (1 + math.exp(-sum(w(k) * v for k, v in x.items())))
            steps = {k: (rare[marks[i]] * (p - marks[i]) * v, w(k)) for k, v in x.items()}
            for k, (g, old) in steps.items():
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * old
                n[k] += g * g
    for i, t in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(w(k) * v for k, v in values(t).items()))), abs=1e-4)
    # features: runs of letters and digits, and of other characters; a repeated trigram counts at REPEAT
    t = "ab ab, ab ab, ab"
    assert len(quality.features(pa_array([t]))[0]) == 7 + 6 + 2


def pa_array(x):
    import pyarrow as pa

    return pa.array(x, pa.string())


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACES", 50)
    df = spark.createDataFrame([(i, f"w{i} " * 3 + "good bad"[5 * (i % 2) :]) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert 0 < np.count_nonzero(quality.fit(df, labels)) < 100


def test_quality(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "a", "tree", "river", "is", "wide", "old"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "***", "cheap!!"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), "z") for i in range(160)]
    df = spark.createDataFrame(rows + [(500, None, "z"), (501, "", "z"), (502, "word " * 50_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.score(df, quality.fit(df, labels)).collect()}
    assert all((got[i] > 0.7) == bool(i % 2) for i in range(120, 160)) and got[500] == got[501] and all(0 <= s <= 1 for s in got.values())
    assert {x.score for x in quality.score(df, quality.fit(df, labels.limit(0))).collect()} == {0.5}


def test_warc(spark):
    big = "<p>é</p>" * 60_000
    rows = [(1, "u1", "x" * 2000), (5, "u5", "x" * 2000), (3, None, "x" * 2000), (2, "u\r\n2", "x" * 999), (4, "u4", "x" * 999), (6, "u6", None), (7, "u7", ""), (8, "u8", big), (9, "u9", "a\r\n\r\nWARC/1.1\r\nb" * 90), (None, "n", "x" * 2000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_type string")
    got = {r.page_id: r for r in warc.archive_pages(df).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        of = 5 if b == b"x" * 2000 else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), hashlib.sha1(b).hexdigest(), "response" if of == i else "revisit", None if of == i else of)
    assert got[8].n_chunks == math.ceil(len(big.encode()) / warc.CHUNK)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_of_repeated_page_ids(spark):
    rows = [(5, "u", "a" * 2000), (5, "v", "b" * 3000), (3, None, "a" * 2000), (5, "u", "a" * 2000), (None, "w", "b" * 3000), (1, "x", "b" * 3000)]
    got = sorted((tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == sorted([(i, len(t), sha(t), "response" if i == 5 else "revisit", None if i == 5 else 5) for i, _, t in rows], key=str)


def test_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    tk, r = Tokenizer.from_file(tokenizer_paths()[0]), random.Random(5)
    kinds = ["the", "Été", "ÆØÅ", "naïve", "ſ", "ß", "'s", "'LL", "don't", " ", "  ", "\n", "\n\n ", "\t", "\r\n", "1234", "3.14", "<|endoftext|>", "...", "—", "日本", "emoji 🙂", "\u00a0", "\u2028", "e\u0301", "_", "#$%", "ЖЖ"]
    encode = packing.Coder(*tokenizer_paths()).encode
    for _ in range(400):
        t = "".join(r.choice(kinds) + r.choice(["", "", " "]) for _ in range(r.randrange(1, 30)))
        ids = tk.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_warc_chunks_are_the_payload(spark, tmp_path):
    big = "0123456789é" * 40_000
    df = warc.roles(spark.createDataFrame([(1, "u", big)], "page_id long, url string, html string"))
    archives = warc.write_archives(df, str(tmp_path / "w")).cache()
    chunks = warc.read_chunks(archives, str(tmp_path / "w")).orderBy("chunk").collect()
    assert b"".join(c.payload for c in chunks) == big.encode() and max(c.chunk_bytes for c in chunks) <= warc.CHUNK
    sums = np.cumsum([c.chunk_bytes for c in chunks])
    assert [c.payload_digest for c in chunks] == [hashlib.sha1(big.encode()[:n]).hexdigest() for n in sums]


def test_pii(spark):
    t = "mail a.b@c.example.com card 4111 1111 1111 1111, not 4111111111111112; ip 10.0.0.255 no 999.1.1.1 date 2024-02-29 31/12/1999 30.02.2001 phone +1 (017) 555-7713 DE89 3704 0044 0532 0130 00 v 4.0"
    df = spark.createDataFrame([(1, t), (2, "again 10.0.0.255 and 4111 1111 1111 1111"), (3, None), (4, ""), (5, "no data 12"), (6, "x " * 100_000 + "10.0.0.255")], "doc_id long, text string").withColumn("n_replaced", F.lit("clash"))
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    a, b = got[1].text, got[2].text
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", a)[1]
    ip = re.search(r"ip (\S+) no", a)[1]
    assert card in b and ip in b and ip in got[6].text and "10.0.0.255" not in a and "@c.example" not in a
    digits = [int(c) for c in card.replace(" ", "")][::-1]
    assert card != "4111 1111 1111 1111" and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert all(int(x) < 256 for x in ip.split(".")) and "4111111111111112" in a and "999.1.1.1" in a and "30.02.2001" in a and a.endswith("v 4.0")
    assert "2024-02-29" not in a and re.search(r"date (\d{4}-\d\d-\d\d) (\d\d/\d\d/\d{4})", a) and "+1 (017)" not in a
    iban = re.search(r"(DE\d\d(?: \d{4}){4} \d\d)", a)[1].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1 and iban != "DE89370400440532013000"
    assert got[1].n_replaced == 7 and (got[3].text, got[3].n_replaced) == (None, 0) and got[4].text == "" and got[5].text == "no data 12"
    other = pii.pseudonymise(df, "other").where("doc_id = 2").first().text
    assert other != b


def test_pii_phones_and_dates_of_all_languages(spark):
    phones = ["+44 20 7946 0958", "+33 6 12 34 56 78", "01 23 45 67 89", "030 12345678", "+49 30 123456", "+34 612 345 678", "+44 (0)20 7946 0958", "+49 (30) 123456", "(030) 123456", "01.23.45.67.89", "+12125551234", "00447911123456", "+33\u00a06\u00a012\u00a034\u00a056\u00a078", "+1 (017) 555-7713", "555-123-4567"]
    stay = ["0.12345678", "0-306-40615-2", "+49 30", "012 34", "2024-13-01", "31/31/2024", "0/5/2024", "v 1.2.3"]
    dates = ["12/25/2024", "3/4/2024", "31/1/1999", "7/28/2001", "1.2.2024", "24.12.2024", "2024-2-9"]
    rows = [(i, f"so {t}, and") for i, t in enumerate(phones + dates + stay)] + [(100, "call 030 12345678 4111 1111 1111 1111 or +49 30 123456 31/12/1999")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    shape = lambda t: re.sub("[0-9]", "0", t)
    for i, t in rows[:-1]:
        assert (got[i].text != t, got[i].n_replaced) == ((False, 0) if t[3:-5] in stay else (True, 1)) and shape(got[i].text) == shape(t), t
    month, day = (int(x) for x in got[len(phones)].text[3:-5].split("/")[:2])
    assert 1 <= month <= 12 < day <= 31 and got[100].n_replaced == 4
    days = spark.range(366).selectExpr("id as doc_id", "date_format(date_add(date'2024-01-01', cast(id as int)), 'M/d/yyyy') as text").where("cast(split(text, '/')[1] as int) > 12")
    out = [r.text for r in pii.pseudonymise(days, "k").collect()]
    assert len(set(out)) == len(out) == days.count() and all(int(t.split("/")[1]) > 12 >= int(t.split("/")[0]) for t in out)


def test_pii_of_long_runs_and_clashing_columns(spark):
    import time

    long_ = "a1" * 500_000
    df = spark.createDataFrame([(1, long_, "x"), (2, "a." * 200_000 + "@", "y"), (3, "a@" * 200_000, "z"), (4, "x@" + "y." * 100_000, "z"), (5, "see -a.b@c.example.co.uk", "q")], "doc_id long, text string, new_values string").withColumn("Found_Values", F.lit("w"))
    began = time.time()
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert time.time() - began < 60 and got[1].text == long_ and got[1].new_values == "x" and got[1].Found_Values == "w"
    assert re.fullmatch(r"see -u[0-9a-f]{16}@example\.invalid", got[5].text)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words here", "c", "d", "e", "f", "g", "h"), (2, None, *"cdefgh")], "doc_id long, text string, SCORE string, has_letters string, text_hash string, slot_at string, slot_page string, Slot_Bits string")
    items = spark.createDataFrame([(1, "nothing of that")], "item_id long, text string")
    assert decontaminate.decontaminate(df, items).columns == df.columns and decontaminate.decontaminate(df, items).count() == 2
    assert langid.identify(df, langid.fit(df.select("doc_id", "text", F.lit("en").alias("lang")))).where("lang_pred = 'en'").count() == 1
    scored = quality.score(df, np.zeros(quality.DIM + 1, np.float32))
    assert scored.columns == ["doc_id", "text", "has_letters", "text_hash", "slot_at", "slot_page", "Slot_Bits", "score"] and scored.count() == 2
    assert sorted(r.doc_id for r in ngram_join.drop_near_duplicates(df).collect()) == [1, 2]


def test_pii_against_a_plain_feistel(spark):
    """Cards, addresses and numbers by the network written out in Python."""

    def noise(*parts):
        return int(hashlib.sha256("|".join(("k", *map(str, parts))).encode()).hexdigest()[:15], 16)

    def feistel(tweak, a, b, size_a, size_b):
        for i in range(8):
            a, b = ((a + noise(tweak, i, b) % size_a) % size_a, b) if i % 2 == 0 else (a, (b + noise(tweak, i, a) % size_b) % size_b)
        return a, b

    def digits(kind, d):
        left = len(d) // 2
        a, b = feistel(f"{kind}{len(d)}", int(d[:left]), int(d[left:]), 10**left, 10 ** (len(d) - left))
        return f"{a:0{left}d}{b:0{len(d) - left}d}"

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))

    def refill(text, d):
        d = iter(d)
        return "".join(next(d) if c.isdigit() else c for c in text)

    def replace(m):
        t = m[0]
        d = re.sub("[^0-9]", "", t)
        if "." in t:
            o = [int(x) for x in t.split(".")]
            if max(o) > 255:
                return t
            a, b = feistel("address", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t):
            return refill(t, digits("ssn", d))
        if luhn(d) % 10:
            return t
        body = digits("card", d[:-1])
        return refill(t, body + str(-luhn(body + "0") % 10))

    r = random.Random(3)
    rows = [(i, f"a {r.randrange(300)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)} b {r.randrange(10**3):03d}-{r.randrange(100):02d}-{r.randrange(10**4):04d} c {' '.join(f'{r.randrange(1000, 10000)}' for _ in range(4))} d") for i in range(120)]
    for i, t in list(rows):  # the same with a check digit that holds
        head = re.search(r"c (.*) d", t)[1][:-1]
        rows.append((1000 + i, f"c {head}{-luhn(re.sub(' ', '', head) + '0') % 10} d"))
    pattern = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}(?: [0-9]{4}){3}"
    got = {x.doc_id: x.text for x in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, t in rows:
        assert got[i] == re.sub(pattern, replace, t), t
    assert sum(got[i] != t for i, t in rows if i >= 1000) == 120


def test_decontaminate_against_plain_matching(spark):
    """Re-parameterised items in noise: each is found, by the plain rule too, and texts that share a few words are not."""
    r = random.Random(21)
    names, nouns = ["Tom", "Lisa", "Ann", "Bob", "Eve", "Max", "Kim", "Jim"], ["apples", "pears", "ropes", "boats", "chairs", "lamps"]
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 7))) for _ in range(200)]
    make = lambda k: f"It is said that {{0}} put {{1}} {nouns[k % 6]} {words[k]} in the {words[k + 1]} by the {words[k + 2]} and {{2}} took {{3}} {nouns[(k + 2) % 6]} {words[k + 3]} to the {words[k + 4]} before the {words[k + 5]} was over."
    items = [(k, make(6 * k).format("Tom", 12, "Lisa", 7)) for k in range(25)]
    docs, want = [], set()
    for d in range(150):
        k = d % 25
        fill = lambda: " ".join(r.choice(words) for _ in range(30)) + ". "
        a, b = r.sample(names, 2)
        kind = d // 25
        body = {0: items[k][1], 1: make(6 * k).format(a, r.randrange(100), b, r.randrange(100)), 2: make(6 * k).format(a, "3.5", b, "1,200"), 3: " ".join(items[k][1].split()[:6]), 4: "", 5: items[k][1].upper()}[kind]
        docs.append((d, fill() + body + " " + fill()))
        if kind in (0, 1, 2):
            want.add((d, k))
    got = {(x.doc_id, x.item_id): x for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want & set(got)) >= 0.9 * len(want) and not {p for p in got if p not in want and p[0] // 25 in (3, 4)}

    def tokens(t):  # (kind or word, value)
        out, begins, number = [], True, False
        for w in t.split():
            core = re.sub(r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "", w)
            if core:
                digits = sum(c.isdigit() for c in core)
                is_number = core[0].isdigit() and 2 * digits >= digits + sum(c.isalpha() for c in core)
                kind = "#" if is_number else "unit" if number and core.lower() in decontaminate.UNITS else "name" if core[0].isupper() and not begins else core.lower()
                out.append((kind, core.lower()))
                number = is_number
            begins = w[-1] in ".!?:;"
        return out

    def windows(t):
        x = tokens(t)
        return [(i, tuple(k for k, _ in x[i : i + 8])) for i in range(len(x) - 7) if sum(k not in ("#", "name", "unit") for k, _ in x[i : i + 8]) >= 4]

    of_items = {k: windows(t) for k, t in items}
    for d, t in docs:
        mine = windows(t)
        for k, own in of_items.items():
            shared = {i for i, w in own if any(w == v for _, v in mine)}
            if len(shared) < len(own) / 3:
                assert (d, k) not in got
            elif (d, k) in got:
                assert got[d, k].item_windows == len(own) and got[d, k].n_windows <= len(shared)


def test_digits_are_permuted(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = [r.x for r in df.select(pii.permute_digits("k", "t", F.col("d")).alias("x")).collect()]
    assert len(set(out)) == 1000 and all(re.fullmatch("[0-9]{3}", x) for x in out)


def test_decontaminate(spark):
    item = "Once again, Tom sold 48 km of rope to Lisa for 75 dollars while riding along the river with old friends."
    docs = spark.createDataFrame([
        (1, "Please say, in May, Anna sold 12 km of rope to Peter for 30 dollars while riding along the river with old friends."),
        (2, "junk | words " + item + " more"), (3, None), (4, ""), (5, "a river with old friends along it"), (None, item), (2, "junk | words " + item + " more"),
        (6, "Once again, Ann sold 48 km of rope to Bob for 75 dollars while riding. Once again, Eve sold 9 km of rope to Kim for 3 dollars while riding along. Once again, Max sold 8 km of rope to Jim for 4 dollars while riding along the river with old friends."),
    ], "doc_id long, text string").withColumn("th", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items).collect()}
    # the last sentence of 6 is the whole item with other values
    assert set(got) == {(1, 7), (2, 7), (6, 7), (None, 7)} and got[1, 7].n_changed == 4 and got[2, 7].n_changed == 0
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [3, 4, 5]
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_decontaminate_each_occurrence(spark):
    say = "Once again, {} sold {} km of rope to {} for {} dollars while riding along the river with old friends. ".format
    item, ann, max_ = say("Tom", 48, "Lisa", 75), say("Ann", 12, "Bob", 30), say("Max", 8, "Jim", 4)
    twice = "They say that Tom put 48 ripe apples in the basket by the door and that Lisa put 75 ripe apples in the basket by the door today."
    mixed = "Once again, Ann sold 12 km of rope to it. Then Kim sold 9 km of rope to Zoe for fun, or for 5 dollars while riding along the river by boat, and Mia for 2 dollars while riding along the coast."
    docs = spark.createDataFrame([
        (1, ann + max_), (2, "So it goes. " + item + "And then some words. " + ann), (3, ann + item + max_ + ann), (4, twice), (5, "Well. " + twice.replace("Tom", "Eve").replace("75", "9") + " " + twice),
        (6, ann.replace("to Bob", "to old uncle Bob") + max_.replace("sold", "has gladly sold")), (7, mixed),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 7), (4, 8), (5, 8), (6, 7)}
    assert got[1, 7].n_changed == 4 and [got[k].n_changed for k in ((2, 7), (3, 7), (4, 8), (5, 8))] == [0] * 4
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [7]


def test_decontaminate_items_without_windows(spark):
    digits, names, short, long_ = "12 3.5 45 6 78 9 10 11 12 13 14", "Anna Berta Carla Dora Emma Frieda Gerda Hanna Ida Jana", "What is 3 + 4 ?", "Tom put 9 red apples in 3 bags"
    items = spark.createDataFrame([(1, digits), (2, names), (3, short), (4, long_), (5, "?!"), (6, "yes"), (7, digits)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Sums: " + digits + " end"), (2, "so " + names + "."), (3, "q: what is 3 + 4? and what is 3 + 4?"), (4, "They say tom put 9 red apples in 3 bags"),
        (5, "12 3.5 45 6 78 9 10 11 12 13"), (6, "14 what is"), (7, "3 4 ?!"), (8, "Yes, " + digits), (9, digits.replace("45", "46")), (None, short), (10, None), (11, ""),
    ], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (1, 7), (2, 2), (3, 3), (4, 4), (8, 6), (8, 1), (8, 7), (None, 3)}
    assert all(r.n_changed == 0 for r in got.values()) and got[1, 1].item_windows == 0
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [5, 6, 7, 9, 10, 11]


def test_quality_rules(spark, corpus, docs):
    good = spark.createDataFrame([(i,) for i, _ in corpus], "doc_id long")
    got = collections.defaultdict(set)
    for r in quality_rules.apply_rules(docs, good).collect():
        got[r.doc_id].add(tuple(r)[1:])
    for i, t in corpus:
        w = [x.decode() for x in split(t)]
        n = len(w)
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(n - 2))
        hit = {p for k in range(n - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = n < 50 or 100 * len(hit) > 50 * n
        assert (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed, not failed) in got[i]
    assert quality_rules.apply_rules(docs.limit(0), good).count() == 0


def test_rules_where_cutoffs_bind(spark, tmp_path):
    """The whole query against its SQL on strata with enough labels that cutoffs reject."""
    import duckdb

    from resolvekit.llm.oracles import ORACLES

    r = random.Random(17)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(900)]
    rows = []
    for i in range(3200):
        text = [r.choice(words) for _ in range(r.randrange(50, 70))]
        if i % 9 == 0:
            text = [f"{w}#*" if r.random() < i % 50 / 60 else w.upper() if i % 2 else w for w in text]
        sep = "\n" if i % 4 == 0 else " "
        rows.append((i, sep.join(text) + (sep + "the end" * (i % 11 == 0)) * (i % 7), "en" if i % 5 < 4 else "de"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(3200)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    got = quality_rules.apply_rules(docs, labels.where("quality = 1"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(ORACLES["op9_quality_rules"])
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    want = sorted(tuple(x[k] for k in at) for x in cur.fetchall())
    assert sorted(tuple(x) for x in got.collect()) == want
    assert 50 < sum(not x[6] and not x[7] for x in want) < 1000


def test_cutoffs_keep_their_promise(spark):
    n = 4000
    rows = [(i, "en", False, 0 if i % 1000 else 500, 0, i % 7 * 10, 0) for i in range(n)] + [(n + i, "rare", False, 900, 0, 0, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, s int, l int, r int, c int").select("doc_id", "stratum", "base_failed", F.struct(F.col("s").alias("symbols"), F.col("l").alias("lines"), F.col("r").alias("repeats"), F.col("c").alias("capitals")).alias("shares"))
    cut = {r.stratum: r for r in quality_rules.choose_cutoffs(df, df.select("doc_id")).collect()}
    assert set(cut) == {"en"} and cut["en"].max_symbols == 0 and cut["en"].max_repeats == 60 and cut["en"].max_lines == 0
    t = spark.createDataFrame([(3, 1000), (0, 5), (40, 20000)], "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect()
    for r in t:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.005) + (r.n - i) * math.log(0.995)) for i in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-6)


def test_bit_tables(spark, docs):
    ids = docs.where("doc_id % 2 = 0").select("doc_id").distinct()
    assert filters.without(docs, ids, "doc_id").count() == docs.where("doc_id is null or doc_id % 2 = 1").count()


#: An item in each language, with places for two names, two numbers and two nouns, and values for them.
LANGUAGES = {
    "de": ("Nach dem Essen hat {0} im Garten {1} {2} in die Kiste gelegt, und der Nachbar {3} hat danach {4} {5} in den Korb am Fluss gelegt, bis die Arbeit nach {6} Stunden zu Ende war.", ["Äpfel", "Birnen", "Nüsse"]),
    "fr": ("Après le repas, on dit que {0} a mis {1} {2} dans la caisse du jardin, et que son voisin {3} a mis ensuite {4} {5} dans le panier au bord du fleuve, avant la fin du travail en {6} heures.", ["pommes", "poires", "noix"]),
    "es": ("Después de comer se dice que {0} puso {1} {2} en la caja del jardín, y que su vecino {3} puso luego {4} {5} en la cesta junto al río, antes de acabar el trabajo en {6} horas.", ["manzanas", "peras", "nueces"]),
    "en": ("After the meal it is said that {0} put {1} {2} into the box in the garden, and that the neighbour {3} then put {4} {5} into the basket by the river, before the work was over in {6} hours.", ["apples", "pears", "nuts"]),
}
UNRELATED = [
    "Nach dem Spiel hat der Lehrer 30 Hefte in die Tasche gelegt und der Schüler hat danach 4 Stifte in den Schrank am Fenster gelegt.",
    "Nach dem Spiel hat Udo im Keller 30 Hefte in die Tasche gelegt, und der Lehrer Kurt hat danach 4 Stifte in den Schrank am Fenster gelegt, bis die Stunde nach 9 Minuten zu Ende war.",
    "Après la pluie, on voit que le chat a dormi dans la cour et que le chien a couru ensuite 4 fois vers le pont avant la nuit, en 3 heures.",
    "Después de la lluvia se ve que el gato durmió en el patio y que el perro corrió luego 4 veces hacia el puente antes de la noche, en 3 horas.",
    "After the rain it is seen that the cat slept in the yard and that the dog then ran 4 times to the bridge before the night, in 3 hours.",
]


def test_decontaminate_in_four_languages(spark):
    r = random.Random(5)
    names = ["Anna", "Emil", "Karla", "Hugo", "Ida", "Otto"]
    fill = lambda t, nouns: t.format(*(x for pair in ((r.choice(names), r.randrange(2, 99)), (nouns[0], r.choice(names)), (r.randrange(2, 99), nouns[1]), (r.randrange(2, 30),)) for x in pair))
    items = [(k, fill(*LANGUAGES[lang])) for k, lang in enumerate(LANGUAGES)] + [(9, "Nach dem Essen hat der Bauer 12 Äpfel in die Kiste gelegt und der Nachbar hat danach 7 Birnen in den Korb am Fluss gelegt.")]
    docs = [(100 * (k + 1) + i, "Es folgt ein Text. " + fill(*LANGUAGES[lang]) + " Ende.") for k, lang in enumerate(LANGUAGES) for i in range(25)] + list(enumerate(UNRELATED))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    for k in range(4):
        assert len({d for d, i in got if i == k and d // 100 == k + 1}) >= 0.9 * 25
    assert not {d for d, _ in got if d < 100}


def test_short_items_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "They went to Paris in spring."), (2, "New York is far"), (3, "So what is 3 + 4 then")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Paris"), (2, "New York is"), (3, "What is 3 + 4?")], "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.item_tokens) for x in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, 1, 1), (2, 2, 3), (3, 3, 4)} and [x.doc_id for x in decontaminate.decontaminate(docs, items).orderBy("doc_id").collect()] == [1, 2]


def test_accounts_before_secrets(spark):
    """A valid account keeps its format and one pseudonym, with blanks or without; what is no account but hexadecimal is a secret."""
    texts = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "BE68539007547034", "BE68 5390 0754 7034", "AB12CD34EF567890AB", "AB12CD34EF567890AB 2024", "2024-02-29T10:00:00Z",
        "ISBN 0306406152", "order no. 0123456789", "Bestellung 0123456789", "ref: 0123456789", "tel 0306406152", "#0123456789", "casino 0306406152"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect()]
    assert got[0] == got[1].replace(" ", "") and got[2] == got[3].replace(" ", "") and re.fullmatch(r"DE\d\d(?: \d{4}){4} \d\d", got[1]) and re.fullmatch(r"BE\d{14}", got[2])
    value = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
    assert got[0] != texts[0] and value(got[0]) == 1 and got[2] != texts[2] and value(got[2]) == 1
    assert re.fullmatch("[0-9A-F]{18}", got[4]) and got[4] != texts[4] and got[5] == got[4] + " 2024"
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT10:00:00Z", got[6]) and got[6] != texts[6]
    assert [got[i] for i in (7, 8, 9, 10, 12)] == [texts[i] for i in (7, 8, 9, 10, 12)] and got[11] != texts[11] and got[13] != texts[13]
