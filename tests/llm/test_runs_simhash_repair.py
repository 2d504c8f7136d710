"""Periodic runs, SimHash groups and conversation repair against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from resolvekit.llm import conversations, periodic, queries, simhash, text
from resolvekit.operators.graph import components


def split(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def plain_runs(w):
    """Every period, every stretch; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x + q < len(w):
            s = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            if x > s and x + q - s >= max(6, 4 * q):
                found.setdefault((s, x + q), q)
            x += x == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(r, n, letters):
    w = [r.randrange(letters) for _ in range(n)]
    if n > 8 and r.random() < 0.7:
        a, p = r.randrange(n), r.randrange(1, n // 3)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_runs():
    r = random.Random(5)
    for letters in (1, 2, 2, 3, 5):
        for _ in range(150):
            docs = [repetitive(r, r.randrange(60), letters) for _ in range(r.randrange(1, 5))]
            h = text.mix(np.array([x for w in docs for x in w], np.uint64) + np.uint64(9))
            got = periodic.runs_in(h, np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(int))
            assert [tuple(x) for x in got.tolist()] == [(d, *x) for d, w in enumerate(docs) for x in plain_runs(w)]


def test_long_runs():
    """A document of one word, and one of a long period, take no more than linear space."""
    for w, run in ((np.zeros(300_000), (0, 300_000, 1)), (np.arange(300_000) % 60_000, (0, 300_000, 60_000))):
        got = periodic.runs_in(text.mix(w.astype(np.uint64)), np.array([0, 300_000]))
        assert [tuple(x) for x in got.tolist()] == [(0, *run)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    words = ["alpha", "Beta", "é", "x y", "über", "zz", "THE", "0"]
    rows = [(i, " ".join(words[x] for x in repetitive(r, r.randrange(50), r.choice([2, 4, 8])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "a " * 5000), (205, " ".join(map(str, range(20_000)))), (None, "a a a a a a a"), (None, None), (0, "b\nb\tb b  b\rb"), (0, rows[0][1])]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "k", "v", "f", 1) for i, t in corpus], "doc_id long, text string, key string, value string, FP string, runs int").repartition(3)


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    if i is None or not w or h % 10:
        return w
    a, p = h // 10 % len(w), 1 + (len(w) - h // 10 % len(w)) // (3 + h // 10 % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def collapsed(i, t, plant):
    w = planted(i, split(t)) if plant else split(t)
    runs = plain_runs(w) if len(w) < 10_000 else []
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()), runs, kept.decode()


def test_collapse_runs(docs, corpus):
    want = sorted((collapsed(i, t, False) for i, t in corpus), key=str)
    got = [(tuple(r)[:8], [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse_runs(docs).collect()]
    assert sorted(got, key=str) == want and any(x[0][1] > 1 for x in want)
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def test_planted_runs(docs, corpus):
    small = [(i, t) for i, t in corpus if i != 205]
    got = periodic.collapse_runs(queries.with_planted_runs(docs.where("doc_id is null or doc_id <> 205")), text=False)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((collapsed(i, t, True)[0] for i, t in small), key=str)


def plain_print(t, n=4):
    w = split((t or "").encode().lower().decode()) if t and t.isascii() else [bytes(c + 32 if 65 <= c < 91 else c for c in x) for x in split(t)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius):
    """The smallest id that each id reaches; prints has a set of fingerprints for each."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any((x ^ y).bit_count() <= radius for x in prints[a] for y in prints[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints():
    assert simhash.fingerprint("Hello hello HELLO") == xxhash.xxh64_intdigest(b"hello hello hello", 42) and simhash.fingerprint("É É") == xxhash.xxh64_intdigest("É É".encode(), 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = " ".join(map(str, range(40_000)))
    assert simhash.fingerprint(long) == plain_print(long)
    assert len(simhash.masks(64, 2)) == 2081 and int(np.bitwise_count(simhash.masks(10, 2)).max()) == 2


def test_simhash_groups(docs, corpus):
    prints = collections.defaultdict(set)
    for i, t in corpus:
        prints[i].add(plain_print(t))
    root = groups({i: p for i, p in prints.items() if i is not None}, 4)
    want = sorted(((i, f"{plain_print(t):016x}", root.get(i)) for i, t in corpus), key=str)
    assert sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str) == want
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_close_pairs_of_dense_groups(spark, monkeypatch):
    """Fingerprints that lie close together, with so low limits that values get further bits several times."""
    monkeypatch.setattr(simhash, "NEAR", 4)
    monkeypatch.setattr(simhash, "MOST", 3000)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {r.getrandbits(64) for _ in range(60)}
    for _ in range(250):
        x = r.choice(base)
        for b in r.sample([0, 1, 5, 8, 20, 33, 60, 62, 63], r.randrange(7)):
            x ^= 1 << b
        fps.add(x)
    signed = lambda x: x - (x >> 63 << 64)
    links = simhash.close_pairs(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    got = {a: b for a, b in components(links).collect()}
    want = groups({signed(x): {x} for x in fps}, 4)
    classes = lambda root: sorted(sorted(x for x in want if root(x) == c) for c in {root(x) for x in want})
    assert classes(lambda x: got.get(x, x)) == classes(lambda x: want[x])
    with pytest.raises(ValueError):
        simhash.close_pairs(spark.createDataFrame([], "fp long"), 3)


STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_repair(rows):
    """Costs and edits of every state at every place, from the last row back, as (cost, audit, repaired rows)."""
    seen, fault = set(), []
    for _, role, t in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", t)
        fault.append("blank" if not ink else "duplicate" if (role, t) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, t))
    never = (10**9, "~", ())
    best = [{"": (0, "", ()), "s": never, "u": never, "a": (0, "", ())}]
    for (_, role, t), f in zip([(0, "", "")] + rows[::-1], ["end"] + fault[::-1], strict=True):
        now = dict(best[-1]) if f == "end" else {}
        for s, (c, a, x) in best[-1].items() if f != "end" else ():
            ways = [(c + 2, "D" + a, x)]
            for edit, name, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                if f in ("", "truncated") and (s, name[:1]) in STEP:
                    c, a, x = best[-1][STEP[s, name[:1]]]
                    ways.append((c + cost + 5 * (f == "truncated"), edit + a, ((name, t), *x)))
            now[s] = min(ways)
        for _ in range(4):
            for s in now:
                for name in ("user", "assistant"):
                    if (s, name[0]) in STEP:
                        c, a, x = now[STEP[s, name[0]]]
                        now[s] = min(now[s], (c + 5, "I" + a, ((name, ""), *x)))
        best.append(now)
    cost, audit, repaired = best[-1][""]
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    count = collections.Counter(fault)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    lines = "\n".join(f"{r}:{t}" for r, t in repaired)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()), repaired


def damaged(rows):
    out = []
    for c, t, role, x in rows:
        role, x = role if role is not None else " ", x if x is not None else " "
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
        out += [(t, "user" if d == 4 else role, x)] * (0 if d == 0 else 2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "x"], ["a.", "b!", "c", "d?\n", "", None, " \t", "yes.", "no.", "Ünd?"]
    rows = [(c, r.choice([t, t, t, r.randrange(9), None]), r.choice(roles), r.choice(texts)) for c in [*range(60), None] for t in range(r.randrange(11))]
    rows += [(70, None, "user", "a.")] * 3 + [(71, t, r.choice(["user", "assistant"]), f"w{t}") for t in range(60)] + [(72, t, "user", f"w{t}.") for t in range(50)]
    rows += [(73, 0, "user", "w.")] * 40 + [(74, 0, "user", "long " * 50_000 + "."), (74, 1, "assistant", "yes.")]
    return rows


@pytest.mark.parametrize("batch", ["1000", "5"])
def test_conversation_repair(spark, talks, batch, monkeypatch):
    """Also with chunks of five rows at most, many of which no row makes independent of what follows."""
    monkeypatch.setattr(conversations, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch))
    df = spark.createDataFrame([(*x, "k", 0, "e") for x in talks], "conv_id long, turn long, role string, text string, k string, idx int, Edits string").repartition(3)
    by = collections.defaultdict(list)
    for x in talks:
        by[x[0]].append(x)
    want = {c: plain_repair(damaged(x)) for c, x in by.items()}
    rows = conversations.damage(df)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_report(df, rows).collect()}
    assert got == {c: x for c, (x, _) in want.items()}
    if batch == "5":
        marked = conversations._marked(rows)
        lines = collections.defaultdict(list)
        for r in conversations.repaired_rows(rows, conversations.find_edits(marked)).orderBy("conv_id", "at").collect():
            lines[r.conv_id].append((r.role, r.text))
        assert lines == {c: list(x) for c, (_, x) in want.items() if x}
        assert conversations.repair_report(df.limit(0), conversations.damage(df.limit(0))).count() == 0


def test_machine():
    m = conversations.Machine()
    assert len(m.vectors) < 64 and all(min(v) == 0 and max(v) <= 10 for v in m.vectors)
    r = random.Random(1)
    rows = bytes(r.choice([0, 1, 2, 5, 6, 8]) for _ in range(400))
    assert len(set(m.start(rows))) == 1  # vectors of a usual chunk come to differ by constants
    assert len(set(m.start(bytes([conversations.CUT + 1] * 400)))) > 1  # those of truncated rows alone don't


def test_a_common_phrase_is_dealt_again(spark, monkeypatch):
    """A phrase in very many contexts: its key is dealt again by other grams, its repeated passages are still found by the index."""
    from resolvekit.llm import substring

    monkeypatch.setattr(substring, "SHARD", 400)
    r = random.Random(12)
    word = lambda: f"w{r.randrange(4000)}"
    import pyarrow as pa

    least = lambda p: int(text.ngrams(text.Words(pa.array([" ".join(p)])).hashes(), substring.GRAM).min())
    phrase = min(([f"p{r.randrange(99)}" for _ in range(14)] for _ in range(300)), key=least)  # one that gives most windows around it their key
    around = lambda: ([word() for _ in range(r.randrange(30, 60))], [word() for _ in range(r.randrange(30, 60))])
    contexts = [around() for _ in range(150)]
    rows = [(i, " ".join(a + phrase + b)) for i, (a, b) in enumerate(contexts)] + [(1000 + i, " ".join([word() for _ in range(9)] + contexts[i][0] + phrase + contexts[i][1])) for i in range(0, 150, 3)]
    first, want = {}, []
    for i, t in sorted(rows):
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone.update(range(k, k + 50))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    levels = []
    table = substring.bit_table
    monkeypatch.setattr(substring, "bit_table", lambda df: levels.append(1) or table(df))
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == want and sum(x[2] > 0 for x in want) == 50 and len(levels) >= 2


def test_languages_are_bounded(spark, monkeypatch):
    from resolvekit.llm import langid

    monkeypatch.setattr(langid, "LANGUAGES", 6)
    monkeypatch.setattr(langid, "MOST_SAMPLE", 60)
    monkeypatch.setattr(langid, "MOST_LANDMARKS", 18)
    rows = [(100 * k + i, f"{'abcdefghij'[k] * 3} {'abcdefghij'[k] * 5} x{i}", f"l{k}") for k in range(10) for i in range(30 - 2 * k)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == [f"l{k}" for k in range(6)] and model.landmarks.shape[0] == 18
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    assert got.where("doc_id < 600").count() == got.where("doc_id < 600 and lang_pred = concat('l', cast(floor(doc_id / 100) as string))").count()
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
