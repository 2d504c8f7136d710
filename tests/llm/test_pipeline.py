"""The pipeline's stages over the smallest tables, each held against its own input."""

import collections
import random
import re
import struct

import numpy as np
import pyarrow as pa

import corpus_pipeline
from resolvekit.llm import pii, quality
from resolvekit.llm.queries import PII_KEY, tokenizer_paths
from resolvekit.llm.store import keep

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == first.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        if name in ("quality", "near_duplicates", "decontamination"):
            assert docs.exceptAll(before).isEmpty() and 0 < docs.count() <= before.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert seen[0] >= sum(labels.values())
    tokens = docs.groupBy("doc_id").sum("length").join(docs.select("doc_id", "doc_tokens").distinct(), "doc_id")
    assert tokens.where("`sum(length)` <> doc_tokens").isEmpty() and docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def _jaccard_classes(rows, n, num, den):
    """The smallest id that each id reaches over pairs with den * intersection >= num * union."""
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()} for i, t in rows for w in [(t or "").lower().split()]}
    low = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and den * len(a & b) >= num * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    return low


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    item = "Once again, {} sold {} km of rope to {} for {} dollars while riding along the river with old friends.".format
    rows, near = [], say(90)
    for i in range(0, 60, 2):
        rows.append((i, " ".join(say(80)) + "."))
    for i in range(100, 106):  # near copies, in a chain
        near = [*near[:80], *say(2), *near[82:]] if i % 2 else near
        rows.append((i, " ".join(near)))
    rows += [(200, f"{' '.join(say(30))}. {item('Tom', 48, 'Lisa', 75)} {' '.join(say(30))}"), (201, f"{' '.join(say(30))}. {item('Ann', 12, 'Bob', 30)} {' '.join(say(30))}"), (202, " ".join(say(60)) + " river with old friends")]
    rows += [(300, f"{' '.join(say(60))} call +1 212 555 0123 or 10.0.0.7 on 2024-02-29 {' '.join(say(20))}"), (301, f"{' '.join(say(60))} at 10.0.0.7 {' '.join(say(20))}"), (400, None), (401, ""), (None, " ".join(say(70))), (402, "x " * 3000)]
    rows += [rows[3], (6, " ".join(say(75)))]  # a repeated row, and another text under a known id
    bad = [(500 + i, " ".join(r.choice(["BUY", "NOW", "***", "cheap!!"]) for _ in range(60))) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, NEAR_ID string, quality_score string"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in [*rows, *bad]], schema)
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(i, 0) for i, _ in bad], "doc_id long, quality int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item("Tom", 48, "Lisa", 75)), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    key = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    stage = dict(corpus_pipeline.STAGES)

    good = keep(stage["quality"](spark, docs, folder), "t")
    assert good.columns == docs.columns
    weights = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).astype(float)
    want = []
    for i, t in [*rows, *bad]:
        places, _ = quality.features(pa.array([t], pa.string()))
        total = sum(c / max(len(places), 1) * quality.SCALE * weights[p] for p, c in collections.Counter(places.tolist()).items()) + weights[quality.DIM]
        if 1 / (1 + np.exp(-total)) >= corpus_pipeline.LEAST_QUALITY:
            want.append((i, t))
    assert key(good) == sorted(want, key=str) and not {i for i, _ in want} & {i for i, _ in bad} and len(want) > 40

    one = keep(stage["near_duplicates"](spark, docs, folder), "t")
    every = {(i, t): k for k, (i, t) in enumerate(dict.fromkeys([*rows, *bad]))}  # rows that are equal are one
    order = sorted(every, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1] or ""))
    place = {x: k for k, x in enumerate(order)}
    low = _jaccard_classes([(place[x], x[1]) for x in every if x[0] is not None], 5, 8, 10)
    kept = [x for x in every if x[0] is None or not (x[1] or "").split() or low[place[x]] == place[x]]
    assert one.columns == docs.columns and key(one) == sorted(kept, key=str)

    clean = stage["decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and key(clean) == sorted(((i, t) for i, t in [*rows, *bad] if i not in (200, 201)), key=str)

    private = stage["pii"](spark, docs, folder)
    got = {x.doc_id: x for x in private.where("doc_id >= 300 and doc_id < 500").collect()}
    assert private.columns == docs.columns and private.count() == docs.count()
    ip = re.search(r" at (\S+) ", got[301].text)[1]
    assert f"or {ip} on" in got[300].text and ip != "10.0.0.7" and "212 555 0123" not in got[300].text and "2024-02-29" not in got[300].text and got[300].n_chars == len(got[300].text)
    same = [i for i, t in rows if not re.search(r"[0-9]{2}", t or "")]
    assert key(private.where(private.doc_id.isin([i for i in same if i is not None]))) == sorted(((i, t) for i, t in rows if i in same and i is not None), key=str)
    assert got[301].text == pii.pseudonymise(docs, PII_KEY).where("doc_id = 301").first().text

    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_paths()[0])
    ids = collections.Counter((i, struct.pack(f"<{n}I", *x)) for i, t in [*rows, *bad] for x in [[*tk.encode(t or "", add_special_tokens=False).ids, 0]] for n in [len(x)])
    parts = collections.defaultdict(list)
    for x in stage["packing"](spark, docs, folder).collect():
        parts[x.doc_id, x.doc_tokens].append((x.start, x.ids))
    whole = collections.Counter()
    for (i, n), found in parts.items():
        found.sort()
        times = len([1 for start, _ in found if start == 0])
        for k in range(times):
            if len(found) == times or times == 1:
                whole[i, b"".join(x for _, x in (found if times == 1 else found[k : k + 1]))] += 1
    assert whole == ids

    none = docs.limit(0)
    for name in stage:
        assert stage[name](spark, none, folder).count() == 0
