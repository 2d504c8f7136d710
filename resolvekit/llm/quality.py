"""Quality classifier: logistic regression over hashed word n-grams.

Tokens are runs of letters or digits and runs of other visible characters; unigrams and bigrams are hashed into
DIM places, and each trigram that the same text had before counts at the place REPEAT. A text's value at a place is
its share of the text's n-grams, times SCALE. Weights are learned by follow-the-regularised-leader (per-coordinate
steps, L1 and L2); a score is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import keep, share, small_batches
from .text import mix, pieces, powers

DIM = 1 << 18
REPEAT = 0
#: Labelled texts of each label that the model is fitted on, at most, and their places (8 bytes each) altogether;
#: passes over them; the values' scale.
SAMPLE, PLACES, PASSES, SCALE = 4000, 4_000_000, 4, 30.0
#: Step size and its damping, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
#: Kinds of bytes: 0 blank, 1 letter or digit (and all bytes of non-ASCII characters), 2 other.
_KIND = np.full(256, 2, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): hashed unigrams and bigrams of each text, with repeats, and where each text's start."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    kind = _KIND[buf]
    change = np.ones(len(buf), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[off[off < len(buf)]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(buf))
    word = kind[start] > 0
    start, end = start[word], end[word]
    doc = np.searchsorted(off, start, "right") - 1
    with np.errstate(over="ignore"):
        p, q = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
        h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[doc[:-1] == doc[1:]] if len(h) > 1 else h[:0]
    three = np.flatnonzero(doc[:-2] == doc[2:]) if len(h) > 2 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        triple = mix(mix(h[three] * np.uint64(3) + h[three + 1]) + h[three + 2])
    keys = np.sort((doc[three].astype(np.uint64) << np.uint64(44)) | (triple >> np.uint64(20)))
    again = (keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)).astype(np.int64)
    at = np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]], again])
    places = np.concatenate([(np.concatenate([h, pair]) % np.uint64(DIM)).astype(np.int64), np.full(len(again), REPEAT)])
    order = np.argsort(at, kind="stable")
    return places[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])


class Ftrl:
    """Weights of a logistic regression, learned one text at a time."""

    def __init__(self):
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)  # the last place is the constant

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(i)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def _example(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, c = np.unique(places, return_counts=True)
    return np.append(i, DIM), np.append(c * (SCALE / max(len(places), 1)), 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights (DIM places and the constant) from docs (doc_id, text) and labels (doc_id, quality 0 or 1).

    The sample is bounded in rows and in bytes: of each label, the SAMPLE texts with the smallest hash of their id,
    as many of them in this order as have PLACES places together. Each text comes to the driver as its hashed places
    alone. Of rows that repeat a doc_id one is taken; of several labels the larger. Null texts, ids and labels are
    left out. Without labelled texts all weights are 0 (every score is 0.5).
    """
    small_batches(docs.sparkSession)
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = docs.where("text is not null").select("doc_id").join(labels, "doc_id").withColumn("key", F.xxhash64("doc_id"))
    take = lambda y: ids.where(F.col("quality") == y).orderBy("key", "doc_id").limit(SAMPLE)
    chosen = take(0).unionByName(take(1)).dropDuplicates(["doc_id"]).select("doc_id", "quality", "key")

    def places(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found, at = features(part.column("text"))
                rows = [_example(found[at[i] : at[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_pydict({"quality": part.column("quality"), "key": part.column("key"),
                    "i": pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()),
                        "x": pa.array([x.astype(np.float32).tobytes() for _, x in rows], pa.binary())})

    # chosen has 2 * SAMPLE rows at most, so it is broadcast whatever the input
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "key")
    sample = keep(sample.mapInArrow(places, "quality int, key long, i binary, x binary").groupBy("quality",
        "key").agg(F.min(F.struct("i", "x")).alias("of")).select("quality", "key", "of.*"), "sample")
    fits, used = {}, {0: 0, 1: 0}
    for r in sample.select("quality", "key", (F.length("i") / 4).cast("long").alias("n")).orderBy("key").collect():
        used[r.quality] += r.n
        if used[r.quality] <= PLACES or r.quality not in fits:
            fits[r.quality] = r.key
    within = F.lit(False)
    for y, last in fits.items():
        within = within | ((F.col("quality") == y) & (F.col("key") <= last))
    rows = sorted(sample.where(within).collect(), key=lambda r: (r.key, r.i))
    model = Ftrl()
    n = np.bincount([r.quality for r in rows], minlength=2)
    rare = n.sum() / np.maximum(2 * n, 1)
    for _ in range(PASSES):
        for r in rows:
            model.learn(np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float32).astype(np.float64), r.quality, min(rare[r.quality], 4.0))
    return model.weights(slice(None)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 appended (higher: label 1 likelier); every other column is kept as it is.

    A null, empty or blank text gets the score of the constant alone. The whole text counts, however long.
    Ties and repeated rows are scored alike. A column named as the score is replaced.
    """
    small_batches(docs.sparkSession)
    fixed = share(docs.sparkSession, weights)
    kept = [f for f in docs.schema.fields if f.name.lower() != column.lower()]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                w = fixed.value
                found, at = features(part.column("text"))
                total = np.concatenate([[0.0], np.cumsum(w[found], dtype=np.float64)])
                size = np.diff(at)
                value = (total[at[1:]] - total[at[:-1]]) * SCALE / np.maximum(size, 1) + w[DIM]
                out = pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), out], names=[*(f.name for f in kept), column])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{column}` double"])
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)
