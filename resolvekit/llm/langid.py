"""Language identification with a blended-spectrum string kernel.

A text's features are which of its byte 1- to 3-grams occur (hashed into DIM places); the kernel of two texts
is their number of common places, divided by the root of the product of their sizes. Landmarks are training
texts (Nyström); one-versus-rest kernel ridge regression is solved on them, and texts are scored in batches
by two matrix products: presence x landmarks, then kernel x coefficients.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .store import share, small_batches, unused
from .text import pieces

#: Places of the hashed n-grams.
DIM = 8192
#: Labelled texts of each language that the model is fitted on, and those of them that are landmarks; both in all; languages.
SAMPLE, LANDMARKS = 400, 60
MOST_SAMPLE, MOST_LANDMARKS, LANGUAGES = 16_000, 1_600, 400
RIDGE = 1e-2
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def presence(column: pa.Array) -> np.ndarray:
    """A 0/1 row of DIM places for each text (float32)."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    out = np.zeros((len(arr), DIM), np.float32)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    if data is None or off[-1] == off[0]:
        return out
    b = _LOWER[np.frombuffer(data, np.uint8)[off[0] : off[-1]]]
    doc = np.repeat(np.arange(len(arr)), np.diff(off))
    code = b.copy()
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        k = len(code)
        if k <= 0:
            break
        inside = doc[:k] == doc[n - 1 :]
        place = ((code[inside] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(19)).astype(np.int64)
        out.ravel()[doc[:k][inside] * DIM + place] = 1
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Model:
    """Landmarks (rows scaled to length 1), coefficients and the languages in order."""

    def __init__(self, landmarks: np.ndarray, coef: np.ndarray, langs: list[str]):
        self.landmarks, self.coef, self.langs = landmarks, coef, langs

    def score(self, x: np.ndarray) -> np.ndarray:
        return (_scaled(x) @ self.landmarks.T) @ self.coef


def fit(docs: DataFrame) -> Model:
    """Fit on at most SAMPLE texts of each language, those with the smallest hash of their id.

    The model is bounded for any number of languages: the LANGUAGES most frequent ones are learned, each with its share
    of MOST_SAMPLE texts and MOST_LANDMARKS landmarks (so 40 languages have SAMPLE texts each, 26 all their landmarks).

    docs: doc_id, text, lang; rows with a null text or lang are left out, and of rows that repeat a doc_id one is
    taken. Only the hashed presence rows of the sample (DIM bits each) come to the driver, never a text.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null")
    known = [r.lang for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    per, marks = min(SAMPLE, MOST_SAMPLE // max(1, len(known))), min(LANDMARKS, MOST_LANDMARKS // max(1, len(known)))
    labelled = labelled.where(F.col("lang").isin(known))
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    some = Window.partitionBy("lang", F.pmod("key", F.lit(64))).orderBy("key", "doc_id")  # so that no task ranks a whole language
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("key"))
    ids = ids.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= per)
    ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per)
    chosen = ids.select("doc_id", "lang", "rank").dropDuplicates(["doc_id"])

    def bits(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = np.packbits(presence(part.column("text")).astype(bool), axis=1)
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "rank": part.column("rank"), "bits": pa.array([r.tobytes() for r in rows], pa.binary())})

    # chosen has at most MOST_SAMPLE rows, so its side is small whatever the input
    sample = labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen),
        ["doc_id", "lang"]).select("text", "lang", "rank")
    sample = sample.mapInArrow(bits, "lang string, rank int, bits binary").groupBy("lang", "rank").agg(F.min("bits").alias("bits"))
    rows = sorted(sample.collect(), key=lambda r: (r.lang, r.rank, r.bits))
    langs = sorted({r.lang for r in rows})
    if not rows:
        return Model(np.zeros((1, DIM), np.float32), np.zeros((1, 0), np.float32), [])
    x = _scaled(np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in rows]), axis=1).astype(np.float32))
    y = np.array([[1.0 if r.lang == lang else -1.0 for lang in langs] for r in rows])
    z = x[[i for i, r in enumerate(rows) if r.rank <= marks]]
    weight = np.array([1 / sum(q.lang == r.lang for q in rows) for r in rows])
    knm, kmm = (x @ z.T).astype(np.float64), (z @ z.T).astype(np.float64)
    left = knm.T @ (weight[:, None] * knm) + RIDGE * kmm + 1e-8 * np.eye(len(z))
    return Model(z, np.linalg.solve(left, knm.T @ (weight[:, None] * y)).astype(np.float32), langs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1); docs has doc_id and text, and all its columns are kept but those two.

    A null text, or one without a letter, is `und` with score 0, as is every text where the model knows no
    language. Ties go to the language that sorts first. The whole text counts, however long. Only the text
    is an input. Repeated rows are predicted alike; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    fixed = share(docs.sparkSession, model)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("text", "lang_pred", "score")]
    marked = unused(docs.columns, "has_letters")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                model = fixed.value
                pred, score = [], []
                for at in range(0, part.num_rows, 256):
                    chunk = part.slice(at, 256)
                    n = chunk.num_rows
                    if model.langs:
                        f = model.score(presence(chunk.column("text")))
                        e = np.exp(4 * (f - f.max(1, keepdims=True)))
                        best = f.argmax(1)
                        p, s = [model.langs[i] for i in best], (e / e.sum(1, keepdims=True))[np.arange(n), best].astype(float)
                    else:
                        p, s = ["und"] * n, np.zeros(n)
                    letters = chunk.column(marked).to_numpy(zero_copy_only=False).astype(bool)
                    pred += [x if ok else "und" for x, ok in zip(p, letters, strict=True)]
                    score += np.where(letters, s, 0.0).tolist()
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*(f.name for f in kept), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double"])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*(f"`{f.name}`" for f in kept), F.col("text").alias("text"), letters.alias(marked)).mapInArrow(run, schema)
