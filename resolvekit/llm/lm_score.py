"""Cross-entropy difference of a target and a background bigram model.

Both models have the same vocabulary (every word of every document), order and smoothing:
p(w | h) = (c(h, w) + KAPPA) / (c(h) + KAPPA * V), with a start symbol as the first h. The background is all
documents, the target those marked as such; a document's own counts are left out of the models that score it. Its
score is the mean over its words of log p_background - log p_target: lower is more like the target.

Documents are taken in chunks. A chunk sends each of its n-grams once, with its count, to the place that the
n-gram's hash says; there counts are added up over chunks and go back to each chunk that asked, which keeps the
counts of its documents. So a place gets a row from a chunk, not from a document, however common an n-gram is.
Words above 1 / FREQUENT of all words (FREQUENT at most) are counted first and broadcast. Terms are whole
millionths, so sums don't depend on their order.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .filters import slot_of, split
from .store import keep, share, small_batches
from .text import Words, mix, pieces

KAPPA = 0.05
#: Words with more than this part of all occurrences have their counts broadcast.
FREQUENT = 1 << 18
#: Words of the documents of a chunk, about; bytes of text whose n-grams meet in one place, about.
CHUNK, PLACE = 1_000_000, 8 << 20
#: Ids of target documents that are broadcast at most (about 40 MB in memory).
SMALL = 1_000_000
START = np.uint64(0x5354415254)
UNIT = 1_000_000


def _dump(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays], 5))


def _load(data: bytes) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() if b else np.zeros(0, t) for t,
        b in pickle.loads(zstandard.ZstdDecompressor().decompress(data))]


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _merge(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each weight."""
    which, inverse = np.unique(keys, return_inverse=True)
    return which, *(np.bincount(inverse, w, len(which)).astype(np.int64) for w in weights)


def _by_bucket(keys: np.ndarray, buckets: int, *columns: np.ndarray):
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    which, start = np.unique(bucket[order], return_index=True)
    for b, at in zip(which.tolist(), np.split(order, start[1:]), strict=True):
        yield b, [c[at] for c in (keys, *columns)]


def _word_stats(docs: DataFrame, buckets: int) -> tuple[int, dict[str, np.ndarray]]:
    """(V, frequent): the number of distinct words; counts as a history of the frequent ones, by hash."""

    def count(batches):
        held = []

        def flush():
            keys, total, own = _merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            for b, (k, t, o) in _by_bucket(keys, buckets, total, own):
                order = np.argsort(k)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()),
                    "data": pa.array([_dump(np.diff(k[order], prepend=np.uint64(0)), _small(t[order]), _small(o[order]))], pa.binary())})

        size = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                target = part.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
                follows = np.append(words.doc[1:] == words.doc[:-1], False)[: len(words.doc)].astype(np.int64)
                begin = words.count > 0
                keys = np.concatenate([words.hashes(), [START] * bool(begin.any())]).astype(np.uint64)
                held.append(_merge(keys, np.append(follows, [begin.sum()] * bool(begin.any())),
                    np.append(follows * target[words.doc], [(begin * target).sum()] * bool(begin.any()))))
                size += len(held[-1][0])
                if size > CHUNK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def total(key, table):
        parts = [_load(x.as_py()) for x in table.column("data")]
        keys, n, own = _merge(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts]),
            np.concatenate([p[2] for p in parts]))
        order = np.argsort(-n, kind="stable")[:FREQUENT]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([len(keys)], pa.int64()),
            "total": pa.array([n.sum()], pa.int64()), "top": pa.array([_dump(keys[order], n[order], own[order])], pa.binary())})

    sums = keep(docs.mapInArrow(count, "bucket int, data binary").groupBy("bucket").applyInArrow(total, "bucket int, words long, total long, top binary"), "words")
    v, n = sums.agg(F.sum("words"), F.sum("total")).first()
    least = max(1, (n or 0) // FREQUENT)

    def frequent(batches):
        for batch in batches:
            for x in batch.column("top"):
                k, t, o = _load(x.as_py())
                yield pa.RecordBatch.from_pydict({"k": pa.array(k[t > least].view(np.int64)), "t": pa.array(t[t > least]), "o": pa.array(o[t > least])})

    rows = sums.mapInArrow(frequent, "k long, t long, o long").toArrow()  # FREQUENT rows at most
    k = rows.column("k").to_numpy().view(np.uint64)
    order = np.argsort(k)
    return max((v or 0) - 1, 0), {"k": k[order], "t": rows.column("t").to_numpy()[order], "o": rows.column("o").to_numpy()[order]}


def _logs(n: np.ndarray) -> np.ndarray:
    """Logarithms in whole millionths."""
    return np.rint(np.log(n) * UNIT).astype(np.int64)


def _sums(doc: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, terms, n).astype(np.int64)


def cross_entropy_difference(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, ce_target, ce_background, ce_diff) for each row of docs (doc_id, text, target boolean).

    Cross entropies are in nats a word, means of terms in whole millionths.

    A null or blank text has no words and null scores. A null target is false. A null doc_id is a document like
    others. Repeated rows are documents of their own (so each is in the model of the other) and score alike. Other
    columns are ignored. Without a target document the target model is uniform. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("target", F.lit(False)).alias("target"))
    buckets = max(8, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PLACE)
    v, frequent = _word_stats(docs, buckets)
    known = share(docs.sparkSession, frequent)

    def send(batches):
        """Rows (place, chunk, part, data): a chunk's n-grams for each place, and (part -1) what stays with the chunk."""
        held, size, chunk = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            ids, null, target, words, base_t, base_b = (np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True))
            shift = np.cumsum([0, *(len(h[0][0]) for h in held)])
            keys = np.concatenate([h[1] for h in held])
            doc = np.concatenate([(h[2] + s).astype(np.int32) for h, s in zip(held, shift, strict=False)])
            held.clear()
            order = np.argsort(keys, kind="stable")  # documents of a key stay in order
            keys, doc = keys[order], doc[order]
            del order
            at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.append(at, len(keys))).astype(np.int32)
            keys, doc = keys[at], doc[at]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else at
            k = keys[first]
            yield -1 - chunk, chunk, -1, _dump(ids, null, _small(target), _small(words), base_t, base_b,
                np.packbits((k & np.uint64(1)).astype(np.uint8)), _small(np.diff(np.append(first, len(keys)))), _small(doc), _small(times))
            if len(k):
                n, own = np.add.reduceat(times, first), np.add.reduceat(times * target[doc].astype(np.int32), first)
                place = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # in order of keys
                which, start = np.unique(place, return_index=True)
                for b, x, y in zip(which.tolist(), start.tolist(), [*start[1:].tolist(), len(k)], strict=True):
                    yield b, chunk, b, _dump(np.diff(k[x:y], prepend=np.uint64(0)), _small(n[x:y]), _small(own[x:y]))

        def batch_of(rows):
            place, at, part, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int64()), "chunk": pa.array(at, pa.int64()),
                "part": pa.array(part, pa.int64()), "data": pa.array(data, pa.binary())})

        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                h = words.hashes()
                before = np.append(START, h[:-1])[: len(h)]
                before[words.first[:-1][words.count > 0]] = START
                with np.errstate(over="ignore"):
                    pair = mix(mix(before * np.uint64(0x9E3779B97F4A7C15)) + h) | np.uint64(1)
                f = known.value
                at = np.minimum(np.searchsorted(f["k"], before), max(len(f["k"]) - 1, 0))
                hit = f["k"][at] == before if len(f["k"]) else np.zeros(len(h), bool)
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                target = part.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
                own, times = np.unique(words.doc[hit] * max(len(f["k"]), 1) + at[hit], return_counts=True)
                doc, which = np.divmod(own, max(len(f["k"]), 1))
                base_t, base_b = (_sums(doc, -_logs(c + KAPPA * v) * times, words.n_docs) if len(doc) else np.zeros(words.n_docs,
                    np.int64) for c in (f["o"][which] - times * target[doc], f["t"][which] - times))
                rest = mix(before[~hit]) & ~np.uint64(1)
                held.append(((ids.fill_null(0).to_numpy(zero_copy_only=False), null, target, words.count, base_t, base_b),
                    np.concatenate([pair, rest]), np.concatenate([words.doc, words.doc[~hit]])))
                size += len(h)
                if size > CHUNK:
                    yield batch_of(list(flush()))
                    size, chunk = 0, chunk + 1
        if held:
            yield batch_of(list(flush()))

    def count(key, table):
        if key[0].as_py() < 0:  # a chunk's own part passes through
            return table.select(["chunk", "part", "data"])
        parts = [_load(x.as_py()) for x in table.column("data")]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        which, n, own = _merge(np.concatenate(keys), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
        out = []
        for k in keys:
            at = np.searchsorted(which, k)
            out.append(_dump(_small(n[at]), _small(own[at])))
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "data": pa.array(out, pa.binary())})

    def finish(key, table):
        order = np.argsort(table.column("part").to_numpy())
        own, *counts = (_load(table.column("data")[int(i)].as_py()) for i in order)
        ids, null, target, words, t, b, kinds, lengths, doc, times = own
        n, of_target = (np.concatenate([c[k] for c in counts]).astype(np.int64) if counts else np.zeros(0, np.int64) for k in (0, 1))
        at = np.repeat(np.arange(len(n)), lengths)
        pair, times = np.unpackbits(kinds, count=len(n)).astype(bool)[at], times.astype(np.int64)
        for total, c in ((t, of_target[at] - times * target[doc]), (b, n[at] - times)):
            term = _logs(np.where(pair, c + KAPPA, c + KAPPA * v))
            total += _sums(doc, np.where(pair, term, -term) * times, len(ids))
        words = words.astype(np.int64)
        mean = lambda s: pa.array(-(s / UNIT) / np.maximum(words, 1), mask=words == 0)
        return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_words": pa.array(words), "ce_target": mean(t), "ce_background": mean(b),
            "ce_diff": mean(t - b)})

    # a chunk is the same in each attempt at its task, in whatever order its rows come
    met = docs.sortWithinPartitions(F.xxhash64("doc_id", "text")).mapInArrow(send, "place long, chunk long, part long, data binary")
    met = met.groupBy("place").applyInArrow(count, "chunk long, part long, data binary")
    return met.groupBy("chunk").applyInArrow(finish, "doc_id long, n_words long, ce_target double, ce_background double, ce_diff double")


def mark_target(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, target): target is true where doc_id is in chosen.

    Up to SMALL chosen ids are broadcast, so no text is shuffled; above that, only texts that may be chosen are.
    """
    chosen = chosen.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mark = lambda df, ids: df.join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    if chosen.limit(SMALL + 1).count() <= SMALL:
        return mark(docs, F.broadcast(chosen))
    maybe, clear = split(docs, slot_of("doc_id"), chosen.select(slot_of("doc_id").alias("slot")))
    return clear.withColumn("target", F.lit(False)).unionByName(mark(maybe, chosen))
