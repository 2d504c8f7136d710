"""Near-duplicates by SimHash fingerprints that meet in the middle.

Fingerprints that differ in 2 * r bits at most have a common variant r bits from each at most, and two that have a
common variant differ in 2 * r bits at most. So every fingerprint emits all its variants within half the radius, and
those that meet on a variant are linked.

There are 2,081 variants for a radius of 4. They are dealt by their leading bits, and a fingerprint is sent to each
value of these bits that one of its variants has, once: with b bits that is 1 + b + b * (b - 1) / 2 rows of 16 bytes
instead of 2,081. The task that has such a value lists the variants with it, sorts them, and verifies what collides.
b grows with the logarithm of the number of fingerprints, so a value has some hundreds of them whatever the input;
where fingerprints lie close together (a group of near copies), values with too many variants get further bits,
again and again. With all 64 bits a value is one variant, which 2,081 fingerprints can have at most.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import components, forest
from .store import keep, small_batches

SEED, BITS = 42, 64
#: Fingerprints of a value of the leading bits, about; variants that a task sorts at once, four times those of a usual
#: value; bits that a full value gets more.
NEAR, MOST, MORE = 512, 4_000_000, 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Hashes whose bits are counted at once.
SLICE = 1 << 14


def fingerprint(text: str | None, n: int = 4) -> int:
    """64 bits: 1 where over half of the hashes of the n-word shingles have a 1; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, end, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        end.append(at)
    start = [0, *(e + 1 for e in end)]
    spans = zip(start, end[n - 1 :], strict=False) if len(words) >= n else [(0, len(joined))]
    of = xxhash.xxh64_intdigest
    h = np.array([of(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = sum(np.unpackbits(h[i : i + SLICE].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64) for i in range(0, len(h), SLICE))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp) of each row of docs (doc_id, text); fp as a signed number."""
    small_batches(docs.sparkSession)

    def describe(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, n) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(describe, "doc_id long, fp long")


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with `most` ones at most, those with fewer ones first."""
    return np.array([sum(1 << b for b in ones) for k in range(most + 1) for ones in combinations(range(bits), k)], np.uint64)


def _spread(rows: DataFrame, known: int, bits: int, half: int) -> DataFrame:
    """(value, fp) for each value of the leading `bits` bits that variants of fp have, from those of `known` bits."""

    def spread(batches):
        more = bits - known
        tails = masks(more, half)
        ones = np.bitwise_count(tails)
        for batch in batches:
            value, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("value", "fp"))
            apart = np.bitwise_count(value ^ (fp >> np.uint64(BITS - known))) if known else np.zeros(len(fp), np.uint8)
            own = fp >> np.uint64(BITS - bits) & np.uint64((1 << more) - 1)
            i, j = np.nonzero(apart[:, None] + ones[None, :] <= half)
            to = (value[i] << np.uint64(more)) | (own[i] ^ tails[j])
            yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(fp[i].view(np.int64))], names=["value", "fp"])

    return rows.mapInArrow(spread, "value long, fp long")


def _apart(bits: int) -> Column:
    return F.bit_count(F.col("value").bitwiseXOR(F.shiftrightunsigned("fp", BITS - bits))) if bits else F.lit(0)


def _collisions(value: np.ndarray, fp: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints that share a variant with this value of the leading bits."""
    rest = BITS - bits
    apart = np.bitwise_count(value ^ (fp >> np.uint64(rest))) if bits else np.zeros(len(fp), np.uint8)
    low = fp & np.uint64((1 << rest) - 1)
    variants, owner = [], []
    for k in range(half + 1):
        own = np.flatnonzero(apart == k)
        if len(own):
            flips = masks(rest, half - k)
            variants.append((low[own][:, None] ^ flips[None, :]).ravel())
            owner.append(np.repeat(own, len(flips)))
    variants, owner = np.concatenate(variants), np.concatenate(owner)
    order = np.argsort(variants)
    variants, owner = variants[order], owner[order]
    meet = np.flatnonzero(variants[1:] == variants[:-1])
    pairs = np.unique(np.stack([owner[meet], owner[meet + 1]], 1), axis=0) if len(meet) else np.zeros((0, 2), np.int64)
    a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
    close = (np.bitwise_count(a ^ b) <= 2 * half) & (a != b)
    return a[close].view(np.int64), b[close].view(np.int64)


def close_pairs(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) of the fingerprints in distinct(fp): a forest with the components of all pairs that differ in `radius` bits at most.

    radius is even. A task holds the fingerprints of one value of the leading bits, MOST variants at most.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    small_batches(distinct.sparkSession)
    schema = "a long, b long"

    def meet(batches):
        key, held = None, []

        def done():
            a, b = _collisions(np.uint64(key[1] % (1 << 64)), np.concatenate(held).view(np.uint64), key[0], half)
            a, b = forest(a, b) if len(a) else (a, b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            bits, value, fp = (batch.column(c).to_numpy() for c in ("bits", "value", "fp"))
            new = np.flatnonzero((bits[1:] != bits[:-1]) | (value[1:] != value[:-1])) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(fp)], strict=True):
                if i < j:
                    if key != (bits[i], value[i]):
                        if held:
                            yield done()
                        key, held = (int(bits[i]), int(value[i])), []
                    held.append(fp[i:j])
        if held:
            yield done()

    bits = min(BITS, max(0, math.ceil(math.log2(max(1, distinct.count() / NEAR)))))
    rows = keep(_spread(distinct.select(F.lit(0).cast("long").alias("value"), "fp"), 0, bits, half), "values")
    ready = None
    while True:
        weight = [sum(math.comb(BITS - bits, j) for j in range(half - k + 1)) for k in range(half + 1)]
        load = F.sum(F.element_at(F.array(*map(F.lit, weight)), _apart(bits) + 1))
        full = keep(rows.groupBy("value").agg(load.alias("load")).where(F.col("load") > MOST).select("value"), "full")
        last = bits == BITS or full.isEmpty()
        own = (rows if last else rows.join(full, "value", "left_anti")).select(F.lit(bits).alias("bits"), "value", "fp")
        ready = own if ready is None else ready.unionByName(own)
        if last:
            break
        more = min(BITS, bits + MORE)
        rows = keep(_spread(rows.join(full, "value", "left_semi").select("value", "fp"), bits, more, half), "values")
        bits = more
    return keep(ready.repartition("bits", "value").sortWithinPartitions("bits", "value").mapInArrow(meet, schema), "links")


def simhash_groups(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id integer, text).

    Fingerprints link when they differ in `radius` bits at most; component_id is the smallest doc_id reachable over
    links. Texts without words have the fingerprint 0, which links like any other; so do null texts. A null doc_id
    links nothing and has a null component. Rows that repeat a doc_id are one node, so their texts link. Equal
    fingerprints are one before anything is compared. Other columns are ignored; an empty table gives an empty result.
    """
    rows = keep(fingerprints(docs, n), "fingerprints")
    known = rows.where("doc_id is not null")
    first = keep(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "first")
    same = known.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("high")).where("b <> high").select("doc_id", "b")
    links = close_pairs(first.select("fp"), radius).unionByName(known.join(same, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    linked = first.join(components(links).withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("node").alias("component"))
    of = first.join(linked.join(least, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = rows.join(of, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
