"""Removal of repeated passages with a compressed FM-index per shard.

A window is `width` consecutive words. Its key is the smallest hash of the GRAM-word grams in it, so equal
windows have equal keys; consecutive windows of one key are a run. Runs of keys that more than one document has
go to shards by key, each different run once. A shard builds an FM-index over its runs (Burrows-Wheeler
transform as a bit-packed wavelet matrix; of the suffix order only the groups of equal windows stay) and streams
the runs through it: backward search gives, at each word, the longest match up to `width` words, and each match
of full width the smallest doc_id that has the window. Where these statistics reach the width, intervals go back
to every document that has the run.

A key with more words than a shard (a phrase that very many documents have, each in a context of its own) is dealt
again: its windows get the smallest gram under another order besides, so that they go to shards by their contexts, and
are searched there like any others. Only what LEVELS such orders don't tell apart is keyed by all words of a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .filters import BITS, bit_table, contains, slot_of, split
from .store import keep, release, share, small_batches
from .text import Words, mix, ngrams, pieces, powers, windows_in

GRAM = 10
#: Words of the different runs in a shard, about, and of one key in a shard at most; times that larger keys are dealt again.
SHARD, LEVELS = 1_000_000, 4
#: Windows that are streamed in one go; longer runs are cut, with width - 1 words more on the right.
LANE = 256
NONE = np.iinfo(np.int64).max


def _place(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - BITS)).astype(np.int64)


def _least_gram(h: np.ndarray, width: int, order: int) -> np.ndarray:
    """The smallest hash of the grams of each window, by one of several orders."""
    low, size, reach = ngrams(h, GRAM), 1, width - GRAM + 1
    if order:
        low = mix(low ^ np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64)))
    while 2 * size <= reach:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    k = len(h) - width + 1
    return np.minimum(low[:k], low[reach - size :][:k])


def _runs(part: pa.RecordBatch, width: int, hot: list[np.ndarray]):
    """(words, h, start, windows, key, mark) of each run in a batch; start in the batch's words. hot has the keys that are dealt again, by level."""
    words = Words(part.column("text"))
    h, at = words.hashes(), windows_in(words, width)
    if not len(at):
        none = np.zeros(0, np.int64)
        return words, h, none, none, none.view(np.uint64), none.view(np.uint64)
    low = _least_gram(h, width, 0)[at]
    for level, keys in enumerate(hot, 1):
        again = contains(keys, _place(low))
        if again.any():
            low = np.where(again, mix(low ^ _least_gram(h, width, level)[at]) if level < LEVELS else ngrams(h, width)[at], low)
    new = np.append(True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    start, windows = at[first], np.diff(np.append(first, len(at)))
    with np.errstate(over="ignore"):
        p, q = powers(len(h) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:-1])])
        mark = mix((total[start + windows + width - 1] - total[start]) * q[start] + windows.astype(np.uint64))
    return words, h, start, windows, low[first], mark


def _slot(doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(doc_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _groups(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the groups of equal keys with two members or more, in order."""
    edge = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]], [True]]))
    large = np.diff(edge) > 1
    return edge[:-1][large].astype(np.int32), edge[1:][large].astype(np.int32)


class FMIndex:
    """A text of integers (0 is a separator) for backward search of patterns up to `depth` symbols.

    It holds a wavelet matrix, and of the suffix order the groups of two or more suffixes that begin alike: those of
    `depth` symbols with their smallest owner, those of one symbol less to shorten a match on the right.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        n = len(text)
        rank, k = np.unique(text, return_inverse=True)[1], 1

        def both(shift: int) -> np.ndarray:
            later = np.zeros(n, np.int64)
            later[: max(n - shift, 0)] = rank[shift:] + 1
            return rank * (n + 1) + later

        while 2 * k < depth:
            rank, k = np.unique(both(k), return_inverse=True)[1], 2 * k
        key = both(depth - k)
        order = np.argsort(key, kind="stable")
        self.n, self.depth, self.levels = n, depth, max(1, int(text.max()).bit_length())
        self.start, end = _groups(key, order)
        size = end - self.start
        member = np.repeat(self.start - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.owner = np.minimum.reduceat(owner[order[member]], np.cumsum(size) - size) if len(size) else np.zeros(0, np.int64)
        self.wide = _groups(both(depth - 1 - k) if depth - 1 > k else rank, order) if depth > 1 else (np.zeros(1, np.int32), np.full(1, n, np.int32))
        counts = np.bincount(text, minlength=1 << self.levels)
        bwt = text[order - 1]
        self.bits, self.sums, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (bwt >> level & 1).astype(bool)
            packed = np.zeros((n + 64) // 64 * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            packed = packed.view(np.uint64)
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        # where a symbol's rows begin, less where its occurrences begin in the last level
        symbol = np.arange(1 << self.levels)
        self.shift = (np.cumsum(counts) - counts - self._follow(symbol, np.zeros(len(symbol), np.int64))).astype(np.int32)

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            ones = self.sums[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with one more symbol in front; a symbol below 0 isn't in the text."""
        known = np.maximum(symbol, 0)
        both = self._follow(np.concatenate([known, known]), np.concatenate([lo, hi])) + np.tile(self.shift[known], 2)
        lo, hi = both[: len(lo)], both[len(lo) :]
        return lo, np.where(symbol < 0, lo, hi)

    def matches(self, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, owner) at each place of text: the longest match up to depth found from there, read from each lane's end.

        Lanes are text[first:end], read from right to left. owner is that of a match of full depth whose group has two
        places or more, NONE elsewhere. A match that can't go on gives up its last symbol and is read anew.
        """
        length, owner = np.zeros(len(text), np.int16), np.full(len(text), NONE)
        at, left = end - 1, first
        lo, hi, size = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        while len(at):
            full = size == self.depth
            if full.any():
                begin, stop = self.wide
                group = np.searchsorted(begin, lo[full], "right") - 1
                inside = (group >= 0) & (lo[full] < stop[np.maximum(group, 0)]) if len(begin) else np.zeros(len(group), bool)
                group = np.maximum(group, 0)
                lo[full], hi[full] = (np.where(inside, begin[group], lo[full]), np.where(inside, stop[group], hi[full])) if len(begin) else (lo[full], hi[full])
                size = size - full
            a, b = self.extend(lo, hi, text[at])
            found = a < b
            lo, hi = np.where(found, a, 0), np.where(found, b, self.n)
            size_now = size + 1
            spot = at[found]
            length[spot] = np.maximum(length[spot], size_now[found])
            whole = np.flatnonzero(found & (size_now == self.depth))
            if len(whole) and len(self.start):
                group = np.minimum(np.searchsorted(self.start, lo[whole]), len(self.start) - 1)
                hit = self.start[group] == lo[whole]
                owner[at[whole[hit]]] = self.owner[group[hit]]
            at = np.where(found, at - 1, at + size - 1)
            size = np.where(found, size_now, 0)
            more = at >= left
            at, left, lo, hi, size = at[more], left[more], lo[more], hi[more], size[more]
        return length, owner


def repeated_windows(runs: list[np.ndarray], owner: np.ndarray, width: int) -> list[np.ndarray]:
    """For each run (word hashes) of an owner, the smallest owner of a run that has it, for each of its windows."""
    size = np.array([len(r) for r in runs])
    symbol = np.unique(np.concatenate(runs), return_inverse=True)[1] + 1
    text = np.zeros(len(symbol) + len(runs), np.int64)  # a 0 after each run
    first = np.cumsum(size + 1) - size - 1
    text[np.arange(len(symbol)) + np.repeat(np.arange(len(runs)), size)] = symbol
    index = FMIndex(text, np.repeat(owner, size + 1), width)
    lanes = -(-(size - width + 1) // LANE)
    start = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    _, found = index.matches(text, start, np.minimum(start + LANE + width - 1, np.repeat(first + size, lanes)))
    return [np.minimum(found[a : a + n - width + 1], o) for a, n, o in zip(first.tolist(), size.tolist(), owner.tolist(), strict=True)]


_SPAN = pa.list_(pa.struct([("offset", pa.int64()), ("windows", pa.int64()), ("owner", pa.int64())]))


def _spans(owner: np.ndarray, last: int) -> list[dict]:
    """Intervals of windows with one owner that is below last."""
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    return [{"offset": a, "windows": b - a, "owner": o} for a, b, o in zip(edge[:-1].tolist(), edge[1:].tolist(), owner[edge[:-1]].tolist(), strict=True) if o < last]


def find_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, th, start, windows): windows of docs (doc_id, text, th) that a smaller doc_id has too, in spans.

    start counts words from 0; th tells texts with one doc_id apart.
    """
    docs = docs.where("doc_id is not null")

    def described(hot):
        hot = tuple(hot)

        def describe(batches):
            for batch in batches:
                for part in pieces(batch, "text"):
                    words, _, start, windows, key, mark = _runs(part, width, [x.value for x in hot])
                    doc = words.doc[start]
                    doc_id, th = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "th"))
                    own = start - words.first[doc]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "mark": pa.array(mark.view(np.int64)),
                        "doc_id": pa.array(doc_id), "th": pa.array(th), "start": pa.array(own.astype(np.int64)),
                            "windows": pa.array(windows.astype(np.int64)), "slot": pa.array(_slot(doc_id, own)), "place": pa.array(_place(key))})

        runs = keep(docs.mapInArrow(describe, "key long, mark long, doc_id long, th long, start long, windows long, slot long, place long"), "runs")
        marks = runs.groupBy("key", "mark").agg(F.min(F.struct("doc_id", "slot", "place", "windows")).alias("own"), F.max("doc_id").alias("last"))
        keys = marks.groupBy("key").agg(F.min("own.doc_id").alias("lo"), F.max("last").alias("hi"),
            F.sum(F.col("own.windows") + width - 1).alias("words")).where("lo < hi").select("key", "words")
        owned = marks.join(keys, "key").select("key", "mark", F.col("own.doc_id").alias("owner"), "own.slot", "own.place",
            (F.col("own.windows") + width - 1).alias("size"), "last", "words")
        return runs, keep(owned, "owned")

    hot = []
    runs, owned = described(hot)
    while len(hot) < LEVELS and not (large := owned.where(F.col("words") > SHARD)).isEmpty():
        hot.append(share(docs.sparkSession, bit_table(large.select(F.col("place").alias("slot")))))
        runs, owned = described(hot)
    flags = share(docs.sparkSession, bit_table(owned.select("slot")))

    def contents(batches):
        seen = set()  # repeated rows go on once a task
        for batch in batches:
            for part in pieces(batch, "text"):
                words, h, start, windows, key, mark = _runs(part, width, [x.value for x in hot])
                doc = words.doc[start]
                doc_id = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                new = [x not in seen and not seen.add(x) for x in zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist(), strict=True)]
                take = np.flatnonzero(contains(flags.value, _slot(doc_id, start - words.first[doc])) & np.array(new, bool)[doc])
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[take].view(np.int64)), "mark": pa.array(mark[take].view(np.int64)),
                    "words": pa.array([h[start[i] : start[i] + windows[i] + width - 1].tobytes() for i in take], pa.binary())})

    texts = docs.mapInArrow(contents, "key long, mark long, words binary").select("key", "mark", "words", F.lit(None).cast("long").alias("owner"),
        F.lit(None).cast("long").alias("last"))
    shards = max(1, int(owned.agg(F.sum("size")).first()[0] or 0) // SHARD)
    rows = texts.unionByName(owned.select("key", "mark", F.lit(None).cast("binary").alias("words"), "owner", "last"))

    def search(table):
        """The runs of a shard: what is known of each, and its words, once or more."""
        known, words = {}, {}
        for key, mark, text, owner, last in zip(*(table.column(c).to_pylist() for c in ("key", "mark")), table.column("words"),
            *(table.column(c).to_pylist() for c in ("owner", "last")), strict=True):
            if owner is None:
                words[key, mark] = text
            else:
                known[key, mark] = owner, last
        names = sorted(k for k in known if k in words)
        spans = []
        if names:
            owner = np.array([known[k][0] for k in names])
            found = repeated_windows([np.frombuffer(words[k].as_buffer(), np.uint64) for k in names], owner, width)
            spans = [_spans(f, known[k][1]) for f, k in zip(found, names, strict=True)]
        return pa.table({"key": pa.array([k for (k, _), s in zip(names, spans, strict=True) if s], pa.int64()),
            "mark": pa.array([m for (_, m), s in zip(names, spans, strict=True) if s], pa.int64()), "spans": pa.array([s for s in spans if s], _SPAN)})

    found = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(search,
        "key long, mark long, spans array<struct<offset:long,windows:long,owner:long>>")
    found = keep(found, "found")
    release(*hot, flags)
    spots = runs.select("key", "mark", "doc_id", "th", "start").join(found, ["key", "mark"]).select("doc_id", "th", "start", F.explode("spans").alias("s"))
    return spots.where("s.owner < doc_id").select("doc_id", "th", (F.col("start") + F.col("s.offset")).alias("start"), "s.windows")


def remove_repeats(docs: DataFrame, width: int = 50, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of docs (doc_id integer, text).

    A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id.
    kept are the words that stay, joined by one blank; kept_sha256 is its hash. Without text, kept is left out.

    A null text has no words. A null doc_id is neither smaller than another nor loses words. Rows that repeat
    a doc_id are judged against smaller ids only, not against each other. Ties don't arise: ids order all.
    Texts of any length are judged whole. Other columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    spans = find_repeats(docs, width).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))
    spans = keep(spans, "spans")
    slot = slot_of("doc_id", "th")
    maybe, clear = split(docs, slot, spans.select(slot.alias("slot")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if text else "")

    def result(doc_id, values, cuts):
        out = []
        for value, cut in zip(values, cuts, strict=True):
            words = value.encode().split()
            n = len(words)
            if cut:
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, [s["start"] for s in cut], 1)
                np.add.at(gone, [s["start"] + s["windows"] + width - 1 for s in cut], -1)
                gone = np.cumsum(gone[:-1]) > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        arrays = [doc_id, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[3], pa.string())] if text else []), names=[c.split()[0] for c in schema.split(", ")])

    def untouched(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield result(part.column("doc_id"), part.column("text").to_pylist(), [None] * part.num_rows)

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield result(part.column("doc_id"), part.column("text").to_pylist(), part.column("spans").to_pylist())

    touched = maybe.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return clear.mapInArrow(untouched, schema).unionByName(touched.mapInArrow(cut, schema))
