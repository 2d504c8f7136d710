"""Runs of words that repeat with a period, found by seeds on diagonals and collapsed to one period.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), with four periods and
six words at least, that goes no further. A run overlaps itself moved by q, the diagonal of lag q, in all but q words:
3 * q at least, and five where q is 1. So lags from L to 2 * L - 1 are found by n-grams of 3 * L words (L a power of
two; five words for L = 1):

1. The n-grams of a document are indexed by hash; those that don't occur twice leave, also for larger L.
2. Each occurrence and the next of the same n-gram are a seed of their lag. An n-gram is longer than the lags that it
   serves, so within a run the next one lies just one period on: pairs further apart aren't needed, and there are no
   more seeds than words.
3. Seeds go along their diagonals in order. One that the stretch so far covers, up to the furthest place covered on
   its lag, is passed over; others are extended to both sides by equal prefix hashes, once.

A document is one row and is worked on whole; short ones share arrays.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import small_batches
from .text import Words, mix, pieces, powers

#: Words and periods that a run has at least.
WORDS, PERIODS = 6, 4
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Grams:
    """Hashes of any stretch of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            self.p, self.q = powers(len(h) + 1)
            self.total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * self.p[:-1], out=self.total[1:])

    def hash(self, at: np.ndarray, n) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[at + n] - self.total[at]) * self.q[at])

    def equal(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words are equal from a and b on (or back from before them), most at most."""
        n = np.zeros(len(a), np.int64)
        for k in reversed(range(int(most.max(initial=0)).bit_length())):
            more = n + (1 << k)
            fits = np.flatnonzero(more <= most)
            x, y, m = a[fits], b[fits], more[fits]
            if back:
                x, y = x - m, y - m
            same = fits[self.hash(x, m) == self.hash(y, m)]
            n[same] = more[same]
        return n


def runs_in(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in order; document d has the words first[d] to first[d + 1] - 1."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    grams, salt = _Grams(h), mix(np.arange(len(size), dtype=np.uint64) + np.uint64(1))
    at, lag, found = np.arange(len(h)), 1, [np.zeros((0, 4), np.int64)]
    while len(at):
        n = WORDS - 1 if lag == 1 else (PERIODS - 1) * lag
        at = at[(at + n < first[doc[at] + 1]) | (at + n == first[doc[at] + 1])]
        key = grams.hash(at, n) ^ salt[doc[at]]
        order = np.argsort(key, kind="stable")
        here, key = at[order], key[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        a, b = here[same], here[same + 1]
        at = np.unique(np.concatenate([a, b]))
        served = (b - a >= lag) & (b - a < 2 * lag)
        found.append(_extended(grams, a[served], (b - a)[served], n, first, doc))
        lag *= 2
    runs = np.concatenate(found)
    runs = runs[(runs[:, 2] >= WORDS) & (runs[:, 2] >= PERIODS * runs[:, 3])]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)  # of equal stretches the smallest period counts
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[new]
    runs[:, 1] -= first[runs[:, 0]]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _extended(grams: _Grams, at: np.ndarray, lag: np.ndarray, n: int, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of the stretches on which seeds (n words at `at` and `at + lag`) lie."""
    order = np.lexsort((at, lag, doc[at]))
    at, lag = at[order], lag[order]
    own = doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + n)  # else covered: seeds of a lag cover n words each
    head = np.flatnonzero(new)
    own, lag, start = own[head], lag[head], at[head]
    end = at[np.append(head[1:], len(at)) - 1] + n if len(head) else start
    left = grams.equal(start, start + lag, start - first[own], back=True)
    right = grams.equal(end, end + lag, first[own + 1] - end - lag)
    return np.stack([own, start - left, end + right + lag - start + left, lag], 1)


def collapse_runs(docs: DataFrame, text: bool = True) -> DataFrame:
    """A row for each of docs (doc_id, text): its runs, the best of them, and the words that stay.

    doc_id, n_runs, start, length, period, exponent_milli (of the run with the greatest length / period; ties: smallest
    start, then period; nulls where there is none), runs_sha256, collapsed_sha256, and with text also runs (array of
    start, length, period, words counted from 0) and collapsed (the words that no run repeats, joined by blanks).

    A word goes if a run has it behind its first period. A null or blank text has no words. Rows that repeat an id, and
    ids that are null, are judged each for itself. Other columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if text else ""
    names = [c.split()[0] for c in schema.split(", ")][: 10 if text else 8]

    def find(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                runs = runs_in(words.hashes(), words.first)
                cuts = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1))
                out = []
                for d, value in enumerate(part.column("text").to_pylist()):
                    own = runs[cuts[d] : cuts[d + 1], 1:]
                    kept = (value or "").encode().split()
                    if len(own):
                        gone = np.zeros(len(kept) + 1, np.int64)
                        np.add.at(gone, own[:, 0] + own[:, 2], 1)
                        np.add.at(gone, own[:, 0] + own[:, 1], -1)
                        kept = [kept[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    own = own.tolist()
                    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=[None] * 3)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                    collapsed = b" ".join(kept)
                    row = [len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
                    out.append([*row, [{"start": s, "length": n, "period": q} for s, n, q in own], collapsed.decode()] if text else row)
                types = [*[pa.int64()] * 5, pa.string(), pa.string(), *([_RUN, pa.string()] if text else [])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, schema)
