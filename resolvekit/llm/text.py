"""Words and hashes of whole Arrow text columns, without a Python loop over words.

A word is a maximal run of bytes other than blank and 0x09-0x0D. Hashes have 64 bits: equal
words have equal hashes, and different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone, whole.
SLICE = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _pow or len(_pow["p"]) < n:
        m = max(n, SLICE + 1)
        for key, base in (("p", _P), ("q", _P_INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _pow[key] = np.multiply.accumulate(x)
    return _pow["p"][:n], _pow["q"][:n]


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each piece has about SLICE bytes of text at most."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + SLICE, "right")))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of a text column: start, end (in buf), doc (row) and hash of each."""

    def __init__(self, column: pa.Array, lower: bool = False):
        arr = pc.fill_null(column.cast(pa.large_binary()), b"")
        n = len(arr)
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
        data = arr.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off, self.n_docs = off - off[0], n
        if lower:
            self.buf = _LOWER[self.buf]
        ink = ~_BLANK[self.buf]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        cut = self.off[(self.off > 0) & (self.off < len(ink))]  # a word ends with its text
        first[cut] = ink[cut]
        last[cut - 1] = ink[cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # of each row, in words

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            p, q = powers(len(self.buf) + 1)
            total = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
            h = (total[self.end] - total[self.start]) * q[self.start]
            return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def ngrams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words that start at each word (over the whole buffer; see windows_in)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        p, q = powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * p[:-1], out=total[1:])
        return mix((total[n:] - total[:-n]) * q[: len(h) - n + 1] + np.uint64(n + 1000 * salt))


def windows_in(words: Words, n: int) -> np.ndarray:
    """Words at which n consecutive words of one text start."""
    k = len(words.doc) - n + 1
    return np.flatnonzero(words.doc[:k] == words.doc[n - 1 :]) if k > 0 else np.zeros(0, np.int64)
