"""Packing by minimum bin slack.

Each document is a run of token ids with an end id. It is cut into full pieces of `capacity` ids and one
remainder; full pieces are sequences as they are and stay where they are. Remainders alone are shuffled: they are
dealt evenly into groups of GROUP at most, about, whatever the documents' lengths.
In a group, each window starts with the longest remainder left; a subset-sum over the lengths left (a bitset
of reachable sums) finds the multiset that fills the rest best, and backtracking gives how many of each
length it takes. A found multiset is used as often as the counts allow.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import keep, small_batches
from .text import pieces

#: Remainders that are packed together; each group leaves about one window that is not full.
GROUP = 8_192
#: Sequences of one full piece have ids from here on.
FULL = 1 << 62
#: Distinct chunks of text whose ids a Python worker keeps.
CACHE = 200_000
_cut = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_double = re.compile(r"\s\s")
_coders: dict[tuple[str, str], Coder] = {}


class Coder:
    """Token ids of texts, as little-endian unsigned 32-bit values.

    Byte-level BPE never joins a character with a blank after it, so a text is cut there and each distinct
    chunk is encoded once. Chunks with characters beyond Latin go through the tokenizers library, others
    through the rank form of the same vocabulary, which gives the same ids in less time. A text that holds an added
    token of the vocabulary goes through the library whole.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if "\0" not in text and not _double.search(text):
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        else:
            chunks = _cut.split(text)
        known = self.known
        for chunk in set(chunks).difference(known):
            ids = self.fast(chunk) if chunk.isascii() or max(chunk) < "ɐ" else self.whole.encode(chunk, add_special_tokens=False).ids
            known[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join(map(known.__getitem__, chunks))
        if len(known) > CACHE:
            known.clear()
        return out


def coder(vocabulary: str, ranks: str) -> Coder:
    if (vocabulary, ranks) not in _coders:
        _coders[vocabulary, ranks] = Coder(vocabulary, ranks)
    return _coders[vocabulary, ranks]


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's full pieces and its remainder; ids is binary."""

    def cut(batches):
        encode = coder(vocabulary, ranks).encode
        tail, step = struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = defaultdict(list)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + tail
                    for at in range(0, len(ids), step):
                        rows["doc_id"].append(doc_id)
                        rows["start"].append(at // 4)
                        rows["ids"].append(ids[at : at + step])
                        rows["doc_tokens"].append(len(ids) // 4)
                if rows:
                    length = [len(x) // 4 for x in rows["ids"]]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rows["doc_id"], pa.int64()), "start": pa.array(rows["start"], pa.int64()),
                        "length": pa.array(length, pa.int64()), "doc_tokens": pa.array(rows["doc_tokens"], pa.int64()), "ids": pa.array(rows["ids"], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length (descending) to take so that their sum is as near to room as it can be, and not above."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, size = min(counts[length], room // length), 1
        while left:
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= reach << (length * size) & mask
            left -= size
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            total -= length * size
            taken[length] += size
    return taken


def fill_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with how many of each, how often) until no remainder is left."""
    out = []
    lengths = sorted(counts, reverse=True)
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        taken = best_fill(counts, lengths, capacity - seed)
        counts[seed] += 1
        taken[seed] += 1
        times = min(counts[length] // k for length, k in taken.items())
        for length, k in taken.items():
            counts[length] -= k * times
        lengths = [x for x in lengths if counts[x]]
        out.append((dict(taken), times))
    return out


def place(parts: DataFrame, capacity: int, groups: int) -> DataFrame:
    """parts, all shorter than capacity, with sequence_id and offset; it needs the columns doc_id, start and length, and keeps all others."""
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        column = lambda c: pa.chunked_array([b.column(c) for b in held])
        order = pc.sort_indices(pa.table({c: column(c) for c in ("length", "doc_id", "start")}), [(c, "ascending") for c in ("length", "doc_id", "start")]).to_pylist()
        length = column("length").to_pylist()
        rows = defaultdict(list)
        for i in order:
            rows[length[i]].append(i)
        sequence, offset, next_id = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), TaskContext.get().partitionId() << 40
        for taken, times in fill_windows({n: len(x) for n, x in rows.items()}, capacity):
            for _ in range(times):
                at = 0
                for n, k in taken.items():
                    for _ in range(k):
                        i = rows[n].pop()
                        sequence[i], offset[i] = next_id, at
                        at += n
                next_id += 1
        at = 0
        for b in held:
            end = at + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence[at:end]), pa.array(offset[at:end])], names=schema.fieldNames())
            at = end

    # dealt in turn, not by a key, so that repeated rows don't meet; Spark sorts first, so a lost task comes out the same
    return parts.repartition(groups).mapInArrow(pack, schema)


def pack(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of docs (doc_id integer, text string) placed in sequences of at most `capacity` ids.

    Columns: doc_id, start (ids of the document before the piece), length, doc_tokens (with the end id),
    ids (binary, little-endian unsigned 32-bit) or, without ids, ids_crc32; sequence_id, offset.

    A null or empty text is the end id alone. A null doc_id and repeated rows are documents like others.
    Text of any length is cut into as many pieces as it needs. Other columns are ignored. An empty table
    gives an empty result. An added token of the vocabulary in a text is that token, as the library reads it.
    vocabulary is a tokenizers file, ranks the same vocabulary as byte ranks.
    """
    small_batches(docs.sparkSession)
    parts = token_pieces(docs, vocabulary, ranks, capacity, end_id)
    if not with_ids:
        parts = parts.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    parts = keep(parts, "pieces")
    full, rest = parts.where(F.col("length") == capacity), parts.where(F.col("length") < capacity)
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(FULL)).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(place(rest, capacity, max(1, -(-rest.count() // GROUP))))
