"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

1. Each text becomes a set of hashed n-grams: a row of the incidence.
2. Rows that can link form blocks. The columns are dealt into m parts by hash. Two sets with Jaccard >= t
   differ in k columns at most, so a row with more than k parts that aren't empty has one that both share
   whole: equal parts are the keys on which rows meet. m and k come from the rows' size class; columns that
   very many texts have are left out of parts (a coarse count over all texts tells; it affects speed only).
   A row with k such parts or fewer also gives parts of all its columns: of two such rows that link, one part
   at least is in both. If even these are k or fewer, it gives its rarest n - ceil(t*n) + 1 columns as well.
3. A block's rows are a sparse matrix. Overlap counts are its product with its transpose, made in blocks of rows
   and columns; pairs below the bounds that their sizes set are discarded, as are pairs in one component already.

Blocks above PANEL rows go in chunks that share pivot rows; what isn't linked then meets all others of its block in
pairs of panels that the sizes allow. No task and no group grows with the input. The result is exact up to 64-bit
hash collisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.graph import components, forest, merged
from .filters import bit_table, contains, slot_of, without
from .store import keep, release, share, small_batches, unused
from .text import Words, mix, ngrams, pieces, windows_in

#: Rows of a block, or of a chunk of a larger block, that one task joins; rows that all chunks of a block get, about.
PANEL, PIVOTS = 2000, 128
#: Rows in blocks whose ids (some 60 bytes each) are broadcast at most.
FEW = 200_000
#: Rows and columns of a block of the product, and its sparse products; rows up to which a column is a sparse list.
ROWS, COLUMNS, PRODUCTS, FEW_ROWS = 128, 2048, 1 << 20, 48
#: The coarse column counts have between 2**16 and 2**24 cells, about 16 per text; a column is common if its
#: cell has COMMON times the mean count.
CELLS, COMMON = (16, 24), 2.5


def shingle_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, hashes, first): sorted distinct n-gram hashes of each row; all words as one where there are fewer than n."""
    for part in pieces(batch, "text"):
        words = Words(part.column("text"), lower=True)
        at = windows_in(words, n)
        h = words.hashes()
        grams, doc = (ngrams(h, n)[at], words.doc[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        short = np.flatnonzero((words.count > 0) & (words.count < n))
        if len(short):
            own = np.array([ngrams(h[words.first[d] : words.first[d + 1]], int(words.count[d]), salt=1)[0] for d in short], np.uint64)
            grams, doc = np.concatenate([grams, own]), np.concatenate([doc, short])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[new], doc[new]
        yield part, grams, np.searchsorted(doc, np.arange(part.num_rows + 1))


def _print(grams: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set: its identity."""
    with np.errstate(over="ignore"):
        return int(mix(grams + np.uint64(11)).sum(dtype=np.uint64).view(np.int64)), int(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


#: Cells of a row of column counts.
SEGMENT = 1 << 16
_ROWS = "doc_id long, n_shingles long, p1 long, p2 long, seg int, counts binary"


def describe_rows(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """A row (doc_id, n_shingles, p1, p2) for each text, and from each task rows (seg, counts) of how many n-grams fall into each of 2**bits cells."""

    def describe(batches):
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for part, grams, at in shingle_sets(batch, n):
                np.add.at(total, (grams >> np.uint64(64 - bits)).astype(np.int64), 1)
                prints = np.array([_print(grams[at[i] : at[i + 1]]) for i in range(part.num_rows)], np.int64).reshape(-1, 2)
                none = part.num_rows
                columns = [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "p1", "p2", "seg", "counts"])
        for k, x in enumerate(total.reshape(-1, SEGMENT)):
            if x.any():
                data = x.astype(np.uint16 if x.max() < 1 << 16 else np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["doc_id", "n_shingles", "p1", "p2", "seg", "counts"])

    return docs.mapInArrow(describe, _ROWS)


def column_counts(counts: DataFrame, bits: int) -> np.ndarray:
    """The sums of counts(seg, counts), in eighths of a power of two: at most 16 MB, whatever the input."""

    def add(key, pdf):
        total = np.zeros(SEGMENT, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.uint16 if len(x) == 2 * SEGMENT else np.int32)
        return pd.DataFrame({"seg": [key[0]], "sums": [np.round(8 * np.log2(total + 1)).clip(0, 255).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << bits, np.uint8).reshape(-1, SEGMENT)
    for row in counts.groupBy("seg").applyInPandas(add, "seg int, sums binary").collect():
        out[row.seg] = np.frombuffer(row.sums, np.uint8)
    return out.ravel()


class Windows:
    """Size classes of ratio 1/t, and for each the number of parts; window c has the classes c and c + 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.parts = num, den, {}
        self.step = math.log(den / num) if num < den else 1e-9

    def classes(self, size: np.ndarray) -> np.ndarray:
        return size if self.num == self.den else np.floor(np.log(np.maximum(size, 1)) / self.step + 1e-9).astype(np.int64)

    def m(self, c: int) -> int:
        """Parts enough that a row of class c or c + 1 that lacks a tenth of its columns still has more than k of them."""
        if c not in self.parts:
            edge = lambda c: c if self.num == self.den else math.exp(c * self.step)
            lo, mid, hi = math.floor(edge(c)), math.ceil(edge(c + 1)), math.ceil(edge(c + 2))
            rows = {(n, self.differ(n, True)) for n in (lo, mid)} | {(n, self.differ(n, False)) for n in (mid, hi)}
            m = max(k for _, k in rows) + 1
            while m < 4 * hi:
                x = {n: math.exp(-0.9 * n / m) for n, _ in rows}
                if all(m * (1 - x[n]) - 3 * math.sqrt(m * (x[n] - (1 + 0.9 * n / m) * x[n] * x[n])) > k for n, k in rows):
                    break
                m += 1 + m // 32
            self.parts[c] = m
        return self.parts[c]

    def differ(self, n: int, smaller: bool) -> int:
        """Columns in which a row of n and one that links with it differ at most, if it is the smaller or the larger of them."""
        return (self.den - self.num) * n // self.num if smaller else 2 * (self.den - self.num) * n // (self.den + self.num)

    def keys(self, grams: np.ndarray, count: np.ndarray, common: int) -> np.ndarray:
        """The keys of one row."""
        n, c = len(grams), int(self.classes(np.array([len(grams)]))[0])
        out, few = [], False
        with np.errstate(over="ignore"):
            for salt, columns in ((0, grams[count < common]), (1, grams)):
                few = False
                for w in range(c, max(c - 2, -1), -1):
                    part = mix(columns + np.uint64(w + 7)) % np.uint64(self.m(w))
                    order = np.argsort(part, kind="stable")
                    part, own = part[order], mix(columns[order])
                    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                    if len(at):
                        out.append(mix(np.add.reduceat(own, at) + mix(part[at] + np.uint64((w << 32) + (salt << 31)))))
                    few |= len(at) <= self.differ(n, w == c)  # the smaller of a pair is in class w
                if not few:
                    break
            if few:
                first = np.lexsort((grams, count))[: n - -(-self.num * n // self.den) + 1]
                out.append(mix(grams[first] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def join_block(node: np.ndarray, sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (as a forest) of the rows of a block: overlaps are the product of its incidence with its transpose.

    The product is made in blocks of ROWS rows and of columns: those that few rows have as sparse lists, the others
    as dense blocks of COLUMNS. Only pairs that the sizes allow are accumulated, and rows whose overlap can't reach
    the least any more are left out of the blocks to come. With side, only rows of side 1 meet rows of side 2. Rows
    of one label are known to be connected, so they don't meet.
    """
    size = np.array([len(s) for s in sets])
    order = np.lexsort((node, size))
    node, size, sets = node[order], size[order], [sets[i] for i in order]
    n = len(sets)
    head, of = np.unique(np.arange(n) if label is None else label[order], return_index=True, return_inverse=True)[1:]
    first = root = head[of]  # the first row of each label
    if side is None:
        left = right = np.arange(n)
    else:
        left, right = (np.flatnonzero(side[order] == k) for k in (1, 2))
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(n), size)
    shared = count[column] > 1
    column, row = column[shared], row[shared]
    number = np.full(len(count), -1)
    light, heavy = np.flatnonzero((count > 1) & (count <= FEW_ROWS)), np.flatnonzero(count > FEW_ROWS)
    number[light], number[heavy] = np.arange(len(light)), np.arange(len(heavy))
    dense = count[column] > FEW_ROWS
    thin_row, thin_col, thick_row, thick_col = row[~dense], number[column[~dense]], row[dense], number[column[dense]]
    by_col = np.argsort(thin_col, kind="stable")
    col_rows, col_first = thin_row[by_col], np.concatenate([[0], np.cumsum(count[light])])
    thin_first, thick_first = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]) for x in (thin_row, thick_row))
    thick_size = np.diff(thick_first)

    def block(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The rows by cols (a run of numbers) of the dense part."""
        out = np.zeros((len(rows), len(cols)), np.float32)
        length = thick_size[rows]
        at = np.repeat(thick_first[rows] - np.cumsum(length) + length, length) + np.arange(length.sum())
        c = thick_col[at] - cols[0]
        inside = (c >= 0) & (c < len(cols))
        out[np.repeat(np.arange(len(rows)), length)[inside], c[inside]] = 1
        return out

    work = np.concatenate([[0], np.cumsum(np.bincount(thin_row, count[light][thin_col], n)[left])])
    end = 0
    while end < len(left):
        begin, end = end, min(end + ROWS, max(end + 1, int(np.searchsorted(work, work[end] + PRODUCTS, "right")) - 1))
        x = left[begin:end]
        y = right[(size[right] * num <= size[x[-1]] * den) & (size[right] * den >= size[x[0]] * num)]
        if side is None:
            y = y[y > x[0]]
        if (root[x] == root[x[0]]).all():
            y = y[root[y] != root[x[0]]]
        if not len(y):
            continue
        least = -(-num * (size[x][:, None] + size[y][None, :]) // (num + den))  # overlap that the threshold asks for
        open_ = (least <= np.minimum(size[x][:, None], size[y][None, :])) & (root[x][:, None] != root[y][None, :])
        if side is None:
            open_ &= y[None, :] > x[:, None]
        place = np.full(n, -1)
        place[y] = np.arange(len(y))
        length = thin_first[x + 1] - thin_first[x]
        own = np.repeat(thin_first[x] - np.cumsum(length) + length, length) + np.arange(length.sum())
        c = thin_col[own]
        times = col_first[c + 1] - col_first[c]
        other = place[col_rows[np.repeat(col_first[c] - np.cumsum(times) + times, times) + np.arange(times.sum())]]
        pair = np.repeat(np.repeat(np.arange(len(x)), length), times) * len(y) + other
        overlap = np.bincount(pair[other >= 0], minlength=len(x) * len(y)).reshape(len(x), len(y))
        rest = np.minimum(thick_size[x][:, None], thick_size[y][None, :])
        for at in range(0, len(heavy), COLUMNS):
            open_ &= overlap + np.minimum(rest, len(heavy) - at) >= least
            rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(rows):
                break
            block_cols = np.arange(at, min(at + COLUMNS, len(heavy)))
            overlap[np.ix_(rows, cols)] += (block(x[rows], block_cols) @ block(y[cols], block_cols).T).astype(np.int64)
        i, j = np.nonzero(open_ & (overlap >= least))
        if len(i):
            root = merged(root, x[i], y[j])
    joined = np.flatnonzero((root != first) & (first == np.arange(n)))
    return list(zip(node[joined].tolist(), node[root[joined]].tolist(), strict=True))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id integer, text string).

    Two documents link when den * |intersection| >= num * |union| of their sets of distinct n-word shingles
    (A-Z lower-cased; all words as one shingle where there are fewer than n). component_id is the smallest
    doc_id reachable over links.

    Null and blank texts have an empty set and link with nothing. A null doc_id gives a null component and
    links nothing. Rows that repeat a doc_id are one node, so the texts under it link. Other columns are
    ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    bits = min(max(math.ceil(math.log2(docs.count() + 1)) + 4, CELLS[0]), CELLS[1])
    described = keep(describe_rows(docs, n, bits), "rows")
    rows = described.where("seg is null").drop("seg", "counts")
    sums = column_counts(described.where("seg is not null").select("seg", "counts"), bits)
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one row of the incidence: that of their smallest doc_id
    first = keep(full.groupBy("p1", "p2", "n_shingles").agg(F.min("doc_id").alias("node")), "first")
    blocks = keep(components(candidate_edges(docs, first, sums, bits, n, num, den)), "blocks")
    links = block_links(docs, first.join(blocks, "node").withColumnRenamed("root", "block"), n, num, den)
    # a doc_id with several texts links them
    same = full.join(first, ["p1", "p2", "n_shingles"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = full.groupBy("doc_id").agg(F.countDistinct("p1", "p2", "n_shingles").alias("k")).where("k > 1").select("doc_id")
    links = links.unionByName(same.join(repeated, same.a == repeated.doc_id, "left_semi"))
    roots = components(links)
    of = first.join(roots, "node", "left").select("p1", "p2", "n_shingles", F.coalesce("root", "node").alias("component"))
    out = rows.join(of, ["p1", "p2", "n_shingles"], "left")
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(known, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def candidate_edges(docs: DataFrame, first: DataFrame, sums: np.ndarray, bits: int, n: int, num: int, den: int) -> DataFrame:
    """(a, b) doc_ids that share a key, of those in first(node): enough edges for the blocks. sums are the column counts of 2**bits cells."""
    spark = docs.sparkSession
    n_rows = first.count()
    flags = share(spark, bit_table(first.select(slot_of("node").alias("slot"))))
    mean = float(np.bincount(sums, minlength=256) @ (np.exp2(np.arange(256) / 8) - 1)) / len(sums)
    common = int(min(255, 8 * math.log2(COMMON * (mean + 4) + 1)))
    counts, windows = share(spark, sums), Windows(num, den)
    buckets = max(8, n_rows // 4000)

    def edges_of(a, b, bucket):
        a, b = forest(a, b)
        return pa.RecordBatch.from_pydict({"bucket": pa.array([-1 - bucket], pa.int32()), "h": pa.array([a.tobytes()], pa.binary()),
            "node": pa.array([b.tobytes()], pa.binary())})

    def spread(batches):
        for batch in batches:
            batch = batch.filter(pa.array(contains(flags.value, batch.column("slot").to_numpy(zero_copy_only=False))))
            keys, nodes = [], []
            for part, grams, at in shingle_sets(batch, n):
                level = counts.value[(grams >> np.uint64(64 - bits)).astype(np.int64)]
                for i, node in enumerate(part.column("doc_id").to_pylist()):
                    if at[i + 1] > at[i]:
                        keys.append(windows.keys(grams[at[i] : at[i + 1]], level[at[i] : at[i + 1]], common))
                        nodes.append(node)
            if not keys:
                continue
            # rows of a batch that share a key are linked here; the first of them goes on
            h, node = np.concatenate(keys), np.repeat(np.array(nodes), [len(k) for k in keys])
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            new = np.append(True, h[1:] != h[:-1])
            head = node[new][np.cumsum(new) - 1]
            if (head != node).any():
                yield edges_of(node[head != node], head[head != node], int(h[0] % np.uint64(buckets)))
            h, node = h[new], node[new]
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            which, start = np.unique(bucket[order], return_index=True)
            cut = lambda x: [y.tobytes() for y in np.split(x[order], start[1:])]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(which, pa.int32()),
                "h": pa.array(cut((h >> np.uint64(32)).astype(np.uint32)), pa.binary()), "node": pa.array(cut(node), pa.binary())})

    def meet(key, table):
        join = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in table.column(c)), t)
        if key[0].as_py() < 0:
            a, b = join("h", np.int64), join("node", np.int64)
        else:
            h, node = join("h", np.uint32), join("node", np.int64)
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            new = np.append(True, h[1:] != h[:-1])
            head = node[new][np.cumsum(new) - 1]
            a, b = node[head != node], head[head != node]
        a, b = forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    docs = docs.where("doc_id is not null").withColumn("slot", slot_of("doc_id"))
    edges = keep(docs.mapInArrow(spread, "bucket int, h binary, node binary").groupBy("bucket").applyInArrow(meet, "a long, b long"), "edges")
    release(flags, counts)
    return edges


def block_links(docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within blocks; members has node, p1, p2, n_shingles and block.

    A block of up to PANEL rows is a task. A larger one is dealt into chunks of that size, and each chunk gets the
    same PIVOTS rows of the block besides: what links there is one component from then on. Only rows outside a
    block's largest component then meet all others, in pairs of panels by size class.
    """
    totals = members.groupBy("block").agg(F.count("*").alias("total")).where("total > 1")
    members = keep(members.join(totals, "block"), "members")
    # sets of the members alone: a bit table says which texts can be one, the joins decide
    flags = share(docs.sparkSession, bit_table(members.select(slot_of("node").alias("slot"))))

    def sets_of(batches):
        seen = set()  # repeated rows go on once a task
        for batch in batches:
            batch = batch.filter(pa.array(contains(flags.value, batch.column("slot").to_numpy(zero_copy_only=False))))
            for part, grams, first in shingle_sets(batch, n):
                out = {}
                for i, node in enumerate(part.column("doc_id").to_pylist()):
                    own = grams[first[i] : first[i + 1]]
                    key = (node, *_print(own))
                    if len(own) and key not in seen:
                        seen.add(key)
                        out[key] = own.tobytes()
                yield pa.RecordBatch.from_pydict({**{c: pa.array([k[i] for k in out], pa.int64()) for i, c in enumerate(("node", "p1", "p2"))},
                    "grams": pa.array(list(out.values()), pa.binary())})

    grams = docs.where("doc_id is not null").withColumn("slot", slot_of("doc_id")).mapInArrow(sets_of, "node long, p1 long, p2 long, grams binary")

    def with_sets(rows: DataFrame) -> DataFrame:
        """rows with their sets, which are the large side: with few rows the sets are not shuffled for it."""
        return grams.join(F.broadcast(rows) if rows.count() <= FEW else rows, ["node", "p1", "p2"])

    task = ["block", "l1", "i1", "l2", "i2"]
    schema = "a long, b long"

    def solve(batches):
        """Tasks come one after another in a partition; the rows of one are held at a time."""
        key, held, found = None, {}, []

        def done():
            if len(held) > 1:
                node, side, label = (np.array([r[k] for r in held.values()]) for k in range(3))
                found.extend(join_block(node, [np.frombuffer(r[3], np.uint64) for r in held.values()], num, den, side if side.any() else None, label))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in task]
            own = (batch.column(c).to_pylist() for c in ("node", "p1", "side", "label"))
            for *k, node, p1, side, label, grams in zip(*cols, *own, batch.column("grams"), strict=True):
                if k != key:
                    done()
                    key, held = k, {}
                if (node, p1) not in held:
                    held[node, p1] = node, side, label, grams.as_py()
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})
                found.clear()
        done()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    def solved(work: DataFrame) -> DataFrame:
        work = work.select("node", "p1", "grams", *(F.col(c).cast("int").alias(c) if c != "block" else c for c in task), F.col("side").cast("int").alias("side"), "label")
        return work.repartition(*task).sortWithinPartitions(*task).mapInArrow(solve, schema)

    zero = [F.lit(0).alias(c) for c in ("l2", "i2", "side")]
    small = with_sets(members.where(F.col("total") <= PANEL).select("node", "p1", "p2", "block"))
    links = keep(solved(small.select("node", "p1", "grams", "block", F.lit(0).alias("l1"), F.lit(0).alias("i1"), *zero, F.col("node").alias("label"))), "links")
    large = keep(members.where(F.col("total") > PANEL), "large")
    if large.isEmpty():
        release(flags)
        return links
    sets = keep(with_sets(large), "sets")
    release(flags)
    chunks, mine = F.ceil(F.col("total") / PANEL), F.xxhash64("node", "p1")
    pivot = F.pmod(F.xxhash64("node", "p2"), F.ceil(F.col("total") / PIVOTS)) == 0
    dealt = F.when(pivot, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(F.pmod(mine, chunks)))
    near = keep(solved(sets.select("node", "p1", "grams", "block", F.lit(0).alias("l1"), F.explode(dealt).alias("i1"), *zero, F.col("node").alias("label"))), "near")
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(den / num) + 1e-9).cast("int") if num < den else F.col("n_shingles").cast("int")
    known = large.join(components(near), "node", "left").select("node", "p1", "p2", "block", F.coalesce("root", "node").alias("label"), level.alias("level"))
    counts = known.groupBy("block", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("block").agg(F.max_by("label", F.struct("k", F.col("label"))).alias("main"))
    known = keep(known.join(main, "block").withColumn("rest", F.col("label") != F.col("main")).drop("main"), "known")
    links = links.unionByName(near)
    if known.where("rest").isEmpty():
        return links
    panels = known.groupBy("block", "level").agg(*(F.ceil(F.count_if(c) / (PANEL // 2)).cast("int").alias(k) for k,
        c in (("rest", F.col("rest")), ("main", ~F.col("rest")))))
    panels = panels.groupBy("block").agg(*(F.map_from_entries(F.collect_list(F.struct("level", k))).alias(f"{k}_panels") for k in ("rest",
        "main")))  # a block has as many levels as there are size classes
    known = known.join(panels, "block")
    of = lambda side, step: F.coalesce(F.col(f"{side}_panels")[F.col("level") + step], F.lit(0))
    own = F.pmod(mine, F.when(F.col("rest"), of("rest", 0)).otherwise(of("main", 0))).cast("int")
    pair = lambda l1, i1, l2, i2, side: F.struct(*(F.lit(v).cast("int").alias(c) for v,
        c in ((l1, "l1"), (i1, "i1"), (l2, "l2"), (i2, "i2"), (side, "side"))))
    each = lambda k, make: F.when(k > 0,
        F.transform(F.sequence(F.lit(0), k - 1), make)).otherwise(F.array().cast("array<struct<l1:int,i1:int,l2:int,i2:int,side:int>>"))
    at, i = F.col("level"), F.col("own")
    same = each(of("rest", 0), lambda j: pair(at, F.least(i, j), at, F.greatest(i, j), F.when(i == j, 0).when(i < j, 1).otherwise(2)))
    up, down = each(of("rest", 1), lambda j: pair(at, i, at + 1, j, 1)), each(of("rest", -1), lambda j: pair(at - 1, j, at, i, 2))
    # a main panel's index is negative
    to_main = [each(of("main", s), lambda j: pair(at, i, at + s, -1 - j, 1)) for s in (-1, 0, 1)]  # noqa: B023
    from_main = [each(of("rest", s), lambda j: pair(at + s, j, at, -1 - i, 2)) for s in (-1, 0, 1)]  # noqa: B023
    tasks = F.when(F.col("rest"), F.concat(same, up, down, *to_main)).otherwise(F.concat(*from_main))
    known = known.withColumn("own", own).select("node", "p1", "p2", "label", F.explode(tasks).alias("t"))
    work = sets.select("node", "p1", "p2", "block", "grams").join(known, ["node", "p1", "p2"])
    return links.unionByName(solved(work.select("node", "p1", "grams", "block", "label", "t.*")))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the smallest doc_id; all columns stay.

    Rows with equal doc_id and text are one document, and any one of them stays. Rows that share a doc_id but not the
    text are documents of their own. Rows without a doc_id or words all stay. An empty table gives an empty result.
    """
    name, text = unused(docs.columns, "near_id"), F.xxhash64(F.coalesce("text", F.lit("")))
    id_ = F.col("doc_id").cast("long")
    ids = docs.where("doc_id is not null").groupBy(id_.alias(name)).agg(F.min(text).alias("low"), F.max(text).alias("high"), F.count("*").alias("rows")).where("rows > 1")
    ids = keep(ids, "repeated-ids")
    several = ids.where("low <> high").select(name)
    if several.isEmpty():
        marked = docs.withColumn(name, id_)
    else:  # the texts of such an id get ids of their own
        marked = docs.join(several, docs["doc_id"] == several[name], "left").withColumn(name, F.when(F.col(name).isNotNull(), F.xxhash64("doc_id", text)).otherwise(id_))
        marked = keep(marked, "marked")
    groups = keep(ngram_jaccard_join(marked.select(F.col(name).alias("doc_id"), "text"), n, num, den), "groups")
    out = without(marked, groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name)), name)
    if not ids.isEmpty():
        again = groups.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name)
        out = out.join(again, name, "left_anti").unionByName(out.join(again, name, "left_semi").dropDuplicates([name]))
    return out.select(*(f"`{c}`" for c in docs.columns))
