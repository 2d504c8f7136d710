"""Bit tables of bounded size: which rows can't be in a set, whatever the set's size.

A table has about SPARSE bits a member, and 2**BITS (8 MB) at most. It never misses a member; what it lets through is
decided by a join, so results don't depend on how full it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .store import keep, small_batches, unused

#: Bits of a slot, and so of the largest table; bits a member; bits of a page.
BITS, SPARSE, PAGE = 26, 16, 1 << 15


def slot_of(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))


def _bits(members: DataFrame) -> int:
    return min(BITS, max(16, (SPARSE * members.count()).bit_length()))


def _pages(members: DataFrame, bits: int, page: str, held: str) -> DataFrame:
    """(page, bits of the page) of a column `slot` (0 to 2**BITS - 1)."""
    at = F.shiftright("slot", BITS - bits)
    return members.select(F.expr(f"cast({PAGE} as bigint)").alias("size"),
        at.alias("at")).groupBy(F.expr("cast(at div size as int)").alias(page)).agg(F.expr("bitmap_construct_agg(at % size)").alias(held))


def bit_table(members: DataFrame) -> np.ndarray:
    """The set of a column `slot` (0 to 2**BITS - 1). At most 2048 pages of 4 kB come to the driver."""
    bits = _bits(members)
    table = np.zeros(((1 << bits) // PAGE, PAGE // 8), np.uint8)
    for row in _pages(members, bits, "page", "bits").collect():
        table[row.page] = np.frombuffer(row.bits, np.uint8)
    return table.ravel()


def contains(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    slot = slot >> (BITS - (8 * len(table)).bit_length() + 1)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def split(docs: DataFrame, slot: Column, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in the set, rows that can't), with the columns of docs; members has the set's column `slot`.

    The pages of the table (2048 of 4 kB at most, so they are broadcast) are joined to the rows, so no row leaves the JVM.
    """
    small_batches(docs.sparkSession)
    at, page, held = (unused(docs.columns, c) for c in ("slot_at", "slot_page", "slot_bits"))
    bits = _bits(members)
    pages = keep(_pages(members, bits, page, held), "pages")
    marked = docs.withColumn(at, F.shiftright(slot, BITS - bits)).withColumn(page, F.expr(f"cast({at} div {PAGE} as int)")).join(F.broadcast(pages), page, "left")
    bit = F.expr(f"shiftright(cast(conv(hex(substring({held}, cast(({at} % {PAGE}) div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) % 2 = 1")
    inside = F.coalesce(bit, F.lit(False))
    same = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(inside).select(*same), marked.where(~inside).select(*same)


def without(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """docs less the rows whose column is in ids (which has that column); only rows that may be are shuffled."""
    ids = ids.where(F.col(column).isNotNull()).select(column)
    maybe, clear = split(docs, F.coalesce(slot_of(column), F.lit(0)), ids.select(slot_of(column).alias("slot")))
    return clear.unionByName(maybe.join(ids, column, "left_anti"))
