"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .numbering import shared_folder

#: Edges that a task holds before it reduces them to a forest.
HELD = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with an edge per node at most: each node and the smallest one it reaches here."""
    nodes, x = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = merged(np.arange(len(nodes)), x[: len(a)], x[len(a) :])
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the places a and b; a label is the smallest place of its component."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return new
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node that it reaches.

    Loops and repeated edges are harmless; rows with a null end are left out. Each task first reduces its edges to a
    forest. Rounds grow with the logarithm of the longest path and end when every tree is a star. A hub's edges are
    aggregated before their shuffle; the joins back are plain equi-joins, which adaptive execution splits where a hub
    is hot.
    """
    shared_folder(edges.sparkSession)

    def reduce(batches):
        a, b, size = [], [], 0
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            size += batch.num_rows
            if size > HELD:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, size = [x], [y], 0
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    e = edges.where("a <> b").selectExpr("cast(a as bigint) as a", "cast(b as bigint) as b").mapInArrow(reduce, "a long, b long").distinct().checkpoint()
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b")))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = e.unionByName(small.select("a", F.col("m").alias("b"))).distinct().checkpoint()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether no node has two edges down, or one down and one up."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("node"),
        F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()
