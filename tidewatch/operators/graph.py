"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import cut, drop

#: Edges that one task takes to their components by itself, in about 200 MB; edges that a task gathers for a forest.
LOCAL, GATHER = 2_000_000, 500_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (further := label[label] != label).any():
            label[further] = label[label[further]]


def forest(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges, the smaller node first, that join the same nodes as those given; fewer than there are nodes."""
    held, n, most = [], 0, GATHER
    for p in chain(parts, [None]):
        if p is not None:
            held.append(p)
            n += len(p[0])
        if held and (p is None or n >= most):
            node, root = least_labels(*map(np.concatenate, zip(*held)))
            apart = node != root
            held = [(root[apart], node[apart])]
            n = len(held[0][0])
            most = max(GATHER, 2 * n)
    yield from held


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = least_labels(*map(np.concatenate, zip(*parts)))
        for k in range(0, len(node), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 500_000]), pa.array(root[k : k + 500_000])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge with the least node of its component.

    A table of whole numbers of at most ``LOCAL`` edges is solved by one task, so that small tables don't cost the
    driver the plans and jobs of every round.  Others alternate large-star and small-star steps until nothing
    changes: the edge table never grows beyond its
    number of edges, and no node's neighbours are gathered into one row.  Each round is written to the shared
    folder, the one before it deleted.  Self-loops and nulls are left out, so a node without another neighbour
    doesn't appear; an empty table gives an empty table.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())

    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(now)
    if 0 < before[0] <= LOCAL and {t for _, t in now.dtypes} <= {"int", "bigint"}:
        kind = "bigint" if "bigint" in dict(now.dtypes).values() else "int"
        both = now.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v")).coalesce(1)
        solved = cut(both.mapInArrow(_solve, f"node {kind}, root {kind}"))
        drop(now)
        return solved
    while before[0]:
        # large-star: every larger neighbour of u is linked to the least of u and its neighbours
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(small.filter("u <> v").distinct())
        drop(now)
        now, last, before = after, before, mark(after)
        if before == last:
            break
    stars = now.groupBy("u").agg(F.min("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root")
    return stars.select(F.col("u").alias("node"), "root").unionAll(roots).distinct()
