"""Connected components: inside a task with NumPy, over a cluster by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Links that one task joins by itself (16 bytes each).
LOCAL_LINKS = 1_000_000


def local_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links u-v, the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def in_one_task(edges: DataFrame) -> DataFrame:
    """Components of few links, without rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.column_stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches if b.num_rows]
        if held:
            names, at = np.unique(np.concatenate(held), return_inverse=True)
            u, v = at.reshape(-1, 2).T
            root = local_components(u, v, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, tag: str = "cc", local: int | None = None) -> DataFrame:
    """``edges(u, v)``, u != v, in any direction and repeated or not -> ``(node, root)``, root the component's smallest node.

    Nodes without links have no row. Large-star and small-star rounds (Kiveris et al. 2014) keep
    the edge list no longer than it was; minima are taken with partial aggregation and joined back, so
    that a node with very many links is a skewed join that Spark splits, not a collected list. Each
    round is written to the shared folder and the one before deleted. At most ``local`` (``LOCAL_LINKS``) links
    are joined in one task; the result is the same.
    """
    local = LOCAL_LINKS if local is None else local
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), tag)
    state, n = None, edges.count()
    while True:
        if n <= local:
            return in_one_task(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        old, edges = edges, written(small, tag)
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            # A fixed point is a set of stars: every node points at its component's smallest.
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, n = now, now[0]
