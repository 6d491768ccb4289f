"""Embedding near-duplicates by Euclidean p-stable hashing.

Each vector is normalised; in every table, ``k`` Gaussian projections plus an offset are
quantised to cells of width ``width``, and vectors that share all k cells share a bucket. Within buckets cosines
are computed exactly, in double precision. On the unit sphere, cosine >= c is distance <= sqrt(2 - 2c),
so the chance that one projection keeps such a pair together is known; k follows from the number of
vectors (a bucket holds few unrelated ones at any size), and the number of tables from
the wanted recall for a pair just at the threshold (closer pairs are found more surely).

Equal vectors are one node with a count, so copies meet no table. A bucket of more than ``hot`` nodes is
cut into blocks, and each pair of blocks is compared by itself, so no task gets the whole bucket.
Buckets give back sums and a spanning set of links per node, never pairs: a pair that meets in
several tables counts in the first only, which both rows' bucket numbers tell.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components have no links, as have
rows with a null id (their component is null, kept false); vectors of other lengths than one
another are compared as if padded with zeros; repeated rows are vectors of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_groups, written
from .components import connected_components, local_components

HOT = 2048


def same_cell(distance: float, width: float) -> float:
    """Chance that a Gaussian projection of two points at this distance falls in one cell (Datar et al. 2004)."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(n: int, cosine: float, recall: float, width: float) -> tuple[int, int]:
    """Projections per table and number of tables for ``n`` vectors."""
    far, near = same_cell(math.sqrt(2), width), same_cell(max(math.sqrt(2 - 2 * cosine), 1e-6), width)
    k = max(8, math.ceil(math.log(max(n, 4) / 4) / -math.log(far)))
    p = near ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < recall else 1)


def to_matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as doubles, one row per list, shorter ones padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), lengths.max(initial=0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _projection(table: int, dims: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and offsets of a table; the first rows do not depend on ``dims``, so padding changes no cell."""
    rng = np.random.default_rng([seed, table])
    shift = rng.random(k)
    return np.stack([np.random.default_rng([seed, table, d]).standard_normal(k) for d in range(dims)]) if dims else np.zeros((0, k)), shift


def buckets(x: np.ndarray, tables: int, k: int, width: float, seed: int) -> np.ndarray:
    """Bucket numbers (64-bit hashes of the k cells), one column per table."""
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        a, shift = _projection(t, x.shape[1], k, seed)
        cells = np.floor(x @ a / width + shift).astype(np.int64).astype(np.uint64)
        h = np.zeros(len(x), np.uint64)
        for j in range(k):
            h = (h ^ cells[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, t] = h.view(np.int64)
    return out


def compare(x: np.ndarray, side: np.ndarray, numbers: np.ndarray, table: int, cosine: float, step: int = 256) -> Iterator[tuple]:
    """Linked pairs of one bucket, in runs: row, column, and whether this table is the first where they meet.

    ``side`` is 0 for all if the bucket is whole or a block meets itself; else only rows of side 0 meet rows of side 1.
    """
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        once = i < j if right is left else np.ones(len(i), bool)
        i, j = i[once], j[once]
        first = ~(numbers[i, :table] == numbers[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
        yield i, j, first


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.98, width: float = 2.0, seed: int = 7, vec_id: str = "vec_id", vector: str = "embedding", hot: int = HOT) -> DataFrame:
    """One row per vector: ``(vec_id, n_links, component_id, kept)``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    nodes = rows.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "pstable-nodes")
    k, tables = plan_tables(nodes.count(), cosine, recall, width)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                numbers = buckets(units(to_matrix(part.column(2))), tables, k, width, seed)
                lists = pa.ListArray.from_arrays(np.arange(0, numbers.size + 1, tables, dtype=np.int32), numbers.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["node", "n", "v", "numbers"])

    kind = dict(nodes.dtypes)["v"]
    keyed = written(nodes.select("node", "n", "v").mapInArrow(hashed, f"node long, n long, v {kind}, numbers array<long>"), "pstable-keys")
    spots = keyed.select("node", F.posexplode("numbers").alias("tab", "bucket"))
    sizes = written(spots.groupBy("tab", "bucket").agg(F.count("*").alias("m")).filter("m > 1"), "pstable-sizes")
    # Vectors travel only to buckets where they are not alone.
    shared = spots.join(sizes, ["tab", "bucket"]).withColumn("blocks", F.ceil(F.col("m") / F.lit(hot)).cast("int"))
    shared = shared.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("a"), F.greatest(b, F.col("own")).alias("b")))
    dealt = shared.select("node", "tab", "bucket", "own", F.explode(meets).alias("e")).select("node", "tab", "bucket", "e.a", "e.b", F.when(F.col("own") == F.col("e.a"), 0).otherwise(1).alias("side"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["tab", "bucket", "a", "b"], 8192):
            yield linked_in(t)

    def linked_in(t: pa.Table) -> pa.RecordBatch:
        x = units(to_matrix(t.column("v").chunk(0)))
        numbers = np.stack(t.column("numbers").chunk(0).flatten().to_numpy().reshape(t.num_rows, -1))
        node, n, tab, side = (t.column(c).to_numpy() for c in ("node", "n", "tab", "side"))
        group = np.unique(np.column_stack([t.column(c).to_numpy().astype(np.int64) for c in ("tab", "bucket", "a", "b")]), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(group, kind="stable")
        names, name = np.unique(node, return_inverse=True)
        links, label = np.zeros(len(names), np.int64), np.arange(len(names))
        waiting, size, everyone = [], 0, np.arange(len(names))

        def join() -> np.ndarray:
            # Earlier links stand as links to their label, so the list of pairs stays short.
            u, v = (np.concatenate(c) for c in zip(*waiting, (everyone, label)))
            return local_components(u, v, len(names))

        for g in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(g) < 2:
                continue
            for i, j, first in compare(x[g], side[g], numbers[g], int(tab[g[0]]), cosine):
                if not len(i):
                    continue
                a, b = name[g[i]], name[g[j]]
                np.add.at(links, a[first], n[g[j]][first])
                np.add.at(links, b[first], n[g[i]][first])
                waiting.append((a, b))
                size += len(a)
                if size > 1 << 20:
                    label, waiting, size = join(), [], 0
        label = join()
        some = np.flatnonzero((links > 0) | (label != np.arange(len(names))))
        return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some]), pa.array(names[label[some]])], names=["node", "links", "low"])

    met = dealt.join(keyed, "node").repartition("tab", "bucket", "a", "b").sortWithinPartitions("tab", "bucket", "a", "b").mapInArrow(linked, "node long, links long, low long")
    met = written(met, "pstable-met")
    roots = connected_components(met.select(F.col("node").alias("u"), F.col("low").alias("v")), "pstable-cc")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    known = written(known.join(links, "node", "left"), "pstable-known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    full = nodes.join(known, "node").select(F.col("v").alias("w"), "n", "links", "component_id")
    out = rows.join(full, rows.v == full.w, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
