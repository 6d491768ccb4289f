"""Global registration by point features: 33-bin histograms of how normals lie to one another (after Rusu et al. 2009), nearest features by hashing, RANSAC over the pairs.

Histograms are counted in blocks with a halo, neighbours' histograms are added in a second pass. Only points whose histogram is far from the usual one go on: on flat ground all are alike. Features are matched
in the buckets of several p-stable hashes, and each keeps its nearest. Trials of RANSAC are rows, dealt over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import neighbours as ne
from . import points as po

#: Bins of each of the three angles.
BINS = 11
#: Pairs of features that a task of RANSAC holds; of more, those with the least hashes are taken.
MOST_PAIRS = 5000


def _dot(a: str, b: str) -> Column:
    return sum((F.col(a + c) * F.col(b + c) for c in "xyz"), F.lit(0.0))


def oriented(points: DataFrame, radius: float, least: int = 6) -> DataFrame:
    """``(a, x, y, z, nx, ny, nz)``: normals of the neighbourhoods, upward where they are steep, else away from the neighbours' mean; both turn with the cloud about z."""
    own = points.select(F.col("id").alias("a"), "x", "y", "z")

    @F.pandas_udf("array<double>")
    def normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        return pd.Series(list(np.linalg.eigh(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3))[1][:, :, 0]))

    t = bl.moments_within(own, own, radius).filter(F.col("n") >= least).select("a", "x", "y", "z", *((F.col(c) - F.col(f"m{c}")).alias(f"o{c}") for c in "xyz"), normal("cxx", "cxy", "cxz", "cyy", "cyz", "czz").alias("v"))
    t = t.select("*", *(F.col("v")[i].alias(f"n{c}") for i, c in enumerate("xyz")))
    sign = F.when(F.abs("nz") > 0.5, F.col("nz")).otherwise(_dot("n", "o")) < 0
    return t.select("a", "x", "y", "z", *(F.when(sign, -F.col(f"n{c}")).otherwise(F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"))


def pair_bins(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The three bins of pairs of points: the way d from the first to the second (of length 1), their normals n and m."""
    v = np.cross(d, n)
    w = np.cross(n, v)
    angles = (v * m).sum(1), (n * d).sum(1), np.arctan2((w * m).sum(1), (n * m).sum(1)) / np.pi
    return np.stack([k * BINS + np.clip((x + 1) / 2 * BINS, 0, BINS - 1).astype(int) for k, x in enumerate(angles)], axis=1)


def histograms(points: DataFrame, radius: float) -> DataFrame:
    """``points(a, x, y, z, nx, ny, nz)`` with ``f``: 33 shares, half from a point's own pairs, half from those of its neighbours, by nearness."""
    place, size = ["x", "y", "z"], 3 * BINS
    normal = ["nx", "ny", "nz"]

    def own(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        p, q, n, m, at = bl.places(l, "xyz"), bl.places(r, "xyz"), bl.places(l.select(normal).rename_columns(place), "xyz"), bl.places(r.select(normal).rename_columns(place), "xyz"), 0
        for i, j, d2 in bl.close_pairs(p, q, radius):
            apart = d2 > 0
            i, j, far = i[apart], j[apart], np.sqrt(d2[apart])
            to = int(i[-1]) + 1 if len(i) else at
            if to == at:
                continue
            k = pair_bins((q[j] - p[i]) / far[:, None], n[i], m[j])
            h = np.bincount(((i - at)[:, None] * size + k).ravel(), minlength=(to - at) * size).reshape(-1, size)
            many = h[:, :BINS].sum(1)
            some = np.flatnonzero(many)
            yield bl._with(l.slice(at, to - at).take(some).select(["a", *place]), {"h": pa.array((h[some] / many[some, None]).tolist())})
            at = to

    def added(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        p, q, at = bl.places(l, "xyz"), bl.places(r, "xyz"), 0
        mine, h = (np.array(t.column("h").to_pylist()).reshape(-1, size) for t in (l, r))
        for i, j, d2 in bl.close_pairs(p, q, radius):
            apart = d2 > 0
            i, j, w = i[apart], j[apart], 1 / np.sqrt(d2[apart])
            to = int(i[-1]) + 1 if len(i) else at
            if to == at:
                continue
            # Near neighbours count more; the weights add up to one.
            total = np.bincount(i - at, w, to - at)
            near = np.stack([np.bincount(i - at, w * h[j, k], to - at) for k in range(size)], axis=1)
            some = np.flatnonzero(total)
            yield bl._with(l.slice(at, to - at).take(some).select(["a", *place]), {"f": pa.array(((mine[at:to] + near / np.maximum(total, 1e-300)[:, None])[some] / 2).tolist())})
            at = to

    kind = dict(points.dtypes)["a"]
    coords = f"a {kind}, x double, y double, z double"
    first = ne.cut_lineage(bl.searched(points.select("a", *place, *normal), points.select(*place, *normal), radius, "xyz", own, f"{coords}, h array<double>"))
    return bl.searched(first, first.select(*place, "h"), radius, "xyz", added, f"{coords}, f array<double>")


def distinct_features(features: DataFrame, beyond: float = 0.5) -> DataFrame:
    """Points whose histogram's distance from the mean one is over the mean of such distances plus ``beyond`` deviations."""
    mean = features.agg(F.array(*(F.avg(F.col("f")[i]) for i in range(3 * BINS))).alias("mean"))
    d = F.aggregate(F.zip_with("f", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    far = ne.cut_lineage(features.crossJoin(F.broadcast(mean)).select("a", "x", "y", "z", "f", F.sqrt(d).alias("odd")))  # one row
    limit = far.agg((F.avg("odd") + beyond * F.stddev_pop("odd")).alias("limit"))
    return far.crossJoin(F.broadcast(limit)).filter("odd >= limit").drop("odd", "limit")  # one row


def hashed(features: DataFrame, width: float, tables: int, lines: int) -> DataFrame:
    """One row a table: ``cell`` of ``lines`` random projections of the histogram."""
    w = np.random.default_rng(11).normal(size=(tables, lines, 3 * BINS))
    shift = np.random.default_rng(12).random((tables, lines)) * width

    @F.pandas_udf("array<string>")
    def cells(f: pd.Series) -> pd.Series:
        if not len(f):
            return pd.Series([], dtype=object)
        got = np.floor((np.einsum("tlk,nk->ntl", w, np.stack(f)) + shift) / width).astype(int)
        return pd.Series([[f"{t}:" + ",".join(map(str, row)) for t, row in enumerate(one)] for one in got.tolist()])

    return features.select("a", "x", "y", "z", "f", F.explode(cells("f")).alias("cell"))


def matched(source: DataFrame, target: DataFrame, width: float = 0.15, tables: int = 8, lines: int = 4) -> DataFrame:
    """Each source feature with its nearest of those it shares a bucket with: ``(a, x, y, z, b, rx, ry, rz, apart)``. Buckets are compared in tasks, by products of matrices."""
    rows = hashed(source, width, tables, lines).withColumn("is_target", F.lit(False)).unionByName(hashed(target, width, tables, lines).withColumn("is_target", F.lit(True)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bl._blocks(batches, ["cell"]):
            n = table.num_rows - int(np.count_nonzero(table.column("is_target").to_numpy()))
            if not n or n == table.num_rows:
                continue
            f = np.array(table.column("f").to_pylist())
            t = f[n:]
            for at in range(0, n, 1000):
                s = f[at:min(at + 1000, n)]
                d = np.maximum((s ** 2).sum(1)[:, None] + (t ** 2).sum(1)[None] - 2 * s @ t.T, 0.0)
                best = d.argmin(1)
                one, two = table.slice(at, len(s)), table.take(pa.array(n + best))
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (*(one.column(k) for k in ("a", "x", "y", "z")), *(two.column(k) for k in ("a", "x", "y", "z")))), pa.array(np.sqrt(d[np.arange(len(s)), best]))], names=["a", "x", "y", "z", "b", "rx", "ry", "rz", "apart"])

    kind = dict(source.dtypes)["a"]
    found = rows.repartition("cell").sortWithinPartitions("cell", "is_target", "a").mapInArrow(nearest, f"a {kind}, x double, y double, z double, b {kind}, rx double, ry double, rz double, apart double")
    best = found.groupBy("a").agg(F.min(F.struct("apart", "b", "x", "y", "z", "rx", "ry", "rz")).alias("m"))
    return best.select("a", "m.x", "m.y", "m.z", "m.b", "m.rx", "m.ry", "m.rz", "m.apart")


def rigid_many(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts that take each set of points (sets x k x 3) to its mates best."""
    cp, cq = p.mean(1, keepdims=True), q.mean(1, keepdims=True)
    u, _, vt = np.linalg.svd(np.einsum("nki,nkj->nij", p - cp, q - cq))
    flip = np.ones((len(p), 3))
    flip[:, 2] = np.sign(np.linalg.det(np.einsum("nji,nkj->nik", vt, u)))
    r = np.einsum("nji,nj,nkj->nik", vt, flip, u)
    return r, cq[:, 0] - np.einsum("nij,nj->ni", r, cp[:, 0])


def ransac(pairs: DataFrame, reach: float, trials: int = 50_000, alike: float = 0.9, spread: float | None = None, seed: int = 5) -> dict | None:
    """The rigid transform most pairs agree with to ``reach``: ``{matrix, inliers, pairs}``; None for fewer than three pairs.

    A trial's three pairs must have sides of like length (``alike``) that are at least ``spread`` long.
    """
    held = pairs.select("a", "b", "x", "y", "z", "rx", "ry", "rz").orderBy(F.xxhash64("a", "b"), "a", "b").limit(MOST_PAIRS).toPandas()
    if len(held) < 3:
        return None
    p, q = held[["x", "y", "z"]].to_numpy(float), held[["rx", "ry", "rz"]].to_numpy(float)
    middle = p.mean(0), q.mean(0)
    p, q = p - middle[0], q - middle[1]
    least = spread if spread is not None else 4 * reach

    def tried(parts):
        for t in parts:
            best = (0, None)
            for n, count in zip(t["id"], t["n"]):
                rng = np.random.default_rng([seed, int(n)])
                tri = rng.integers(0, len(p), (int(count), 3))
                a, b = (np.stack([np.linalg.norm(v[tri[:, i]] - v[tri[:, (i + 1) % 3]], axis=1) for i in range(3)], axis=1) for v in (p, q))
                good = (np.minimum(a, b) >= least).all(1) & (np.minimum(a, b) >= alike * np.maximum(a, b)).all(1)
                if not good.any():
                    continue
                r, s = rigid_many(p[tri[good]], q[tri[good]])
                for at in range(0, len(r), 64):
                    gap = np.einsum("nij,kj->nki", r[at:at + 64], p) + s[at:at + 64, None] - q[None]
                    on = ((gap ** 2).sum(2) <= reach * reach).sum(1)
                    k = int(on.argmax())
                    if on[k] > best[0]:
                        best = (int(on[k]), [*r[at + k].ravel().tolist(), *s[at + k].tolist()])
            yield pd.DataFrame([best] if best[1] else [], columns=["found", "m"])

    spark = pairs.sparkSession
    parts = spark.sparkContext.defaultParallelism
    rows = spark.range(0, -(-trials // 1000), 1, parts).select("id", F.least(F.lit(1000), trials - F.col("id") * 1000).alias("n"))
    best = rows.mapInPandas(tried, "found int, m array<double>").orderBy(F.desc("found"), "m").first()
    if best is None:
        return None
    r, s = np.array(best["m"][:9]).reshape(1, 3, 3), np.array(best["m"][9:])[None]
    on = np.zeros(len(p), bool)
    for _ in range(10):
        now = ((p @ r[0].T + s[0] - q) ** 2).sum(1) <= reach * reach
        if now.sum() < 3 or (now == on).all():
            break
        on = now
        r, s = rigid_many(p[None, on], q[None, on])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r[0], s[0] + middle[1] - r[0] @ middle[0]
    return {"matrix": m.ravel().tolist(), "inliers": int(on.sum()), "pairs": len(p)}


def feature_start(moving: DataFrame, reference: DataFrame, voxel: float = 0.3, trials: int = 50_000) -> dict | None:
    """A transform that takes ``moving`` near ``reference``, whatever its place and turn about z; clouds are thinned by voxel first."""

    def described(cloud: DataFrame) -> DataFrame:
        thin = ne.cut_lineage(po.decimate(cloud, voxel).select(F.xxhash64("vx", "vy", "vz").alias("id"), "x", "y", "z"))
        return distinct_features(histograms(ne.cut_lineage(oriented(thin, 2.5 * voxel)), 5 * voxel))

    one, two = (ne.cut_lineage(described(c)) for c in (moving, reference))
    # Pairs that choose each other lead; a few may be right only one way, so both ways are in.
    there, back = matched(one, two), matched(two, one)
    back = back.select(F.col("b").alias("a"), F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rz").alias("z"), F.col("a").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), "apart")
    pairs = there.unionByName(back)
    mutual = ne.cut_lineage(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("x", "y", "z", "rx", "ry", "rz"))))
    chosen = mutual.filter("n = 2")
    return ransac(chosen if chosen.count() >= 50 else mutual, 1.5 * voxel, trials)


def overlap(moving: DataFrame, reference: DataFrame, matrix: list[float], voxel: float, reach: float) -> float:
    """Share of the thinned, moved cloud's points with a reference point within reach."""
    thin = lambda d, n: po.decimate(d, voxel).select(F.xxhash64("vx", "vy", "vz").alias(n), "x", "y", "z")
    a, b = ne.cut_lineage(po.transform(thin(moving, "a"), matrix)), thin(reference, "b")
    near = ne.radius_pairs(a, b, reach).select("a").distinct().count()
    return near / max(a.count(), 1)
