"""Plane patches of scans, the pose that two scans' patches agree on, and the adjustment of all scans' poses at once.

Patches are connected components of planar cells, found for all scans in one job; what is known of a patch is put together from
its cells' moments, so points are read once. A pose is searched among rotations that take pairs of normals to pairs at the same angle
(an equal-key join on the angle), each completed by the shifts that three independent planes allow. The adjustment adds up the
normal equations of all correspondences in tasks; a round sends one block for each pair of scans.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import neighbours as ne

MOMENTS = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
PATCH = ("cx", "cy", "cz", "nx", "ny", "nz", "n", "std", "width", "length")
#: Patches of two scans that a search for a pose holds in each task; more are refused.
MOST_PATCHES = 5000


def frames() -> Column:
    """Least direction and the three eigenvalues (least first) of the covariance in columns cxx .. czz."""

    @F.pandas_udf("struct<nx:double,ny:double,nz:double,e0:double,e1:double,e2:double>")
    def solve(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        e, v = np.linalg.eigh(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3))
        return pd.DataFrame(np.hstack([v[:, :, 0], np.maximum(e, 0.0)]), columns=["nx", "ny", "nz", "e0", "e1", "e2"])

    return solve(*MOMENTS)


def _dot(a: str, b: str) -> Column:
    return sum((F.col(a + c) * F.col(b + c) for c in "xyz"), F.lit(0.0))


def plane_patches(points: DataFrame, cell: float = 0.5, planarity: float = 0.015, least_cell: int = 16, angle: float = 10.0, least: int = 200, max_std: float = 0.03, min_size: float = 0.125, max_size: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., patch, cx, cy, cz, nx, ny, nz, n, std, width, length)``: flat patches of each scan in its own frame, with normals that face its origin.

    A cell is planar where the least eigenvalue is at most ``planarity`` of their sum. Cells that touch, whose normals differ by at most
    ``angle`` degrees and that lie in each other's plane to within a cell, are one patch. ``std`` is across the patch, ``width`` and ``length`` are the
    sides of a rectangle of its spread; ``max_size`` of 0 allows any length. A patch is named by its least cell.
    """
    k = ["vx", "vy", "vz"]
    cells = points.groupBy(*by, *(S.cell(F.col(c), cell).alias(f"v{c}") for c in "xyz")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *(F.covar_pop(m[1], m[2]).alias(m) for m in MOMENTS)).filter(F.col("n") >= least_cell)
    cells = cells.withColumn("f", frames()).select("*", "f.*").filter(F.col("e0") <= planarity * (F.col("e0") + F.col("e1") + F.col("e2"))).drop("f", "e0", "e1", "e2")
    cells = ne.cut_lineage(cells.withColumn("node", F.concat_ws(":", *by, *k)))
    # Each pair of touching cells once: towards the half of the 26 that lies ahead.
    ahead = [(i, j, h) for i in (-1, 0, 1) for j in (-1, 0, 1) for h in (-1, 0, 1) if (i, j, h) > (0, 0, 0)]
    spread = cells.select(*by, F.col("node").alias("u"), *(F.col(f"{p}{c}").alias(f"{p}1{c}") for p in "cn" for c in "xyz"), *k, F.explode(F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"o{c}") for c, d in zip("xyz", s))) for s in ahead))).alias("o"))
    spread = spread.select(*by, "u", *(f"{p}1{c}" for p in "cn" for c in "xyz"), *((F.col(f"v{c}") + F.col(f"o.o{c}")).alias(f"v{c}") for c in "xyz"))
    pairs = spread.join(cells.select(*by, F.col("node").alias("v"), *k, *(F.col(f"{p}{c}").alias(f"{p}2{c}") for p in "cn" for c in "xyz")), [*by, *k]).withColumns({f"d{c}": F.col(f"c2{c}") - F.col(f"c1{c}") for c in "xyz"})
    links = pairs.filter((F.abs(_dot("n1", "n2")) >= math.cos(math.radians(angle))) & (F.abs(_dot("n1", "d")) <= cell) & (F.abs(_dot("n2", "d")) <= cell)).select("u", "v")
    roots = ne.components(links)
    own = cells.join(roots, "node", "left").withColumn("patch", F.coalesce("root", "node"))
    mean = own.groupBy(*by, "patch").agg(F.sum("n").alias("total"), *((F.sum(F.col("n") * F.col(f"c{c}")) / F.sum("n")).alias(f"m{c}") for c in "xyz")).filter(F.col("total") >= least)
    whole = own.join(mean, [*by, "patch"]).groupBy(*by, "patch", "total", "mx", "my", "mz").agg(*((F.sum(F.col("n") * (F.col(m) + (F.col(f"c{m[1]}") - F.col(f"m{m[1]}")) * (F.col(f"c{m[2]}") - F.col(f"m{m[2]}")))) / F.sum("n")).alias(m) for m in MOMENTS))
    t = whole.withColumn("f", frames()).select(*by, "patch", "total", "mx", "my", "mz", "f.*")
    # Normals face the scanner, which stands at the origin of its frame.
    flip = F.when(_dot("n", "m") > 0, -1.0).otherwise(1.0)
    t = t.select(*by, "patch", *(F.col(f"m{c}").alias(f"c{c}") for c in "xyz"), *((flip * F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"), F.col("total").alias("n"), F.sqrt("e0").alias("std"), F.sqrt(12 * F.col("e1")).alias("width"), F.sqrt(12 * F.col("e2")).alias("length"))
    return t.filter((F.col("std") <= max_std) & (F.col("width") >= min_size) & ((F.col("length") <= max_size) | F.lit(max_size <= 0)))


# ---------------------------------------------------------------- the pose of one scan in another's frame


def _pairs(patches: DataFrame, step: float, tag: str) -> DataFrame:
    """Ordered pairs of patches whose normals differ by 20 to 160 degrees, with the cell of that angle. One row a scan's pair: patches are few."""
    one, two = (patches.select(F.col("patch").alias(f"{tag}{i}"), *(F.col(f"n{c}").alias(f"{tag}{i}{c}") for c in "xyz"), F.lit(0).alias("all")) for i in (1, 2))
    both = one.join(two, "all").filter(F.col(f"{tag}1") != F.col(f"{tag}2"))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(f"{tag}1", f"{tag}2")))))
    return both.drop("all").withColumn(f"{tag}_angle", angle).filter(F.col(f"{tag}_angle").between(20, 160)).withColumn("k", F.floor(F.col(f"{tag}_angle") / step))


def basis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Right-handed frames (rows x 3 x 3, columns are axes) from two directions: their sum, what is left of their difference, the normal of both."""
    x = a + b
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = np.cross(a, b)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return np.stack([x, np.cross(z, x), z], axis=2)


def rotations(source: DataFrame, target: DataFrame, angle: float, levelled: bool, seeds: int, most: int) -> DataFrame:
    """``(votes, r)``: rotations (row-major) that take pairs of the ``seeds`` largest source normals to pairs of target normals, by their votes.

    ``levelled``: turns about z only, to within the angle."""
    large = source.orderBy(F.desc("n"), "patch").limit(seeds)
    a, b = _pairs(large, angle, "a").filter("a1 < a2"), _pairs(target, angle, "b")
    b = b.withColumn("k", F.explode(F.array(*(F.col("k") + i for i in (-1, 0, 1)))))
    near = a.join(b, "k").filter(F.abs(F.col("a_angle") - F.col("b_angle")) <= angle)
    names = [f"{t}{i}{c}" for t in "ab" for i in (1, 2) for c in "xyz"]

    def solve(parts):
        for t in parts:
            v = t[names].to_numpy(float).reshape(-1, 4, 3)
            r = basis(v[:, 2], v[:, 3]) @ basis(v[:, 0], v[:, 1]).transpose(0, 2, 1) if len(v) else np.zeros((0, 3, 3))
            if levelled:
                r = r[r[:, 2, 2] >= math.cos(math.radians(angle))]
            # Rotations that differ by a few degrees have the same key, or one beside it.
            yield pd.DataFrame({"key": [",".join(map(str, k)) for k in np.round(r.reshape(-1, 9) / math.radians(angle)).astype(int).tolist()], "r": r.reshape(-1, 9).tolist()})

    votes = near.select(*names).mapInPandas(solve, "key string, r array<double>").groupBy("key").agg(F.count(F.lit(1)).alias("votes"), F.min("r").alias("r"))
    return votes.orderBy(F.desc("votes"), "key").limit(most).select("votes", "r")


def best_shift(r: np.ndarray, a: np.ndarray, b: np.ndarray, cos_tol: float, offset: float, reach: float, triples: int = 10) -> tuple[list, np.ndarray] | None:
    """For one rotation: the shift most planes agree on. ``a``, ``b``: rows of centre, normal, size; (pairs, shift)."""
    n, c = a[:, 3:6] @ r.T, a[:, :3] @ r.T
    fits = n @ b[:, 3:6].T >= cos_tol
    if not fits.any():
        return None
    order, picked = np.argsort(-a[:, 6], kind="stable"), []
    for i in order:
        for j in order[order != i]:
            for k in order[(order != i) & (order != j)]:
                if len(picked) < triples and i < j < k and fits[i].any() and fits[j].any() and fits[k].any() and abs(np.linalg.det(n[[i, j, k]])) >= 0.15:
                    picked.append((i, j, k))
    best = None
    for tri in picked:
        choice = np.stack(np.meshgrid(*(np.flatnonzero(fits[i]) for i in tri), indexing="ij"), -1).reshape(-1, 3)
        q = b[choice]
        # Each plane fixes the shift along its normal.
        wall = np.einsum("cik,cik->ci", q[:, :, 3:6], q[:, :, :3] - c[list(tri)][None])
        good = np.abs(np.linalg.det(q[:, :, 3:6])) >= 0.1
        for t in np.linalg.solve(q[good][:, :, 3:6], wall[good][:, :, None])[:, :, 0]:
            d = b[None, :, :3] - (c + t)[:, None]
            across = np.abs(np.einsum("ijk,jk->ij", d, b[:, 3:6]))
            cost = np.where(fits & (across <= offset) & (np.linalg.norm(d, axis=2) <= reach), across + 1e-3 * np.linalg.norm(d, axis=2), np.inf)
            mate = cost.argmin(1)
            pairs = [(i, int(m)) for i, m in enumerate(mate) if np.isfinite(cost[i, m]) and cost[:, m].argmin() == i]
            score = (len(pairs), -sum(cost[p] for p in pairs))
            if best is None or score > best[0]:
                best = (score, pairs, t)
    return None if best is None else (best[1], best[2])


def fitted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """4 x 4 transform that takes planes ``a`` (centre, normal, size) to planes ``b`` best: normals first, then offsets along them."""
    w = np.sqrt(np.minimum(a[:, 6], b[:, 6]))
    u, _, vt = np.linalg.svd((a[:, 3:6] * w[:, None]).T @ b[:, 3:6])
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    wall = np.einsum("ij,ij->i", b[:, 3:6], b[:, :3] - a[:, :3] @ r.T)
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, np.linalg.lstsq(b[:, 3:6] * w[:, None], wall * w, rcond=None)[0]
    return m


def plane_pose(source: DataFrame, target: DataFrame, angle: float = 10.0, offset: float = 0.2, reach: float = 5.0, levelled: bool = False, seeds: int = 12, most: int = 200, least: int = 3) -> dict | None:
    """The pose that takes ``source`` patches to ``target`` patches with most pairs: ``{matrix, pairs, rmse}``; None where fewer than ``least`` agree.

    ``reach`` bounds the distance of paired centres, ``offset`` that across the plane. Rotations come from the ``seeds`` largest
    patches, the ``most`` best voted are tried, each in a task of its own.
    """
    cols = ["cx", "cy", "cz", "nx", "ny", "nz", "n"]
    source, target = ne.cut_lineage(source.select("patch", *cols)), ne.cut_lineage(target.select("patch", *cols))
    if (n := source.count() + target.count()) > MOST_PATCHES:
        raise ValueError(f"{n} patches are more than {MOST_PATCHES}; ask for larger ones")
    a, b = (p.orderBy("patch").toPandas() for p in (source, target))
    if min(len(a), len(b)) < least:
        return None
    x, y, cos_tol = a[cols].to_numpy(float), b[cols].to_numpy(float), math.cos(math.radians(angle))

    def tried(parts):
        for t in parts:
            rows = []
            for r in t["r"]:
                got = best_shift(np.array(r, float).reshape(3, 3), x, y, cos_tol, offset, reach)
                if got and len(got[0]) >= least:
                    i, j = map(list, zip(*got[0]))
                    m = fitted(x[i], y[j])
                    gap = x[i][:, :3] @ m[:3, :3].T + m[:3, 3] - y[j][:, :3]
                    rmse = float(np.sqrt((np.einsum("ij,ij->i", y[j][:, 3:6], gap) ** 2).mean()))
                    # Walls at right angles fit in several ways; then centres decide.
                    rows.append((len(i), rmse, rmse + 0.01 * float(np.linalg.norm(gap, axis=1).mean()), m.ravel().tolist(), i, j))
            yield pd.DataFrame(rows, columns=["found", "rmse", "cost", "matrix", "i", "j"])

    spun = rotations(source, target, angle, levelled, seeds, most).repartition(source.sparkSession.sparkContext.defaultParallelism)
    best = spun.mapInPandas(tried, "found int, rmse double, cost double, matrix array<double>, i array<int>, j array<int>").orderBy(F.desc("found"), "cost", "matrix").first()
    if best is None:
        return None
    return {"matrix": list(best["matrix"]), "pairs": [(a["patch"][i], b["patch"][j]) for i, j in zip(best["i"], best["j"])], "rmse": best["rmse"]}


def paired(patches: DataFrame, angle: float = 10.0, offset: float = 0.2, reach: float = 5.0) -> DataFrame:
    """Pairs of patches of different scans in one frame that are each other's nearest across the plane: ``(a_scan, a_patch, b_scan, b_patch)``, a before b."""
    key = F.struct("scan", "patch")
    side = lambda n: patches.select(key.alias(n), *(F.col(f"c{c}").alias(c) for c in "xyz"), *(F.col(f"n{c}").alias(f"{n}{c}") for c in "xyz"))
    near = ne.radius_pairs(side("a"), side("b"), reach).filter(F.col("a.scan") < F.col("b.scan")).withColumns({f"d{c}": F.col(f"r{c}") - F.col(c) for c in "xyz"})
    across = F.greatest(F.abs(_dot("a", "d")), F.abs(_dot("b", "d")))
    near = near.filter(_dot("a", "b") >= math.cos(math.radians(angle))).withColumn("cost", across).filter(F.col("cost") <= offset)
    first = lambda side, other: F.row_number().over(Window.partitionBy(side, f"{other}.scan").orderBy("cost", "distance", side, other))
    return near.withColumns({"i": first("a", "b"), "j": first("b", "a")}).filter("i = 1 AND j = 1").select(*(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in ("scan", "patch")))


def posed(patches: DataFrame, poses: dict[str, list[float]]) -> DataFrame:
    """Patches of ``scan`` moved by their scan's pose."""
    m = patches.sparkSession.createDataFrame([(s, [float(x) for x in p]) for s, p in poses.items()], "scan string, m array<double>")
    t = patches.join(F.broadcast(m), "scan")  # one row a scan
    row = lambda p, i, w: sum((F.col("m")[4 * i + j] * F.col(f"{p}{c}") for j, c in enumerate("xyz")), w)
    moved = {f"{p}{c}": row(p, i, F.col("m")[4 * i + 3] if p == "c" else F.lit(0.0)) for p in "cn" for i, c in enumerate("xyz")}
    return t.withColumns(moved).select(*patches.columns)


def correspondences(pairs: DataFrame, patches: DataFrame) -> DataFrame:
    """Pairs of patches with both sides' centres and normals, as ``adjust_poses`` takes them."""
    side = lambda n: patches.select(F.col("scan").alias(f"{n}_scan"), F.col("patch").alias(f"{n}_patch"), *(F.col(f"c{c}").alias(f"{n}{c}") for c in "xyz"), *(F.col(f"n{c}").alias(f"{n}n{c}") for c in "xyz"), F.col("width").alias(f"{n}_width"))
    t = pairs.join(side("a"), ["a_scan", "a_patch"]).join(side("b"), ["b_scan", "b_patch"]).withColumn("size", F.least("a_width", "b_width"))
    return t.select(*(x.split()[0] for x in CORRESPONDENCE.split(", ")))


# ---------------------------------------------------------------- all poses at once

CORRESPONDENCE = "a_scan string, b_scan string, ax double, ay double, az double, bx double, by double, bz double, anx double, any double, anz double, bnx double, bny double, bnz double, size double"


def equations(t: pd.DataFrame, poses: dict[str, np.ndarray], middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x m x 12 derivatives by both scans' small turns and shifts, rows x m residuals): three of a point, two offsets and the turn of the normals of a plane."""
    pa, pb = (np.stack([poses[s] for s in t[c]]) for c in ("a_scan", "b_scan"))
    place = lambda p, c: np.einsum("nij,nj->ni", p[:, :3, :3], t[[c + k for k in "xyz"]].to_numpy(float)) + p[:, :3, 3] - middle
    face = lambda p, c: np.einsum("nij,nj->ni", p[:, :3, :3], t[[c + "n" + k for k in "xyz"]].fillna(0.0).to_numpy(float))
    a, b, na, nb = place(pa, "a"), place(pb, "b"), face(pa, "a"), face(pb, "b")
    flat = t["anx"].notna().to_numpy()
    n = len(t)

    def skew(v: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 3, 3))
        out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
        return out - out.transpose(0, 2, 1)

    eye = np.broadcast_to(np.eye(3), (n, 3, 3))
    move = np.concatenate((-skew(a), eye, skew(b), -eye), axis=2)
    gap = a - b
    rows, left = np.zeros((n, 6, 12)), np.zeros((n, 6))
    rows[~flat, :3], left[~flat, :3] = move[~flat], gap[~flat]
    # A plane tells only about what lies along its normals; half each, so that no side counts more.
    for i, face_ in enumerate((na, nb)):
        rows[flat, i] = np.einsum("nj,njk->nk", face_[flat], move[flat]) * math.sqrt(0.5)
        left[flat, i] = (face_ * gap).sum(1)[flat] * math.sqrt(0.5)
    lever = (t["size"].fillna(0.0).to_numpy(float) / math.sqrt(12))[:, None]
    turn = np.cross(na, nb)
    spin_a, spin_b = -skew(nb) @ -skew(na), skew(na) @ -skew(nb)
    rows[flat, 2:5, 0:3], rows[flat, 2:5, 6:9] = (lever[:, :, None] * spin_a)[flat], (lever[:, :, None] * spin_b)[flat]
    left[flat, 2:5] = (lever * turn)[flat]
    return rows, left


def adjust_poses(matches: DataFrame, poses: dict[str, list[float]], rounds: int = 1000, eps: float = 1e-6, damping: float = 1e-4, keep_level: bool = True) -> dict:
    """Poses of all scans that fit all correspondences best (Levenberg and Marquardt); the first scan stays.

    ``matches`` has the columns of ``CORRESPONDENCE``, each side in its scan's frame; normals are null for points. ``keep_level``: turns about z only.
    ``{poses, rmse, rounds}``.
    """
    names, matches = sorted(poses, key=list(poses).index), ne.cut_lineage(matches)
    now = {s: np.array(p, float).reshape(4, 4) for s, p in poses.items()}
    free = [2, 3, 4, 5] if keep_level else [0, 1, 2, 3, 4, 5]
    spots = {s: (i - 1) * len(free) for i, s in enumerate(names)}

    def total(at: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, int]:
        middle = np.mean([p[:3, 3] for p in at.values()], axis=0)

        def sums(parts):
            for t in parts:
                out = []
                for (p, q), g in t.groupby(["a_scan", "b_scan"]):
                    rows, left = equations(g, at, middle)
                    out.append((p, q, np.einsum("nmi,nmj->ij", rows, rows).ravel().tolist(), np.einsum("nmi,nm->i", rows, left).tolist(), float((left ** 2).sum()), int(len(g))))
                yield pd.DataFrame(out, columns=["a_scan", "b_scan", "h", "g", "e", "n"])

        many = matches.mapInPandas(sums, "a_scan string, b_scan string, h array<double>, g array<double>, e double, n long")
        added = many.groupBy("a_scan", "b_scan").agg(*(F.array(*(F.sum(F.col(c)[i]) for i in range(k))).alias(c) for c, k in (("h", 144), ("g", 12))), F.sum("e").alias("e"), F.sum("n").alias("n"))
        size = max(len(names) - 1, 0) * len(free)
        h, g, e, n = np.zeros((size, size)), np.zeros(size), 0.0, 0
        for row in added.collect():
            block, side = np.array(row["h"]).reshape(12, 12), np.array(row["g"])
            e, n = e + row["e"], n + row["n"]
            for i, s in enumerate((row["a_scan"], row["b_scan"])):
                if s == names[0]:
                    continue
                at_s, own = slice(spots[s], spots[s] + len(free)), [6 * i + f for f in free]
                g[at_s] += side[own]
                for j, r in enumerate((row["a_scan"], row["b_scan"])):
                    if r != names[0]:
                        h[at_s, spots[r]:spots[r] + len(free)] += block[np.ix_(own, [6 * j + f for f in free])]
        return h, g, e, n

    from .registration import turned

    h, g, e, n = total(now)
    done = 0
    for done in range(1, rounds + 1):
        if not n or not len(g):
            break
        step = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), -g, rcond=None)[0]
        middle, new = np.mean([p[:3, 3] for p in now.values()], axis=0), {names[0]: now[names[0]]}
        for s in names[1:]:
            d = np.zeros(6)
            d[free] = step[spots[s]:spots[s] + len(free)]
            m = np.eye(4)
            m[:3, :3] = turned(d[:3])
            m[:3, 3] = d[3:] + middle - m[:3, :3] @ middle
            new[s] = m @ now[s]
        h2, g2, e2, _ = total(new)
        if e2 < e:
            better = math.sqrt(e / n) - math.sqrt(e2 / n)
            now, h, g, e, damping = new, h2, g2, e2, damping / 10
            if better < eps:
                break
        else:
            damping *= 10
            if damping > 1e6 or np.abs(step).max() < 1e-12:
                break
    return {"poses": {s: m.ravel().tolist() for s, m in now.items()}, "rmse": math.sqrt(e / n) if n else 0.0, "rounds": done}
