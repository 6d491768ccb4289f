"""Rigid registration: Kabsch from ties, iterative registration with distributed normal equations, votes for shifts and turns, targets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import neighbours as ne
from . import points as po


def _sums(pairs: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Count, both means, and the 3 x 3 cross-covariance of pairs (x.. -> rx..); numbers only reach the driver."""
    aggs = [F.count("*")] + [F.avg(c) for c in ("x", "y", "z", "rx", "ry", "rz")] + [F.covar_pop(a, b) for a in ("x", "y", "z") for b in ("rx", "ry", "rz")]
    r = pairs.agg(*aggs).first()
    return r[0], np.array(r[1:4], float), np.array(r[4:7], float), np.array(r[7:16], float).reshape(3, 3)


def kabsch(pairs: DataFrame) -> list[float]:
    """4 x 4 row-major transform that takes (x, y, z) to (rx, ry, rz) best; at least three ties."""
    n, a, b, h = _sums(pairs)
    if n < 3:
        raise ValueError("at least three ties are needed")
    u, _, vt = np.linalg.svd(h)
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ d @ u.T
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, b - r @ a
    return m.ravel().tolist()


#: Parameters that stay free: rotations about x, y, z, then shifts.
FREE = {"full": [1, 1, 1, 1, 1, 1], "levelled": [0, 0, 1, 1, 1, 1], "translation": [0, 0, 0, 1, 1, 1]}
METHODS = ("symmetric", "pointToPlane", "pointToPoint", "gicp")


def normals(cloud: DataFrame, name: str, k: int) -> DataFrame:
    """``cloud(name, x, y, z)`` with ``n``: the direction of least spread of each point's k nearest, itself among them."""
    from pyspark.sql.functions import pandas_udf

    near = ne.k_nearest(cloud.select(F.col(name).alias("a"), "x", "y", "z"), cloud.select(F.col(name).alias("b"), "x", "y", "z"), k)

    @pandas_udf("array<double>")
    def least(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        return pd.Series(list(np.linalg.eigh(m)[1][:, :, 0]))

    n = ne.covariance(near).select(F.col("a").alias(name), least("cxx", "cxy", "cxz", "cyy", "cyz", "czz").alias("n"))
    return ne.cut_lineage(cloud.join(n, name))


def pair_equations(p: np.ndarray, q: np.ndarray, np_: np.ndarray, nq: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the linearised problem, pairs x m x 6; residuals, pairs x m) for a small turn and shift of p."""
    eye = np.broadcast_to(np.eye(3), (len(p), 3, 3))
    # The derivative of a turned point by the turn: minus its cross-product matrix.
    turn = np.zeros((len(p), 3, 3))
    turn[:, 0, 1], turn[:, 0, 2], turn[:, 1, 2] = p[:, 2], -p[:, 1], p[:, 0]
    turn -= turn.transpose(0, 2, 1)
    full, gap = np.concatenate((turn, eye), axis=2), q - p
    if method == "pointToPoint":
        return full, gap
    if method == "gicp":
        # Plane to plane: both points may slide on their planes; the whitening of the summed covariances.
        cov = sum(eye - (1 - 1e-3) * n[:, :, None] * n[:, None, :] for n in (np_, nq))
        w, v = np.linalg.eigh(cov)
        white = (v / np.sqrt(w)[:, None, :]).transpose(0, 2, 1)
        return white @ full, (white @ gap[:, :, None])[:, :, 0]
    if method == "symmetric":
        # The sum of both normals, pointing one way.
        n = nq + np.sign((np_ * nq).sum(1, keepdims=True) + 1e-300) * np_
        n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
    else:
        n = nq
    return (n[:, None, :] @ full), (n * gap).sum(1, keepdims=True)


#: Numbers that a set of pairs adds to: the normal matrix, its right side, the squared error, the weight, pairs within the robust bound.
SUMS = [f"s{i}" for i in range(45)]


def pair_sums(near: DataFrame, turn: np.ndarray, middle: np.ndarray, method: str, kernel: str, c: float, block: float | None = None) -> DataFrame:
    """Normal equations of nearest pairs, added up by task, or by square ``block`` of the reference (columns ``bx``, ``by``)."""

    def sums(parts):
        for t in parts:
            p, q = t[["x", "y", "z"]].to_numpy(float) - middle, t[["rx", "ry", "rz"]].to_numpy(float) - middle
            rows, gap = pair_equations(p, q, np.stack(t["n"]) @ turn.T, np.stack(t["m"]), method) if len(t) else (np.zeros((0, 1, 6)), np.zeros((0, 1)))
            # Robust weights by what the method makes small, not by distances that a sliding point may have.
            d = np.linalg.norm(gap, axis=1)
            w = {"welsch": lambda: np.exp(-((d / c) ** 2)), "tukey": lambda: np.where(d < 2 * c, (1 - (d / (2 * c)) ** 2) ** 2, 0.0), "huber": lambda: np.minimum(1.0, c / np.maximum(d, 1e-12)), "none": lambda: np.ones(len(d))}[kernel]()
            each = np.hstack([np.einsum("i,imj,imk->ijk", w, rows, rows).reshape(len(t), 36), np.einsum("i,imj,im->ij", w, rows, gap), np.stack([w * (gap ** 2).sum(1), w, (d <= c).astype(float)], axis=1)])
            if block is None:
                yield pd.DataFrame([each.sum(0)], columns=SUMS)
            elif len(t):
                spots, own = np.unique(np.floor(t[["rx", "ry"]].to_numpy(float) / block).astype(np.int64), axis=0, return_inverse=True)
                added = np.stack([np.bincount(own.ravel(), v, len(spots)) for v in each.T], axis=1)
                yield pd.DataFrame(added, columns=SUMS).assign(bx=spots[:, 0], by=spots[:, 1])

    kinds = ", ".join(f"{k} double" for k in SUMS)
    if block is None:
        return near.mapInPandas(sums, kinds)
    return near.mapInPandas(sums, f"{kinds}, bx long, by long").groupBy("bx", "by").agg(*(F.sum(k).alias(k) for k in SUMS))


def solved(h: np.ndarray, g: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The small turn and shift that the normal equations ask for."""
    delta = np.zeros(6)
    delta[free] = np.linalg.lstsq(h[np.ix_(free, free)], g[free], rcond=None)[0]
    return delta


def jackknife(blocks: DataFrame, free: np.ndarray) -> tuple[int, list[float]]:
    """(blocks, standard error of each parameter) by leaving out one block after another: its sums are taken off the whole ones and the rest is solved, in tasks."""
    whole = np.array(blocks.agg(*(F.sum(k) for k in SUMS)).first(), float)

    def without(parts):
        for t in parts:
            left = whole[None, :42] - t[SUMS[:42]].to_numpy(float)
            yield pd.DataFrame([solved(v[:36].reshape(6, 6), v[36:42], free) for v in left], columns=[f"d{i}" for i in range(6)])

    r = blocks.mapInPandas(without, ", ".join(f"d{i} double" for i in range(6))).agg(F.count(F.lit(1)), *(F.var_pop(f"d{i}") for i in range(6))).first()
    n = r[0]
    return n, [float(np.sqrt(max(v or 0.0, 0.0) * (n - 1))) for v in r[1:]]


def icp(moving: DataFrame, reference: DataFrame, voxel: float = 0.05, reach: float = 0.5, rounds: int = 30, eps: float = 1e-6, kernel: str = "welsch", method: str = "symmetric", dof: str = "full", normal_k: int = 16, start: list[float] | None = None, floor: float = 0.002, jackknife_block: float | None = None) -> dict:
    """Registration by nearest pairs, found by a cell join, with robust weights; clouds are thinned by voxel first.

    ``method``: symmetric (both normals), pointToPlane, pointToPoint, or gicp (plane to plane); ``dof``: full, levelled (turns about z only)
    or translation. Tasks add up the 6 x 6 normal equations of their pairs, so each round sends sums to the driver.
    ``{matrix, rmse, pairs, rounds, inlier_fraction, std_err}``; rmse is of point distances. ``jackknife_block``: also ``jackknife_blocks`` and
    ``jackknife_std_err``, from leaving out square blocks of that side, which correlated errors do not flatter.
    """
    if method not in METHODS or dof not in FREE or kernel not in ("welsch", "tukey", "huber", "none"):
        raise ValueError(f"unknown method {method!r}, dof {dof!r} or kernel {kernel!r}")
    thin = lambda d, n: ne.cut_lineage(po.decimate(d, voxel).select(F.xxhash64("vx", "vy", "vz").alias(n), "x", "y", "z"))
    a, b = thin(moving, "a"), thin(reference, "b")
    size = a.count()
    flat = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    a = normals(a, "a", normal_k) if method in ("symmetric", "gicp") else a.withColumn("n", flat)
    b = (normals(b, "b", normal_k) if method != "pointToPoint" else b.withColumn("n", flat)).withColumnRenamed("n", "m")
    total, last, n, rmse, done, spread = np.array(start or np.eye(4).ravel(), float).reshape(4, 4), np.inf, 0, None, 0, None
    middle = np.array(b.agg(*(F.avg(c) for c in "xyz")).first(), float)
    free = np.flatnonzero(FREE[dof])
    for done in range(1, rounds + 1):
        turn = total[:3, :3].copy()
        near = ne.cut_lineage(ne.nearest(ne.radius_pairs(po.transform(a, total.ravel().tolist()), b, reach), 1).select("x", "y", "z", "rx", "ry", "rz", "n", "m", "distance"))
        s = near.agg(F.sqrt(F.avg(F.col("distance") * F.col("distance"))), F.count("*"), F.percentile_approx("distance", 0.5, 10_000)).first()
        rmse, n = s[0], s[1]
        if n < 6:
            break
        c = 3 * max(1.4826 * (s[2] or 0.0), floor)
        got = np.array(pair_sums(near, turn, middle, method, kernel, c).agg(*(F.sum(k) for k in SUMS)).first(), float)
        h = got[:36].reshape(6, 6)
        delta = solved(h, got[36:42], free)
        step = np.eye(4)
        step[:3, :3] = turned(delta[:3])
        step[:3, 3] = delta[3:] + middle - step[:3, :3] @ middle
        total = step @ total
        inverse = np.linalg.pinv(h[np.ix_(free, free)]) * got[42] / max(got[43] - len(free), 1.0)
        spread = np.zeros(6)
        spread[free] = np.sqrt(np.maximum(np.diag(inverse), 0.0))
        if np.abs(delta).max() < eps or (last == rmse and np.abs(delta).max() < 1e-4):
            break
        last = rmse
    out = {"matrix": total.ravel().tolist(), "rmse": rmse, "pairs": n, "rounds": done, "inlier_fraction": n / size if size else 0.0, "std_err": None if spread is None else spread.tolist()}
    if jackknife_block:
        # Blocks of the last round's pairs; one block alone leaves nothing to solve.
        blocks = ne.cut_lineage(pair_sums(near, turn, middle, method, kernel, c, jackknife_block)) if n >= 6 else None
        many, errors = jackknife(blocks, free) if blocks is not None else (0, None)
        out |= {"jackknife_blocks": many, "jackknife_std_err": errors if many > 1 else None}
    return out


def turned(v: np.ndarray) -> np.ndarray:
    """Rotation by a vector (Rodrigues)."""
    t = float(np.linalg.norm(v))
    if t < 1e-15:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / t
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def vote_shift(moving: DataFrame, reference: DataFrame, reach: float = 30.0, cell: float = 0.5, dims: str = "xy") -> DataFrame:
    """Planar shifts between stems by votes: pairs within reach count for the cell of their difference; best first."""
    a, b = moving.select(F.col("id").alias("a"), "x", "y"), reference.select(F.col("id").alias("b"), "x", "y")
    p = ne.radius_pairs(a, b, reach, dims)
    return p.groupBy(F.round((F.col("rx") - F.col("x")) / cell).cast("long").alias("i"), F.round((F.col("ry") - F.col("y")) / cell).cast("long").alias("j")).agg(F.count("*").alias("votes"), F.avg(F.col("rx") - F.col("x")).alias("dx"), F.avg(F.col("ry") - F.col("y")).alias("dy")).orderBy(F.desc("votes"), "i", "j")


def align_stems(moving: DataFrame, reference: DataFrame, reach: float = 30.0, cell: float = 0.5, allow_rotation: bool = True, yaw_range: float = 10.0, yaw_step: float = 1.0) -> dict | None:
    """Turn about z and shift between stems by votes: every turn of a grid is tried in one job, the one with most votes for one shift wins.

    ``{yaw_deg, dx, dy, votes}``: a stem goes to the turned place plus the shift; then both are fitted to the pairs that agree.
    """
    steps = np.arange(-yaw_range, yaw_range + yaw_step / 2, yaw_step).tolist() if allow_rotation else [0.0]
    # Stems in one place vote together: a place counts as often as it has stems.
    one, two = bl.spots(moving, "x", "y", ids=F.count_distinct("id")), bl.spots(reference, "x", "y")
    spun = one.select("x", "y", "m", "ids", F.explode(F.array(*map(F.lit, sorted(steps, key=abs)))).alias("yaw"))
    a = F.radians("yaw")
    spun = spun.select(F.struct("yaw", "x", "y", "m", "ids").alias("a"), (F.col("x") * F.cos(a) - F.col("y") * F.sin(a)).alias("x"), (F.col("x") * F.sin(a) + F.col("y") * F.cos(a)).alias("y"))
    pairs = ne.cut_lineage(ne.radius_pairs(spun, two.select(F.col("m").alias("b"), "x", "y"), reach, "xy").select("a", "b", "x", "y", "rx", "ry"))
    dx, dy = F.col("rx") - F.col("x"), F.col("ry") - F.col("y")
    # A shift counts for its cell and the three next to it, so cell borders cut no peak.
    spots = F.array(*(F.struct(F.floor(dx / cell + i).cast("long").alias("i"), F.floor(dy / cell + j).cast("long").alias("j")) for i in (0.0, 0.5) for j in (0.0, 0.5)))
    kind = F.posexplode(spots)
    seen = pairs.select("a.yaw", F.struct("a.x", "a.y", "a.ids").alias("place"), kind.alias("k", "s")).distinct()
    votes = seen.groupBy("yaw", "k", "s").agg(F.sum("place.ids").alias("votes"))
    best = votes.orderBy(F.desc("votes"), F.abs("yaw"), "yaw", "k", "s.i", "s.j").first()
    if best is None:
        return None
    mine = pairs.filter(F.col("a.yaw") == best["yaw"]).select("a", "b", "rx", "ry", kind.alias("k", "s")).filter((F.col("k") == best["k"]) & (F.col("s.i") == best["s"]["i"]) & (F.col("s.j") == best["s"]["j"]))
    t = ne.cut_lineage(mine.select((F.col("a.m") * F.col("b")).alias("w"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), "rx", "ry"))
    r = t.agg(*(F.sum(F.col("w") * F.col(c)) / F.sum("w") for c in ("x", "y", "rx", "ry")), F.sum("w")).first()
    # Products about the means, in a pass of its own.
    off = {c: F.col(c) - v for c, v in zip(("x", "y", "rx", "ry"), r)}
    c = t.agg(*(F.sum(F.col("w") * off[p] * off[q]) / F.sum("w") for p in ("x", "y") for q in ("rx", "ry"))).first()
    r = (*r[:4], *c, r[4])
    yaw = math.atan2(r[5] - r[6], r[4] + r[7]) if allow_rotation and r[8] > 1 and (r[4] + r[7] or r[5] - r[6]) else math.radians(best["yaw"])
    c, s = math.cos(yaw), math.sin(yaw)
    return {"yaw_deg": math.degrees(yaw), "dx": r[2] - (c * r[0] - s * r[1]), "dy": r[3] - (s * r[0] + c * r[1]), "votes": best["votes"]}


def find_spheres(points: DataFrame, radius: tuple[float, float] = (0.05, 0.15), tol: float = 0.01, least: int = 40, rounds: int = 300, tile: float = 2.0) -> DataFrame:
    """Sphere targets by RANSAC in tiles with a halo: ``(cx, cy, cz, r, n)``; a sphere belongs to the tile that holds its centre."""
    import pandas as pd

    from .segmentation import tiled

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p, out = pdf[["x", "y", "z"]].to_numpy(float), []
        tx, ty = int(pdf["tile_x"].iloc[0]), int(pdf["tile_y"].iloc[0])
        rng = np.random.default_rng([tx & 0xFFFFFFFF, ty & 0xFFFFFFFF])
        while len(p) >= least:
            best = None
            for _ in range(rounds):
                # Three more points near the first: a target is a small part of its tile.
                c = p[rng.integers(len(p))]
                near = np.flatnonzero(((p - c) ** 2).sum(1) <= (2 * radius[1]) ** 2)
                if len(near) < least:
                    continue
                q = p[rng.choice(near, 4, replace=False)]
                a = 2 * (q[1:] - q[0])
                if abs(np.linalg.det(a)) < 1e-12:
                    continue
                centre = np.linalg.solve(a, (q[1:] ** 2).sum(1) - (q[0] ** 2).sum())
                r = float(np.linalg.norm(q[0] - centre))
                if not radius[0] <= r <= radius[1]:
                    continue
                on = np.abs(np.linalg.norm(p - centre, axis=1) - r) <= tol
                if on.sum() >= least and (best is None or on.sum() > best[2].sum()):
                    best = (centre, r, on)
            if best is None:
                break
            q = p[best[2]]
            m = np.column_stack([2 * q, np.ones(len(q))])
            s = np.linalg.lstsq(m, (q * q).sum(1), rcond=None)[0]
            c, r = s[:3], float(np.sqrt(s[3] + s[:3] @ s[:3]))
            if np.floor(c[0] / tile) == tx and np.floor(c[1] / tile) == ty and radius[0] <= r <= radius[1]:
                out.append((*map(float, c), r, len(q)))
            p = p[np.linalg.norm(p - c, axis=1) > r + 2 * tol]
        return pd.DataFrame(out, columns=["cx", "cy", "cz", "r", "n"])

    return tiled(points.select("x", "y", "z"), tile, 2 * radius[1], work, "cx double, cy double, cz double, r double, n int")


def match_targets(source: list, target: list, tol: float = 0.05) -> tuple[list[tuple[int, int]], list[float] | None]:
    """Pairs of target centres of two scans whose mutual distances agree, and the transform; the one with most pairs wins.

    Pairs of centres vote for pairs of their ends by equal distance (found by a sorted list, not by trying all); triples are
    tried among the ends with most votes only.
    """
    a, b = np.array(source, float).reshape(-1, 3), np.array(target, float).reshape(-1, 3)
    if min(len(a), len(b)) < 3:
        return [], None
    da, db = (np.linalg.norm(v[:, None] - v[None], axis=2) for v in (a, b))
    k, m = np.triu_indices(len(b), 1)
    order = np.argsort(db[k, m])
    length = db[k, m][order]
    votes, same = np.zeros((len(a), len(b)), int), {}
    for i, j in zip(*np.triu_indices(len(a), 1)):
        for e in order[np.searchsorted(length, da[i, j] - tol):np.searchsorted(length, da[i, j] + tol, "right")]:
            for u, v in ((k[e], m[e]), (m[e], k[e])):
                votes[i, u] += 1
                votes[j, v] += 1
                same.setdefault((i, u), []).append((j, v))
    best: tuple = ([], None, np.inf)
    for i, u in sorted(same, key=lambda x: -votes[x])[:200]:
        mates = sorted(same[i, u], key=lambda x: -votes[x])[:30]
        for n, (j, v) in enumerate(mates):
            for l, w in mates[n + 1:]:
                if l == j or w == v or abs(da[j, l] - db[v, w]) > tol:
                    continue
                t = rigid(a[[i, j, l]], b[[u, v, w]])
                d = np.linalg.norm((a @ t[:3, :3].T + t[:3, 3])[:, None] - b[None], axis=2)
                pairs = [(x, int(d[x].argmin())) for x in range(len(a)) if d[x].min() <= tol and d[:, d[x].argmin()].argmin() == x]
                error = sum(d[x] for x in pairs)
                if (len(pairs), -error) > (len(best[0]), -best[2]):
                    best = (pairs, t, error)
        if len(best[0]) == min(len(a), len(b)):
            break
    if len(best[0]) < 3:
        return [], None
    x, y = zip(*best[0])
    return best[0], rigid(a[list(x)], b[list(y)]).ravel().tolist()


def rigid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """4 x 4 transform that takes rows of a to rows of b best."""
    u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, b.mean(0) - r @ a.mean(0)
    return m


def adjust_network(observed: dict[str, dict[str, list]], rounds: int = 1000, eps: float = 1e-6) -> dict:
    """Poses of all scans from shared targets at once: ``observed[scan][target] = (x, y, z)``.

    Targets' places are means over the scans that see them, scans are fitted to those, and so on until the residual
    stands still (generalised Procrustes); the first scan stays where it is. ``{poses, rmse}``.
    """
    scans = list(observed)
    poses, last = {s: np.eye(4) for s in scans}, np.inf
    # A first guess scan by scan, along shared targets.
    known, waiting = {scans[0]}, scans[1:]
    place = {t: np.array(p, float) for t, p in observed[scans[0]].items()}
    while waiting:
        ready = max(waiting, key=lambda s: len(set(observed[s]) & set(place)))
        shared = sorted(set(observed[ready]) & set(place))
        if len(shared) < 3:
            raise ValueError(f"{ready} shares fewer than three targets with the others")
        poses[ready] = rigid(np.array([observed[ready][t] for t in shared], float), np.array([place[t] for t in shared]))
        for t, p in observed[ready].items():
            place.setdefault(t, poses[ready][:3, :3] @ np.array(p, float) + poses[ready][:3, 3])
        waiting.remove(ready)
        known.add(ready)
    rmse = 0.0
    for _ in range(rounds):
        seen: dict[str, list] = {}
        for s in scans:
            for t, p in observed[s].items():
                seen.setdefault(t, []).append(poses[s][:3, :3] @ np.array(p, float) + poses[s][:3, 3])
        place = {t: np.mean(v, axis=0) for t, v in seen.items()}
        rmse = float(np.sqrt(np.mean([((q - place[t]) ** 2).sum() for t, v in seen.items() for q in v])))
        if abs(last - rmse) < eps * 1e-3:
            break
        last = rmse
        for s in scans[1:]:
            names = sorted(observed[s])
            poses[s] = rigid(np.array([observed[s][t] for t in names], float), np.array([place[t] for t in names]))
    return {"poses": {s: m.ravel().tolist() for s, m in poses.items()}, "rmse": rmse}
