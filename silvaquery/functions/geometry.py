"""Plane geometry on arrays: hulls, Delaunay triangles, alpha shapes, ear clipping. For results of bounded size."""

from __future__ import annotations

import math

import numpy as np


def cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the signed area of the triangle; above zero where it turns left."""
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise (Andrew's monotone chain); fewer than three for points on a line."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2)[np.isfinite(points).reshape(-1, 2).all(1)], axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (three row numbers, counter-clockwise) by incremental insertion (Bowyer and Watson); repeated points are left out."""
    p = np.asarray(points, float)
    _, first = np.unique(p, axis=0, return_index=True)
    order = np.sort(first)
    if len(order) < 3:
        return np.zeros((0, 3), int)
    mid, wide = p.mean(0), max(float(np.ptp(p, axis=0).max()), 1e-9)
    n = len(p)
    q = np.vstack([p, mid + wide * 1e3 * np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0]])]) - mid
    tri = np.array([[n, n + 1, n + 2]])
    for i in order:
        a, b, c = (q[tri[:, k]] - q[i] for k in range(3))
        inside = ((a ** 2).sum(1) * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]) - (b ** 2).sum(1) * (a[:, 0] * c[:, 1] - a[:, 1] * c[:, 0]) + (c ** 2).sum(1) * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])) > 0
        bad = tri[inside]
        edges = {}
        for t in bad.tolist():
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                if e[::-1] in edges:
                    del edges[e[::-1]]
                else:
                    edges[e] = True
        tri = np.vstack([tri[~inside], np.array([(u, v, i) for u, v in edges], int).reshape(-1, 3)])
    tri = tri[(tri < n).all(1)]
    return tri[cross(p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]) > 0]


def alpha_shape(points: np.ndarray, alpha: float) -> np.ndarray:
    """Border edges (two row numbers) of the Delaunay triangles whose circumscribed circle's radius is at most ``alpha``."""
    p, tri = np.asarray(points, float), delaunay(points)
    if not len(tri):
        return np.zeros((0, 2), int)
    a, b, c = (p[tri[:, k]] for k in range(3))
    sides = np.linalg.norm(a - b, axis=1) * np.linalg.norm(b - c, axis=1) * np.linalg.norm(c - a, axis=1)
    tri = tri[sides / np.maximum(2 * np.abs(cross(a, b, c)), 1e-300) <= alpha]
    edges: dict[tuple[int, int], int] = {}
    for t in tri.tolist():
        for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            if e[::-1] in edges:
                del edges[e[::-1]]
            else:
                edges[e] = 1
    return np.array(sorted(edges), int).reshape(-1, 2)


def ring_area(ring: np.ndarray) -> float:
    """Signed area, above zero counter-clockwise."""
    x, y = np.asarray(ring, float).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def ear_clip(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon: ears are cut off one by one."""
    p = np.asarray(ring, float)
    left = list(range(len(p)))
    if ring_area(p) < 0:
        left.reverse()
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if cross(p[a], p[b], p[c]) <= 0:
                continue
            rest = p[[i for i in left if i not in (a, b, c)]]
            if ((cross(p[a], p[b], rest) >= 0) & (cross(p[b], p[c], rest) >= 0) & (cross(p[c], p[a], rest) >= 0)).any():
                continue
            out.append((a, b, c))
            left.pop(k)
            break
        else:
            break
    return out + [tuple(left)] if len(left) == 3 else out


def smoothed(line: np.ndarray, rounds: int, closed: bool = False) -> np.ndarray:
    """Corners cut at a quarter of their sides, again and again (Chaikin); ends of an open line stay."""
    p = np.asarray(line, float)
    for _ in range(rounds):
        if len(p) < 3:
            return p
        a, b = (p, np.roll(p, -1, axis=0)) if closed else (p[:-1], p[1:])
        cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], axis=1).reshape(-1, 2)
        p = cut if closed else np.vstack([p[:1], cut[1:-1], p[-1:]])
    return p


def chained(segments: np.ndarray, places: int = 9) -> list[np.ndarray]:
    """Segments (x1, y1, x2, y2) joined end to end into lines, as long as they go; closed ones repeat their first point."""
    ends: dict[tuple, list[int]] = {}
    key = [[tuple(np.round(s[2 * k:2 * k + 2], places)) for k in (0, 1)] for s in np.asarray(segments, float)]
    for i, k in enumerate(key):
        for e in k:
            ends.setdefault(e, []).append(i)
    used, out = np.zeros(len(key), bool), []
    # Lines with loose ends first, then rings.
    starts = [(i, e) for i, k in enumerate(key) for e in k if len(ends[e]) == 1] + [(i, k[0]) for i, k in enumerate(key)]
    for i, e in starts:
        if used[i]:
            continue
        line = [e]
        while True:
            used[i] = True
            e = key[i][1] if key[i][0] == e else key[i][0]
            line.append(e)
            i = next((j for j in ends[e] if not used[j]), None)
            if i is None:
                break
        out.append(np.array(line, float))
    return out


def length_of(line: np.ndarray) -> float:
    return float(sum(math.hypot(*d) for d in np.diff(np.asarray(line, float), axis=0)))


# ---------------------------------------------------------------- in space


def circumspheres(q: np.ndarray, tets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, squared radii) of tetrahedra; flat ones get an infinite radius."""
    a = q[tets[:, 0]]
    m = 2 * (q[tets[:, 1:]] - a[:, None])
    rhs = ((q[tets[:, 1:]] - a[:, None]) ** 2).sum(2)
    flat = np.abs(np.linalg.det(m)) < 1e-14
    m[flat] = np.eye(3)
    off = np.linalg.solve(m, rhs[:, :, None])[:, :, 0]
    return a + off, np.where(flat, np.inf, (off ** 2).sum(1))


def tetrahedra(points: np.ndarray) -> np.ndarray:
    """Delaunay tetrahedra (four row numbers) by incremental insertion; repeated points are left out.

    Points are moved by some 1e-7 of the cloud's width first, drawn by their order, so that none lie on one sphere by chance.
    """
    p = np.asarray(points, float).reshape(-1, 3)
    _, first = np.unique(p, axis=0, return_index=True)
    order = np.sort(first)
    if len(order) < 4:
        return np.zeros((0, 4), int)
    wide = max(float(np.ptp(p, axis=0).max()), 1e-9)
    q = (p - p.mean(0)) / wide
    q = q + np.random.default_rng(1).normal(0, 1e-7, q.shape)
    n = len(q)
    q = np.vstack([q, 40.0 * np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]])])
    tets = np.array([[n, n + 1, n + 2, n + 3]])
    centre, size = circumspheres(q, tets)
    for i in order:
        bad = ((centre - q[i]) ** 2).sum(1) <= size
        faces = np.sort(tets[bad][:, [[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]]].reshape(-1, 3), axis=1)
        # Faces of one removed tetrahedron only are the walls of the hole.
        walls, times = np.unique(faces, axis=0, return_counts=True)
        new = np.column_stack([walls[times == 1], np.full((times == 1).sum(), i)])
        c, s = circumspheres(q, new)
        tets, centre, size = np.vstack([tets[~bad], new]), np.vstack([centre[~bad], c]), np.concatenate([size[~bad], s])
    return tets[(tets < n).all(1)]


def alpha_volume(points: np.ndarray, alpha: float) -> float:
    """Volume of the Delaunay tetrahedra whose circumscribed sphere's radius is at most ``alpha``; with infinity that of the hull."""
    p, tets = np.asarray(points, float).reshape(-1, 3), tetrahedra(points)
    if not len(tets):
        return 0.0
    size = np.abs(np.linalg.det(p[tets[:, 1:]] - p[tets[:, :1]])) / 6
    solid = size > 1e-12
    _, r2 = circumspheres(p, tets[solid])
    return float(size[solid][r2 <= alpha * alpha].sum()) if np.isfinite(alpha) else float(size.sum())
