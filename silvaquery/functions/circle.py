"""Circle fits: Taubin's from moments, and a seeded RANSAC with a Taubin refit."""

from __future__ import annotations

import numpy as np


def taubin_from_moments(uu, vv, uv, zu, zv, zz, mean_z):
    """Centre offsets and radius for arrays of centred moments: z = u^2 + v^2, covariances of (z, u, v), mean of z.

    The normalised z0 = (z - mean) / (2 sqrt(mean)) turns the gradient-weighted fit into the smallest
    eigenvector of a symmetric 3 x 3 matrix.
    """
    s = 2 * np.sqrt(np.maximum(mean_z, 1e-300))
    m = np.stack([zz / s / s, zu / s, zv / s, zu / s, uu, uv, zv / s, uv, vv], axis=-1).reshape(-1, 3, 3)
    bad = ~np.isfinite(m).all(axis=(1, 2))
    m[bad] = 0
    a = np.linalg.eigh(m)[1][:, :, 0]
    lead = a[:, 0] / s
    with np.errstate(all="ignore"):
        cx, cy = -a[:, 1] / lead / 2, -a[:, 2] / lead / 2
        r = np.sqrt(cx * cx + cy * cy + mean_z)
    bad |= np.abs(lead) < 1e-12
    return tuple(np.where(bad, np.nan, v) for v in (cx, cy, r))


def taubin(x: np.ndarray, y: np.ndarray, m: np.ndarray | None = None) -> tuple[float, float, float] | None:
    """The circle of points, of which row k stands for ``m[k]``."""
    if len(x) < 3:
        return None
    mean = lambda q: np.average(q, weights=m)
    mx, my = mean(x), mean(y)
    u, v = x - mx, y - my
    z = u * u + v * v
    d = z - mean(z)
    cx, cy, r = taubin_from_moments(*(np.array([mean(k)]) for k in (u * u, v * v, u * v, d * u, d * v, d * d, z)))
    return None if not np.isfinite(r[0]) else (float(cx[0] + mx), float(cy[0] + my), float(r[0]))


#: Distances that are looked at together.
AT_ONCE = 4_000_000


def ransac(x: np.ndarray, y: np.ndarray, tol: float, rounds: int, least: int, seed: int, m: np.ndarray | None = None) -> tuple[float, float, float, int, float] | None:
    """(cx, cy, r, inliers, rmse) of the circle with most points within ``tol``, refitted to them. ``m``: how many points a row stands for."""
    m = np.ones(len(x), np.int64) if m is None else m
    if len(x) < 3 or m.sum() < max(3, least):
        return None
    rng = np.random.default_rng(seed)
    pick = np.stack([rng.choice(len(x), 3, replace=False) for _ in range(rounds)])
    ax, ay, bx, by, cx, cy = (q[pick[:, k]] for k in range(3) for q in (x, y))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    with np.errstate(all="ignore"):
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = np.hypot(ax - ux, ay - uy)
    real = np.isfinite(r)
    ux, uy, r = ux[real], uy[real], r[real]
    if not len(r):
        return None
    on = lambda u, v, w: np.abs(np.hypot(x[None] - u[:, None], y[None] - v[:, None]) - w[:, None]) <= tol
    step = max(1, AT_ONCE // len(x))
    best = int(np.argmax(np.concatenate([on(ux[k:k + step], uy[k:k + step], r[k:k + step]) @ m for k in range(0, len(r), step)])))
    inside = on(ux[[best]], uy[[best]], r[[best]])[0]
    if m[inside].sum() < least:
        return None
    # The refitted circle names its own inliers, a few times over.
    for _ in range(5):
        fit = taubin(x[inside], y[inside], m[inside])
        if fit is None:
            return None
        again = np.abs(np.hypot(x - fit[0], y - fit[1]) - fit[2]) <= tol
        if m[again].sum() < least or (again == inside).all():
            break
        inside = again
    res = np.hypot(x[inside] - fit[0], y[inside] - fit[1]) - fit[2]
    return (*fit, int(m[inside].sum()), float(np.sqrt(np.average(res * res, weights=m[inside]))))
