"""Tetrahedra and the volumes of crowns."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from silvaquery.functions import geometry as ge
from silvaquery.operators import trees as tr


def test_no_point_lies_in_a_circumscribed_sphere():
    p = np.random.default_rng(1).random((60, 3))
    tets = ge.tetrahedra(p)
    centre, r2 = ge.circumspheres(p, tets)
    inside = ((centre[:, None] - p[None]) ** 2).sum(2) < r2[:, None] - 1e-4
    assert not inside.any() and len(np.unique(tets)) == 60
    # They fill the hull once: as much as the hull of the points by the faces that belong to one of them only.
    faces = np.sort(tets[:, [[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]]].reshape(-1, 3), axis=1)
    walls, times = np.unique(faces, axis=0, return_counts=True)
    assert times.max() == 2
    mid = p.mean(0)
    hull = sum(abs(np.linalg.det(p[w] - mid)) for w in walls[times == 1]) / 6
    assert ge.alpha_volume(p, np.inf) == pytest.approx(hull, rel=1e-9)


def test_volume_goes_from_nothing_to_the_hull():
    grid = np.array(list(itertools.product(np.linspace(0, 1, 5), repeat=3)))
    assert ge.alpha_volume(grid, np.inf) == pytest.approx(1.0, rel=1e-6)
    v = [ge.alpha_volume(grid, a) for a in (0.01, 0.15, 0.25, 1.0, 100.0)]
    assert v[0] == 0 and v == sorted(v) and v[2] == pytest.approx(1.0, rel=1e-3)
    # Two cubes far apart: a small radius sees two of them, the hull the air between as well.
    two = np.vstack([grid, grid + [4, 0, 0]])
    assert ge.alpha_volume(two, 0.3) == pytest.approx(2.0, rel=1e-3) and ge.alpha_volume(two, np.inf) == pytest.approx(5.0, rel=1e-3)
    for flat in (np.zeros((0, 3)), grid[:3], grid[grid[:, 2] == 0]):
        assert ge.alpha_volume(flat, 0.5) == pytest.approx(0.0, abs=1e-6)


def test_crowns_of_balls(spark):
    rng, rows = np.random.default_rng(2), []
    for k, r in ((1, 1.5), (2, 2.5)):
        d = rng.normal(size=(4000, 3))
        d = d / np.linalg.norm(d, axis=1, keepdims=True) * r * rng.random((4000, 1)) ** (1 / 3)
        rows += [(k, k * 10 + x, y, z + 8) for x, y, z in d] + [(k, k * 10.0, 0.0, h) for h in np.arange(0, 3, 0.1)]
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["tree_id", "x", "y", "hag"]).astype({"tree_id": int}))
    got = {r.tree_id: r for r in tr.crown_volumes(p, 0.6, base=0.5).collect()}
    for k, r in ((1, 1.5), (2, 2.5)):
        assert got[k].hull_volume == pytest.approx(4 / 3 * math.pi * r**3, rel=0.15)
        assert 0.8 * got[k].hull_volume < got[k].alpha_volume <= got[k].hull_volume
    assert tr.crown_volumes(p.limit(0)).count() == 0
