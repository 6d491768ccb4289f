"""Point features, global registration by them, and the block jackknife."""

import math

import numpy as np
import pandas as pd
import pytest

from silvaquery.operators import features as ft
from silvaquery.operators import neighbours as ne
from silvaquery.operators import registration as rg


def scene(seed, trees=10, boxes=4, noise=0.01, wide=16.0):
    """Uneven ground, leaning stems with crowns and some boxes: the same place for every seed, sampled anew."""
    rng, fix = np.random.default_rng(seed), np.random.default_rng(3)
    g = rng.random((7000, 2)) * wide
    out = [np.column_stack([g, 0.6 * np.sin(g[:, 0] / 3.1) + 0.5 * np.cos(g[:, 1] / 2.3 + g[:, 0] / 9)])]
    for _ in range(trees):
        (x, y), r, h, lean = fix.random(2) * (wide - 2) + 1, fix.uniform(0.25, 0.6), fix.uniform(3, 9), fix.normal(0, 0.08, 2)
        n = int(800 * h / 4)
        t, a = rng.random(n) * h, rng.random(n) * 2 * np.pi
        out.append(np.column_stack([x + lean[0] * t + r * np.cos(a), y + lean[1] * t + r * np.sin(a), t + 0.2]))
        d = rng.normal(size=(int(fix.integers(300, 700)), 3))
        out.append(np.array([x + lean[0] * h, y + lean[1] * h, h + 1]) + d / np.linalg.norm(d, axis=1)[:, None] * fix.uniform(0.8, 1.6) * fix.uniform(0.7, 1.2, 3))
    for _ in range(boxes):
        c, w = fix.random(2) * (wide - 4) + 1, fix.uniform(0.8, 2.5, 3)
        p, f = rng.random((1200, 3)) * w, rng.integers(0, 3, 1200)
        p[np.arange(1200), f] = np.where(rng.random(1200) < 0.5, 0, w[f])
        out.append(p + [*c, 0.5])
    p = np.vstack(out)
    return p + rng.normal(0, noise, p.shape)


def turn(yaw, shift):
    m, a = np.eye(4), math.radians(yaw)
    m[:2, :2], m[:3, 3] = [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]], shift
    return m


def cloud(spark, p):
    return spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")))


def test_histograms_against_brute_force(spark):
    rng = np.random.default_rng(1)
    p, n = rng.random((60, 3)) * 2, rng.normal(size=(60, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    own, near = np.zeros((60, 33)), [[] for _ in range(60)]
    for i in range(60):
        for j in range(60):
            d = p[j] - p[i]
            far = np.linalg.norm(d)
            if i == j or far > 0.8:
                continue
            near[i].append((j, far))
            d /= far
            v = np.cross(d, n[i])
            w = np.cross(n[i], v)
            for k, (x, low, high) in enumerate(((v @ n[j], -1, 1), (n[i] @ d, -1, 1), (math.atan2(w @ n[j], n[i] @ n[j]), -math.pi, math.pi))):
                own[i, 11 * k + min(10, max(0, int((x - low) / (high - low) * 11)))] += 1
    own /= np.maximum(own[:, :11].sum(1, keepdims=True), 1)
    want = {i: (own[i] + sum(own[j] / d for j, d in near[i]) / sum(1 / d for _, d in near[i])) / 2 for i in range(60) if near[i]}
    rows = spark.createDataFrame([(i, *map(float, p[i]), *map(float, n[i])) for i in range(60)], "a long, x double, y double, z double, nx double, ny double, nz double")
    got = {r.a: np.array(r.f) for r in ft.histograms(rows, 0.8).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)


def test_features_do_not_turn_with_the_cloud(spark):
    p = scene(1, trees=2, boxes=1, wide=6.0)[::4]
    q = p @ turn(90, [0, 0, 0])[:3, :3].T + [50, -20, 3]
    rows = lambda v: spark.createDataFrame(pd.DataFrame(v, columns=list("xyz")).assign(id=range(len(v))))
    one, two = ({r.a: np.array(r.f) for r in ft.histograms(ne.cut_lineage(ft.oriented(rows(v), 0.7)), 1.2).collect()} for v in (p, q))
    apart = np.array([np.abs(one[i] - two[i]).max() for i in one.keys() & two.keys()])
    assert len(apart) > 0.9 * max(len(one), len(two)) and (apart < 1e-6).mean() > 0.9


def test_ransac_finds_the_few_right_pairs(spark):
    rng, m = np.random.default_rng(2), turn(130, [30, -7, 2])
    p = rng.random((300, 3)) * 10
    q = p @ m[:3, :3].T + m[:3, 3] + rng.normal(0, 0.01, p.shape)
    q[60:] = rng.random((240, 3)) * 10 + m[:3, 3]
    pairs = spark.createDataFrame([(i, i, *map(float, p[i]), *map(float, q[i])) for i in range(300)], "a long, b long, x double, y double, z double, rx double, ry double, rz double")
    got = ft.ransac(pairs, 0.1, 20_000)
    assert got["inliers"] >= 60 and np.allclose(got["matrix"], m.ravel(), atol=0.02)
    assert ft.ransac(pairs.limit(2), 0.1) is None


def test_operation_starts_from_features_and_picks_the_best_start(spark, tmp_path):
    """A quarter turn and an offset of hundreds of metres, where the given place and stems are of no use."""
    from silvaquery.plans import catalogue as c

    c.run(spark, "project.create", {"folder": str(tmp_path), "name": "p"})
    c.run(spark, "project.open", {"folder": str(tmp_path)})
    m = turn(90, [250.0, -120.0, 8.0])
    back, dirs = np.linalg.inv(m), {}
    for name, p in (("moving", scene(1) @ back[:3, :3].T + back[:3, 3]), ("still", scene(2))):
        (tmp_path / f"{name}.csv").write_text("x,y,z\n" + "".join(f"{x:.4f},{y:.4f},{z:.4f}\n" for x, y, z in p))
        dirs[name] = c.run(spark, "dataset.import", {"srcPath": f"{tmp_path}/{name}.csv", "name": name})
    few = {"movingDir": dirs["moving"], "referenceDir": dirs["still"], "levels": 1, "voxel": 0.15, "maxIters": 8, "maxCorrDist": 0.6, "method": "pointToPlane", "featureIterations": 20_000}
    got = c.run(spark, "change.register", few | {"init": "features"})
    assert np.allclose(np.array(got["matrix"]).reshape(4, 4)[:3, :3], m[:3, :3], atol=0.01) and np.allclose(np.array(got["matrix"])[[3, 7, 11]], m[:3, 3], atol=0.5)
    moved = scene(1) @ back[:3, :3].T + back[:3, 3]
    found = np.array(got["matrix"]).reshape(4, 4)
    assert np.abs(moved @ found[:3, :3].T + found[:3, 3] - scene(1)).max() < 0.1
    assert got["jackknife_blocks"] > 20 and len(got["jackknife_std_err"]) == 6 and max(got["jackknife_std_err"]) < 0.05
    a, b = c.points_of(spark, dirs["moving"]), c.points_of(spark, dirs["still"])
    place = {"dx": 0.0, "dy": 0.0, "dz": 0.0, "yaw_deg": 0.0}
    auto = c._start(spark, "auto", a, b, dirs["moving"], dirs["still"], place, 0.5, 30.0, 5.0, 0.3, 20_000, 0.6)
    assert np.abs(moved @ np.array(auto).reshape(4, 4)[:3, :3].T + np.array(auto)[[3, 7, 11]] - scene(1)).max() < 0.5
    # From the right place the given start is the best one, or as good.
    right = place | {"dx": 250.0, "dy": -120.0, "dz": 8.0, "yaw_deg": 90.0}
    auto = c._start(spark, "auto", a, b, dirs["moving"], dirs["still"], right, 0.5, 30.0, 5.0, 0.3, 20_000, 0.6)
    assert np.abs(moved @ np.array(auto).reshape(4, 4)[:3, :3].T + np.array(auto)[[3, 7, 11]] - scene(1)).max() < 0.5
    with pytest.raises(ValueError, match="unknown init"):
        c.run(spark, "change.register", few | {"init": "guess"})


def test_jackknife_equals_fits_without_each_block(spark):
    rng = np.random.default_rng(4)
    p = np.column_stack([rng.random((800, 2)) * 6 + 1, rng.normal(0, 0.2, 800)])
    q = p + rng.normal(0, 0.01, p.shape) + np.array([0.02, -0.01, 0.03])
    n = rng.normal(size=(800, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    near = spark.createDataFrame([(*map(float, a), *map(float, b), [0.0] * 3, v.tolist()) for a, b, v in zip(p, q, n)], "x double, y double, z double, rx double, ry double, rz double, n array<double>, m array<double>")
    middle, free = q.mean(0), np.arange(6)
    blocks = rg.pair_sums(near, np.eye(3), middle, "pointToPlane", "welsch", 0.1, 2.0)
    many, errors = rg.jackknife(blocks, free)
    home = np.floor(q[:, :2] / 2.0)
    rows, gap = rg.pair_equations(p - middle, q - middle, np.zeros_like(n), n, "pointToPlane")
    w = np.exp(-(np.linalg.norm(gap, axis=1) / 0.1) ** 2)
    fits = []
    for spot in np.unique(home, axis=0):
        left = (home != spot).any(1)
        a, b = (rows[left][:, 0] * np.sqrt(w[left])[:, None]), gap[left][:, 0] * np.sqrt(w[left])
        fits.append(np.linalg.lstsq(a, b, rcond=None)[0])
    assert many == len(fits)
    assert np.allclose(errors, np.sqrt((many - 1) * np.var(fits, axis=0)), rtol=1e-6)
    assert rg.jackknife(rg.pair_sums(near, np.eye(3), middle, "pointToPlane", "welsch", 0.1, 1000.0), free)[1] == [0.0] * 6
