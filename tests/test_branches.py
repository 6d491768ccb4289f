"""Calliper readings on branches against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from silvaquery.operators import branches as br


def branch(axis, middle, a, b, n=4000, seed=1, length=1.0):
    """Bark of an elliptic cylinder: half widths a along the level direction across the axis and b along the other."""
    rng = np.random.default_rng(seed)
    axis = np.array(axis, float) / np.linalg.norm(axis)
    u = np.cross(axis, [0, 0, 1.0])
    u = u / np.linalg.norm(u) if np.linalg.norm(u) > 1e-6 else np.array([-1.0, 0, 0])
    v = np.cross(axis, u)
    t, w = (rng.random((n, 1)) - 0.5) * length, rng.random((n, 1)) * 2 * np.pi
    return np.array(middle) + t * axis + a * np.cos(w) * u + b * np.sin(w) * v


CASES = {1: ((1, 0.2, 0.4), (0, 0, 5), 0.06, 0.04), 2: ((0, 0, 1), (4, 1, 2), 0.10, 0.10), 3: ((0.3, 1, -0.2), (0, 0.6, 5.1), 0.03, 0.05)}


def test_readings_on_elliptic_branches(spark):
    rows, clicks = [], []
    for k, (axis, middle, a, b) in CASES.items():
        p = branch(axis, middle, a, b, seed=k)
        rows += [(k, *map(float, v)) for v in p]
        clicks.append((f"c{k}", k, *map(float, p[np.argmin(np.linalg.norm(p - middle, axis=1))])))
    clicks.append(("lost", 1, 50.0, 50.0, 50.0))
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["branch", "x", "y", "z"]))
    got = {r.click: r for r in br.measured_branches(spark.createDataFrame(clicks, "click string, branch long, x double, y double, z double"), points, 0.4, 0.03).collect()}
    assert set(got) == {"c1", "c2", "c3"}
    for k, (axis, middle, a, b) in CASES.items():
        r = got[f"c{k}"]
        assert r.least_width == pytest.approx(2 * min(a, b), rel=0.03) and r.cross_width == pytest.approx(2 * max(a, b), rel=0.03)
        assert r.mean_width == pytest.approx(a + b, rel=0.03) and r.coverage == 1.0
        if a != b:
            # Level across the axis is 0 degrees, the other way 90.
            assert min(abs(r.angle_deg - (0 if a < b else 90)), 180 - abs(r.angle_deg)) < 6
        off = np.array([r.cx, r.cy, r.cz]) - middle
        line = np.array(axis, float) / np.linalg.norm(axis)
        assert np.linalg.norm(off - (off @ line) * line) < 0.005


def test_readings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = {f"s{k}": rng.normal(size=(int(rng.integers(3, 60)), 2)) * [0.1, 0.04] for k in range(5)}
    rows = [(k, *map(float, v), 0.0, 0.0, 0.0) for k, p in sets.items() for v in p]
    df = spark.createDataFrame(rows, "click string, u double, v double, cx double, cy double, cz double")
    for trim in (0.0, 0.05):
        got = {r.click: r for r in br.caliper_readings(df, trim).collect()}
        for k, p in sets.items():
            def width(deg):
                x = p @ [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
                return np.quantile(x, 1 - trim) - np.quantile(x, trim)
            best = min(range(180), key=lambda d: (round(width(d), 12), d))
            fine = min((best + i / 50 for i in range(-50, 51)), key=width)
            assert got[k].least_width == pytest.approx(width(fine), abs=1e-9) and got[k].cross_width == pytest.approx(width(fine + 90), abs=1e-6)
            assert got[k].n == len(p)
