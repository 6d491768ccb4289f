"""Plane patches, poses from planes, adjustment of several scans."""

import math

import numpy as np
import pandas as pd
import pytest

from silvaquery.operators import planes as pl
from silvaquery.operators.registration import turned

#: Corner, two sides: a floor, three walls, a slanted roof and a small board.
FACES = [([0, 0, 0], [6, 0, 0], [0, 5, 0]), ([0, 0, 0], [6, 0, 0], [0, 0, 3]), ([0, 0, 0], [0, 5, 0], [0, 0, 3]), ([6, 0, 0], [0, 5, 0], [0, 0, 2]), ([0, 5, 2.2], [6, 0, 0], [0, -2, 0.8]), ([2, 3, 0.6], [1.2, 0, 0], [0, 0.9, 0.5])]


def room(seed=1, per=900, noise=0.004):
    rng, out = np.random.default_rng(seed), []
    for corner, u, v in FACES:
        a, b = rng.random((2, int(per * np.linalg.norm(np.cross(u, v)) / 6) + 300, 1))
        out.append(np.array(corner) + a * u + b * v + rng.normal(0, noise, (len(a), 3)))
    return np.vstack(out)


def pose(yaw, shift, tilt=0.0):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = turned(np.array([tilt, 0, 0])) @ turned(np.array([0, 0, math.radians(yaw)])), shift
    return m


def seen_from(p, m):
    """Points in the frame of a scanner that stands at pose ``m``."""
    return (p - m[:3, 3]) @ m[:3, :3]


def cloud(spark, p, scan="s"):
    return spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(scan=scan))


HERE, THERE = pose(0, [3, 2, 1.5]), pose(73, [4, 3, 1.2])


def test_patches_are_the_faces(spark):
    p = seen_from(room(), HERE)
    got = pl.plane_patches(cloud(spark, p), cell=0.4, by=("scan",)).toPandas()
    want = []
    for corner, u, v in FACES:
        n = np.cross(u, v) / np.linalg.norm(np.cross(u, v))
        c = seen_from(np.array([corner], float) + 0.5 * np.array(u) + 0.5 * np.array(v), HERE)[0]
        want.append((c, n if n @ c < 0 else -n))
    assert len(got) == len(FACES)
    for c, n in want:
        near = got[(np.abs(got[["nx", "ny", "nz"]].to_numpy() @ n - 1) < 0.002)]
        gap = np.abs((near[["cx", "cy", "cz"]].to_numpy() - c) @ n)
        assert (gap < 0.02).sum() == 1
    assert (got["std"] < 0.03).all() and ((got[["nx", "ny", "nz"]].to_numpy() * got[["cx", "cy", "cz"]].to_numpy()).sum(1) < 0).all()
    floor = got[got["nz"] > 0.99].iloc[0]
    assert floor["length"] == pytest.approx(6, abs=0.6) and floor["width"] == pytest.approx(5, abs=0.6)


def test_no_patches_in_a_ball_or_nothing(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(size=(4000, 3))
    ball = d / np.linalg.norm(d, axis=1, keepdims=True) * 1.5
    assert pl.plane_patches(cloud(spark, ball), cell=0.5, max_std=0.03).count() == 0
    assert pl.plane_patches(cloud(spark, ball).limit(0)).count() == 0


@pytest.mark.parametrize(("levelled", "tilt"), [(True, 0.0), (False, 0.3)])
def test_pose_from_planes(spark, levelled, tilt):
    """Another sampling of the same room from another place, turned by 73 degrees."""
    there = pose(73, [4, 3, 1.2], tilt)
    a = pl.plane_patches(cloud(spark, seen_from(room(1), HERE)), cell=0.4)
    b = pl.plane_patches(cloud(spark, seen_from(room(5), there)), cell=0.4)
    got = pl.plane_pose(b, a, levelled=levelled)
    m = np.array(got["matrix"]).reshape(4, 4)
    want = np.linalg.inv(HERE) @ there
    assert len(got["pairs"]) >= 5 and got["rmse"] < 0.02
    assert np.allclose(m[:3, :3], want[:3, :3], atol=0.01) and np.allclose(m[:3, 3], want[:3, 3], atol=0.03)
    assert pl.plane_pose(a.limit(2), b) is None


def test_three_walls_recover_a_known_pose(spark):
    n = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    c = np.array([[-2, 0.3, 0.1], [0.2, -3, 0.4], [0.1, 0.2, -1.5]])
    want = pose(25, [0.4, -0.3, 0.2], 0.1)
    back = np.linalg.inv(want)
    kind = "patch string, cx double, cy double, cz double, nx double, ny double, nz double, n long"
    rows = lambda c, n: spark.createDataFrame([(str(i), *map(float, x), *map(float, y), 500 + i) for i, (x, y) in enumerate(zip(c, n))], kind)
    got = pl.plane_pose(rows(c @ back[:3, :3].T + back[:3, 3], n @ back[:3, :3].T), rows(c, n))
    assert np.allclose(got["matrix"], want.ravel(), atol=1e-9) and sorted(got["pairs"]) == [("0", "0"), ("1", "1"), ("2", "2")]


@pytest.mark.parametrize("keep_level", [True, False])
def test_network_of_planes_and_points(spark, keep_level):
    """Three scans from rough poses: planes and two points bring them together; the first one stays."""
    tilt = 0.0 if keep_level else 0.02
    true = {"a": HERE, "b": pose(73, [4, 3, 1.2], tilt), "c": pose(-40, [2, 3.5, 1.7], -tilt)}
    rough = {"a": true["a"], "b": pose(2, [0.05, -0.04, 0.03]) @ true["b"], "c": pose(-1.5, [-0.06, 0.02, -0.03]) @ true["c"]}
    scans = None
    for i, (s, m) in enumerate(true.items()):
        scans = cloud(spark, seen_from(room(i), m), s) if scans is None else scans.unionByName(cloud(spark, seen_from(room(i), m), s))
    own = pl.plane_patches(scans, cell=0.4, by=("scan",)).toPandas()
    world = own.copy()
    for s, m in rough.items():
        at = own["scan"] == s
        world.loc[at, ["cx", "cy", "cz"]] = own.loc[at, ["cx", "cy", "cz"]].to_numpy() @ m[:3, :3].T + m[:3, 3]
        world.loc[at, ["nx", "ny", "nz"]] = own.loc[at, ["nx", "ny", "nz"]].to_numpy() @ m[:3, :3].T
    pairs = pl.paired(spark.createDataFrame(world)).toPandas()
    assert len(pairs) >= 15
    by = own.set_index(["scan", "patch"])
    rows = []
    for r in pairs.itertuples():
        p, q = by.loc[(r.a_scan, r.a_patch)], by.loc[(r.b_scan, r.b_patch)]
        rows.append((r.a_scan, r.b_scan, *p[["cx", "cy", "cz"]], *q[["cx", "cy", "cz"]], *p[["nx", "ny", "nz"]], *q[["nx", "ny", "nz"]], float(min(p["width"], q["width"]))))
    for x in ([1.0, 1.0, 1.0], [4.0, 3.0, 0.5]):
        for s, t in (("a", "b"), ("b", "c")):
            rows.append((s, t, *seen_from(np.array([x]), true[s])[0], *seen_from(np.array([x]), true[t])[0], *[None] * 7))
    rows = [tuple(None if v is None else v if isinstance(v, str) else float(v) for v in r) for r in rows]
    got = pl.adjust_poses(spark.createDataFrame(rows, pl.CORRESPONDENCE), {s: m.ravel().tolist() for s, m in rough.items()}, keep_level=keep_level)
    assert np.allclose(got["poses"]["a"], HERE.ravel()) and got["rmse"] < 0.02
    for s in "bc":
        m = np.array(got["poses"][s]).reshape(4, 4)
        assert np.allclose(m[:3, 3], true[s][:3, 3], atol=0.02) and np.allclose(m[:3, :3], true[s][:3, :3], atol=0.01)


def test_operations_find_planes_and_adjust_by_them(spark, tmp_path):
    """Two scans on disk without any sphere: targets has the planes, msa brings the second scan home, from nearby and from a turn of 73 degrees."""
    from silvaquery.plans import catalogue as c

    c.run(spark, "project.create", {"folder": str(tmp_path), "name": "p"})
    c.run(spark, "project.open", {"folder": str(tmp_path)})
    ids = []
    for i, m in enumerate((HERE, THERE)):
        p = seen_from(room(i), m)
        (tmp_path / f"{i}.csv").write_text("x,y,z\n" + "".join(f"{x:.4f},{y:.4f},{z:.4f}\n" for x, y, z in p))
        ids.append(c.run(spark, "preprocess.import", {"sourcePath": f"{tmp_path}/{i}.csv"})["id"])
    flat = {"voxelSize": 0.4}
    near = pose(2, [0.05, -0.04, 0.03]) @ THERE
    for given in (near, np.eye(4)):
        c.run(spark, "preprocess.apply", {"pose": HERE.ravel().tolist(), "scan": ids[0]})
        c.run(spark, "preprocess.apply", {"pose": given.ravel().tolist(), "scan": ids[1]})
        got = c.run(spark, "preprocess.targets", {"scan": ids[0], "planes": flat, "spheres": {"minPoints": 100_000}})
        assert got["spheres"] == [] and got["planes"].count() == len(FACES)
        got = c.run(spark, "preprocess.msa", {"planes": flat, "spheres": {"minPoints": 100_000}, "apply": True})
        now = np.array(next(s for s in c._scans(None)[1] if s["id"] == ids[1])["poses"]["pose"]).reshape(4, 4)
        assert got["rmse"] < 0.02 and np.allclose(now[:3, 3], THERE[:3, 3], atol=0.03) and np.allclose(now[:3, :3], THERE[:3, :3], atol=0.01)
    with pytest.raises(TypeError, match="unknown plane"):
        c.run(spark, "preprocess.targets", {"scan": ids[0], "planes": {"voxels": 1}})
