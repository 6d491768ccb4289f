"""Closed surfaces around voxels."""

import math
import struct

import numpy as np
import pandas as pd
import pytest

from silvaquery.operators import meshes as me


def cloud(spark, p):
    return spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")))


def ball(radius, size):
    """A point in the middle of each cell of a ball."""
    g = (np.stack(np.meshgrid(*[np.arange(-radius - 1, radius + 1, size)] * 3, indexing="ij"), -1).reshape(-1, 3) // size + 0.5) * size
    return g[np.linalg.norm(g, axis=1) <= radius]


def test_one_voxel_is_a_closed_box(spark):
    c, f = me.closed_surface(cloud(spark, [(0.3, 0.3, 0.3)]), 1.0)
    m = me.mesh_measures(c, f)
    assert (m["corners"], m["triangles"], m["border_edges"]) == (8, 12, 0) and m["volume"] > 0
    assert me.mesh_measures(*me.closed_surface(cloud(spark, [(0.3, 0.3, 0.3)]).limit(0), 1.0))["triangles"] == 0


def test_a_ball_is_closed_with_its_volume(spark):
    """No border edge, volume within two in a hundred, also when smoothed."""
    p = cloud(spark, ball(2.0, 0.1))
    want = 4 / 3 * math.pi * 8
    for smooth in (0, 3):
        m = me.mesh_measures(*me.closed_surface(p, 0.1, smooth=smooth))
        assert m["border_edges"] == 0 and m["volume"] == pytest.approx(want, rel=0.02)
    # Smoothing takes the steps away: the area comes near that of the ball.
    rough, fine = (me.mesh_measures(*me.closed_surface(p, 0.1, smooth=s))["area"] for s in (0, 6))
    assert 4 * math.pi * 4 * 0.98 < fine < rough and fine < 1.08 * 4 * math.pi * 4


def test_hollow_and_touching_voxels_stay_closed(spark):
    shell = ball(1.5, 0.25)
    shell = shell[np.linalg.norm(shell, axis=1) > 0.8]
    m = me.mesh_measures(*me.closed_surface(cloud(spark, shell), 0.25))
    assert m["border_edges"] == 0 and m["volume"] == pytest.approx(4 / 3 * math.pi * (1.5**3 - 0.8**3), rel=0.12)
    # Two voxels that meet in an edge, two in a corner.
    assert me.mesh_measures(*me.closed_surface(cloud(spark, [(0.5, 0.5, 0.5), (1.5, 1.5, 0.5), (5.5, 5.5, 5.5), (6.5, 6.5, 6.5)]), 1.0))["border_edges"] == 0


def test_clustering_keeps_it_closed(spark):
    p = cloud(spark, ball(2.0, 0.1))
    whole, few = (me.mesh_measures(*me.closed_surface(p, 0.1, decimate=d)) for d in (0.0, 0.35))
    assert few["border_edges"] == 0 and few["triangles"] < whole["triangles"] / 5
    assert few["volume"] == pytest.approx(whole["volume"], rel=0.08)


def test_files_of_a_mesh(spark, tmp_path):
    from silvaquery.plans import catalogue as c

    rng = np.random.default_rng(1)
    pts = ball(1.0, 0.2)
    (tmp_path / "in.csv").write_text("x,y,z\n" + "".join(f"{x:.3f},{y:.3f},{z:.3f}\n" for x, y, z in np.repeat(pts, 2, axis=0) + rng.normal(0, 0.001, (2 * len(pts), 3))))
    c.run(spark, "project.create", {"folder": str(tmp_path), "name": "p"})
    c.run(spark, "project.open", {"folder": str(tmp_path)})
    d = c.run(spark, "dataset.import", {"srcPath": f"{tmp_path}/in.csv", "name": "a"})
    out = c.run(spark, "export.mesh", {"octreeDir": d, "method": "3d", "cellSize": 0.2, "minPoints": 2, "formats": ["ply", "obj", "stl", "dxf"], "smooth": 1})
    corners, faces = me.closed_surface(c.points_of(spark, d), 0.2, 2, 1)
    n = faces.count()
    ply, obj, stl, dxf = (open(f, "rb").read() for f in out)
    assert f"element face {n}\n".encode() in ply and obj.count(b"\nf ") == n and struct.unpack_from("<I", stl, 80)[0] == n and len(stl) == 84 + 50 * n and dxf.count(b"3DFACE") == n
    v, f = me.arrays(corners, faces)
    assert np.einsum("ij,ij->i", v[f[:, 0]], np.cross(v[f[:, 1]], v[f[:, 2]])).sum() / 6 == pytest.approx(me.mesh_measures(corners, faces)["volume"])
    with pytest.raises(ValueError, match="unknown formats"):
        c.run(spark, "export.mesh", {"octreeDir": d, "formats": ["glb"]})
