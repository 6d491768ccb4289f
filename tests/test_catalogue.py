"""The catalogue over datasets on disk, and recipes."""

import pytest

from silvaquery.plans import catalogue as c
from silvaquery.plans.recipes import run_recipe


def make(spark, folder):
    (folder / "in.csv").write_text("x,y,z,tree_id,classification\n" + "".join(f"{i % 20 * 0.5},{i // 20 * 0.5},{10 + (i % 5)},{i % 3},{2 if i % 5 == 0 else 1}\n" for i in range(200)))
    c.run(spark, "project.create", {"folder": str(folder), "name": "p"})
    c.run(spark, "project.open", {"folder": str(folder)})
    return c.run(spark, "dataset.import", {"srcPath": f"{folder}/in.csv", "name": "a"})


def test_names_and_parameters(spark):
    assert len(c.OPS) == 89
    with pytest.raises(KeyError):
        c.run(spark, "no.such")
    with pytest.raises(TypeError):
        c.run(spark, "dataset.info", {"octreDir": "x"})
    with pytest.raises(TypeError):
        c.run(spark, "dataset.info", {})


def test_parameters_without_effect_are_refused(spark):
    for name in c.OPS:
        for k in c.idle(name):
            plain = c.parameters(name)[k]
            if plain is c.inspect.Parameter.empty:
                raise AssertionError(f"{name} does not read {k}, which it asks for")
            other = not plain if isinstance(plain, bool) else "something else"
            camel = "".join(w if not i else w.capitalize() for i, w in enumerate(k.split("_")))
            need = {"".join(w if not i else w.capitalize() for i, w in enumerate(q.split("_"))): "/none" for q, v in c.parameters(name).items() if v is c.inspect.Parameter.empty}
            with pytest.raises(ValueError, match="not supported"):
                c.run(spark, name, need | {camel: other})


def test_datasets(spark, tmp_path):
    d = make(spark, tmp_path)
    assert c.run(spark, "project.datasets") == [d] and c.run(spark, "project.current") == str(tmp_path)
    assert c.run(spark, "dataset.info", {"octreeDir": d})["n_points"] == 200
    s = c.run(spark, "export.subset", {"srcDir": d, "name": "s", "filter": {"z": [11, 12]}})
    assert c.run(spark, "dataset.info", {"octreeDir": s})["n_points"] == 80
    assert c.run(spark, "dataset.downsample", {"srcDir": d, "name": "v", "voxelSize": 2.0}).endswith("/v")
    c.run(spark, "transfer.shift", {"octreeDir": s, "dx": 5.0, "dy": 0.0})
    assert c.run(spark, "dataset.info", {"octreeDir": s})["min_x"] == 5.5
    c.run(spark, "segment.reset", {"octreeDir": s, "attr": "treeId"})
    assert c.run(spark, "metrics.summary", {"octreeDir": s}).count() == 1
    c.run(spark, "dataset.remove", {"octreeDir": s})
    with pytest.raises(FileNotFoundError):
        c.run(spark, "dataset.info", {"octreeDir": s})


def test_review_and_exports(spark, tmp_path):
    d = make(spark, tmp_path)
    assert c.run(spark, "review.setSpecies", {"octreeDir": d, "species": {"1": "pine"}}) == {"1": "pine"}
    assert c.run(spark, "review.setSpecies", {"octreeDir": d, "species": {"2": "birch"}}) == {"1": "pine", "2": "birch"}
    assert c.run(spark, "review.setSpecies", {"octreeDir": d, "species": {"2": "oak"}, "replace": True}) == {"2": "oak"}
    c.run(spark, "review.setPlot", {"octreeDir": d, "boundary": {"kind": "circular", "center": [5, 2], "radius": 4}})
    c.run(spark, "ground.normalize", {"octreeDir": d, "cellSize": 5.0})
    assert c.run(spark, "metrics.plot", {"octreeDir": d}).count() == 1
    assert c.run(spark, "qc.flags", {"octreeDir": d}).filter("code = 'no-dbh'").count() >= 1
    v = {r: c.run(spark, "ground.volume", {"octreeDir": d, "cellSize": 1.0, "reference": r, **({"planeZ": 12.0} if r == "plane" else {})}).first() for r in ("rim", "plane", "lowest", "dtm")}
    assert all(x.cells > 0 for x in v.values()) and v["lowest"].max_below == 0.0 and v["plane"].net != v["lowest"].net
    with pytest.raises(ValueError):
        c.run(spark, "ground.volume", {"octreeDir": d, "reference": "plane"})
    t = c.run(spark, "ground.terrain", {"octreeDir": d, "cellSize": 1.0})
    assert {"dtm", "chm", "slope", "tpi", "tri", "hli", "profile_curvature", "stream", "accumulation"} <= set(t.columns) and t.count() > 0
    assert c.run(spark, "ground.contours", {"octreeDir": d, "cellSize": 1.0}).columns == ["level", "index", "length", "line"]
    assert not c.run(spark, "run.status", {"stage": "metrics.trees"})
    q = c.run(spark, "qc.points", {"octreeDir": d, "params": {"reflMin": 0, "reflMax": 70000, "outlierRadiusMax": 2.0}})
    assert q.count() == 200 and "point_quality" in c.points_of(spark, d).columns
    assert c.run(spark, "change.voxels", {"octreeDir": d, "referenceDir": d}).first().appeared == 0
    assert c.run(spark, "export.geometry", {"octreeDir": d, "points": [[0, 0], [3, 4]]})["length_2d"] == 5.0
    for k in c.run(spark, "export.mesh", {"octreeDir": d, "cellSize": 0.5}):
        assert (tmp_path / "a" / k.rsplit("/", 1)[-1]).stat().st_size > 100
    c.run(spark, "export.report", {"octreeDir": d, "outPath": f"{tmp_path}/r.html"})
    assert "<svg" in (tmp_path / "r.html").read_text()
    c.run(spark, "export.csv", {"octreeDir": d, "outPath": f"{tmp_path}/trees"})
    assert any((tmp_path / "trees").glob("part-*"))


def test_recipe(spark, tmp_path):
    make(spark, tmp_path)
    recipe = {"steps": [{"op": "dataset.import", "params": {"srcPath": "{{source}}", "name": "{{plot}}"}}, {"op": "ground.normalize", "params": {"octreeDir": "{{dataset}}"}}, {"op": "export.las", "params": {"octreeDir": "{{dataset}}", "outPath": "x", "geoid": "y"}, "optional": True}, {"op": "metrics.summary", "params": {"octreeDir": "{{dataset}}"}, "as": "summary"}]}
    got = run_recipe(spark, recipe, [{"plot": "one", "source": f"{tmp_path}/in.csv"}, {"plot": "two", "source": f"{tmp_path}/none.csv"}])
    assert [g["ok"] for g in got] == [True, False] and len(got[1]["steps"]) == 1
    with pytest.raises(KeyError):
        run_recipe(spark, {"steps": [{"op": "x.y"}]}, [])


def test_terrain_with_a_pit_free_surface(spark, tmp_path):
    d = make(spark, tmp_path)
    p2r, free = (c.run(spark, "ground.terrain", {"octreeDir": d, "cellSize": 1.0, "dsmMethod": m}) for m in ("p2r", "pit_free"))
    assert p2r.columns == free.columns
    a, b = ({(r["col"], r["row"]): r.chm for r in t.collect() if r.chm is not None} for t in (p2r, free))
    # No cell of the surface lies lower than its own points' tops by more than triangles between them allow.
    assert len(b.keys() & a.keys()) > 0.8 * len(a) and max(b.values()) <= max(a.values()) + 1e-6
    with pytest.raises(ValueError, match="unknown method"):
        c.run(spark, "ground.terrain", {"octreeDir": d, "dsmMethod": "tin"})


def test_voxel_change_is_written_by_default(spark, tmp_path):
    d = make(spark, tmp_path)
    s = c.run(spark, "export.subset", {"srcDir": d, "name": "s", "filter": {"x": [0, 5]}})
    got = c.run(spark, "change.voxels", {"octreeDir": d, "referenceDir": s, "voxelSize": 1.0}).first()
    marked = [(r.x, r.voxel_change) for r in c.points_of(spark, d).select("x", "voxel_change").collect()]
    assert got.appeared > 0 and len(marked) == 200
    assert {v for x, v in marked if x <= 5} == {0} and {v for x, v in marked if x >= 7} == {1}
    with pytest.raises(ValueError, match="0.04"):
        c.run(spark, "segment.forest", {"octreeDir": d, "voxel": 0.01})


def test_las_above_a_geoid(spark, tmp_path):
    """Heights less undulations between the middles of a grid's cells; a grid that is too small is refused."""
    import pandas as pd

    from silvaquery.sources import formats as fm
    from silvaquery.sources import scans as sc

    d = make(spark, tmp_path)
    g = pd.DataFrame([(i, j, 20 + 0.5 * i + 0.25 * j) for i in range(-2, 8) for j in range(-2, 8)], columns=["col", "row", "v"])
    (tmp_path / "geoid.asc").write_text(fm.esri_ascii(g, 2.0, "v"))
    c.run(spark, "export.las", {"octreeDir": d, "outPath": f"{tmp_path}/out", "geoid": f"{tmp_path}/geoid.asc"})
    got = sorted((round(r.x, 2), round(r.y, 2), round(r.z, 3)) for r in sc.read_records(spark, f"{tmp_path}/out").collect())
    want = sorted((round(r.x, 2), round(r.y, 2), round(r.z - (20 + 0.5 * (r.x / 2 - 0.5) + 0.25 * (r.y / 2 - 0.5)), 3)) for r in c.points_of(spark, d).collect())
    assert len(got) == 200 and all(abs(a - b) < 0.0011 for p, q in zip(got, want) for a, b in zip(p, q))
    (tmp_path / "small.asc").write_text(fm.esri_ascii(g[(g["col"] < 3)], 2.0, "v"))
    with pytest.raises(ValueError, match="lie beyond"):
        c.run(spark, "export.las", {"octreeDir": d, "outPath": f"{tmp_path}/out2", "geoid": f"{tmp_path}/small.asc"})
