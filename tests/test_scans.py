"""Point files read in pieces."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaquery.plans import catalogue as c
from silvaquery.sources import formats as fm
from silvaquery.sources import scans as sc


def cloud(spark, n=5000):
    rng = np.random.default_rng(1)
    p = np.column_stack([500_000 + rng.random(n) * 50, 6_800_000 + rng.random(n) * 50, 100 + rng.random(n) * 20]).round(3)
    return spark.createDataFrame([(*map(float, v), i % 60_000, i % 9, i % 4, i * 7, i % 3 + 1) for i, v in enumerate(p)], "x double, y double, z double, intensity int, cls int, return_no int, tree_id int, point_source_id int")


COLS = ["x", "y", "z", "intensity", "cls", "return_no", "tree_id"]


def rows(df):
    return sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.select(*COLS).collect())


def test_one_las_file_is_many_tasks(spark, tmp_path):
    p = cloud(spark)
    fm.write_las(p.coalesce(1), f"{tmp_path}/las")
    whole = sc.read_records(spark, f"{tmp_path}/las", range_bytes=10_000)
    n = whole.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(n) == -(-5000 // (10_000 // 24)) and max(r["count"] for r in n) <= 10_000 // 24
    assert rows(whole) == rows(p) == rows(fm.read_points(spark, f"{tmp_path}/las/*.las"))
    assert sc.read_records(spark, f"{tmp_path}/las", range_bytes=1).count() == 5000


def test_las_of_other_formats_and_broken_ones(spark, tmp_path):
    """LAS 1.4, point format 6, whose counts are 64 bits and whose bits are laid out anew."""
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<I", head, 96, 400)
    struct.pack_into("<BHI", head, 104, 6, 30, 0)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.1, 10.0, 20.0, 30.0)
    struct.pack_into("<Q", head, 247, 3)
    body = b"".join(struct.pack("<iiiHBBBBhHd", 100 * i, 200, 5, 9, 0x52, 0, 40 + i, 0, 0, 0, 0.0) for i in range(3))
    (tmp_path / "a.las").write_bytes(bytes(head) + b"\0" * 25 + body)
    assert rows(fm.read_points(spark, f"{tmp_path}/a.las")) == [(10.0 + i, 22.0, 30.5, 9, 40 + i, 2, 0) for i in range(3)]
    (tmp_path / "b.las").write_bytes(bytes(head) + b"\0" * 25 + body[:-5])
    with pytest.raises(Exception, match="ends before its last record"):
        fm.read_points(spark, f"{tmp_path}/b.las").collect()
    (tmp_path / "c.las").write_bytes(b"no")
    with pytest.raises(ValueError, match="not a LAS"):
        fm.read_points(spark, f"{tmp_path}/c.las")
    with pytest.raises(FileNotFoundError):
        fm.read_points(spark, f"{tmp_path}/d.las")


@pytest.mark.parametrize("order", ["little", "big"])
def test_binary_ply_in_ranges(spark, tmp_path, order):
    kind = "<" if order == "little" else ">"
    rec = np.zeros(100, np.dtype([("x", kind + "f8"), ("red", "u1"), ("y", kind + "f8"), ("z", kind + "f4"), ("class", "u1")]))
    rec["x"], rec["y"], rec["z"], rec["class"] = np.arange(100) / 4, 3, np.arange(100), 5
    head = f"ply\nformat binary_{order}_endian 1.0\nelement vertex 100\nproperty double x\nproperty uchar red\nproperty double y\nproperty float z\nproperty uchar class\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.encode() + rec.tobytes())
    got = sc.read_records(spark, f"{tmp_path}/a.ply", range_bytes=300)
    assert got.rdd.getNumPartitions() > 5
    assert rows(got) == [(i / 4, 3.0, float(i), 0, 5, 0, 0) for i in range(100)]


def ptx(spots, seed=2):
    """Text of a PTX file: scans of some columns and rows at poses; a third of the rays have no return."""
    rng, text, want = np.random.default_rng(seed), "", []
    for k, (cols, rows_, yaw, shift) in enumerate(spots):
        r = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = r, shift
        text += f"{cols}\n{rows_}\n" + "".join("%g %g %g\n" % tuple(v) for v in (shift, *r.T)) + "".join("%.12g %.12g %.12g %.12g\n" % tuple(v) for v in m.T)
        for _ in range(cols * rows_):
            p = np.round(rng.random(3) * 9 + 0.5, 4) if rng.random() > 1 / 3 else np.zeros(3)
            i = round(rng.random(), 3)
            text += "%.4f %.4f %.4f %.3f\n" % (*p, i)
            if p.any():
                want.append((k, *np.round(r @ p + shift, 5), round(i * 65535)))
    return text, sorted(want)


@pytest.mark.parametrize("range_bytes", [97, 1000, 1 << 20])
def test_ptx_by_ranges_of_bytes(spark, tmp_path, range_bytes):
    """Ranges that begin in headers and in lines, several scans in a file."""
    text, want = ptx([(7, 5, 0.3, (10.0, 20.0, 1.0)), (1, 1, 0.0, (0.0, 0.0, 0.0)), (6, 11, -1.2, (-5.0, 3.0, 2.5))])
    (tmp_path / "a.ptx").write_text(text)
    got = sc.read_ptx(spark, f"{tmp_path}/a.ptx", range_bytes=range_bytes)
    out = sorted((r.scan, r.x, r.y, r.z, r.intensity) for r in got.collect())
    assert len(out) == len(want) and np.allclose(np.array(out, float), np.array(want, float), atol=2e-5)


def test_scans_of_a_project(spark, tmp_path):
    """Each scan of a PTX file is a scan position with its own pose; exports number them."""
    text, want = ptx([(7, 5, 0.3, (10.0, 20.0, 1.0)), (6, 11, -1.2, (-5.0, 3.0, 2.5))])
    (tmp_path / "a.ptx").write_text(text)
    c.run(spark, "project.create", {"folder": str(tmp_path), "name": "p"})
    c.run(spark, "project.open", {"folder": str(tmp_path)})
    new = c.run(spark, "preprocess.import", {"sourcePath": f"{tmp_path}/a.ptx"})
    assert [s["section"] for s in new] == [0, 1] and c.run(spark, "preprocess.scans") == [s["id"] for s in new]
    for k, s in enumerate(new):
        got = sorted((r.x, r.y, r.z) for r in c._scan_points(spark, None, s["id"]).collect())
        assert np.allclose(got, sorted(w[1:4] for w in want if w[0] == k), atol=2e-5)
    c.run(spark, "preprocess.export", {"format": "ptx", "id": new[0]["id"], "scanPositionIds": [s["id"] for s in new], "outPath": f"{tmp_path}/out"})
    assert sc.read_records(spark, f"{tmp_path}/out/*.las").count() == len(want)
    d = c.run(spark, "dataset.import", {"srcPath": f"{tmp_path}/a.ptx", "name": "whole"})
    assert c.run(spark, "dataset.info", {"octreeDir": d})["n_points"] == len(want)


def test_las_in_and_out_of_a_dataset(spark, tmp_path):
    p = cloud(spark, 800)
    fm.write_las(p.repartition(3), f"{tmp_path}/src")
    one = next(f for f in sorted((tmp_path / "src").glob("*.las")))
    c.run(spark, "project.create", {"folder": str(tmp_path), "name": "p"})
    c.run(spark, "project.open", {"folder": str(tmp_path)})
    d = c.run(spark, "dataset.import", {"srcPath": f"{tmp_path}/src/*.las", "name": "a"})
    assert rows(c.points_of(spark, d)) == rows(p)
    c.run(spark, "transfer.shift", {"octreeDir": d, "dx": 0.0004, "dy": 0.0})
    c.run(spark, "dataset.realignToSource", {"lasPath": str(one), "octreeDir": d})
    assert rows(c.points_of(spark, d)) == rows(p)


def test_delimiters_inside_quotes_do_not_count():
    assert fm.sniff('name;x;y\n"a,b,c,d,e";1.5;2\n"f,g,h,i,j";3.5;4\n') == (";", False)
    assert fm.sniff('name,x,y\n"a;b;c;""d;e",1.5,2\n') == (",", False)
