"""Matching, alignment, stems, sections, tiles and transfer: copies in one place are one row of what tasks hold."""

import numpy as np
from pyspark.sql import functions as F

from silvaquery.functions import circle
from silvaquery.operators import branches as br
from silvaquery.operators import forestry as fo
from silvaquery.operators import neighbours as ne
from silvaquery.operators import registration as rg
from silvaquery.operators import segmentation as sg
from silvaquery.operators import trees as tr


def test_alignment_votes_by_place(spark, monkeypatch):
    seen, own = [], ne.radius_pairs
    monkeypatch.setattr(ne, "radius_pairs", lambda left, right, *a, **k: seen.append((left.count(), right.count())) or own(left, right, *a, **k))
    t = spark.range(300).select("id", (F.col("id") % 3 * 7.0).alias("x"), (F.col("id") % 3 * F.col("id") % 3 * 5.0).alias("y"))
    got = rg.align_stems(t, t.withColumns({"x": F.col("x") + 2, "y": F.col("y") - 1}), 3.0, allow_rotation=False)
    assert got["votes"] == 300 and abs(got["dx"] - 2) < 1e-9 and abs(got["dy"] + 1) < 1e-9
    assert max(seen[0]) < 10


def test_growth_and_detection_collect_no_inventory(spark, monkeypatch):
    t = ne.cut_lineage(spark.range(50).select(F.col("id").alias("tree_id"), (F.col("id") * 5.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.3).alias("dbh"), F.lit(20.0).alias("height"), F.lit(0.07).alias("basal_area")))
    plans, own = [], fo.growth_summary
    monkeypatch.setattr(fo, "growth_summary", lambda *a: plans.extend(d._jdf.queryExecution().executedPlan().toString() for d in a[:3]) or own(*a))
    fo.matched_growth(t, t, 1.0)
    plans.append(fo.found_by_place(t, t, 1.0, (0.05,))[1]._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_tiles_hold_cells(spark, monkeypatch):
    seen, own = [], sg.tiled
    monkeypatch.setattr(sg, "tiled", lambda df, *a: seen.append(df.count()) or own(df, *a))
    p = spark.range(4000).select(F.col("id").alias("point_id"), (F.col("id") % 4 * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("y"), F.when(F.col("id") < 2000, 0.0).otherwise(10.0).alias("z")).withColumn("hag", F.col("z"))
    for got in (sg.classify_ground(p, 1.0), sg.classify_cloth(p, 1.0)):
        assert {(r.cls, r["count"]) for r in got.groupBy("cls").count().collect()} == {(1, 2000), (2, 2000)}
    assert {(r.tree_id > 0, r["count"]) for r in sg.segment_chm(p, 1.0).groupBy("tree_id").count().collect()} == {(True, 2000), (False, 2000)}
    assert seen == [20, 20, 20]


def test_circles_count_what_a_row_stands_for():
    w = np.linspace(0, 6, 40)
    x, y, m = 3 + 0.2 * np.cos(w), 0.2 * np.sin(w), np.full(40, 50)
    got = circle.ransac(x, y, 0.01, 100, 1000, 3, m)
    assert abs(got[2] - 0.2) < 1e-6 and got[3] == 2000
    assert circle.ransac(x, y, 0.01, 100, 1000, 3) is None


def test_stems_of_many_copies(spark):
    p = spark.range(8000).withColumn("w", F.col("id") % 40 * 0.15).select(F.lit(1).alias("tree_id"), (0.2 * F.cos("w")).alias("x"), (0.2 * F.sin("w")).alias("y"), F.lit(2.0).alias("z"), F.lit(2.0).alias("hag"))
    r = tr.fit_stems(p).first()
    assert abs(r.dbh - 0.4) < 1e-6 and r.band_count == 8000 and r.inlier_count == 8000


def test_sections_by_place(spark):
    p = spark.range(600).withColumn("w", F.col("id") % 6 * 1.0).select(F.lit(1).alias("branch"), (0.1 * F.cos("w")).alias("x"), (0.1 * F.sin("w")).alias("y"), F.lit(0.0).alias("z"))
    axes = spark.createDataFrame([("c", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "click string, branch int, x double, y double, z double, mx double, my double, mz double, ax double, ay double, az double")
    assert sorted(r.m for r in br.section_places(axes, p).collect()) == [100] * 6
    assert br.sections(axes, p).count() == 600


def test_transfer_asks_each_place_once(spark, monkeypatch):
    seen, own = [], ne.k_nearest
    monkeypatch.setattr(ne, "k_nearest", lambda left, *a: seen.append(left.count()) or own(left, *a))
    p = spark.range(900).select(F.col("id").alias("point_id"), (F.col("id") % 3 * 1.0).alias("x"), F.lit(0.5).alias("y"), F.lit(0.0).alias("z"))
    sk = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 1, 2.0, 1.0, 0.0)], "tree_id int, branch_order int, x double, y double, z double")
    got = sg.transfer_labels(p, sk, 0.6, hull=[])
    assert {(r.tree_id, r.semantic, r["count"]) for r in got.groupBy("tree_id", "semantic").count().collect()} == {(1, 1, 300), (1, 0, 300), (2, 2, 300)}
    assert seen == [3]
