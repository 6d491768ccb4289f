"""Points in one place are searched once: what reaches the tasks grows with places, not with copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaquery.operators import blocks as bl
from silvaquery.operators import neighbours as ne


@pytest.fixture
def rows(monkeypatch):
    seen, own = [], bl.searched
    monkeypatch.setattr(bl, "searched", lambda left, right, *a, **k: seen.append((left.count(), right.count())) or own(left, right, *a, **k))
    return seen


@pytest.fixture(scope="module")
def copies(spark):
    """Three near places of 400 points each, and a lone point."""
    p = spark.range(1201).withColumn("k", F.when(F.col("id") < 1200, F.col("id") % 3).otherwise(50))
    return ne.cut_lineage(p.select(F.col("id").alias("point_id"), (F.col("k") * 0.5).alias("x"), (F.col("k") * F.col("k") * 0.1).alias("y"), F.lit(1.0).alias("z")))


def test_searches_go_by_place(copies, rows):
    assert ne.clean_radius(copies, 0.2, 399).count() == 1200
    assert ne.clean_radius(copies, 0.2, 400).count() == 0
    assert ne.clean_sor(copies, 8, 1.0).count() == 1200
    assert {(r.point_id, r.n) for r in ne.shape_features(copies, 0.6, 4).collect()} == {(i, 1200 if i % 3 == 1 else 800) for i in range(1200)}
    assert {r.cluster for r in ne.dbscan(copies, 0.7, 500).collect()} == {0}
    assert ne.leaf_wood(copies, 2.0, least=4).filter("semantic = 1").count() == 1200
    cores = copies.filter("point_id = 0").select(F.col("point_id").alias("core"), "x", "y", "z")
    assert [(r.n_ref, r.n_now) for r in ne.m3c2(cores, copies, copies, 4.0, 4.0).collect()] == [(1200, 1200)]
    assert rows and max(r for pair in rows for r in pair) <= 4


def test_quality_of_dense_trees_is_seen_by_cell(copies, rows):
    p = copies.withColumns({"tree_id": F.lit(1), "hag": F.col("z"), "refl": F.lit(0.0), "scan": (F.col("point_id") % 7).cast("int")})
    got = {r.label: r["count"] for r in ne.point_quality(p, outlier_radius_min=4.0, outlier_radius_max=6.0, wind_radius_min=4.0, wind_radius_max=6.0).groupBy("label").count().collect()}
    assert got == {ne.KEPT: 1200, ne.OUTLIER: 1}
    assert max(left for left, _ in rows) <= 1


def test_pairs_are_not_collected_at_the_driver(spark, copies):
    a, b = ne._ab(copies, "point_id")
    assert "Broadcast" not in ne.radius_pairs(a, b, 0.1)._jdf.queryExecution().executedPlan().toString()


def test_quality_moves_no_keys(copies):
    p = copies.withColumns({"tree_id": F.lit(1), "hag": F.col("z"), "refl": F.lit(0.0), "scan": (F.col("point_id") % 7).cast("int")})
    plan = ne.point_quality(p, outlier_radius_min=4.0, outlier_radius_max=6.0, wind_radius_min=4.0, wind_radius_max=6.0)._jdf.queryExecution().executedPlan().toString()
    assert "point_id" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("method", ["radius", "density"])
def test_quality_is_the_same_with_many_exceptions(spark, monkeypatch, method):
    """Trees, cells and rejected places that are merged, not sent whole, give the same labels, also for copies, missing places and missing scans."""
    rng = np.random.default_rng(3)
    rows = []
    for t, n in ((0, 20), (1, 240), (2, 120), (3, 80), (4, 3)):
        for i in range(n):
            x, y, z = (float(v) for v in np.round(rng.normal(0, 0.12, 3), 2))
            rows.append((f"{t}-{i}", None if i % 60 == 5 else x + 5 * t, y, z, z, t, None if i % 40 == 7 else float(rng.uniform(-22, 5)), None if i % 30 == 11 else i % 4 if t != 3 else 1))
    rows += [(f"copy-{k}-{r[0]}", *r[1:]) for k in range(2) for r in rows[40:70]]
    d = spark.createDataFrame(rows, "point_id string, x double, y double, z double, hag double, tree_id int, refl double, scan int")
    few = {r.point_id: r.label for r in ne.point_quality(d, outlier_method=method, min_tree_points=2).collect()}
    monkeypatch.setattr(bl, "FEW_ROWS", 0)
    many = {r.point_id: r.label for r in ne.point_quality(d, outlier_method=method, min_tree_points=2).collect()}
    assert few == many and len(few) == len(rows) and set(few.values()) == {0, 1, 2, 3, 4}
    # Of a tree with enough points, those without a place have no neighbour.
    assert {few[r[0]] for r in rows if r[1] is None and r[5] in (1, 2, 3) and r[6] is not None and -20 <= r[6] <= 5} == {ne.OUTLIER}
