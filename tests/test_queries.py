"""Every query that has SQL against DuckDB on the small tables; the others for rows and a stable schema."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from silvaquery.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and {"tree_id", "n"} <= set(got.columns)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, duck, name):
    a, b = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.SQL[name]).df()
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        same = (a[c].to_numpy() == b[c].to_numpy()) | (a[c].isna().to_numpy() & b[c].isna().to_numpy())
        assert same.all(), (name, c, a[c][~same].head(), b[c][~same].head())


@pytest.mark.parametrize("name", ["rescan_advice", "ground_classify", "terrain_flow", "segment_chm", "match_optimal"])
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_dbscan_clusters_takes_all_points(spark):
    from silvaquery.sources import adapters as ad

    p = ad.points(spark, SF).select("point_id", "x", "y", "z").toPandas()
    xyz = p[["x", "y", "z"]].to_numpy()
    near = np.concatenate([((xyz[at:at + 500, None] - xyz[None]) ** 2).sum(2) <= 1.0 for at in range(0, len(xyz), 500)])
    core = near.sum(1) >= 4
    want = set(p.point_id[(near & core[None]).any(1)])
    assert {r.point_id for r in plans.QUERIES["dbscan_clusters"](spark, SF).collect()} == want


def test_change_register_takes_all_points(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(plans.rg, "icp", lambda moving, reference, *a, **k: seen.append((moving.count(), reference.count())) or {"matrix": [0.0] * 16})
    plans.QUERIES["change_register"](spark, SF)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert seen == [(n, n)]


@pytest.mark.parametrize("name, operator", [("rescan_advice", "slices"), ("virtual_caliper", "caliper")])
def test_stem_queries_take_all_points(spark, monkeypatch, name, operator):
    seen, own = [], getattr(plans.tr, operator)
    monkeypatch.setattr(plans.tr, operator, lambda points, *a: seen.append(points.count()) or own(points, *a))
    assert plans.QUERIES[name](spark, SF).count() > 0
    assert seen == [spark.read.parquet(f"{SF}/lineitem.parquet").count()]
