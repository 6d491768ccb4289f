"""Neighbourhood operators and others without SQL, against brute force on small clouds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaquery.operators import neighbours as ne
from silvaquery.operators import registration as rg
from silvaquery.operators import segmentation as sg
from silvaquery.operators import trees as tr


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    return np.round(np.vstack([rng.normal(0, 0.5, (120, 3)), rng.normal(4, 0.4, (80, 3)), rng.uniform(-3, 8, (20, 3))]), 6)


@pytest.fixture(scope="module")
def table(spark, cloud):
    return ne.cut_lineage(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "point_id int, x double, y double, z double"))


def distances(p):
    return np.linalg.norm(p[:, None] - p[None], axis=2)


def test_radius_pairs_and_cleaning(cloud, table):
    d = distances(cloud)
    got = {(r.a, r.b) for r in ne.radius_pairs(*ne._ab(table, "point_id"), 0.7).select("a", "b").collect()}
    assert got == set(zip(*map(list, (x.tolist() for x in np.nonzero(d <= 0.7)))))
    kept = {r.point_id for r in ne.clean_radius(table, 0.7, 3).collect()}
    assert kept == set(np.flatnonzero((d <= 0.7).sum(1) - 1 >= 3).tolist())


def test_k_nearest_at_any_distance(spark, cloud, table):
    d = distances(cloud)
    np.fill_diagonal(d, np.inf)
    for reach in (None, 0.01):
        got = {}
        for r in ne.k_nearest(*ne._ab(table, "point_id"), 5, reach, other=True).collect():
            got.setdefault(r.a, []).append((r.distance, r.b))
        for i in range(len(cloud)):
            assert sorted(b for _, b in got[i]) == sorted(np.argsort(d[i], kind="stable")[:5].tolist())
    few = table.filter("point_id < 3")
    assert ne.k_nearest(*ne._ab(few, "point_id"), 5, other=True).count() == 6


def test_outliers_by_neighbours(cloud, table):
    d = distances(cloud)
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, axis=1)[:, :5].mean(1)
    limit = mean.mean() + mean.std()
    assert {r.point_id for r in ne.clean_sor(table, 5, 1.0).collect()} == set(np.flatnonzero(mean <= limit).tolist())


def test_pairs_grow_with_points_not_with_their_square(spark):
    counts = []
    for n in (4000, 8000):
        p = spark.range(n).select(F.col("id").alias("point_id"), *((F.rand(i) * 10).alias(c) for i, c in enumerate("xyz")))
        p = ne.cut_lineage(p)
        counts.append(ne.radius_pairs(*ne._ab(p, "point_id"), ne.usual_reach(p, 8)).count())
    assert counts[1] < 4 * counts[0] and counts[1] < 8000 * 120


def test_shapes_match_eigenvalues(cloud, table):
    d = distances(cloud)
    got = {r.point_id: r for r in ne.shape_features(table, 0.8, 6).collect()}
    for i in range(len(cloud)):
        near = cloud[d[i] <= 0.8]
        assert (i in got) == (len(near) >= 6)
        if i in got:
            e = np.linalg.eigvalsh(np.cov(near.T, bias=True))[::-1]
            assert got[i].linearity == pytest.approx((e[0] - e[1]) / e[0], abs=1e-6) and got[i].scatter == pytest.approx(e[2] / e[0], abs=1e-6)


def test_leaf_and_wood(spark):
    rng = np.random.default_rng(1)
    pole = np.column_stack([np.zeros(100), np.zeros(100), np.linspace(0, 2, 100)])
    ball = rng.normal(5, 0.15, (200, 3))
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.vstack([pole, ball]))], "point_id int, x double, y double, z double")
    got = {r.point_id: r.semantic for r in ne.leaf_wood(p, 0.2, least=5).collect()}
    assert all(got[i] == 1 for i in range(100)) and np.mean([got[i] == 4 for i in range(100, 300)]) > 0.6


def test_dbscan(cloud, table):
    d = distances(cloud) <= 0.5
    core = d.sum(1) >= 5
    label = np.where(core, np.arange(len(cloud)), -1)
    while True:
        new = np.array([min([label[j] for j in np.flatnonzero(d[i] & core)], default=-1) if core[i] else -1 for i in range(len(cloud))])
        if (new == label).all():
            break
        label = new
    want = {i: int(label[i]) if core[i] else int(min(label[j] for j in np.flatnonzero(d[i] & core))) for i in range(len(cloud)) if core[i] or (d[i] & core).any()}
    assert {r.point_id: r.cluster for r in ne.dbscan(table, 0.5, 5).collect()} == want


def brute_quality(rows, refl=(-20.0, 5.0), method="radius", least=3, knn=8, dev=3.0, radius=(0.04, 0.12), wind=(0.03, 0.10), others=(2.0, 1.0), strata=5, floor=50):
    """Tree by tree, stage by stage, as the operator's docstring words it."""
    out = {r[0]: 0 for r in rows}
    for t in {r[5] for r in rows if r[5] > 0}:
        own = [r for r in rows if r[5] == t]
        if len(own) < floor:
            continue
        low, high = min(r[4] for r in own), max(r[4] for r in own)
        mid = {r[0]: (min(strata - 1, int((r[4] - low) / (high - low) * strata)) + 0.5) / strata for r in own}
        at = lambda ends, r: ends[0] + (ends[1] - ends[0]) * min(1.0, max(0.0, (mid[r[0]] - 0.6) / 0.15))
        far = lambda a, b: np.linalg.norm(np.subtract(a[1:4], b[1:4]))
        good = [r for r in own if r[6] is not None and refl[0] <= r[6] <= refl[1]]
        out |= {r[0]: 2 for r in own if r not in good}
        if method == "radius":
            kept = good if len(good) <= least else [r for r in good if sum(far(r, q) <= at(radius, r) for q in good if q is not r) >= least]
        else:
            mean = {r[0]: sorted(d for q in good if 0 < (d := far(r, q)) <= 4 * max(radius))[:knn] for r in good}
            mean = {k: np.mean(v) if v else np.inf for k, v in mean.items()}
            fin = [v for v in mean.values() if np.isfinite(v)]
            kept = good if len(good) <= knn + 1 else [r for r in good if mean[r[0]] <= np.mean(fin) + dev * np.std(fin)]
        out |= {r[0]: 3 for r in good if r not in kept}
        for r in kept:
            seen = {q[7] for q in kept if q[7] != r[7] and far(r, q) <= at(wind, r)}
            moved = len(kept) > 3 and len({q[7] for q in kept}) > 1 and len(seen) < int(at(others, r) + 0.5)
            out[r[0]] = 4 if moved else 1
    return out


@pytest.mark.parametrize("method", ["radius", "density"])
def test_point_quality_against_brute_force(spark, method):
    rng = np.random.default_rng(9)
    rows = []
    for t, n in ((0, 30), (1, 260), (2, 200), (3, 20), (4, 90)):
        for i in range(n):
            p = rng.normal(0, 0.12, 3) + [t * 5, 0, 2]
            rows.append((f"{t}-{i}", *map(float, p), float(p[2] - 1.2), t, None if i % 50 == 7 else float(rng.uniform(-24, 6)), int(rng.integers(0, 4)) if t != 4 else 1))
    d = spark.createDataFrame(rows, "point_id string, x double, y double, z double, hag double, tree_id int, refl double, scan int")
    got = {r.point_id: r.label for r in ne.point_quality(d, outlier_method=method).collect()}
    want = brute_quality(rows, method=method)
    assert got == want and set(want.values()) == {0, 1, 2, 3, 4}
    some = {r.point_id: r.label for r in ne.point_quality(d, outlier_method=method, tree_ids=[2]).collect()}
    assert all(v == (got[k] if k.startswith("2-") else 0) for k, v in some.items())


def test_label_transfer(spark):
    sk = sg.sample_skeletons(spark.createDataFrame([(7, 0, [0.0, 0.0, 0.0], [0.0, 0.0, 2.0]), (8, 1, [3.0, 0.0, 0.0], [3.0, 0.0, 0.5])], "tree_id int, branch_order int, start array<double>, end array<double>"), 0.1)
    assert sk.filter("tree_id = 7").count() == 20 and sk.filter("tree_id = 8").agg(F.max("z")).first()[0] == 0.5
    p = spark.createDataFrame([("near", 0.1, 0.0, 1.0), ("far", 0.9, 0.0, 1.0), ("branch", 3.1, 0.0, 0.2), ("lost", 50.0, 0.0, 0.0), ("six", 0.0, 6.0, 1.0)], "point_id string, x double, y double, z double")
    one = lambda **k: {r.point_id: (r.tree_id, r.semantic) for r in sg.transfer_labels(p, sk, **k).collect()}
    # All skeleton points are on one line, so there is no hull and nothing is gated; the nearest counts at any distance.
    assert one() == {"near": (7, 1), "far": (7, 0), "branch": (8, 2), "lost": (8, 0), "six": (7, 0)}
    assert one(beyond=False)["far"] == (0, 0) and one(beyond=False)["six"] == (0, 0)
    assert one(hull=[(-1, -1), (1, -1), (1, 1), (-1, 1)])["branch"] == (0, 0)


def test_hull_and_stem_alignment(spark):
    rng = np.random.default_rng(10)
    xy = rng.uniform(0, 40, (60, 2))
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "id int, x double, y double").repartition(5)
    hull = np.array(sg.hull_of(t))
    from silvaquery.functions import geometry as ge

    assert sorted(map(tuple, hull)) == sorted(map(tuple, ge.convex_hull(xy)))
    a = np.radians(4.0)
    moved = xy @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + [3.0, -2.0]
    r = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(moved[:50])], "id int, x double, y double")
    got = rg.align_stems(t, r, 10.0)
    assert abs(got["yaw_deg"] - 4.0) < 0.3 and abs(got["dx"] - 3.0) < 0.3 and abs(got["dy"] + 2.0) < 0.3 and got["votes"] >= 40
    assert rg.align_stems(t.limit(0), r) is None


def test_votes_find_the_shift(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 40, (30, 2))
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id int, x double, y double")
    r = rg.vote_shift(t, t.select("id", (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y")), 6.0).first()
    assert r.votes >= 30 and abs(r.dx - 3) < 0.3 and abs(r.dy + 2) < 0.3


def test_shadow_gaps(spark):
    s = spark.createDataFrame([(1, 5, 0b111111111000), (1, 5, 0b000000000001), (2, 5, 0b011111111110), (3, 5, 0b111111111111), (4, 0, 1)], "tree_id int, n long, sectors int")
    got = {r.tree_id: (r.unseen, r.gap_from_deg, r.gap_deg) for r in tr.shadows(s).collect()}
    assert got == {1: (2, 30, 60), 2: (2, 330, 60), 3: (0, 0, 0)}


def test_li2012_tells_two_crowns_apart(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, (cx, cy, top) in enumerate(((5.0, 5.0, 15.0), (13.0, 5.0, 12.0))):
        for _ in range(300):
            h = rng.uniform(3, top)
            r = 2.0 * (top - h) / top * np.sqrt(rng.random())
            a = rng.uniform(0, 2 * np.pi)
            rows.append((f"{k}-{len(rows)}", float(cx + r * np.cos(a)), float(cy + r * np.sin(a)), float(h)))
    p = spark.createDataFrame(rows, "point_id string, x double, y double, hag double")
    got = {r.point_id: r.tree_id for r in sg.segment_li2012(p).collect()}
    for k in (0, 1):
        own = [t for i, t in got.items() if i.startswith(f"{k}-") and t]
        assert max(map(own.count, set(own))) / len(own) > 0.95
    assert len({t for t in got.values() if t}) <= 4


def test_a_tree_across_a_tile_edge_is_one_tree(spark):
    rng = np.random.default_rng(5)
    h = rng.uniform(3, 14, 250)
    r, a = 1.8 * (14 - h) / 14 * np.sqrt(rng.random(250)), rng.uniform(0, 2 * np.pi, 250)
    rows = [(f"c{i}", float(40 + r[i] * np.cos(a[i])), float(5 + r[i] * np.sin(a[i])), float(h[i])) for i in range(250)]
    p = spark.createDataFrame(rows, "point_id string, x double, y double, hag double")
    got = [{x.point_id: x.tree_id for x in sg.segment_li2012(p, tile=t).collect()} for t in (40.0, 200.0)]
    assert got[0] == got[1] and len(set(got[0].values())) == 1 and 0 not in got[0].values()
    stem = [(f"s{k}", 50.0 + 0.05 * (k % 2), 5.0, 0.1 * k) for k in range(100)]
    arm = [(f"a{k}", 50.0 + s * 0.15 * k, 5.0, 8.0) for k in range(60) for s in (-1, 1)]
    q = spark.createDataFrame([(i + f"{n}", *map(float, v)) for n, (i, *v) in enumerate(stem + arm)], "point_id string, x double, y double, hag double")
    got = [{x.point_id: x.tree_id for x in sg.segment_graph(q, tile=t).filter("tree_id <> 0").collect()} for t in (50.0, 400.0)]
    assert got[0] == got[1] and len(set(got[0].values())) == 1 and len(got[0]) > 200


def test_flow_does_not_show_tiles(spark):
    rng = np.random.default_rng(6)
    z = np.round(np.add.outer(np.linspace(0, 4, 24), np.linspace(0, 6, 30)) + rng.normal(0, 0.6, (24, 30)), 1)
    g = spark.createDataFrame([(c, r, float(z[r, c])) for r in range(24) for c in range(30) if rng.random() > 0.03], "col long, row long, v double")
    one = lambda t: sorted(map(tuple, sg.flow_accumulation(g, 1.0, "v", t).collect()))
    whole = one(512)
    assert one(11) == whole
    # The filled surface by the plain definition: the least, over ways out, of the highest cell on the way.
    have = {(c, r): (f, a) for c, r, f, a, _ in whole}
    level = {(r.col, r.row): r.v for r in g.collect()}
    around = lambda k: [(k[0] + i, k[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    fill = {k: v if any(n not in level for n in around(k)) else np.inf for k, v in level.items()}
    while True:
        new = {k: min(v, max(level[k], min((fill[n] for n in around(k) if n in fill)))) if np.inf in (v, 0) or True else v for k, v in fill.items()}
        if new == fill:
            break
        fill = new
    assert all(have[k][0] == fill[k] for k in level)
    channel = spark.createDataFrame([(c, 0, 64.0 - c) for c in range(64)] + [(c, r, 1000.0) for c in range(64) for r in (-1, 1)], "col long, row long, v double")
    assert len(one(512)) == len(level) and sg.flow_accumulation(channel, 1.0, "v", 16).agg(F.max("accumulation")).first()[0] >= 1


def test_flow_fills_a_sink_and_runs_down(spark):
    z = {(c, r): 10.0 - c for c in range(10) for r in range(3)}
    z[4, 1] = 0.0
    g = spark.createDataFrame([(c, r, v) for (c, r), v in z.items()], "col long, row long, v double")
    got = {(r.col, r.row): r for r in sg.flow_accumulation(g, 1.0, "v").collect()}
    assert got[4, 1].filled > 0.0 and got[4, 1].filled <= 6.0 and all(got[k].filled == z[k] for k in z if k != (4, 1))
    assert sum(r.accumulation for k, r in got.items() if k[0] in (0, 9) or k[1] in (0, 2)) >= 30


def wide_tree():
    """Two stems; from one a branch of 60 m runs past the other's crown, far beyond any tile."""
    rows = [(x, 5.0, h) for x in (5.0, 40.0) for h in np.arange(0.3, 4.0, 0.1)]
    rows += [(x, 5.0, 4.0) for x in np.arange(5.0, 38.0, 0.2)] + [(38.0, y, 4.0) for y in np.arange(5.0, 32.0, 0.2)]
    return [(f"{i:05d}", float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)]


def test_trees_wider_than_tiles_stay_whole(spark):
    """Labels and distances are those of one search over everything, whatever the tiles."""
    import heapq

    pts = wide_tree()
    p = spark.createDataFrame(pts, "point_id string, x double, y double, hag double")
    got = [{r.point_id: r.tree_id for r in sg.segment_graph(p, tile=t).collect()} for t in (4.0, 11.0, 500.0)]
    assert got[0] == got[1] == got[2] and len(set(got[0].values()) - {0}) == 2
    long_branch = [i for i, x, y, z in pts if z == 4.0 and x < 37.5]
    assert len({got[0][i] for i in long_branch}) == 1 and got[0][pts[0][0]] == got[0][long_branch[-1]]
    xyz = np.array([r[1:] for r in pts])
    v = spark.createDataFrame([(i, x, y, z) for i, x, y, z in pts], "v string, x double, y double, hag double")
    seeds = spark.createDataFrame([(pts[0][0], 7), (pts[40][0], 3)], "v string, seed long")
    near = {r.v: (r.tree_id, r.distance) for r in sg.geodesic_labels(v, seeds, 0.5, 0.0, 6.0).collect()}
    best, heap = {0: (0.0, 7), 40: (0.0, 3)}, [(0.0, 7, 0), (0.0, 3, 40)]
    while heap:
        d, name, i = heapq.heappop(heap)
        if (d, name) > best[i]:
            continue
        for j in np.flatnonzero(((xyz - xyz[i]) ** 2).sum(1) <= 0.25):
            e = d + float(np.linalg.norm(xyz[j] - xyz[i]))
            if (e, name) < best.get(int(j), (np.inf, 0)):
                best[int(j)] = (e, name)
                heapq.heappush(heap, (e, name, int(j)))
    for i, r in enumerate(pts):
        assert near[r[0]][1] == pytest.approx(best[i][0]) if i in best else near[r[0]] == (0, float("inf"))
    assert {near[r[0]][0] for i, r in enumerate(pts) if i in best} == {3, 7}
