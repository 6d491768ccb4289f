"""Cut pursuit: exact cuts, energies against all partitions, tree isolation over tiles."""

import itertools
import math

import numpy as np
import pytest

from silvaquery.operators import cuts
from silvaquery.operators import segmentation as sg


def chain(n):
    return np.array([(i, i + 1) for i in range(n - 1)])


def test_min_cut_is_least_of_all():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = int(rng.integers(2, 9)), int(rng.integers(0, 14))
        e = rng.integers(0, n, (m, 2))
        e = e[e[:, 0] != e[:, 1]]
        c, pull = rng.random(len(e)) * rng.choice([0.2, 1, 5]), rng.normal(size=n)

        def cost(side):
            return np.maximum(pull, 0)[~side].sum() + np.maximum(-pull, 0)[side].sum() + c[side[e[:, 0]] != side[e[:, 1]]].sum()

        assert cost(cuts.min_cut(n, e, c, pull)) == pytest.approx(min(cost(np.array(s, bool)) for s in itertools.product((0, 1), repeat=n)), abs=1e-9)


def test_a_step_is_cut_once_and_in_place():
    x = np.repeat([0.0, 10.0], 20)[:, None]
    got = cuts.cut_pursuit(x, chain(40), np.ones(39), 1.0)
    assert len(set(got)) == 2 and len(set(got[:20])) == 1 and len(set(got[20:])) == 1


def test_penalty_and_weights_decide():
    x = np.arange(60)[:, None] * 0.5
    many = [len(set(cuts.cut_pursuit(x, chain(60), np.ones(59), p))) for p in (0.01, 0.5, 5, 50, 500, 20_000)]
    assert many == sorted(many, reverse=True) and many[-1] == 1
    step, seam = np.repeat([0.0, 3.0], 10)[:, None], np.arange(19) == 9
    weak, strong = (cuts.cut_pursuit(step, chain(20), np.where(seam, w, 1.0), 2.0) for w in (0.01, 1000.0))
    assert weak[9] != weak[10] and strong[9] == strong[10]


def test_energy_against_all_partitions_and_merging():
    rng = np.random.default_rng(4)

    def partitions(n):
        def grow(labels, k):
            if len(labels) == n:
                yield np.array(labels)
            else:
                for i in range(k + 1):
                    yield from grow([*labels, i], max(k, i + 1))
        return grow([0], 1)

    exact = 0
    for _ in range(12):
        x = rng.normal(size=(7, 1)) + 2 * rng.integers(0, 3, (7, 1))
        e = np.array([p for p in itertools.combinations(range(7), 2) if rng.random() < 0.5])
        w = np.ones(len(e))
        got, best = cuts.energy(x, e, w, 0.5, cuts.cut_pursuit(x, e, w, 0.5)), min(cuts.energy(x, e, w, 0.5, p) for p in partitions(7))
        assert best - 1e-9 <= got <= 1.05 * best + 1e-9
        exact += got <= best + 1e-9
    assert exact >= 10
    better = 0
    for i in range(60):
        n = int(rng.integers(5, 60))
        x = rng.normal(size=(n, 2)) + 3 * rng.integers(0, 4, (n, 1))
        e = np.array([p for p in itertools.combinations(range(n), 2) if rng.random() < 6 / n]).reshape(-1, 2)
        w, penalty = rng.random(len(e)) + 0.5, float(rng.choice([0.1, 1, 5]))
        a, b = (cuts.energy(x, e, w, penalty, f(x, e, w, penalty)) for f in (cuts.cut_pursuit, cuts.merge_regions))
        assert a <= b + 1e-9
        better += a < b - 1e-9
    assert better > 5


def test_regions_are_connected_and_odd_input_is_sane():
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=(80, 3)), np.array([p for p in itertools.combinations(range(80), 2) if rng.random() < 0.04])
    got = cuts.cut_pursuit(x, e, np.ones(len(e)), 0.3)
    same = got[e[:, 0]] == got[e[:, 1]]
    assert len(np.unique(cuts.connected(80, *e[same].T))) == len(np.unique(got))
    assert len(cuts.cut_pursuit(np.zeros((0, 2)), [], [], 1.0)) == 0
    assert len(set(cuts.cut_pursuit(np.zeros((3, 2)), [], [], 1.0))) == 3
    assert len(set(cuts.cut_pursuit(np.ones((5, 1)), np.vstack([chain(5), [[2, 2]]]), np.ones(5), 0.1))) == 1


def stand(centres, seed=7):
    rng, rows = np.random.default_rng(seed), []
    for k, (cx, cy) in enumerate(centres):
        for h in np.arange(0, 8, 0.1):
            rows += [(f"{k}-{len(rows) + a}", cx + 0.1 * math.cos(a * 1.6), cy + 0.1 * math.sin(a * 1.6), float(h)) for a in range(4)]
        rows += [(f"{k}-{len(rows) + i}", cx + v[0], cy + v[1], 8 + abs(v[2])) for i, v in enumerate(rng.normal(0, 0.8, (150, 3)))]
    return [(i, float(x), float(y), float(z)) for i, x, y, z in rows]


KIND = "point_id string, x double, y double, hag double"


def test_treeiso_tells_stems_apart_whatever_the_tiles(spark):
    """The same points have the same labels with tiles of two sizes, one of which cuts crowns."""
    centres = ((5.0, 5.0), (11.0, 5.0), (19.5, 5.0))
    p = spark.createDataFrame(stand(centres), KIND)
    one, two = ({r.point_id: r.tree_id for r in sg.segment_treeiso(p, voxel=0.2, tile=t, halo=8.0).collect()} for t in (50.0, 10.0))
    assert one == two
    main = [max(set(v), key=v.count) for v in ([t for i, t in one.items() if i.startswith(f"{k}-")] for k in range(3))]
    assert len(set(main)) == 3 and 0 not in main
    assert sum(t == main[int(i[0])] for i, t in one.items()) / len(one) > 0.9


def test_treeiso_looks_at_k3_pieces_only():
    """A crown between two stems: with one neighbour it must take the nearest in plan, with two the one that overlaps it in height."""
    near, far, crown = [(0.0, 0.0, h) for h in np.arange(0, 1.0, 0.1)], [(1.5, 0.0, h) for h in np.arange(0, 9.0, 0.1)], [(0.5, 0.0, h) for h in np.arange(5, 8.0, 0.1)]
    v, label = np.array(near + far + crown), np.repeat([0, 1, 2], [10, 90, 30])
    one, two = (sg.joined_pieces(v, label, k, 2.0, 0.5, 0.5, 5, 0.1) for k in (1, 2))
    assert one[-1] == one[0] != one[10] and two[-1] == two[10] != two[0]
