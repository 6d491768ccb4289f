"""Neighbourhood operators.

What is asked of dense clouds (counts, sums, the k nearest, clusters) is found inside tasks, block by block; pairs that are wanted themselves
come from an equal-key join: cells as wide as the radius, one side spread over the 27 cells around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.assignment import assign
from . import blocks as bl
from .blocks import cut_lineage
from .cuts import connected
from .forestry import whole_groups


def _around(dims: str) -> Column:
    shifts = [()]
    for _ in dims:
        shifts = [(*s, d) for s in shifts for d in (-1, 0, 1)]
    return F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"o{c}") for c, d in zip(dims, s))) for s in shifts))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, dims: str = "xyz", by: tuple[str, ...] = ()) -> DataFrame:
    """``left(a, x, y[, z], ...)`` and ``right(b, ...)`` -> pairs at most ``radius`` apart, with all columns of left, ``b``, right's
    coordinates as ``rx`` ... and ``distance``. Columns ``by`` of both sides must be equal."""
    if not radius > 0:
        raise ValueError("a radius is above zero")
    lk = left.withColumns({f"k{c}": S.cell(F.col(c), radius) for c in dims})
    rest = [c for c in right.columns if c not in dims]
    rk = right.select(*rest, *(F.col(c).alias(f"r{c}") for c in dims), F.explode(_around(dims)).alias("o")).withColumns({f"k{c}": S.cell(F.col(f"r{c}"), radius) + F.col(f"o.o{c}") for c in dims}).drop("o")
    d2 = sum((F.pow(F.col(c) - F.col(f"r{c}"), F.lit(2)) for c in dims), F.lit(0.0))
    keys = [f"k{c}" for c in dims]
    # Spread over cells the rows are many times what the planner takes them for, so they are never collected at the driver.
    return lk.join(rk.hint("merge"), [*keys, *by]).withColumn("distance", F.sqrt(d2)).filter(F.col("distance") <= radius).drop(*keys)


def usual_reach(points: DataFrame, k: int, dims: str = "xyz") -> float:
    """A radius that about 2 k points of the cloud lie within: the size of cells that hold k / 2 points, where any.

    Cells are counted at twenty sizes in one pass, with small sketches.
    """
    box = points.agg(*(F.min(c).alias(f"lo{c}") for c in dims), *(F.max(c).alias(f"hi{c}") for c in dims), F.count("*").alias("n")).first()
    if not box["n"]:
        return 1.0
    wide = max(max(box[f"hi{c}"] - box[f"lo{c}"] for c in dims), 1e-6)
    sizes = [wide / 2**i for i in range(20)]
    cells = points.agg(*(F.approx_count_distinct(F.hash(*(S.cell(F.col(c), s) for c in dims))).alias(f"s{i}") for i, s in enumerate(sizes))).first()
    return next((s for i, s in reversed(list(enumerate(sizes))) if box["n"] / max(1, cells[f"s{i}"]) >= k / 2), wide)


def k_nearest(left: DataFrame, right: DataFrame, k: int, reach: float | None = None, dims: str = "xyz", other: bool = False) -> DataFrame:
    """The k nearest of ``right`` to each row of ``left``, at any distance (all, if fewer); ties by b. ``other``: a row is not its own neighbour.

    Rows that lack k neighbours within the radius are searched again with twice as wide a one, so pairs stay few where points are dense.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    reach, found, todo = reach or usual_reach(right, k, dims), None, left
    box = left.select(*dims).unionByName(right.select(*dims)).agg(*(x for c in dims for x in (F.min(c), F.max(c)))).first()
    wide = sum((box[2 * i + 1] - box[2 * i]) ** 2 for i in range(len(dims)) if box[0] is not None) ** 0.5
    while True:
        near = bl.nearest_within(todo, right, reach, k, dims, other)
        if reach >= wide:
            return near if found is None else found.unionByName(near)
        near = cut_lineage(near)
        full = near.filter(F.col("rank") == k).select("a")
        done = near.join(full, "a", "left_semi")
        found = done if found is None else found.unionByName(done)
        todo = cut_lineage(todo.join(full, "a", "left_anti"))
        if todo.isEmpty():
            return found
        reach *= 2


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each ``a``; ties by b."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).filter(F.col("rank") <= k)


def _ab(points: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return points.select(F.col(key).alias("a"), "x", "y", "z"), points.select(F.col(key).alias("b"), "x", "y", "z")


def enough_within(points: DataFrame, radius: float, least: int, key: str = "point_id") -> DataFrame:
    """``points`` that have at least ``least`` others within the radius.

    Of a cell that fits in the radius and holds more than that, all points have; only places in other cells are searched around.
    """
    at, sure = ["x", "y", "z"], [f"sure_{c}" for c in "xyz"]
    p = bl.spots(points, *at).withColumns({f"sure_{c}": S.cell(F.col(c), 0.57 * radius) for c in "xyz"})
    full = p.groupBy(*sure).agg(F.sum("m").alias("all")).filter(F.col("all") > least).select(*sure)
    p = cut_lineage(p.join(full.withColumn("full", F.lit(True)), sure, "left").select(*at, "m", F.coalesce("full", F.lit(False)).alias("full")))
    todo = p.filter("NOT full").select(*at)
    # A point is within the radius of itself.
    found = bl.spot_counts(todo, near_rows(p, todo, radius), radius).filter(F.col("n") > least).select(*at)
    return points.join(p.filter("full").select(*at).unionByName(found), at, "left_semi")


def near_rows(rows: DataFrame, around: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the cells, as wide as the radius, that hold a row of ``around`` or touch one that does: all that are within the radius are among them."""
    cells = [f"near_{c}" for c in "xyz"]
    around_few = F.broadcast if 27 * around.count() <= bl.FEW_ROWS else lambda df: df.hint("merge")
    here = around.select(*by, *(S.cell(F.col(c), 1.0001 * radius).alias(f"near_{c}") for c in "xyz")).distinct()
    wide = here.select(*by, *cells, F.explode(_around("xyz")).alias("o")).select(*by, *((F.col(f"near_{c}") + F.col(f"o.o{c}")).alias(f"near_{c}") for c in "xyz")).distinct()
    return rows.withColumns({f"near_{c}": S.cell(F.col(c), 1.0001 * radius) for c in "xyz"}).join(around_few(wide), [*by, *cells], "left_semi").select(*rows.columns)


def clean_radius(points: DataFrame, radius: float = 0.05, least: int = 2, key: str = "point_id") -> DataFrame:
    """Points with at least so many others within the radius."""
    return enough_within(points, radius, least, key).select(*points.columns)


def clean_sor(points: DataFrame, k: int = 8, deviations: float = 1.0, key: str = "point_id") -> DataFrame:
    """Statistical outlier removal: mean distance to the k nearest others, however far, at most the cloud's mean plus deviations."""
    p = bl.spots(points, "x", "y", "z")
    reach, near, todo = usual_reach(p, k), None, p
    box = p.agg(*(x for c in "xyz" for x in (F.min(c), F.max(c)))).first()
    wide = sum((box[2 * i + 1] - box[2 * i]) ** 2 for i in range(3) if box[0] is not None) ** 0.5
    while True:
        # Points that lack k others within the reach are searched again with twice as wide a one.
        got = cut_lineage(bl.mean_distances(todo, p, reach, k))
        done = got if reach >= wide else got.filter(F.col("n") >= k)
        near = done if near is None else near.unionByName(done)
        todo = got.filter(F.col("n") < k).select("x", "y", "z", "m")
        if reach >= wide or todo.isEmpty():
            break
        reach *= 2
    near = near.filter("d IS NOT NULL")
    # The points' mean and deviation, each place as often as it has points.
    mean = near.agg((F.sum(F.col("m") * F.col("d")) / F.sum("m")).alias("mean"))
    spread = near.crossJoin(F.broadcast(mean)).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("m") * (F.col("d") - F.col("mean")) ** 2) / F.sum("m")).alias("sd"))  # one row
    good = near.crossJoin(F.broadcast(spread)).filter(F.col("d") <= F.col("mean") + deviations * F.col("sd"))  # one row
    return points.join(good.select("x", "y", "z"), ["x", "y", "z"], "left_semi").select(*points.columns)


def covariance(pairs: DataFrame, group: str = "a") -> DataFrame:
    """Mean and covariance of the neighbours of each group, from sums about their own mean."""
    names = ("rx", "ry", "rz")
    aggs = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{c[1]}") for c in names]
    aggs += [F.covar_pop(p, q).alias(f"c{p[1]}{q[1]}") for i, p in enumerate(names) for q in names[i:]]
    return pairs.groupBy(group).agg(*aggs)


def eigenvalues() -> tuple[Column, Column, Column]:
    """Eigenvalues of the symmetric 3 x 3 matrix in columns cxx .. czz, largest first, in closed form (Smith 1961)."""
    c = F.col
    q = (c("cxx") + c("cyy") + c("czz")) / 3
    p2 = F.pow(c("cxx") - q, F.lit(2)) + F.pow(c("cyy") - q, F.lit(2)) + F.pow(c("czz") - q, F.lit(2)) + 2 * (c("cxy") * c("cxy") + c("cxz") * c("cxz") + c("cyz") * c("cyz"))
    p = F.sqrt(p2 / 6)
    a, b, d = c("cxx") - q, c("cyy") - q, c("czz") - q
    det = a * (b * d - c("cyz") * c("cyz")) - c("cxy") * (c("cxy") * d - c("cyz") * c("cxz")) + c("cxz") * (c("cxy") * c("cyz") - b * c("cxz"))
    r = F.try_divide(det, 2 * p * p * p)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    one = F.when(p > 0, q + 2 * p * F.cos(phi)).otherwise(q)
    three = F.when(p > 0, q + 2 * p * F.cos(phi + F.lit(2.0943951023931953))).otherwise(q)
    return one, 3 * q - one - three, three


def spot_shapes(p: DataFrame, radius: float, least: int) -> DataFrame:
    """Linearity, planarity and scatter of the neighbourhoods of places ``(x, y, z, m)``."""
    t = bl.spot_moments(p.select("x", "y", "z"), p, radius).filter(F.col("n") >= least)
    e1, e2, e3 = eigenvalues()
    t = t.withColumns({"e1": e1, "e2": e2, "e3": e3})
    return t.select("x", "y", "z", "n", F.try_divide(F.col("e1") - F.col("e2"), F.col("e1")).alias("linearity"), F.try_divide(F.col("e2") - F.col("e3"), F.col("e1")).alias("planarity"), F.try_divide(F.col("e3"), F.col("e1")).alias("scatter"))


def shape_features(points: DataFrame, radius: float = 0.06, least: int = 8, key: str = "point_id") -> DataFrame:
    """Linearity, planarity and scatter of each point's neighbourhood (itself included)."""
    at = ["x", "y", "z"]
    f = spot_shapes(bl.spots(points, *at), radius, least)
    return points.select(key, *at).join(f, at).select(key, "n", "linearity", "planarity", "scatter")


def leaf_wood(points: DataFrame, radius: float = 0.06, linear: float = 0.6, planar: float = 0.55, scattered: float = 0.35, least: int = 8, passes: int = 2, key: str = "point_id") -> DataFrame:
    """``semantic``: 1 wood, 4 leaf, 0 undecided, then majority passes over the neighbourhood. Points in one place are one kind."""
    at = ["x", "y", "z"]
    p = bl.spots(points, *at)
    wood = ((F.col("linearity") >= linear) | (F.col("planarity") >= planar)) & (F.col("scatter") <= scattered)
    out = cut_lineage(p.join(spot_shapes(p, radius, least), at, "left").select(*at, "m", F.when(F.col("n").isNull(), 0).when(wood, 1).otherwise(4).alias("semantic")))
    kind = {1: "w", 4: "l"}

    def votes(l: pa.Table, r: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> dict:
        said, m = r.column("semantic").to_numpy()[j], r.column("m").to_numpy()[j]
        return {name: np.bincount(i, m * (said == value), l.num_rows).astype(np.int64) for value, name in kind.items()}

    for _ in range(passes):
        vote = bl.measured_pairs(out, out, radius, "w long, l long", votes)
        out = cut_lineage(vote.withColumn("semantic", F.when(F.col("semantic") == 0, 0).when(F.col("w") > F.col("l"), 1).when(F.col("l") > F.col("w"), 4).otherwise(F.col("semantic"))).drop("w", "l"))
    rest = [c for c in points.columns if c != "semantic"]
    return points.select(*rest).join(out.drop("m"), at, "left").select(*rest, F.coalesce("semantic", F.lit(0)).alias("semantic"))


def m3c2(cores: DataFrame, before: DataFrame, after: DataFrame, normal_scale: float = 1.0, projection: float = 0.5, depth: float = 3.0, reg_error: float = 0.02) -> DataFrame:
    """M3C2 distances: normals by PCA of ``before`` (at least 4 points, upward), mean signed distances of both epochs in a
    cylinder along them, and the level of detection, the registration error inside the 1.96."""
    a = cores.select(F.col("core").alias("a"), "x", "y", "z")
    before, after = (bl.spots(c, "x", "y", "z") for c in (before, after))
    cov = bl.spot_moments(a, before, normal_scale / 2).filter("n >= 4")

    @F.pandas_udf("struct<nx:double,ny:double,nz:double>")
    def normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        v = np.linalg.eigh(m)[1][:, :, 0]
        # Upward; level ones towards y, or x.
        v = np.where(np.abs(v) < 1e-9, 0.0, v)
        lead = np.where(v[:, 2] != 0, v[:, 2], np.where(v[:, 1] != 0, v[:, 1], v[:, 0]))
        return pd.DataFrame(np.where(lead[:, None] < 0, -v, v) + 0.0, columns=["nx", "ny", "nz"])

    n = cut_lineage(cov.select("a", "x", "y", "z", normal("cxx", "cxy", "cxz", "cyy", "cyz", "czz").alias("v")).select("a", "x", "y", "z", "v.*"))
    reach = (depth ** 2 + (projection / 2) ** 2) ** 0.5

    def inside(l: pa.Table, r: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> dict:
        own, other, up = bl.places(l, "xyz"), bl.places(r, "xyz"), bl.places(l.select(["nx", "ny", "nz"]).rename_columns(["x", "y", "z"]), "xyz")
        along = ((other[j] - own[i]) * up[i]).sum(1)
        on = (np.abs(along) <= depth) & (d2 - along * along <= (projection / 2) ** 2)
        i, along, m = i[on], along[on], r.column("m").to_numpy()[j[on]]
        many = np.bincount(i, m, l.num_rows).astype(np.int64)
        mean = np.bincount(i, m * along, l.num_rows) / np.maximum(many, 1)
        spread = np.sqrt(np.bincount(i, m * (along - mean[i]) ** 2, l.num_rows) / np.maximum(many - 1, 1))
        return {"n": many, "m": pa.array(mean, mask=many == 0), "s": pa.array(spread, mask=many < 2)}

    def side(cloud: DataFrame, name: str) -> DataFrame:
        return bl.measured_pairs(n, cloud, reach, "n long, m double, s double", inside).filter("n > 0").select("a", F.col("n").alias(f"n_{name}"), F.col("m").alias(f"m_{name}"), F.col("s").alias(f"s_{name}"))

    t = n.join(side(before, "ref"), "a", "left").join(side(after, "now"), "a", "left")
    spread = F.sqrt(F.pow("s_ref", F.lit(2)) / F.col("n_ref") + F.pow("s_now", F.lit(2)) / F.col("n_now"))
    t = t.withColumn("distance", F.col("m_now") - F.col("m_ref")).withColumn("lod", 1.96 * (spread + reg_error))
    return t.select(F.col("a").alias("core"), "nx", "ny", "nz", "n_ref", "n_now", "distance", "lod", (F.abs("distance") > F.col("lod")).alias("significant"))


# ---------------------------------------------------------------- point quality

# Labels of points.
NOT_EVALUATED, KEPT, REFLECTANCE, OUTLIER, WIND = range(5)


def ramp(low: float, high: float, at: float, begin: float, end: float) -> float:
    """From ``low`` to ``high`` between two heights; a step where they are one."""
    t = min(1.0, max(0.0, (at - begin) / (end - begin))) if end > begin else float(at >= end)
    return low + (high - low) * t


def point_quality(points: DataFrame, refl_min: float = -20.0, refl_max: float = 5.0, outlier_method: str = "radius", outlier_knn: int = 8, outlier_std_mult: float = 3.0, outlier_min_neighbors: int = 3, outlier_radius_min: float = 0.04, outlier_radius_max: float = 0.12, wind_radius_min: float = 0.03, wind_radius_max: float = 0.10, wind_min_other_scans_low: float = 2.0, wind_min_other_scans_high: float = 1.0, h_low: float = 0.60, h_high: float = 0.75, n_strata: int = 5, tree_ids: list[int] | tuple = (), min_tree_points: int = 50, key: str = "point_id") -> DataFrame:
    """``label`` of each point: not evaluated (no tree, or a small one), kept, or rejected by reflectance, as an outlier, or as moved by wind.

    Trees are judged by themselves, each stage on what the one before left. Points are in strata of their height between the tree's
    lowest and highest; a stratum's radius, and how many other scans must see a point, follow a ramp of the stratum's middle.
    Missing reflectance is rejected. Outliers: too few others within the radius, or (``density``) a mean distance to the k nearest
    beyond the tree's mean plus deviations. Wind needs a tree with more than one scan.
    """
    density = outlier_method == "density"
    tree = (F.col("tree_id") > 0) & (F.col("tree_id").isin(list(tree_ids)) if tree_ids else F.lit(True))
    ok = F.coalesce(F.col("refl").between(refl_min, refl_max) & ~F.isnan("refl"), F.lit(False))
    hag = S.measured(F.col("hag"))
    few = F.col("m") <= outlier_knn + 1 if density else (F.col("m") <= outlier_min_neighbors) | F.lit(outlier_min_neighbors <= 0)
    size = points.filter(tree).groupBy("tree_id").agg(F.count("*").alias("n"), F.min(hag).alias("quality_low"), F.max(hag).alias("quality_high"), F.count_if(ok).alias("m")).filter(F.col("n") >= min_tree_points)
    size = bl.stored(size.select("tree_id", "quality_low", "quality_high", few.alias("quality_few")))
    share = F.coalesce(F.try_divide(hag - F.col("quality_low"), F.col("quality_high") - F.col("quality_low")), F.lit(0.0))
    stratum = F.greatest(F.lit(0), F.least(F.lit(n_strata - 1), F.floor(share * n_strata).cast("int")))

    def by_stratum(low: float, high: float, name: str = "stratum") -> Column:
        values = [ramp(low, high, (s + 0.5) / n_strata, h_low, h_high) for s in range(n_strata)]
        return F.element_at(F.array(*map(F.lit, values)), F.col(name) + 1)

    def need(name: str = "stratum") -> Column:
        return F.floor(by_stratum(wind_min_other_scans_low, wind_min_other_scans_high, name) + 0.5)

    within = lambda l, i, d2: np.sqrt(d2) <= l.column("radius").to_numpy()[i]
    place, sure = ["tree_id", "x", "y", "z"], ["tree_id", *(f"sure_{c}" for c in "xyz")]
    spot = [*place, "stratum"]
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()

    def fitting(least_radius: float) -> dict[str, Column]:
        """Cells whose points are all within the least radius of one another."""
        return {f"sure_{c}": S.cell(F.col(c), 0.57 * least_radius) for c in "xyz"}

    def near_others(l: pa.Table, r: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> dict:
        on = within(l, i, d2)
        # A point is within its own radius.
        return {"k": np.bincount(i[on], r.column("m").to_numpy()[j[on]], l.num_rows).astype(np.int64) - 1}

    def near_mean(l: pa.Table, r: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> dict:
        apart = d2 > 0
        i, j, d2 = i[apart], j[apart], d2[apart]
        at, _ = bl.first_k(i, j, d2, outlier_knn)
        i, w = i[at], r.column("m").to_numpy()[j[at]]
        before = np.cumsum(w) - w
        before -= before[np.searchsorted(i, i)]
        w = np.clip(outlier_knn - before, 0, w)
        many = np.bincount(i, w, l.num_rows)
        return {"d": pa.array(np.bincount(i, w * np.sqrt(d2[at]), l.num_rows) / np.maximum(many, 1), mask=many == 0)}

    def other_scans(l: pa.Table, r: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> dict:
        on = within(l, i, d2)
        i, own, seen = i[on], l.column("scan").to_numpy()[i[on]].astype(float), r.column("scan").to_numpy()[j[on]].astype(float) if r.num_rows else np.zeros(0)
        other = own != seen
        pairs = np.unique(np.stack([i[other], seen[other].astype(np.int64)], axis=1), axis=0)
        return {"k": np.bincount(pairs[:, 0], minlength=l.num_rows)}

    # From here to the last join rows are places without keys, and what is kept are the exceptions: places that a stage rejects.
    live = bl.stored(points.filter(tree & ok).join(bl.by_size(size), "tree_id").select(*place, "scan", stratum.alias("stratum"), F.col("quality_few").alias("few")))
    asked = live.filter(~F.col("few") & placed)
    if density:
        reach = 4 * max(outlier_radius_min, outlier_radius_max)
        todo = bl.stored(asked.groupBy(*spot).agg(F.count("*").alias("m")))
        near = bl.stored(bl.measured_pairs(todo, todo.select(*place, "m"), reach, "d double", near_mean, by=("tree_id",)))
        mean = near.groupBy("tree_id").agg((F.sum(F.when(F.col("d").isNotNull(), F.col("m") * F.col("d"))) / F.sum(F.when(F.col("d").isNotNull(), F.col("m")))).alias("mean"))
        spread = near.filter("d IS NOT NULL").join(mean, "tree_id").groupBy("tree_id").agg((F.first("mean") + outlier_std_mult * F.sqrt(F.sum(F.col("m") * (F.col("d") - F.col("mean")) ** 2) / F.sum("m"))).alias("limit"))
        limit = bl.stored(spread)
        failed = near.join(bl.by_size(limit), "tree_id", "left").filter("d IS NULL OR d > limit").select(*spot)
        used = [todo, near, limit]
    else:
        # What a cell shows by itself is not searched for.
        widest = max(outlier_radius_min, outlier_radius_max)
        asked_cells = asked.withColumns(fitting(min(outlier_radius_min, outlier_radius_max)))
        loose = bl.stored(asked_cells.groupBy(*sure).agg(F.count("*").alias("all")).filter(F.col("all") <= outlier_min_neighbors).select(*sure))
        todo = bl.stored(asked_cells.join(bl.by_size(loose), sure, "left_semi").select(*spot).distinct().withColumn("radius", by_stratum(outlier_radius_min, outlier_radius_max)))
        around = bl.stored(near_rows(asked.select(*place), todo, widest, ("tree_id",)).groupBy(*place).agg(F.count("*").alias("m")))
        failed = bl.measured_pairs(todo, around, widest, "k long", near_others, by=("tree_id",)).filter(F.col("k") < outlier_min_neighbors).select(*spot)
        used = [loose, todo, around]
    failed = bl.stored(failed)
    bl.forget(*used)
    left = live.join(bl.by_size(failed), spot, "left_anti").filter(F.col("few") | placed).drop("few")
    if failed.count() > bl.FEW_ROWS:
        merged, left = live, bl.stored(left)
        bl.forget(merged)
        live = left
    windy = bl.stored(left.groupBy("tree_id").agg(F.count("*").alias("m"), F.count_distinct("scan").alias("scans")).filter("m > 3 AND scans > 1").select("tree_id"))
    asked = left.filter(F.col("scan").isNotNull() & placed).join(bl.by_size(windy), "tree_id", "left_semi")
    widest, most = max(wind_radius_min, wind_radius_max), max(wind_min_other_scans_low, wind_min_other_scans_high)
    asked_cells = asked.withColumns(fitting(min(wind_radius_min, wind_radius_max)))
    loose = bl.stored(asked_cells.groupBy(*sure).agg((F.count_distinct("scan") - 1).alias("cell_others")).filter(F.col("cell_others") < F.floor(F.lit(most) + 0.5)))
    todo = bl.stored(asked_cells.join(bl.by_size(loose), sure).filter(F.col("cell_others") < need()).select(*spot, "scan").distinct().withColumn("radius", by_stratum(wind_radius_min, wind_radius_max)))
    around = bl.stored(near_rows(asked.select(*place, "scan"), todo, widest, ("tree_id",)).distinct())
    moved = bl.measured_pairs(todo, around, widest, "k long", other_scans, by=("tree_id",)).filter(F.col("k") < need()).select(*spot, "scan")
    rejected = failed.select(*spot, F.lit(True).alias("out"), F.lit(None).cast(moved.schema["scan"].dataType).alias("scan")).unionByName(moved.select(*spot, F.lit(False).alias("out"), "scan"))
    rejected = bl.stored(rejected.groupBy(*place, F.col("stratum").alias("quality_stratum")).agg(F.max("out").alias("quality_out"), F.collect_set("scan").alias("quality_moved")))
    size = bl.stored(size.join(windy.withColumn("quality_windy", F.lit(True)), "tree_id", "left"))
    bl.forget(live, failed, loose, todo, around)

    judged = points.join(bl.by_size(size), "tree_id", "left").withColumn("quality_stratum", stratum).join(bl.by_size(rejected), [*place, "quality_stratum"], "left")
    is_out = ~F.col("quality_few") & (~placed | F.coalesce("quality_out", F.lit(False)))
    is_moved = F.col("quality_windy") & (need("quality_stratum") > 0) & (~placed | F.col("scan").isNull() | F.coalesce(F.array_contains("quality_moved", F.col("scan")), F.lit(False)))
    label = F.when(F.col("quality_few").isNull(), NOT_EVALUATED).when(~ok, REFLECTANCE).when(is_out, OUTLIER).when(is_moved, WIND).otherwise(KEPT)
    return judged.withColumn("label", label).select(key, *(c for c in points.columns if c not in (key, "label")), "label")


# ---------------------------------------------------------------- components and matching


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)``, root the component's smallest node: labels go to the smallest of the neighbours', then to their label's label.

    Labels are as many as nodes, so joins sort and merge; none is collected at the driver.
    """
    both = cut_lineage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")))
    while True:
        low = both.join(labels.hint("merge"), both.v == labels.node).groupBy("u").agg(F.min("root").alias("m"))
        new = labels.join(low.hint("merge"), labels.node == low.u).select("node", F.least("root", "m").alias("root"))
        up = new.select(F.col("node").alias("w"), F.col("root").alias("up"))
        new = cut_lineage(new.join(up.hint("merge"), new.root == up.w).select("node", "up"))
        changed = new.join(labels.hint("merge"), "node").filter("up <> root").limit(1).count()
        labels = new.withColumnRenamed("up", "root")
        if not changed:
            return labels


def dbscan(points: DataFrame, eps: float, least: int, key: str = "point_id") -> DataFrame:
    """``(point_id, cluster)``: core points have ``least`` points within eps (themselves included), border points join a core's cluster (its smallest).

    Core points of a block are joined in the task that sees it; what leaves it is one link for each of them to the block's smallest, and
    blocks meet in the points of their halos.
    """
    at = ["x", "y", "z"]
    # A place is named by its smallest point.
    p = bl.spots(points, *at, a=F.min(key))
    dense = cut_lineage(bl.spot_counts(p, p, eps).select("a", *at, (F.col("n") >= least).alias("core")))
    core = dense.filter("core").select("a", "x", "y", "z")
    kind = dict(core.dtypes)["a"]

    def linked(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        # Every left row is among the right ones too; halo rows are linked as far as the block sees it.
        where, label = bl.places(r, "xyz"), np.arange(r.num_rows)
        for i, j, _ in bl.close_pairs(where, where, eps):
            u, v = label[i], label[j]
            differ = u != v
            if differ.any():
                label = connected(len(label), u[differ], v[differ])[label]
        loose = np.flatnonzero(label != np.arange(len(label)))
        names = r.column("b")
        yield pa.table({"u": names.take(pa.array(loose)), "v": names.take(pa.array(label[loose]))})

    links = bl.searched(core, core.withColumnRenamed("a", "b"), eps, "xyz", linked, f"u {kind}, v {kind}", order="b")
    roots = components(links)
    named = cut_lineage(core.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("cluster", F.coalesce("root", "a")).drop("root"))

    def smallest(l: pa.Table, r: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> dict:
        first = np.full(l.num_rows, r.num_rows)
        np.minimum.at(first, i, j)
        got = np.flatnonzero(first < r.num_rows)
        at = np.full(l.num_rows, -1)
        at[got] = first[got]
        return {"cluster": r.column("cluster").take(pa.array(at, mask=at < 0)).combine_chunks() if r.num_rows else pa.nulls(l.num_rows, dict_type)}

    from pyspark.sql.pandas.types import to_arrow_type

    dict_type = to_arrow_type(core.schema["a"].dataType)
    # Right rows are sorted by cluster, so the first one near is the smallest.
    border = bl.measured_pairs(dense.filter("NOT core").drop("core"), named.select("x", "y", "z", "cluster"), eps, f"cluster {kind}", smallest, order="cluster")
    found = named.select(*at, "cluster").unionByName(border.filter("cluster IS NOT NULL").select(*at, "cluster"))
    return points.select(key, *at).join(found, at).select(key, "cluster")


def match_positions(a: DataFrame, b: DataFrame, radius: float, method: str = "optimal") -> DataFrame:
    """One-to-one pairs ``(a, b, distance)`` within the radius; ``a(a, x, y)``, ``b(b, x, y)`` with numeric ids.

    optimal: most pairs, then least sum of squared distances; greedy: nearest first, ties by a, b. Candidates fall into
    connected components, which are solved each by itself in Python; missing positions match nothing.
    """
    schema = "a long, b long, distance double"
    if not radius >= 0:
        return a.sparkSession.createDataFrame([], schema)
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    cand = radius_pairs(a.filter(ok).select(F.col("a").cast("long").alias("a"), "x", "y"), b.filter(ok).select(F.col("b").cast("long").alias("b"), "x", "y"), radius or 1e-9, "xy").filter(F.col("distance") <= radius).select("a", "b", "distance")
    cand = cut_lineage(cand)
    parts = components(cand.select((F.col("a") * 2).alias("u"), (F.col("b") * 2 + 1).alias("v")))
    grouped = cand.join(parts.hint("merge"), F.col("a") * 2 == parts.node).select("root", "a", "b", "distance")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Components side by side are one sparse problem.
        for t in whole_groups(parts, "root"):
            yield pd.DataFrame(assign(t[["a", "b", "distance"]].itertuples(index=False, name=None), method), columns=["a", "b", "distance"])

    return grouped.repartition("root").sortWithinPartitions("root").mapInPandas(solve, schema)
