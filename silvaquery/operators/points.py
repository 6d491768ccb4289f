"""Point-level operators: overlays, filters, summaries, grids, voxels, profiles, rasters.

Grids and voxels are long tables keyed by cell numbers, so a cloud of any size is aggregated with partial sums and joined by
equal keys; a dense raster exists only in sinks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

# ---------------------------------------------------------------- edits, labels, coordinates


def apply_overlay(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits ``(point_id, new_tree, semantic, deleted)``: -1 keeps a tree, semantic 0 keeps, 3 clears, deleted 1 drops the point."""
    e = edits.select("point_id", F.col("new_tree"), F.col("semantic").alias("new_semantic"), F.col("deleted"))
    p = points.join(e, "point_id", "left").filter(F.coalesce("deleted", F.lit(0)) != 1)
    old = F.col("semantic") if "semantic" in points.columns else F.lit(0)
    semantic = F.when(F.col("new_semantic") == 3, 0).when(F.coalesce("new_semantic", F.lit(0)) != 0, F.col("new_semantic")).otherwise(old)
    tree = F.when(F.coalesce("new_tree", F.lit(-1)) >= 0, F.col("new_tree")).otherwise(F.col("tree_id"))
    return p.withColumns({"tree_id": tree, "semantic": semantic}).drop("new_tree", "new_semantic", "deleted")


def subset(points: DataFrame, ranges: dict[str, tuple[float | None, float | None]] | None = None, classes: list[int] | None = None, slab: dict | None = None, polygon: list | None = None) -> DataFrame:
    """Conjunction of column ranges, a class list, a plane slab and a polygon; ranges and classes reach the Parquet scan."""
    out = points
    for name, (low, high) in (ranges or {}).items():
        out = out.filter(F.col(name) >= low) if low is not None else out
        out = out.filter(F.col(name) <= high) if high is not None else out
    if classes:
        out = out.filter(F.col("cls").isin(classes))
    if slab:
        out = out.filter(S.in_slab(F.col("x"), F.col("y"), F.col("z"), slab["anchor"], slab["normal"], slab["thickness"]))
    return out.filter(S.in_polygon(F.col("x"), F.col("y"), polygon)) if polygon else out


def visible(points: DataFrame, eye: tuple[float, float, float], bin_deg: float = 1.0, tolerance: float = 0.1) -> DataFrame:
    """Points no farther than the nearest in their direction bin, plus a tolerance."""
    p = _ranged(points, eye, bin_deg)
    # A minimum per bin, aggregated partially and joined back: a bin with very many points is no single task.
    near = p.groupBy("az_bin", "el_bin").agg(F.min("range").alias("nearest"))
    return p.join(near, ["az_bin", "el_bin"]).filter(F.col("range") <= F.col("nearest") + tolerance)


def _ranged(points: DataFrame, eye: tuple[float, float, float], bin_deg: float) -> DataFrame:
    dx, dy, dz = (F.col(c) - F.lit(float(e)) for c, e in zip("xyz", eye))
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    az, el = F.degrees(F.atan2(dy, dx)), F.degrees(F.atan2(dz, F.hypot(dx, dy)))
    return points.withColumns({"range": r, "az_bin": F.floor(az / bin_deg).cast("int"), "el_bin": F.floor(el / bin_deg).cast("int")})


def scan_inspection(points: DataFrame, eye: tuple[float, float, float], bin_deg: float = 10.0) -> DataFrame:
    return _ranged(points, eye, bin_deg).groupBy("az_bin", "el_bin").agg(F.count("*").alias("n"), F.min("range").alias("nearest"))


def reset_label(points: DataFrame, attr: str, only: int | None = None, value: int = 0) -> DataFrame:
    """``value`` into a label column; with ``only``, where it has that value (-1: all)."""
    hit = F.lit(True) if only is None or only == -1 else F.col(attr) == only
    return points.withColumn(attr, F.when(hit, F.lit(value)).otherwise(F.col(attr)))


def transform(points: DataFrame, matrix: list[float]) -> DataFrame:
    """Rigid 4 x 4 row-major transform of the coordinates."""
    if len(matrix) != 16:
        raise ValueError("a matrix has 16 numbers")
    rows = [sum((F.lit(float(matrix[4 * i + j])) * F.col(c) for j, c in enumerate("xyz")), F.lit(float(matrix[4 * i + 3]))) for i in range(3)]
    return points.withColumns(dict(zip("xyz", rows)))


def realign(points: DataFrame, scale: float, offset: tuple[float, float, float]) -> DataFrame:
    """Coordinates on a source file's grid."""
    return points.withColumns({c: F.round((F.col(c) - F.lit(float(o))) / F.lit(scale)) * F.lit(scale) + F.lit(float(o)) for c, o in zip("xyz", offset)})


def infer_scale(points: DataFrame, column: str) -> DataFrame:
    """One decision per file: 0-1, 0-255, 12-bit or 16-bit from the observed range; values as 16-bit."""
    top = points.agg(F.max(column).alias("top"), F.min(column).alias("low"))
    unit = F.when(F.col("top") <= 1, 65535.0).when(F.col("top") <= 255, 257.0).when(F.col("top") <= 4095, 65535.0 / 4095).otherwise(1.0)
    return top.select("low", "top", unit.alias("factor"))


def merge_clouds(*clouds: DataFrame) -> DataFrame:
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- summaries


def summary(points: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Per tree: count, box, centroid, population deviations. ``merges(tree_id, into)`` is applied to the totals, not to points.

    Sums of squares are taken about each tree's own mean (as stddev_pop does), and merged trees' are combined by the
    parallel-variance rule.
    """
    aggs = [F.count("*").alias("n")]
    for c in "xyz":
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    t = points.groupBy("tree_id").agg(*aggs)
    if merges is None:
        return t
    t = t.join(merges, "tree_id", "left").withColumn("tree_id", F.coalesce("into", "tree_id"))
    n = F.col("n")
    out = [F.sum("n").alias("n")]
    for c in "xyz":
        mean = F.sum(n * F.col(f"mean_{c}")) / F.sum("n")
        # Between-group part as the weighted population variance of the means, from products about their average.
        spread = F.sum(n * F.pow(F.col(f"sd_{c}"), F.lit(2))) / F.sum("n") + F.sum(n * F.pow(F.col(f"mean_{c}") - F.col(f"pivot_{c}"), F.lit(2))) / F.sum("n") - F.pow(mean - F.first(f"pivot_{c}"), F.lit(2))
        out += [F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}"), mean.alias(f"mean_{c}"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias(f"sd_{c}")]
    w = Window.partitionBy("tree_id")
    t = t.withColumns({f"pivot_{c}": F.avg(f"mean_{c}").over(w) for c in "xyz"})
    return t.groupBy("tree_id").agg(*out)


def info(points: DataFrame) -> DataFrame:
    aggs = [F.count("*").alias("n_points"), F.count_distinct("tree_id").alias("n_trees"), F.max("tree_id").alias("max_tree_id")]
    for c in "xyz":
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return points.agg(*aggs, F.min("intensity").alias("min_intensity"), F.max("intensity").alias("max_intensity"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin 1..bins; the top edge falls into the last."""
    b = F.least(F.lit(bins), F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).cast("int"))
    return df.filter(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- grids


def surface_grid(points: DataFrame, size: float, polygon: list | None = None, classes: list[int] | None = None) -> DataFrame:
    """Per cell ``(col, row)``: count, top, lowest, mean, and lowest of ground points."""
    p = subset(points, classes=classes, polygon=polygon)
    ground = F.when(F.col("cls") == 2, F.col("z"))
    return p.groupBy(S.cell(F.col("x"), size).alias("col"), S.cell(F.col("y"), size).alias("row")).agg(F.count("*").alias("n"), F.max("z").alias("top"), F.min("z").alias("lowest"), F.avg("z").alias("mean"), F.min(ground).alias("ground"))


def fill_gaps(grid: DataFrame, value: str, rounds: int = 1) -> DataFrame:
    """Missing cells next to known ones get the mean of their known neighbours; each round reaches one cell farther."""
    out = grid.select("col", "row", F.col(value))
    for _ in range(rounds):
        near = out.select(F.explode(_offsets(False)).alias("o"), "col", "row", value).select((F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"), F.col(value).alias("v"))
        new = near.groupBy("col", "row").agg(F.avg("v").alias(value)).join(out.select("col", "row"), ["col", "row"], "left_anti")
        out = out.unionByName(new)
    return out


def _offsets(own: bool, reach: int = 1) -> Column:
    return F.array(*(F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if own or i or j))


def normalize(points: DataFrame, size: float = 0.5) -> DataFrame:
    """``hag``: height above the lowest ground point of the cell; null where the cell has none."""
    dtm = points.filter(F.col("cls") == 2).groupBy(S.cell(F.col("x"), size).alias("col"), S.cell(F.col("y"), size).alias("row")).agg(F.min("z").alias("dtm"))
    keyed = points.withColumns({"col": S.cell(F.col("x"), size), "row": S.cell(F.col("y"), size)})
    return keyed.join(dtm, ["col", "row"], "left").withColumn("hag", F.col("z") - F.col("dtm")).drop("col", "row", "dtm")


def ground_model(points: DataFrame, size: float = 0.5, k: int = 4) -> DataFrame:
    """``(col, row, dtm, filled)`` for every cell that holds a point: the lowest ground point, else the mean of the k nearest cells that have one, by nearness.

    So crowns over cells that no ground was seen in stand on the ground around; without any ground point at all there are no rows.
    """
    from . import neighbours as ne

    cells = points.groupBy(S.cell(F.col("x"), size).alias("col"), S.cell(F.col("y"), size).alias("row")).agg(F.min(F.when(F.col("cls") == 2, F.col("z"))).alias("dtm"))
    cells = ne.cut_lineage(cells.withColumns({"x": (F.col("col") + 0.5) * size, "y": (F.col("row") + 0.5) * size}))
    known = cells.filter("dtm IS NOT NULL")
    near = ne.k_nearest(cells.filter("dtm IS NULL").select(F.struct("col", "row").alias("a"), "x", "y"), known.select(F.struct("col", "row").alias("b"), "dtm", "x", "y"), k, dims="xy")
    gaps = near.groupBy("a").agg((F.sum(F.col("dtm") / F.col("distance")) / F.sum(1 / F.col("distance"))).alias("dtm"))
    return known.select("col", "row", "dtm", F.lit(False).alias("filled")).unionByName(gaps.select("a.col", "a.row", "dtm", F.lit(True).alias("filled")))


def normalize_filled(points: DataFrame, size: float = 0.5) -> DataFrame:
    """``hag`` above the ground model with its gaps filled; null only where the cloud has no ground."""
    keyed = points.withColumns({"col": S.cell(F.col("x"), size), "row": S.cell(F.col("y"), size)})
    return keyed.join(ground_model(points, size).drop("filled"), ["col", "row"], "left").withColumn("hag", F.col("z") - F.col("dtm")).drop("col", "row", "dtm")


def sampled(points: DataFrame, grid: DataFrame, size: float, value: str, name: str) -> DataFrame:
    """``points`` with ``name``: the grid's value between the centres of the four cells around (bilinear); null where one is missing.

    For ground models, geoid undulations and grid shifts alike: the grid has the points' own coordinates.
    """
    g = grid.select("col", "row", F.col(value).alias("v"))
    corners = g.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (0, 1) for j in (0, 1)))).alias("o"), "col", "row", "v")
    at = lambda i, j: F.max(F.when((F.col("o.i") == i) & (F.col("o.j") == j), F.col("v"))).alias(f"v{i}{j}")
    square = corners.groupBy((F.col("col") - F.col("o.i")).alias("gc"), (F.col("row") - F.col("o.j")).alias("gr")).agg(*(at(i, j) for i in (0, 1) for j in (0, 1)))
    u, v = (F.col(c) / F.lit(size) - 0.5 for c in "xy")
    p = points.withColumns({"gc": F.floor(u).cast("long"), "gr": F.floor(v).cast("long")}).join(square, ["gc", "gr"], "left")
    fx, fy = u - F.col("gc"), v - F.col("gr")
    mixed = (F.col("v00") * (1 - fx) + F.col("v10") * fx) * (1 - fy) + (F.col("v01") * (1 - fx) + F.col("v11") * fx) * fy
    return p.withColumn(name, mixed).drop("gc", "gr", "v00", "v01", "v10", "v11")


def volume(grid: DataFrame, size: float, reference: float | Column, value: str = "top") -> DataFrame:
    """One row: volumes above and below a level, net, and extremes."""
    d = F.col(value) - (F.lit(float(reference)) if isinstance(reference, (int, float)) else reference)
    a = F.lit(size * size)
    return grid.agg(F.count(value).alias("cells"), (F.coalesce(F.sum(F.greatest(d, F.lit(0.0))), F.lit(0.0)) * a).alias("above"), (F.coalesce(F.sum(F.greatest(-d, F.lit(0.0))), F.lit(0.0)) * a).alias("below"), (F.coalesce(F.sum(d), F.lit(0.0)) * a).alias("net"), F.greatest(F.coalesce(F.max(d), F.lit(0.0)), F.lit(0.0)).alias("max_above"), F.greatest(F.coalesce(F.max(-d), F.lit(0.0)), F.lit(0.0)).alias("max_below"))


def rim_plane(grid: DataFrame, value: str = "top", inside: DataFrame | None = None) -> DataFrame:
    """One row ``(a, b, c)`` of z = a + b col + c row through the cells at the area's edge, from sums.

    A cell is at the edge where one of its four neighbours is not among ``inside(col, row)`` (the grid's own cells if not given).
    """
    known = grid.filter(F.col(value).isNotNull()).select("col", "row", F.col(value).alias("v"))
    area = (inside if inside is not None else known).select("col", "row")
    four = F.array(*(F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    near = area.select(F.explode(four).alias("o"), "col", "row").select((F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"))
    full = near.groupBy("col", "row").agg(F.count("*").alias("k")).filter("k = 4")
    rim = known.join(full, ["col", "row"], "left_anti")
    x, y, v = F.col("col").cast("double"), F.col("row").cast("double"), F.col("v")
    s = rim.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv"), F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, v).alias("xv"), F.covar_pop(y, v).alias("yv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    b, c = F.try_divide(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det), F.try_divide(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det)
    return s.select((F.col("mv") - F.coalesce(b, F.lit(0.0)) * F.col("mx") - F.coalesce(c, F.lit(0.0)) * F.col("my")).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"), F.coalesce(c, F.lit(0.0)).alias("c"))


def cells_inside(box: tuple[float, float, float, float], size: float, polygon: list, spark) -> DataFrame:
    """``(col, row)`` of the cells of a box whose centres are in the polygon (all without one): a range, never collected."""
    x0, y0, x1, y1 = (math.floor(v / size) for v in box)
    wide = x1 - x0 + 1
    c = spark.range(wide * (y1 - y0 + 1)).select((F.col("id") % wide + x0).alias("col"), (F.floor(F.col("id") / wide).cast("long") + y0).alias("row"))
    return c.filter(S.in_polygon((F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size, polygon)) if polygon else c


def density(points: DataFrame, size: float = 2.0, min_height: float = 0.2, canopy: float = 2.0, height: str = "hag") -> DataFrame:
    """Per cell: mean, sd, cv, skewness, kurtosis, percentiles of heights above ``min_height``, density and cover."""
    h = F.when(F.col(height) >= min_height, F.col(height))
    p = F.percentile(h, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    g = points.groupBy(S.cell(F.col("x"), size).alias("col"), S.cell(F.col("y"), size).alias("row")).agg(
        F.count("*").alias("n"), F.avg(h).alias("mean"), F.stddev_pop(h).alias("sd"), F.skewness(h).alias("skew"), F.kurtosis(h).alias("kurt"), p.alias("p"),
        (F.count("*") / F.lit(size * size)).alias("density"), (F.count_if(F.col(height) >= canopy) / F.count("*")).alias("cover"))
    return g.select("col", "row", "n", "mean", "sd", F.try_divide(F.col("sd"), F.col("mean")).alias("cv"), "skew", "kurt", *(F.col("p")[i].alias(f"p{k}") for i, k in enumerate((25, 50, 75, 90, 95))), "density", "cover")


def slope_aspect(grid: DataFrame, size: float, value: str = "lowest", azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Horn's 3 x 3 slope and aspect in degrees, and hillshade, for cells with all neighbours."""
    return terrain_layers(grid, size, value, azimuth, altitude).select("col", "row", "slope", "aspect", "hillshade")


def terrain_layers(grid: DataFrame, size: float, value: str = "lowest", azimuth: float = 315.0, altitude: float = 45.0, latitude: float = 60.0) -> DataFrame:
    """Layers of the 3 x 3 neighbourhood, for cells with all neighbours, in one aggregation.

    Horn's slope and aspect (degrees, clockwise from north, downhill) and hillshade; position index (height less the mean of the eight);
    ruggedness (root of the summed squared differences, Riley et al. 1999); profile and plan curvature (Zevenbergen and Thorne 1987);
    heat load (McCune and Keon 2002, equation 3, aspect folded about the line from north-east to south-west).
    """
    g = grid.select("col", "row", F.col(value).alias("v"))
    spread = g.select(F.explode(_offsets(True)).alias("o"), "col", "row", "v").select((F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"), (-F.col("o.dx")).alias("dx"), (-F.col("o.dy")).alias("dy"), "v")
    name = lambda i, j: f"v{i + 1}{j + 1}"
    at = lambda i, j: F.col(name(i, j))
    nine = [F.sum(F.when((F.col("dx") == i) & (F.col("dy") == j), F.col("v"))).alias(name(i, j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    t = spread.groupBy("col", "row").agg(F.count("*").alias("k"), *nine).filter("k = 9")
    gx = (at(1, 1) + 2 * at(1, 0) + at(1, -1) - at(-1, 1) - 2 * at(-1, 0) - at(-1, -1)) / F.lit(8 * size)
    gy = (at(1, 1) + 2 * at(0, 1) + at(-1, 1) - at(1, -1) - 2 * at(0, -1) - at(-1, -1)) / F.lit(8 * size)
    t = t.withColumns({"gx": gx, "gy": gy})
    steep, az, alt = F.atan(F.hypot("gx", "gy")), math.radians(azimuth), math.radians(altitude)
    aspect = F.pmod(F.degrees(F.atan2(-F.col("gx"), -F.col("gy"))), F.lit(360.0))
    shade = F.greatest(F.lit(0.0), math.sin(alt) * F.cos(steep) + math.cos(alt) * F.sin(steep) * F.cos(F.lit(az) - F.radians(aspect)))
    around = [at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    mean = sum(around[1:], around[0]) / 8
    rugged = F.sqrt(sum(((v - at(0, 0)) * (v - at(0, 0)) for v in around), F.lit(0.0)))
    d, e = ((at(1, 0) + at(-1, 0)) / 2 - at(0, 0)) / F.lit(size**2), ((at(0, 1) + at(0, -1)) / 2 - at(0, 0)) / F.lit(size**2)
    f = (at(1, 1) + at(-1, -1) - at(-1, 1) - at(1, -1)) / F.lit(4 * size**2)
    u, v = (at(1, 0) - at(-1, 0)) / F.lit(2 * size), (at(0, 1) - at(0, -1)) / F.lit(2 * size)
    profile = F.coalesce(F.try_divide(-2 * (d * u * u + e * v * v + f * u * v), u * u + v * v), F.lit(0.0))
    plan = F.coalesce(F.try_divide(2 * (d * v * v + e * u * u - f * u * v), u * u + v * v), F.lit(0.0))
    lat, folded = math.radians(latitude), F.radians(F.abs(180 - F.abs(aspect - 225)))
    heat = 0.339 + 0.808 * math.cos(lat) * F.cos(steep) - 0.196 * math.sin(lat) * F.sin(steep) - 0.482 * F.cos(folded) * F.sin(steep)
    return t.select("col", "row", F.degrees(steep).alias("slope"), aspect.alias("aspect"), shade.alias("hillshade"), (at(0, 0) - mean).alias("tpi"), rugged.alias("tri"), profile.alias("profile_curvature"), plan.alias("plan_curvature"), heat.alias("hli"))


def streams(flow: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Cells that drain at least this share of all cells."""
    n = flow.agg(F.count("*").alias("cells"))
    return flow.crossJoin(F.broadcast(n)).withColumn("stream", F.col("accumulation") >= F.col("cells") * fraction).drop("cells")  # one row


def contour_segments(grid: DataFrame, size: float, interval: float, value: str = "lowest") -> DataFrame:
    """Marching squares: for each square of four known cells and each level that crosses it, the crossed sides, in pairs.

    Levels are exploded within a square only (its own range over the interval), so rows follow relief, not the whole range.
    """
    g = grid.select("col", "row", F.col(value).alias("v"))
    corners = g.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy"), F.lit(n).alias("k")) for n, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))).alias("o"), "col", "row", "v")
    sq = corners.groupBy((F.col("col") - F.col("o.dx")).alias("col"), (F.col("row") - F.col("o.dy")).alias("row")).agg(F.count("*").alias("k"), *(F.sum(F.when(F.col("o.k") == n, F.col("v"))).alias(f"v{n}") for n in range(4))).filter("k = 4")
    low, high = F.least("v0", "v1", "v2", "v3"), F.greatest("v0", "v1", "v2", "v3")
    first, last = F.floor(low / F.lit(interval)).cast("long") + 1, F.floor(high / F.lit(interval)).cast("long")
    lv = sq.filter(first <= last).select("*", F.explode(F.sequence(first, last)).alias("step")).withColumn("level", F.col("step") * F.lit(interval))

    def side(a: str, b: str, x0: float, y0: float, x1: float, y1: float) -> Column:
        va, vb, z = F.col(a), F.col(b), F.col("level")
        t = (z - va) / (vb - va)
        return F.when((va < z) != (vb < z), F.struct(((F.col("col") + x0 + t * (x1 - x0)) * size).alias("x"), ((F.col("row") + y0 + t * (y1 - y0)) * size).alias("y")))

    ends = F.array_compact(F.array(side("v0", "v1", 0.5, 0.5, 1.5, 0.5), side("v1", "v2", 1.5, 0.5, 1.5, 1.5), side("v2", "v3", 1.5, 1.5, 0.5, 1.5), side("v3", "v0", 0.5, 1.5, 0.5, 0.5)))
    lv = lv.withColumn("e", ends)
    pairs = F.when(F.size("e") == 4, F.array(F.struct(F.col("e")[0].alias("p"), F.col("e")[1].alias("q")), F.struct(F.col("e")[2].alias("p"), F.col("e")[3].alias("q")))).otherwise(F.array(F.struct(F.col("e")[0].alias("p"), F.col("e")[1].alias("q"))))
    return lv.filter(F.size("e") >= 2).select("level", "col", "row", F.explode(pairs).alias("s")).select("level", "col", "row", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


# ---------------------------------------------------------------- voxels


def voxels(points: DataFrame, size: float, min_points: int = 1) -> DataFrame:
    v = points.groupBy(*(S.cell(F.col(c), size).alias(f"v{c}") for c in "xyz")).agg(F.count("*").alias("n"))
    return v.filter(F.col("n") >= min_points)


def voxel_change(now: DataFrame, before: DataFrame, size: float, min_points: int = 1, neighbours: bool = True) -> DataFrame:
    """One row: voxels unchanged, appeared, disappeared, and volumes; with ``neighbours`` any of 26 counts as occupied before or after."""
    key = ["vx", "vy", "vz"]
    a, b = (voxels(p, size, min_points).select(*key, F.lit(True).alias(side)) for p, side in ((now, "now"), (before, "ref")))
    # Voxels that both have need no neighbours; only the others are spread over the 26 around them.
    both = a.join(b, key, "full")
    near = F.array(*(F.struct(*(F.lit(d).cast("long").alias(n) for d, n in zip((i, j, k), "ijk"))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k))

    def alone(side: str, other: DataFrame, kind: str) -> DataFrame:
        """Voxels of one side only: ``unchanged`` (of now) where the other side has one beside them."""
        own = both.filter(F.col("ref" if side == "now" else "now").isNull()).select(*key)
        if not neighbours:
            return own.select(F.lit(kind).alias("kind"))
        around = own.select(F.struct(*key).alias("own"), F.explode(near).alias("o")).select("own", *((F.col(f"own.{k}") + F.col(f"o.{n}")).alias(k) for k, n in zip(key, "ijk")))
        met = around.join(other.select(*key), key, "left_semi").select("own").distinct().withColumn("met", F.lit(True))
        marked = own.select(F.struct(*key).alias("own")).join(met, "own", "left")
        return marked.select(F.when(F.col("met"), "unchanged" if side == "now" else "near").otherwise(kind).alias("kind"))

    kind = both.filter("now AND ref").select(F.lit("unchanged").alias("kind")).unionByName(alone("now", b, "appeared")).unionByName(alone("ref", a, "disappeared"))
    one = lambda k: F.count_if(F.col("kind") == k)
    m3 = F.lit(size ** 3)
    return kind.agg(one("unchanged").alias("unchanged"), one("appeared").alias("appeared"), one("disappeared").alias("disappeared"), (one("appeared") * m3).alias("appeared_m3"), (one("disappeared") * m3).alias("disappeared_m3"))


def mark_new_voxels(now: DataFrame, before: DataFrame, size: float, min_points: int = 1, neighbours: bool = True) -> DataFrame:
    """``now`` with ``voxel_change``: 1 in voxels that ``before`` has neither itself nor, with ``neighbours``, beside it; else 0."""
    key = ["vx", "vy", "vz"]
    mine, theirs = (voxels(p, size, min_points).select(*key) for p in (now, before))
    lone = mine.join(theirs, key, "left_anti")
    if neighbours:
        near = F.array(*(F.struct(*(F.lit(d).cast("long").alias(n) for d, n in zip((i, j, k), "ijk"))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k))
        around = lone.select(F.struct(*key).alias("own"), F.explode(near).alias("o")).select("own", *((F.col(f"own.{k}") + F.col(f"o.{n}")).alias(k) for k, n in zip(key, "ijk")))
        met = around.join(theirs, key, "left_semi").select("own.*").distinct()
        lone = lone.join(met, key, "left_anti")
    keyed = now.drop("voxel_change").withColumns({f"v{c}": S.cell(F.col(c), size) for c in "xyz"})
    return keyed.join(lone.withColumn("is_new", F.lit(1)), key, "left").withColumn("voxel_change", F.coalesce("is_new", F.lit(0))).drop(*key, "is_new")


def downsample(points: DataFrame, size: float, keep: str = "center", order: str = "point_id") -> DataFrame:
    """One point per voxel: the first by ``order``, or the one nearest the voxel's centroid.

    The point is chosen by a minimum, which is aggregated partially, not by ranking a voxel's points.
    """
    key = [f"v{c}" for c in "xyz"]
    p = points.select(order, *"xyz", *(S.cell(F.col(c), size).alias(f"v{c}") for c in "xyz"))
    if keep == "first":
        chosen = p.groupBy(*key).agg(F.min(order).alias(order))
    else:
        mean = p.groupBy(*key).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        d = sum((F.pow(F.col(c) - F.col(f"m{c}"), F.lit(2)) for c in "xyz"), F.lit(0.0))
        chosen = p.join(mean, key).groupBy(*key).agg(F.min(F.struct(F.round(d, 9).alias("d"), order)).alias("m")).select(F.col("m")[order].alias(order))
    return points.join(chosen.select(order), order, "left_semi")


def decimate(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy(*(S.cell(F.col(c), size).alias(f"v{c}") for c in "xyz")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


# ---------------------------------------------------------------- survey exports


def polyline_measures(vertices: DataFrame, closed: bool = False) -> DataFrame:
    """``vertices(line, seq, x, y, z)`` -> lengths in 2D and 3D, plan area, height range and rise of each line."""
    w = Window.partitionBy("line").orderBy("seq")
    first = Window.partitionBy("line").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in "xyz"}
    v = vertices.withColumns({f"n{c}": e for c, e in nx.items()} | {"last": F.lead("seq").over(w).isNull()})
    on = F.lit(True) if closed else ~F.col("last")
    d2 = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    d3 = F.hypot(d2, F.col("nz") - F.col("z"))
    up = F.greatest(F.col("nz") - F.col("z"), F.lit(0.0))
    return v.groupBy("line").agg(
        F.coalesce(F.sum(F.when(on, d2)), F.lit(0.0)).alias("length_2d"), F.coalesce(F.sum(F.when(on, d3)), F.lit(0.0)).alias("length_3d"),
        (F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"), (F.max("z") - F.min("z")).alias("height_range"), F.coalesce(F.sum(F.when(on, up)), F.lit(0.0)).alias("rise"))


def profile(points: DataFrame, line: list[tuple[float, float]], width: float = 0.5) -> DataFrame:
    """Points within half the width of a polyline: station along it, offset from it (left positive), from the segment with the least offset."""
    x, y, choices, start = F.col("x"), F.col("y"), [], 0.0
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        n = math.hypot(x2 - x1, y2 - y1)
        if not n:
            continue
        ux, uy = (x2 - x1) / n, (y2 - y1) / n
        t, o = (x - F.lit(x1)) * F.lit(ux) + (y - F.lit(y1)) * F.lit(uy), (y - F.lit(y1)) * F.lit(ux) - (x - F.lit(x1)) * F.lit(uy)
        choices.append(F.when((t >= 0) & (t <= n) & (F.abs(o) <= width / 2), F.struct(F.abs(o).alias("a"), (t + F.lit(start)).alias("station"), o.alias("offset"))))
        start += n
    xs, ys = zip(*line)
    box = x.between(min(xs) - width, max(xs) + width) & y.between(min(ys) - width, max(ys) + width)
    return points.filter(box).withColumn("hit", F.array_min(F.array_compact(F.array(*choices)))).filter(F.col("hit").isNotNull()).select(*points.columns, F.col("hit.station").alias("station"), F.col("hit.offset").alias("offset"))


def ground_line(profiled: DataFrame, step: float = 0.25) -> DataFrame:
    return profiled.filter(F.col("cls") == 2).groupBy(F.floor(F.col("station") / step).cast("long").alias("bin")).agg(F.min("z").alias("z"), F.count("*").alias("n"))


def ortho(points: DataFrame, pixel: float, view: str = "top", value: str = "intensity", order: str = "point_id") -> DataFrame:
    """Nearest point per pixel: the highest from above, or the nearest along +y from the side."""
    u, v, depth = (F.col("x"), F.col("y"), -F.col("z")) if view == "top" else (F.col("x"), F.col("z"), F.col("y"))
    return points.groupBy(S.cell(u, pixel).alias("col"), S.cell(v, pixel).alias("row")).agg(F.min_by(value, F.struct(depth, F.col(order))).alias("value"), F.min(depth).alias("depth"))


def numbered(points: DataFrame, by: str, order: str) -> DataFrame:
    """``nth`` from 0 within ``by``, in order: ranges of the sort key are numbered apart and shifted by the counts before them, so no group is one task."""
    from .neighbours import cut_lineage

    p = cut_lineage(points.repartitionByRange(by, order).withColumn("part", F.spark_partition_id()))
    sizes = p.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = sizes.select(by, "part", (F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(by, "part").orderBy(order)) - 1
    return p.withColumn("inside", inside).join(before, [by, "part"]).withColumn("nth", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def every_nth(points: DataFrame, every: int, order: str = "point_id", by: str = "cls") -> DataFrame:
    """Each n-th point of every layer, in order."""
    return numbered(points, by, order).filter(F.col("nth") % every == 0).drop("nth")
