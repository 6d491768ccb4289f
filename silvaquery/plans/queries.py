"""One query per operator over the test tables, and the same in SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import stats
from ..operators import branches as br
from ..operators import forestry as fo
from ..operators import meshes as me
from ..operators import neighbours as ne
from ..operators import points as po
from ..sources import adapters as ad
from ..sources import grids as gr
from ..sources.adapters import POINTS_SQL, QSM_SQL, TREES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits on some points: those of intensity 70 are deleted, those near the western edge go to tree 5."""
    p = ad.points(spark, sf_dir).select("point_id", "tree_id", "intensity", "x")
    edited = p.filter((F.col("intensity") == 70) | (F.col("x") < 2))
    return edited.select("point_id", F.when(F.col("x") < 2, 5).otherwise(-1).alias("new_tree"), F.when(F.col("intensity") == 70, 3).otherwise(1).alias("semantic"), F.when(F.col("intensity") == 70, 1).otherwise(0).alias("deleted"))


OVERLAID_SQL = POINTS_SQL + """,
overlaid AS (SELECT * REPLACE (CASE WHEN x < 2 THEN 5 ELSE tree_id END AS tree_id) FROM points WHERE intensity <> 70)"""

PLOT = {"kind": "circular", "center": [50.0, 50.0], "radius": 30.0}
BOX = {"kind": "rectangular", "min": [20.0, 20.0], "max": [80.0, 70.0]}
POLYGON = [(5.0, 5.0), (40.0, 8.0), (45.0, 40.0), (20.0, 30.0), (8.0, 45.0)]


def _sql_in_polygon(polygon: list = POLYGON) -> str:
    terms = []
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 == y2:
            continue
        terms.append(f"CASE WHEN (({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y)) AND (x < {x2 - x1}::DOUBLE * (y - {y1}::DOUBLE) / {y2 - y1}::DOUBLE + {x1}::DOUBLE) THEN 1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 2 = 1"


# ---------------------------------------------------------------- points

_SUMMARY = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS sd_{c}" for c in "xyz")


@query(f"WITH {OVERLAID_SQL} SELECT tree_id, count(*) AS n, {_SUMMARY} FROM overlaid GROUP BY tree_id")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.summary(po.apply_overlay(ad.points(spark, sf_dir), overlay(spark, sf_dir))))


@query(f"WITH {POINTS_SQL} SELECT CASE WHEN tree_id % 10 = 3 THEN tree_id - 1 ELSE tree_id END AS tree_id, count(*) AS n, {_SUMMARY} FROM points GROUP BY 1")
def metrics_summary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = spark.range(97).filter("id % 10 = 3").select(F.col("id").cast("int").alias("tree_id"), (F.col("id") - 1).cast("int").alias("into"))
    return rounded(po.summary(ad.points(spark, sf_dir), merges))


@query(f"WITH {OVERLAID_SQL} SELECT point_id, tree_id, CASE WHEN x < 2 THEN 1 ELSE 0 END AS semantic FROM overlaid")
def overlay_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.apply_overlay(ad.points(spark, sf_dir), overlay(spark, sf_dir)).select("point_id", "tree_id", "semantic")


@query(f"WITH {POINTS_SQL} SELECT point_id, x, y, z FROM points WHERE z BETWEEN 10 AND 40 AND intensity >= 20 AND cls IN (1, 2) AND abs((x - 20) * 0.6::DOUBLE + (z - 20) * 0.8::DOUBLE) <= 5")
def export_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = po.subset(ad.points(spark, sf_dir), {"z": (10, 40), "intensity": (20, None)}, [1, 2], {"anchor": (20, 0, 20), "normal": (3, 0, 4), "thickness": 10})
    return p.select("point_id", "x", "y", "z")


@query(f"WITH {POINTS_SQL} SELECT point_id FROM points WHERE x BETWEEN 5 AND 45 AND y BETWEEN 5 AND 45 AND {_sql_in_polygon()}")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.subset(ad.points(spark, sf_dir), polygon=POLYGON).select("point_id")


@query(f"WITH {POINTS_SQL} SELECT point_id, tree_id, CASE WHEN cls = 2 THEN 1 ELSE cls END AS cls, 0 AS reset_tree FROM points")
def ground_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = po.reset_label(ad.points(spark, sf_dir), "cls", 2, 1).withColumn("reset_tree", F.col("tree_id"))
    return po.reset_label(p, "reset_tree").select("point_id", "tree_id", "cls", "reset_tree")


_RANGED = f"""WITH {POINTS_SQL}, r AS (SELECT *, sqrt((x - 25.1::DOUBLE) * (x - 25.1::DOUBLE) + (y - 25.1::DOUBLE) * (y - 25.1::DOUBLE) + (z - 2.3::DOUBLE) * (z - 2.3::DOUBLE)) AS range,
  CAST(floor(degrees(atan2(y - 25.1::DOUBLE, x - 25.1::DOUBLE)) / 10.0) AS INT) AS az_bin,
  CAST(floor(degrees(atan2(z - 2.3::DOUBLE, sqrt((x - 25.1::DOUBLE) * (x - 25.1::DOUBLE) + (y - 25.1::DOUBLE) * (y - 25.1::DOUBLE)))) / 10.0) AS INT) AS el_bin FROM points)"""


@query(_RANGED + " SELECT az_bin, el_bin, count(*) AS n, round(min(range), 6) AS nearest FROM r GROUP BY 1, 2")
def scan_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.scan_inspection(ad.points(spark, sf_dir), (25.1, 25.1, 2.3), 10.0))


@query(_RANGED + ", m AS (SELECT point_id, range, min(range) OVER (PARTITION BY az_bin, el_bin) AS nearest FROM r) SELECT point_id, round(range, 6) AS range FROM m WHERE range <= nearest + 0.5")
def hidden_point_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.visible(ad.points(spark, sf_dir), (25.1, 25.1, 2.3), 10.0, 0.5).select("point_id", "range"))


@query(f"WITH {POINTS_SQL} SELECT count(*) AS n_points, count(DISTINCT tree_id) AS n_trees, max(tree_id) AS max_tree_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, min(intensity) AS min_intensity, max(intensity) AS max_intensity FROM points")
def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.info(ad.points(spark, sf_dir))


@query(f"WITH {POINTS_SQL} SELECT point_id, round(0.8::DOUBLE * x - 0.6::DOUBLE * y + 100, 6) AS x, round(0.6::DOUBLE * x + 0.8::DOUBLE * y - 50, 6) AS y, round(z + 2, 6) AS z FROM points")
def dataset_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.transform(ad.points(spark, sf_dir), [0.8, -0.6, 0, 100, 0.6, 0.8, 0, -50, 0, 0, 1, 2, 0, 0, 0, 1]).select("point_id", "x", "y", "z"))


@query(f"WITH {POINTS_SQL} SELECT point_id, round(round((x - 0.1) / 0.3) * 0.3 + 0.1, 6) AS x, round(round((y - 0.1) / 0.3) * 0.3 + 0.1, 6) AS y, round(round(z / 0.3) * 0.3, 6) AS z FROM points")
def dataset_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.realign(ad.points(spark, sf_dir), 0.3, (0.1, 0.1, 0.0)).select("point_id", "x", "y", "z"))


@query(f"WITH {POINTS_SQL} SELECT CAST(min(intensity) AS INT) AS low, CAST(max(intensity) AS INT) AS top, CASE WHEN max(intensity) <= 1 THEN 65535.0::DOUBLE WHEN max(intensity) <= 255 THEN 257.0::DOUBLE WHEN max(intensity) <= 4095 THEN round(65535.0::DOUBLE / 4095, 6) ELSE 1.0::DOUBLE END AS factor FROM points")
def intensity_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.infer_scale(ad.points(spark, sf_dir), "intensity"))


@query(f"WITH {POINTS_SQL} SELECT least(20, CAST(floor(z / 2.5) + 1 AS INT)) AS bin, count(*) AS n FROM points WHERE z BETWEEN 0 AND 50 GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.histogram(ad.points(spark, sf_dir), "z", 0.0, 50.0, 20)


# ---------------------------------------------------------------- grids and voxels

_GRID = f"{POINTS_SQL}, grid AS (SELECT CAST(floor(x / 2.0) AS BIGINT) AS col, CAST(floor(y / 2.0) AS BIGINT) AS row, count(*) AS n, max(z) AS top, min(z) AS lowest, avg(z) AS mean, min(CASE WHEN cls = 2 THEN z END) AS ground FROM points GROUP BY 1, 2)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.surface_grid(ad.points(spark, sf_dir), 2.0)


@query(f"WITH {_GRID} SELECT col, row, n, top, lowest, round(mean, 6) AS mean, ground FROM grid")
def surface_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_grid(spark, sf_dir))


@query(f"WITH {_GRID} SELECT count(mean) AS cells, round(sum(greatest(mean - 25.0, 0.0::DOUBLE)) * 4, 6) AS above, round(sum(greatest(25.0 - mean, 0.0::DOUBLE)) * 4, 6) AS below, round(sum(mean - 25.0) * 4, 6) AS net, round(greatest(max(mean - 25.0), 0.0::DOUBLE), 6) AS max_above, round(greatest(max(25.0 - mean), 0.0::DOUBLE), 6) AS max_below FROM grid")
def ground_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.volume(_grid(spark, sf_dir), 2.0, 25.0, "mean"))


@query(f"""WITH {_GRID}, lack AS (SELECT g.col, g.row, g.mean AS v FROM grid g WHERE (SELECT count(*) FROM grid h WHERE abs(h.col - g.col) + abs(h.row - g.row) = 1) < 4),
s AS (SELECT avg(col) mx, avg(row) my, avg(v) mv, covar_pop(col, col) xx, covar_pop(row, row) yy, covar_pop(col, row) xy, covar_pop(col, v) xv, covar_pop(row, v) yv FROM lack),
p AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS b, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS c FROM s)
SELECT round(mv - b * mx - c * my, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM p""")
def rim_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.rim_plane(_grid(spark, sf_dir), "mean"))


@query(f"""WITH {POINTS_SQL}, dtm AS (SELECT floor(x / 0.5) AS c, floor(y / 0.5) AS r, min(z) AS dtm FROM points WHERE cls = 2 GROUP BY 1, 2)
SELECT point_id, z - dtm AS hag FROM points LEFT JOIN dtm ON floor(x / 0.5) = c AND floor(y / 0.5) = r""")
def ground_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.normalize(ad.points(spark, sf_dir), 0.5).select("point_id", "hag")


_SIDES = ", ".join(f"({i}, {j}, {k}, [{', '.join(str(list(c)) for c in corners)}])" for (i, j, k), corners in me.SIDES.items())
_SQUARES = f"""WITH {POINTS_SQL}, cells AS (SELECT CAST(floor(x / 2.5) AS BIGINT) AS i, CAST(floor(y / 2.5) AS BIGINT) AS j, CAST(floor(z / 2.5) AS BIGINT) AS k FROM points WHERE scan = 1 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
sides(di, dj, dk, corners) AS (VALUES {_SIDES}),
squares AS (SELECT c.*, s.* FROM cells c CROSS JOIN sides s WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.i = c.i + di AND o.j = c.j + dj AND o.k = c.k + dk))"""


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.surface_squares(ad.points(spark, sf_dir).filter("scan = 1"), 2.5, 2)


@query(_SQUARES + """, corner AS (SELECT i + c[1] AS i, j + c[2] AS j, k + c[3] AS k, (i0 + 0.5 + di * 0.5) * 2.5 AS mx, (j0 + 0.5 + dj * 0.5) * 2.5 AS my, (k0 + 0.5 + dk * 0.5) * 2.5 AS mz FROM (SELECT *, i AS i0, j AS j0, k AS k0, unnest(corners) AS c FROM squares))
SELECT i, j, k, round(avg(mx), 6) AS x, round(avg(my), 6) AS y, round(avg(mz), 6) AS z FROM corner GROUP BY ALL""")
def mesh_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.corner_places(_squares(spark, sf_dir)).select("v.i", "v.j", "v.k", "x", "y", "z"))


@query(_SQUARES + """, t AS (SELECT i, j, k, corners[1] AS a, corners[2] AS b, corners[3] AS c FROM squares UNION ALL SELECT i, j, k, corners[1], corners[3], corners[4] FROM squares)
SELECT i + a[1] AS ai, j + a[2] AS aj, k + a[3] AS ak, i + b[1] AS bi, j + b[2] AS bj, k + b[3] AS bk, i + c[1] AS ci, j + c[2] AS cj, k + c[3] AS ck FROM t""")
def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.triangles(_squares(spark, sf_dir)).select(*(F.col(f"{t}.{k}").alias(f"{t}{k}") for t in "abc" for k in "ijk"))


@query(f"""WITH {POINTS_SQL}, cells AS (SELECT CAST(floor(x / 1.5) AS BIGINT) AS col, CAST(floor(y / 1.5) AS BIGINT) AS row, min(z) FILTER (cls = 2 AND z < 12) AS dtm FROM points GROUP BY 1, 2),
near AS (SELECT a.col, a.row, b.dtm, sqrt(((a.col + 0.5) * 1.5 - (b.col + 0.5) * 1.5) ** 2 + ((a.row + 0.5) * 1.5 - (b.row + 0.5) * 1.5) ** 2) AS d, b.col AS c, b.row AS r FROM cells a, cells b WHERE a.dtm IS NULL AND b.dtm IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col, row ORDER BY d, c, r) AS n FROM near)
SELECT col, row, round(dtm, 6) AS dtm, false AS filled FROM cells WHERE dtm IS NOT NULL UNION ALL SELECT col, row, round(sum(dtm / d) / sum(1 / d), 6), true FROM ranked WHERE n <= 4 GROUP BY 1, 2""")
def ground_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.points(spark, sf_dir).withColumn("cls", F.when(F.col("z") < 12, F.col("cls")).otherwise(1))
    return rounded(po.ground_model(p, 1.5))


@query(f"""WITH {_GRID}, p AS (SELECT point_id, x / 2.0 - 0.5 AS u, y / 2.0 - 0.5 AS v FROM points), q AS (SELECT *, floor(u) AS c, floor(v) AS r FROM p)
SELECT point_id, round((a.mean * (1 - (u - c)) + b.mean * (u - c)) * (1 - (v - r)) + (d.mean * (1 - (u - c)) + e.mean * (u - c)) * (v - r), 6) AS undulation FROM q
LEFT JOIN grid a ON a.col = c AND a.row = r LEFT JOIN grid b ON b.col = c + 1 AND b.row = r LEFT JOIN grid d ON d.col = c AND d.row = r + 1 LEFT JOIN grid e ON e.col = c + 1 AND e.row = r + 1""")
def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.sampled(ad.points(spark, sf_dir), _grid(spark, sf_dir), 2.0, "mean", "undulation").select("point_id", "undulation"))


def _bilinear(t: str) -> str:
    """A grid of means between cell centres, as SQL over points p; t: its alias, its size, and its last cell but one."""
    a, size, last = t.split()
    u, v = (f"(p.{c} / {size} - 0.5)" for c in "xy")
    i, j = (f"least(floor({w}), {last})" for w in (u, v))
    return f"""LEFT JOIN (SELECT p.point_id, a.m * (1 - u) * (1 - v) + b.m * u * (1 - v) + c.m * (1 - u) * v + d.m * u * v AS z FROM (SELECT point_id, {u} - {i} AS u, {v} - {j} AS v, {i} AS i, {j} AS j FROM points p WHERE {u} <= {last} + 1 AND {v} <= {last} + 1) p
JOIN {a} a ON a.i = p.i AND a.j = p.j JOIN {a} b ON b.i = p.i + 1 AND b.j = p.j JOIN {a} c ON c.i = p.i AND c.j = p.j + 1 JOIN {a} d ON d.i = p.i + 1 AND d.j = p.j + 1) {a}_z USING (point_id)"""


@query(f"""WITH {POINTS_SQL}, wide AS (SELECT CAST(floor(x / 10.0) AS BIGINT) AS i, CAST(floor(y / 10.0) AS BIGINT) AS j, avg(z) AS m FROM points GROUP BY 1, 2),
fine AS (SELECT CAST(floor(x / 2.0) AS BIGINT) AS i, CAST(floor(y / 2.0) AS BIGINT) AS j, avg(z) AS m FROM points WHERE x >= 10 AND x < 30 AND y >= 10 AND y < 30 GROUP BY 1, 2)
SELECT point_id, round(CASE WHEN p.x BETWEEN 11 AND 29 AND p.y BETWEEN 11 AND 29 THEN fine_z.z ELSE wide_z.z END, 6) AS value FROM points p {_bilinear("wide 10.0 3")} {_bilinear("fine 2.0 13")}""")
def grid_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 10 m over all and one of 2 m nested in it: each point takes the finer one where it can."""
    p = ad.points(spark, sf_dir)
    cells = lambda df, size, g: df.groupBy(F.lit(g).alias("grid"), S.cell(F.col("x"), size).alias("i"), S.cell(F.col("y"), size).alias("j")).agg(F.avg("z").alias("value"))
    fine = cells(p.filter("x >= 10 AND x < 30 AND y >= 10 AND y < 30"), 2.0, 1).withColumns({"i": F.col("i") - 5, "j": F.col("j") - 5})
    lattices = [gr.Lattice(0, 5.0, 5.0, 10.0, 10.0, 5, 5), gr.Lattice(1, 11.0, 11.0, 2.0, 2.0, 10, 10)]
    return rounded(gr.nested_values(p, lattices, cells(p, 10.0, 0).unionByName(fine), ["value"]).select("point_id", "value"))


_M = "(avg(h * h * h) - 3 * avg(h) * avg(h * h) + 2 * avg(h) ** 3) / nullif(stddev_pop(h) ** 3, 0)"


@query(f"""WITH {POINTS_SQL}, h AS (SELECT *, CASE WHEN z >= 0.2 THEN z END AS h FROM points)
SELECT CAST(floor(x / 5.0) AS BIGINT) AS col, CAST(floor(y / 5.0) AS BIGINT) AS row, count(*) AS n, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS sd, round(stddev_pop(h) / avg(h), 6) AS cv,
round({_M}, 6) AS skew, round(kurtosis_pop(h), 6) AS kurt, {', '.join(f'round(quantile_cont(h, {q / 100}), 6) AS p{q}' for q in (25, 50, 75, 90, 95))},
count(*) / 25.0::DOUBLE AS density, round(count(*) FILTER (z >= 2) / count(*)::DOUBLE, 6) AS cover FROM h GROUP BY 1, 2""")
def metrics_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.density(ad.points(spark, sf_dir), 5.0, 0.2, 2.0, "z"))


_NINE = f"""WITH {_GRID}, o AS (SELECT c.col, c.row, g.col - c.col AS dx, g.row - c.row AS dy, g.mean AS v FROM (SELECT DISTINCT col + i.r AS col, row + j.r AS row FROM grid, (SELECT unnest([-1,0,1]) r) i, (SELECT unnest([-1,0,1]) r) j) c JOIN grid g ON g.col BETWEEN c.col - 1 AND c.col + 1 AND g.row BETWEEN c.row - 1 AND c.row + 1),
n AS (SELECT col, row, {', '.join(f"sum(v) FILTER (dx = {i} AND dy = {j}) AS v{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))} FROM o GROUP BY 1, 2 HAVING count(*) = 9),
k AS (SELECT *, (v22 + 2 * v21 + v20 - v02 - 2 * v01 - v00) / 16.0 AS gx, (v22 + 2 * v12 + v02 - v20 - 2 * v10 - v00) / 16.0 AS gy,
  ((v21 + v01) / 2 - v11) / 4.0 AS d, ((v12 + v10) / 2 - v11) / 4.0 AS e, (v22 + v00 - v02 - v20) / 16.0 AS f, (v21 - v01) / 4.0 AS u, (v12 - v10) / 4.0 AS w FROM n),
a AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS s, CASE WHEN degrees(atan2(-gx, -gy)) < 0 THEN degrees(atan2(-gx, -gy)) + 360 ELSE degrees(atan2(-gx, -gy)) END AS aspect FROM k)"""


@query(_NINE + """ SELECT col, row, round(degrees(s), 5) AS slope, round(aspect, 5) AS aspect, round(greatest(0.0::DOUBLE, sin(radians(45)) * cos(s) + cos(radians(45)) * sin(s) * cos(radians(315) - radians(aspect))), 5) AS hillshade FROM a""")
def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.slope_aspect(_grid(spark, sf_dir), 2.0, "mean"), 5)


_RUGGED = " + ".join(f"(v{i}{j} - v11) ** 2" for i in range(3) for j in range(3) if (i, j) != (1, 1))
_EIGHT = " + ".join(f"v{i}{j}" for i in range(3) for j in range(3) if (i, j) != (1, 1))


@query(_NINE + f""" SELECT col, row, round(v11 - ({_EIGHT}) / 8, 5) AS tpi, round(sqrt({_RUGGED}), 5) AS tri,
round(coalesce(-2 * (d * u * u + e * w * w + f * u * w) / nullif(u * u + w * w, 0), 0.0::DOUBLE), 5) AS profile_curvature, round(coalesce(2 * (d * w * w + e * u * u - f * u * w) / nullif(u * u + w * w, 0), 0.0::DOUBLE), 5) AS plan_curvature,
round(0.339 + 0.808 * cos(radians(60)) * cos(s) - 0.196 * sin(radians(60)) * sin(s) - 0.482 * cos(radians(abs(180 - abs(aspect - 225)))) * sin(s), 5) AS hli FROM a""")
def terrain_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.terrain_layers(_grid(spark, sf_dir), 2.0, "mean").select("col", "row", "tpi", "tri", "profile_curvature", "plan_curvature", "hli"), 5)


def _side(a: str, b: str, x: str, y: str) -> str:
    return f"CASE WHEN ({a} < level) <> ({b} < level) THEN struct_pack(x := {x.format(t=f'((level - {a}) / ({b} - {a}))')}, y := {y.format(t=f'((level - {a}) / ({b} - {a}))')}) END"


_ENDS = ", ".join(_side(*v) for v in (("v0", "v1", "col + 0.5 + {t}", "row + 0.5"), ("v1", "v2", "col + 1.5", "row + 0.5 + {t}"), ("v2", "v3", "col + 1.5 - {t}", "row + 1.5"), ("v3", "v0", "col + 0.5", "row + 1.5 - {t}")))


@query(f"""WITH {_GRID}, sq AS (SELECT a.col, a.row, a.mean AS v0, b.mean AS v1, c.mean AS v2, d.mean AS v3 FROM grid a JOIN grid b ON b.col = a.col + 1 AND b.row = a.row JOIN grid c ON c.col = a.col + 1 AND c.row = a.row + 1 JOIN grid d ON d.col = a.col AND d.row = a.row + 1),
l AS (SELECT *, unnest(range(CAST(floor(least(v0, v1, v2, v3) / 5.0) AS BIGINT) + 1, CAST(floor(greatest(v0, v1, v2, v3) / 5.0) AS BIGINT) + 1)) * 5.0::DOUBLE AS level FROM sq),
e AS (SELECT level, list_filter([{_ENDS}], lambda p: p IS NOT NULL) AS e FROM l),
g AS (SELECT level, e[1] AS p, e[2] AS q FROM e WHERE len(e) >= 2 UNION ALL SELECT level, e[3], e[4] FROM e WHERE len(e) = 4)
SELECT level, count(*) AS segments, round(sum(2 * sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 5) AS length, round(avg(p.x + q.x), 5) AS mid_x, round(avg(p.y + q.y), 5) AS mid_y FROM g GROUP BY level""")
def ground_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = po.contour_segments(_grid(spark, sf_dir), 2.0, 5.0, "mean")
    n = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    return rounded(seg.groupBy("level").agg(F.count("*").alias("segments"), F.sum(n).alias("length"), F.avg((F.col("x1") + F.col("x2")) / 2).alias("mid_x"), F.avg((F.col("y1") + F.col("y2")) / 2).alias("mid_y")), 5)


_VOX = f"""WITH {POINTS_SQL}, a AS (SELECT DISTINCT CAST(floor(x / 2.0) AS BIGINT) vx, CAST(floor(y / 2.0) AS BIGINT) vy, CAST(floor(z / 2.0) AS BIGINT) vz FROM points WHERE epoch = 0),
b AS (SELECT DISTINCT CAST(floor(x / 2.0) AS BIGINT) vx, CAST(floor(y / 2.0) AS BIGINT) vy, CAST(floor(z / 2.0) AS BIGINT) vz FROM points WHERE epoch = 1),
o AS (SELECT unnest([-1, 0, 1]) AS d), s AS (SELECT i.d AS i, j.d AS j, k.d AS k FROM o i, o j, o k),
ga AS (SELECT DISTINCT vx + i AS vx, vy + j AS vy, vz + k AS vz FROM a, s), gb AS (SELECT DISTINCT vx + i AS vx, vy + j AS vy, vz + k AS vz FROM b, s),
c AS (SELECT (SELECT count(*) FROM a SEMI JOIN gb USING (vx, vy, vz)) AS unchanged, (SELECT count(*) FROM a ANTI JOIN gb USING (vx, vy, vz)) AS appeared, (SELECT count(*) FROM b ANTI JOIN ga USING (vx, vy, vz)) AS disappeared)
SELECT *, appeared * 8.0::DOUBLE AS appeared_m3, disappeared * 8.0::DOUBLE AS disappeared_m3 FROM c"""


@query(_VOX)
def change_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.points(spark, sf_dir)
    return rounded(po.voxel_change(p.filter("epoch = 0"), p.filter("epoch = 1"), 2.0))


@query(f"""WITH {POINTS_SQL}, a AS (SELECT DISTINCT CAST(floor(x / 2.0) AS BIGINT) vx, CAST(floor(y / 2.0) AS BIGINT) vy, CAST(floor(z / 2.0) AS BIGINT) vz FROM points WHERE epoch = 1),
b AS (SELECT DISTINCT CAST(floor(x / 2.0) AS BIGINT) vx, CAST(floor(y / 2.0) AS BIGINT) vy, CAST(floor(z / 2.0) AS BIGINT) vz FROM points WHERE epoch = 0 AND z < 30),
o AS (SELECT unnest([-1, 0, 1]) AS d), g AS (SELECT DISTINCT vx + i.d AS vx, vy + j.d AS vy, vz + k.d AS vz FROM b, o i, o j, o k), n AS (SELECT * FROM a ANTI JOIN g USING (vx, vy, vz))
SELECT point_id, CASE WHEN n.vx IS NULL THEN 0 ELSE 1 END AS voxel_change FROM points LEFT JOIN n ON floor(x / 2.0) = vx AND floor(y / 2.0) = vy AND floor(z / 2.0) = vz WHERE epoch = 1""")
def change_voxel_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.points(spark, sf_dir)
    return po.mark_new_voxels(p.filter("epoch = 1"), p.filter("epoch = 0 AND z < 30"), 2.0).select("point_id", "voxel_change")


@query(f"""WITH {POINTS_SQL}, m AS (SELECT *, floor(x / 3.0) vx, floor(y / 3.0) vy, floor(z / 3.0) vz FROM points),
c AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM m WINDOW w AS (PARTITION BY vx, vy, vz)),
r AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 9), point_id) AS n FROM c)
SELECT point_id, x, y, z FROM r WHERE n = 1""")
def dataset_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.downsample(ad.points(spark, sf_dir), 3.0, "center").select("point_id", "x", "y", "z")


@query(f"WITH {POINTS_SQL} SELECT CAST(floor(x / 3.0) AS BIGINT) AS vx, CAST(floor(y / 3.0) AS BIGINT) AS vy, CAST(floor(z / 3.0) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM points GROUP BY 1, 2, 3")
def voxel_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.decimate(ad.points(spark, sf_dir), 3.0))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT *, (x - 5) * 0.8::DOUBLE + (y - 5) * 0.6::DOUBLE AS station, (y - 5) * 0.8::DOUBLE - (x - 5) * 0.6::DOUBLE AS off FROM points)
SELECT point_id, round(station, 6) AS station, round(off, 6) AS "offset" FROM p WHERE station BETWEEN 0 AND 45 AND abs(off) <= 1""")
def export_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(po.profile(ad.points(spark, sf_dir), [(5.0, 5.0), (41.0, 32.0)], 2.0).select("point_id", "station", "offset"))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT CAST(floor(x) AS BIGINT) AS col, CAST(floor(y) AS BIGINT) AS row, intensity AS value, -z AS depth, row_number() OVER (PARTITION BY floor(x), floor(y) ORDER BY -z, point_id) AS n FROM points)
SELECT col, row, value, depth FROM r WHERE n = 1""")
def export_ortho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.ortho(ad.points(spark, sf_dir), 1.0)


@query(f"WITH {POINTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY point_id) - 1 AS n FROM points) SELECT cls, point_id, x, y, z FROM r WHERE n % 10 = 0")
def export_dxf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.every_nth(ad.points(spark, sf_dir), 10).select("cls", "point_id", "x", "y", "z")


@query("""WITH v AS (SELECT o_custkey AS line, o_orderkey AS seq, (o_orderkey % 100)::DOUBLE AS x, (o_orderkey * 7 % 100)::DOUBLE AS y, o_totalprice / 1000.0::DOUBLE AS z FROM orders),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM v WINDOW w AS (PARTITION BY line ORDER BY seq))
SELECT line, round(coalesce(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 0.0::DOUBLE), 6) AS length_2d, round(coalesce(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2 + (nz - z) ** 2)), 0.0::DOUBLE), 6) AS length_3d,
round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 6) AS area, round(max(z) - min(z), 6) AS height_range, round(coalesce(sum(greatest(nz - z, 0.0::DOUBLE)) FILTER (nz IS NOT NULL), 0.0::DOUBLE), 6) AS rise FROM n GROUP BY line""")
def export_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = ad.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), k.alias("seq"), (k % 100).cast("double").alias("x"), (k * 7 % 100).cast("double").alias("y"), (F.col("o_totalprice") / F.lit(1000.0)).alias("z"))
    return rounded(po.polyline_measures(v))


# ---------------------------------------------------------------- trees


@query(f"""WITH {TREES_SQL}, f AS (SELECT *, CASE WHEN tree_id % 4 = 0 THEN tree_id % 60 / 100.0::DOUBLE END AS fit FROM trees)
SELECT tree_id, CASE WHEN fit > 0 THEN fit ELSE dbh END AS dbh, CASE WHEN fit > 0 THEN 'ransac' WHEN dbh IS NOT NULL THEN 'band' ELSE 'none' END AS dbh_source,
round(pi() * ((CASE WHEN fit > 0 THEN fit ELSE dbh END) / 2) ** 2, 6) AS basal_area FROM f""")
def merge_stem_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.trees(spark, sf_dir)
    fits = t.filter("tree_id % 4 = 0").select("tree_id", (F.col("tree_id") % 60 / F.lit(100.0)).alias("dbh"))
    return rounded(fo.merge_stem_fits(t, fits).select("tree_id", "dbh", "dbh_source", "basal_area"))


def _sql_laas(kind: str) -> str:
    a1, a2, a3, a4, a5 = S.LAASASENAHO[kind]
    return f"{a1} * pow(dbh * 100, {a2}) * pow({a3}, dbh * 100) * pow(height, {a4}) * pow(height - 1.3, {a5}) / 1000.0"


VOLUMES_SQL = f"""{TREES_SQL}, {QSM_SQL}, k AS (SELECT t.*, q.stem_volume, q.confidence, CASE WHEN species IS NULL THEN 'pine' WHEN lower(trim(species)) IN ('pine', 'manty', 'mänty') THEN 'pine' WHEN lower(trim(species)) IN ('spruce', 'kuusi') THEN 'spruce' WHEN lower(trim(species)) IN ('birch', 'koivu') THEN 'birch' END AS kind FROM trees t LEFT JOIN qsm q USING (tree_id)),
m AS (SELECT *, CASE WHEN stem_volume > 0 THEN stem_volume END AS scanned, CASE WHEN height >= 4 AND dbh > 0 THEN CASE kind {' '.join(f"WHEN '{k}' THEN {_sql_laas(k)}" for k in S.LAASASENAHO)} END END AS model,
CASE WHEN dbh > 0 AND height > 0 THEN pi() * (dbh / 2) ** 2 * height * 0.5 END AS form FROM k),
vol AS (SELECT tree_id, coalesce(scanned, model, form) AS volume, CASE WHEN scanned IS NOT NULL THEN 'qsm' WHEN model IS NOT NULL THEN 'laasasenaho' WHEN form IS NOT NULL THEN 'formFactor' ELSE 'none' END AS volume_source FROM m)"""


@query(f"WITH {VOLUMES_SQL} SELECT tree_id, round(volume, 6) AS volume, volume_source FROM vol")
def metrics_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.volumes(ad.trees(spark, sf_dir), ad.qsm(spark, sf_dir)))


@query(f"WITH {VOLUMES_SQL} SELECT volume_source, count(*) AS n, round(coalesce(sum(volume), 0.0::DOUBLE), 6) AS volume FROM vol GROUP BY 1")
def volume_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.volumes(ad.trees(spark, sf_dir), ad.qsm(spark, sf_dir)).groupBy("volume_source").agg(F.count("*").alias("n"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")))


_WOOD_SQL = {i: " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in S.WOOD.items()) for i in range(3)}
BIOMASS_SQL = f"""{TREES_SQL}, {QSM_SQL}, j AS (SELECT q.*, coalesce(CASE WHEN lower(trim(species)) IN ('pine', 'manty', 'mänty') THEN 'pine' WHEN lower(trim(species)) IN ('spruce', 'kuusi') THEN 'spruce' WHEN lower(trim(species)) IN ('birch', 'koivu') THEN 'birch' END, lower(trim(species)), 'pine') AS sp FROM qsm q LEFT JOIN trees t USING (tree_id)),
w AS (SELECT *, CASE sp {_WOOD_SQL[0]} ELSE 400.0 END AS rho, CASE sp {_WOOD_SQL[1]} ELSE 25.0 END AS rho_std, CASE sp {_WOOD_SQL[2]} ELSE 0.5 END AS cf, 0.02::DOUBLE AS cf_std, stem_volume + branch_volume AS v, sqrt(stem_volume_std ** 2 + (0.25 * branch_volume) ** 2) AS vs FROM j),
b AS (SELECT *, rho * v AS biomass, cf * rho * v AS carbon, vs / nullif(v, 0) AS rv, rho_std / rho AS rr, cf_std / cf AS rc FROM w)"""


@query(f"WITH {BIOMASS_SQL} SELECT tree_id, round(v, 6) AS volume, round(vs, 6) AS volume_std, round(biomass, 6) AS biomass, round(biomass * sqrt(rv * rv + rr * rr), 6) AS biomass_std, round(carbon, 6) AS carbon, round(carbon * sqrt(rv * rv + rr * rr + rc * rc), 6) AS carbon_std, round(carbon * (44.0 / 12.0), 6) AS co2e FROM b")
def metrics_biomass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.biomass(ad.qsm(spark, sf_dir), ad.trees(spark, sf_dir)).select("tree_id", "volume", "volume_std", "biomass", "biomass_std", "carbon", "carbon_std", "co2e"))


@query(f"""WITH {BIOMASS_SQL}, r AS (SELECT sum(e) AS e FROM (SELECT (any_value(rr) * sum(biomass)) ** 2 AS e FROM b GROUP BY rho, rho_std)), c AS (SELECT sum(e) AS e FROM (SELECT (any_value(rc) * sum(carbon)) ** 2 AS e FROM b GROUP BY cf, cf_std)),
t AS (SELECT count(*) AS n, sum(v) AS v, sqrt(sum(vs * vs)) AS vs, sum(biomass) AS bm, sum(carbon) AS ca, sum((rho * vs) ** 2) AS bv FROM b),
u AS (SELECT t.*, sqrt(bv + r.e) AS bs, c.e AS ce FROM t, r, c)
SELECT n AS n_trees, round(v, 4) AS volume, round(vs, 4) AS volume_std, round(bm, 4) AS biomass, round(bs, 4) AS biomass_std, round(ca, 4) AS carbon, round(sqrt((bs / bm * ca) ** 2 + ce), 4) AS carbon_std, round(ca * (44.0 / 12.0), 4) AS co2e, round(sqrt((bs / bm * ca) ** 2 + ce) * (44.0 / 12.0), 4) AS co2e_std FROM u""")
def biomass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.biomass_totals(fo.biomass(ad.qsm(spark, sf_dir), ad.trees(spark, sf_dir))), 4)


def _plot_sql(weight: str, area: float) -> str:
    return f"""WITH {TREES_SQL}, {QSM_SQL}, j AS (SELECT t.*, q.stem_volume, q.stem_volume_ci95 FROM trees t LEFT JOIN qsm q USING (tree_id)),
w AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN 0.0::DOUBLE ELSE {weight} END AS w, CASE WHEN dbh > 0 THEN pi() * (dbh / 2) ** 2 END AS g FROM j)
SELECT round({area!r}::DOUBLE, 6) AS area_ha, round(sum(w), 6) AS n_weighted, count(*) FILTER (w = 1) AS n_fully_in, count(*) FILTER (w > 0 AND w < 1) AS n_partial, count(*) FILTER (w = 0) AS n_out, round(sum(w) / {area!r}::DOUBLE, 6) AS stems_per_ha, round(sum(w * g) / {area!r}::DOUBLE, 6) AS basal_area_per_ha,
round(sum(w * g * height) FILTER (height > 0) / sum(w * g) FILTER (height > 0), 6) AS lorey_mean_height, count(*) FILTER (w > 0 AND g IS NOT NULL AND (height IS NULL OR height <= 0)) AS n_no_height,
round(sum(w * stem_volume) / {area!r}::DOUBLE, 6) AS stem_volume_per_ha, round(sqrt(sum((w * stem_volume_ci95) ** 2)) / {area!r}::DOUBLE, 6) AS stem_volume_ci95_per_ha FROM w"""


_IN_PLOT = "({x} - 50.0) * ({x} - 50.0) + ({y} - 50.0) * ({y} - 50.0) <= 900.0"
_CROWN = " + ".join(f"CASE WHEN {_IN_PLOT.format(x=f'(x + sqrt(crown_area / pi()) * {u!r}::DOUBLE)', y=f'(y + sqrt(crown_area / pi()) * {v!r}::DOUBLE)')} THEN 0.015625::DOUBLE ELSE 0.0::DOUBLE END" for u, v in S.crown_lattice())
_STEM = f"CASE WHEN {_IN_PLOT.format(x='x', y='y')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(_plot_sql(f"CASE WHEN crown_area > 0 THEN {_CROWN} ELSE {_STEM} END", S.boundary_area_ha(PLOT)))
def metrics_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.plot_stats(ad.trees(spark, sf_dir), PLOT, "crownArea", qsm=ad.qsm(spark, sf_dir)))


@query(_plot_sql(_STEM, S.boundary_area_ha(PLOT)))
def metrics_plot_uncorrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.plot_stats(ad.trees(spark, sf_dir), PLOT, "none", qsm=ad.qsm(spark, sf_dir)))


@query(_plot_sql("CASE WHEN greatest(20.0 - x, x - 80.0, 20.0 - y, y - 70.0) > 0 THEN 0.0::DOUBLE WHEN -greatest(20.0 - x, x - 80.0, 20.0 - y, y - 70.0) <= 1.0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END", S.boundary_area_ha(BOX)))
def metrics_plot_halfcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.plot_stats(ad.trees(spark, sf_dir), BOX, "halfcount", qsm=ad.qsm(spark, sf_dir)))


@query(f"""WITH {TREES_SQL}, r AS (SELECT height, row_number() OVER (ORDER BY height DESC) AS n, count(*) OVER () AS total FROM trees WHERE height IS NOT NULL),
d AS (SELECT avg(height) AS dominant_height, count(*) AS n_dominant FROM r WHERE n <= greatest(1, ceil(total * 0.1::DOUBLE)))
SELECT count(*) AS n, round(avg(dbh), 6) AS mean_dbh, round(avg(height), 6) AS mean_height, round(sqrt(avg(dbh * dbh)), 6) AS quadratic_mean_dbh, round(sum(pi() * (dbh / 2) ** 2), 6) AS basal_area, round(any_value(d.dominant_height), 6) AS dominant_height, any_value(d.n_dominant) AS n_dominant FROM trees, d""")
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.tree_stats(ad.trees(spark, sf_dir)))


@query(f"WITH {TREES_SQL} SELECT round(greatest((max(x) - min(x)) * (max(y) - min(y)) / 10000, 0.0025::DOUBLE), 6) AS area_ha FROM trees WHERE x IS NOT NULL AND y IS NOT NULL")
def plot_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.estimated_area_ha(ad.trees(spark, sf_dir)))


def _robust_sql(name: str, source: str, cols: dict[str, str]) -> str:
    med = ", ".join(f"quantile_cont({e}, 0.5) AS {c}_med" for c, e in cols.items())
    sig = ", ".join(f"any_value({c}_med) AS {c}_med, 1.4826 * quantile_cont(abs({e} - {c}_med), 0.5) AS {c}_sig" for c, e in cols.items())
    return f"{name}_m AS (SELECT {med} FROM {source}), {name} AS (SELECT {sig} FROM {source}, {name}_m)"


@query(f"WITH {TREES_SQL}, {_robust_sql('r', 'trees', {'dbh': 'dbh', 'height': 'height'})} SELECT round(dbh_med, 6) AS dbh_med, round(dbh_sig, 6) AS dbh_sig, round(height_med, 6) AS height_med, round(height_sig, 6) AS height_sig FROM r")
def robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.robust(ad.trees(spark, sf_dir), "dbh", "height"))


FLAGS_SQL = f"""{TREES_SQL}, {QSM_SQL}, {_robust_sql('p', 'trees', {'height': 'height', 'crown_area': 'crown_area', 'n': '"count"::DOUBLE'})}, {_robust_sql('qs', 'qsm', {'stem_volume': 'stem_volume'})},
c0 AS (SELECT dbh * 100 AS d, dbh * 100 / sqrt(height - 1.3) AS q FROM trees WHERE dbh > 0 AND height > 1.8), l0 AS (SELECT count(*) AS n, regr_intercept(q, d) AS b0, regr_slope(q, d) AS b1 FROM c0),
res AS (SELECT d, q, n, q - (b0 + b1 * d) AS r FROM c0, l0), {_robust_sql('rr', 'res', {'r': 'r'})},
l1 AS (SELECT count(*) AS n, regr_intercept(q, d) AS b0, regr_slope(q, d) AS b1 FROM res, rr WHERE n >= 15 AND (r_sig <= 0 OR abs(r - r_med) <= 2.5 * r_sig)),
hd AS (SELECT CASE WHEN n >= 10 AND b0 > 0 THEN b0 END AS hd_b0, CASE WHEN n >= 10 AND b0 > 0 THEN b1 END AS hd_b1 FROM l1)"""


@query(f"WITH {FLAGS_SQL} SELECT round(hd_b0, 6) AS hd_b0, round(hd_b1, 6) AS hd_b1 FROM hd")
def height_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fo.height_curve(ad.trees(spark, sf_dir)))


@query(f"""WITH {FLAGS_SQL}, t AS (SELECT t.*, t."count"::DOUBLE AS n, q.confidence, q.completeness, q.stem_volume, p.*, qs.*, hd.*, CASE WHEN height > 1.8 THEN sqrt(height - 1.3) END AS s FROM trees t LEFT JOIN qsm q USING (tree_id), p, qs, hd),
u AS (SELECT *, dbh * 100 / (hd_b0 * s / CASE WHEN 1 - hd_b1 * s > 0.05 THEN 1 - hd_b1 * s END) AS ratio, dbh * 100 / CASE WHEN height > 0 THEN height END AS slender FROM t)
SELECT tree_id, 'no-dbh' AS code, 'critical' AS severity FROM u WHERE dbh IS NULL
UNION ALL SELECT tree_id, 'crown-large', 'warning' FROM u WHERE CASE WHEN crown_area_sig > 0 THEN (crown_area - crown_area_med) / crown_area_sig > 3 ELSE crown_area_med > 0 AND crown_area > 3 * crown_area_med END
UNION ALL SELECT tree_id, 'crown-small', 'warning' FROM u WHERE crown_area < crown_area_med * 0.15 AND n < n_med * 0.10
UNION ALL SELECT tree_id, 'slenderness', 'warning' FROM u WHERE dbh > 0 AND (slender < 0.3 OR slender > 4.0)
UNION ALL SELECT tree_id, 'height-high', 'info' FROM u WHERE height_sig > 0 AND (height - height_med) / height_sig > 4
UNION ALL SELECT tree_id, 'height-low', 'info' FROM u WHERE height_sig > 0 AND (height - height_med) / height_sig < -3 AND height < 3
UNION ALL SELECT tree_id, 'few-points', 'info' FROM u WHERE n_med > 0 AND n < n_med * 0.05
UNION ALL SELECT tree_id, 'hd-curve', 'warning' FROM u WHERE dbh > 0 AND (ratio < 0.6 OR ratio > 1.6)
UNION ALL SELECT tree_id, 'qsm-coverage', 'warning' FROM u WHERE confidence < 0.5
UNION ALL SELECT tree_id, 'qsm-completeness', 'warning' FROM u WHERE completeness < 0.5
UNION ALL SELECT tree_id, 'qsm-volume', 'warning' FROM u WHERE stem_volume_sig > 0 AND (stem_volume - stem_volume_med) / stem_volume_sig > 4""")
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.flags(ad.trees(spark, sf_dir), ad.qsm(spark, sf_dir))


@query(f"""WITH {TREES_SQL}, v AS (SELECT dbh AS x, CASE WHEN dbh > 0 AND tree_id % 9 <> 0 THEN dbh * 1.02 + 0.01 + (tree_id % 7) / 500.0::DOUBLE END AS y FROM trees), ok AS (SELECT * FROM v WHERE x > 0 AND y > 0)
SELECT count(*) AS n, (SELECT count(*) FROM v) - count(*) AS n_unusable, round(avg(y - x), 6) AS bias, round(sqrt(avg((y - x) ** 2)), 6) AS rmse, round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM ok""")
def qc_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("tree_id")
    y = F.when((F.col("dbh") > 0) & (k % 9 != 0), F.col("dbh") * 1.02 + 0.01 + k % 7 / F.lit(500.0))
    return rounded(stats.validation(ad.trees(spark, sf_dir).select(F.col("dbh").alias("x"), y.alias("y")), "x", "y"))


AREA = 1.0


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.thinning(ad.trees(spark, sf_dir), ad.qsm(spark, sf_dir), AREA, target=100.0, default_species="pine")


THIN_SQL = f"""WITH {VOLUMES_SQL}, t AS (SELECT m.*, vol.volume, pi() * (dbh / 2) ** 2 AS ba FROM m JOIN vol USING (tree_id) WHERE dbh > 0),
b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, max(dbh) dm, sum(ba) total FROM t),
d AS (SELECT t.*, b.*, abs((y - (y0 + y1) / 2) - 20.0 * greatest(ceil(-((y1 - y0) / 2 + 4) / 20.0), least(floor(((y1 - y0) / 2 + 4) / 20.0), round((y - (y0 + y1) / 2) / 20.0)))) AS rd FROM t, b),
g AS (SELECT *, CASE WHEN rd <= 2 THEN 'forced' WHEN rd <= 10 THEN 'candidate' ELSE 'unreachable' END AS grp,
0.3 * (1 - greatest(0.0, least(1.0, coalesce(confidence, 1.0)))) + 0.7 * (1 - dbh / dm) + 0.05 * ((tree_id::HUGEINT * 2654435761) % 4294967296)::DOUBLE / 4294967296.0 AS score FROM d),
f AS (SELECT coalesce(sum(ba) FILTER (grp = 'forced'), 0.0) AS fb FROM g),
r AS (SELECT *, coalesce(sum(ba) OVER (PARTITION BY grp ORDER BY score DESC, tree_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS taken FROM g, f)"""


@query(THIN_SQL + """ SELECT tree_id, round(ba, 6) AS ba, round(volume, 6) AS volume, round(rd, 6) AS road_distance, grp AS "group", round(score, 6) AS score, grp = 'forced' OR (grp = 'candidate' AND taken < greatest(total - fb - 100.0, 0.0)) AS removed FROM r""")
def metrics_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_thinned(spark, sf_dir))


GROWTH_SQL = f"""WITH {TREES_SQL}, e AS (SELECT tree_id, x, dbh, height, pi() * (dbh / 2) ** 2 AS basal_area FROM trees),
a AS (SELECT * FROM e WHERE tree_id % 10 <> 1), b AS (SELECT tree_id, dbh * 1.05 AS dbh, height + 1 AS height, pi() * (dbh * 1.05 / 2) ** 2 AS basal_area FROM e WHERE tree_id % 10 <> 2),
m AS (SELECT b.dbh - a.dbh AS dd, b.height - a.height AS dh, 0.5 * (b.basal_area * b.height - a.basal_area * a.height) AS dv FROM a JOIN b USING (tree_id) WHERE x IS NOT NULL),
k AS (SELECT tree_id FROM a JOIN b USING (tree_id) WHERE x IS NOT NULL), h AS (SELECT basal_area * height * 0.5 AS v FROM a ANTI JOIN k USING (tree_id)), i AS (SELECT basal_area * height * 0.5 AS v FROM b ANTI JOIN k USING (tree_id))
SELECT count(*) AS n, count(dd) AS n_dbh_pairs, count(dv) AS n_vol_pairs, round(coalesce(avg(dd), 0.0::DOUBLE), 6) AS mean_ddbh, round(coalesce(avg(dh), 0.0::DOUBLE), 6) AS mean_dh, round(coalesce(sum(dv), 0.0::DOUBLE), 6) AS sum_dv,
(SELECT count(*) FROM h) AS harvested_count, (SELECT round(coalesce(sum(v), 0.0::DOUBLE), 6) FROM h) AS harvested_vol, (SELECT count(*) - count(v) FROM h) AS harvested_unmeasured,
(SELECT count(*) FROM i) AS ingrowth_count, (SELECT round(coalesce(sum(v), 0.0::DOUBLE), 6) FROM i) AS ingrowth_vol, (SELECT count(*) - count(v) FROM i) AS ingrowth_unmeasured FROM m"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with plots of a thousand side by side, so no two stand in one place and the stand is as dense at any size."""
    t = ad.trees(spark, sf_dir)
    return t.withColumn("x", F.col("x") + 100 * F.expr("tree_id DIV 1000"))


@query(GROWTH_SQL)
def change_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _placed(spark, sf_dir).select("tree_id", "x", "y", "dbh", "height").withColumn("basal_area", S.basal_area(F.col("dbh")))
    a = t.filter("tree_id % 10 <> 1")
    b = t.filter("tree_id % 10 <> 2").withColumns({"x": F.col("x") + 0.3, "dbh": F.col("dbh") * 1.05, "height": F.col("height") + 1}).withColumn("basal_area", S.basal_area(F.col("dbh")))
    return rounded(fo.matched_growth(a, b, 1.0))


@query(f"""WITH {TREES_SQL}, c AS (SELECT CASE WHEN dbh >= 0.45 THEN 4 WHEN dbh >= 0.35 THEN 3 WHEN dbh >= 0.25 THEN 2 WHEN dbh >= 0.15 THEN 1 WHEN dbh >= 0.05 THEN 0 END AS size_class, f FROM trees, LATERAL (SELECT unnest(CASE WHEN tree_id % 6 = 0 THEN ['onlyReference'] WHEN tree_id % 8 = 1 THEN ['onlyDetected'] WHEN x IS NULL THEN ['onlyReference', 'onlyDetected'] ELSE ['both'] END) AS f)),
g AS (SELECT size_class, count(*) FILTER (f = 'both') AS tp, count(*) FILTER (f = 'onlyReference') AS fn, count(*) FILTER (f = 'onlyDetected') AS fp FROM c GROUP BY 1 UNION ALL SELECT -1, count(*) FILTER (f = 'both'), count(*) FILTER (f = 'onlyReference'), count(*) FILTER (f = 'onlyDetected') FROM c),
r AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp / nullif(tp + fp, 0)::DOUBLE AS precision FROM g)
SELECT size_class, tp, fn, fp, round(recall, 6) AS recall, round(precision, 6) AS precision, round(2 * recall * precision / nullif(recall + precision, 0), 6) AS f1 FROM r""")
def detection_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _placed(spark, sf_dir)
    seen = t.filter("tree_id % 6 <> 0").withColumn("y", F.col("y") + 0.4)
    return rounded(fo.detection(fo.found_by_place(t.filter("tree_id % 8 <> 1 OR tree_id % 6 = 0"), seen, 1.0, (0.05, 0.15, 0.25, 0.35, 0.45))[1]))


_OPTIONS = ", ".join(f"({a * 100 - n}, '{k}', {least}::DOUBLE, {length}::DOUBLE, {price}::DOUBLE)" for a, (k, least, lengths, price) in enumerate(fo.ASSORTMENTS, 1) for n, length in enumerate(sorted(lengths)))


# The taper is a straight line, so every part is one frustum.
@query(f"""WITH RECURSIVE {TREES_SQL}, opts(prio, assortment, least, len, price) AS (VALUES {_OPTIONS}),
s AS (SELECT tree_id, height, dbh * 1.1 AS b FROM trees WHERE dbh > 0 AND height > 0),
cut AS (SELECT tree_id, height, b, 0 AS nth, 'stump' AS assortment, 0.0::DOUBLE AS from_h, least(0.1::DOUBLE, height) AS to_h, 0.0::DOUBLE AS price FROM s
UNION ALL SELECT c.tree_id, c.height, c.b, c.nth + 1, o.assortment, c.to_h, c.to_h + o.len, o.price FROM cut c JOIN opts o ON o.prio = (SELECT min(q.prio) FROM opts q WHERE c.to_h + q.len <= c.height + 1e-9 AND c.b * (1 - (c.to_h + q.len) / c.height) * 100 >= q.least)),
last AS (SELECT tree_id, any_value(height) AS height, any_value(b) AS b, max(nth) AS nth, max(to_h) AS to_h FROM cut GROUP BY 1),
every AS (SELECT tree_id, height, b, nth, assortment, from_h, to_h, price FROM cut UNION ALL SELECT tree_id, height, b, nth + 1, 'residue', to_h, height, 0.0 FROM last WHERE height > to_h),
v AS (SELECT *, b * (1 - from_h / height) AS d0, b * (1 - to_h / height) AS d1 FROM every)
SELECT tree_id, nth, assortment, round(from_h, 6) AS from_h, round(to_h, 6) AS to_h, round(d1, 6) + 0.0 AS top_d, round(pi() / 12 * (to_h - from_h) * (d0 * d0 + d0 * d1 + d1 * d1), 6) AS volume, round(price * pi() / 12 * (to_h - from_h) * (d0 * d0 + d0 * d1 + d1 * d1), 6) AS value FROM v""")
def metrics_bucking(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.trees(spark, sf_dir).filter("dbh > 0 AND height > 0")
    n = F.sequence(F.lit(0), F.lit(20))
    taper = t.select("tree_id", "dbh", "height", F.explode(n).alias("k")).select("tree_id", (F.col("height") * F.col("k") / 20).alias("h"), (F.col("dbh") * 1.1 * (1 - F.col("k") / 20)).alias("d"))
    return rounded(fo.buck(taper)).withColumn("top_d", F.col("top_d") + 0.0)


@query("""WITH s AS (SELECT CAST(p_partkey AS INT) AS tree_id, unnest(range(p_size % 4 + 1)) * 0.5 AS hag, p_size / 200.0::DOUBLE AS r FROM part)
SELECT tree_id, round(hag + CASE WHEN count(*) OVER (PARTITION BY tree_id) > 1 THEN 0.25 ELSE 0.125 END, 6)::DOUBLE AS h, round(2 * r, 6) AS d FROM s""")
def taper_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("tree_id"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("k"), (F.col("p_size") / 200.0).alias("r"))
    return rounded(fo.taper_of(t.select("tree_id", (F.col("k") * 0.5).alias("hag"), "r")))


# ---------------------------------------------------------------- neighbourhoods

_PAIRS = f"WITH {POINTS_SQL}, q AS (SELECT a.point_id AS a, b.point_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM points a JOIN points b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.point_id <> b.point_id)"


@query(_PAIRS + " SELECT a AS point_id FROM q WHERE d <= 1 GROUP BY a HAVING count(*) >= 2")
def dataset_clean_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ne.clean_radius(ad.points(spark, sf_dir), 1.0, 2).select("point_id")


@query(f"""WITH {POINTS_SQL}, c AS (SELECT *, floor(x / 8) AS kx, floor(y / 8) AS ky, floor(z / 8) AS kz FROM points), o AS (SELECT unnest([-1, 0, 1]) AS d),
m AS (SELECT c.*, kx + i.d AS jx, ky + j.d AS jy, kz + k.d AS jz FROM c, o i, o j, o k),
n AS (SELECT a.point_id, list_sort(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, 4)) AS near FROM c a JOIN m b ON a.kx = b.jx AND a.ky = b.jy AND a.kz = b.jz AND a.point_id <> b.point_id GROUP BY 1),
d AS (SELECT point_id, list_avg(list_transform(near, lambda v: sqrt(v))) AS d FROM n), l AS (SELECT avg(d) + stddev_pop(d) AS limit_ FROM d)
SELECT point_id FROM d, l WHERE d <= limit_ + 1e-12""")
def dataset_clean_sor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ne.clean_sor(ad.points(spark, sf_dir), 4, 1.0).select("point_id")


_SHAPES = f"""WITH {POINTS_SQL}, c AS (SELECT *, floor(x / 1.5) AS kx, floor(y / 1.5) AS ky, floor(z / 1.5) AS kz FROM points), o AS (SELECT unnest([-1, 0, 1]) AS d),
m AS (SELECT c.*, kx + i.d AS jx, ky + j.d AS jy, kz + k.d AS jz FROM c, o i, o j, o k),
q AS (SELECT a.point_id AS a, b.point_id AS b, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM c a JOIN m b ON a.kx = b.jx AND a.ky = b.jy AND a.kz = b.jz AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 2.25),
v AS (SELECT a AS point_id, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM q GROUP BY 1 HAVING count(*) >= 4),
w AS (SELECT *, (xx + yy + zz) / 3 AS t FROM v),
p AS (SELECT *, sqrt(((xx - t) ** 2 + (yy - t) ** 2 + (zz - t) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM w),
r AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((xx - t) * ((yy - t) * (zz - t) - yz * yz) - xy * (xy * (zz - t) - yz * xz) + xz * (xy * yz - (yy - t) * xz)) / nullif(2 * p * p * p, 0)))) / 3 AS phi FROM p),
e AS (SELECT point_id, n, CASE WHEN p > 0 THEN t + 2 * p * cos(phi) ELSE t END AS e1, CASE WHEN p > 0 THEN t + 2 * p * cos(phi + 2.0943951023931953) ELSE t END AS e3, t FROM r),
f AS (SELECT point_id, n, (e1 - (3 * t - e1 - e3)) / nullif(e1, 0) AS linearity, (3 * t - e1 - e3 - e3) / nullif(e1, 0) AS planarity, e3 / nullif(e1, 0) AS scatter FROM e)"""


# Eigenvalues by closed form keep seven digits or so where two of them are nearly equal, hence four places.
# A millionth is added, as many values lie on a half.
@query(_SHAPES + " SELECT point_id, n, round(linearity + 1e-6, 4) AS linearity, round(planarity + 1e-6, 4) AS planarity, round(scatter + 1e-6, 4) AS scatter FROM f")
def shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ne.shape_features(ad.points(spark, sf_dir), 1.5, 4)
    return f.select("point_id", "n", *(F.round(F.col(c) + 1e-6, 4).alias(c) for c in ("linearity", "planarity", "scatter")))


def _votes(new: str, old: str) -> str:
    return f"""{new} AS (SELECT s.point_id, CASE WHEN s.semantic = 0 THEN 0 WHEN count(*) FILTER (t.semantic = 1) > count(*) FILTER (t.semantic = 4) THEN 1 WHEN count(*) FILTER (t.semantic = 4) > count(*) FILTER (t.semantic = 1) THEN 4 ELSE s.semantic END AS semantic
FROM {old} s JOIN q ON q.a = s.point_id JOIN {old} t ON t.point_id = q.b GROUP BY s.point_id, s.semantic)"""


@query(_SHAPES + ", s0 AS (SELECT points.point_id, CASE WHEN f.n IS NULL THEN 0 WHEN (linearity >= 0.6037 OR planarity >= 0.5511) AND scatter <= 0.3519 THEN 1 ELSE 4 END AS semantic FROM points LEFT JOIN f USING (point_id)), " + _votes("s1", "s0") + ", " + _votes("s2", "s1") + " SELECT * FROM s2")
def segment_leafwood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ne.leaf_wood(ad.points(spark, sf_dir), 1.5, 0.6037, 0.5511, 0.3519, least=4).select("point_id", "semantic")


_AHEAD = ", ".join(f"{p} AS {n}" for n, p in (("u1", "b * c - e * e"), ("u2", "d * e - f * c"), ("u3", "f * e - b * d"), ("v1", "f * e - d * b"), ("v2", "d * f - a * e"), ("v3", "a * b - f * f"), ("w1", "f * c - d * e"), ("w2", "d * d - a * c"), ("w3", "a * e - f * d")))


@query(f"""WITH {POINTS_SQL}, cores AS (SELECT concat_ws(':', CAST(floor(x / 10) AS BIGINT), CAST(floor(y / 10) AS BIGINT), CAST(floor(z / 10) AS BIGINT)) AS core, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY 1),
near AS (SELECT core, covar_pop(p.x, p.x) AS xx, covar_pop(p.x, p.y) AS xy, covar_pop(p.x, p.z) AS xz, covar_pop(p.y, p.y) AS yy, covar_pop(p.y, p.z) AS yz, covar_pop(p.z, p.z) AS zz FROM cores c JOIN points p ON sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2) <= 2 WHERE epoch = 0 GROUP BY 1 HAVING count(*) >= 4),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM near), s AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS s FROM q),
t AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * s ** 3)))) / 3 AS t FROM s),
m AS (SELECT core, xx - low AS a, yy - low AS b, zz - low AS c, xz AS d, yz AS e, xy AS f FROM (SELECT *, q + 2 * s * cos(t + 2 * pi() / 3) AS low FROM t)),
v AS (SELECT core, {_AHEAD} FROM m),
k AS (SELECT core, CASE WHEN nu >= nv AND nu >= nw THEN [u1, u2, u3] WHEN nv >= nw THEN [v1, v2, v3] ELSE [w1, w2, w3] END AS n FROM (SELECT *, u1 ** 2 + u2 ** 2 + u3 ** 2 AS nu, v1 ** 2 + v2 ** 2 + v3 ** 2 AS nv, w1 ** 2 + w2 ** 2 + w3 ** 2 AS nw FROM v)),
h AS (SELECT core, list_transform(n, lambda x: CASE WHEN abs(x) < 1e-9 * sqrt(n[1] ** 2 + n[2] ** 2 + n[3] ** 2) THEN 0 ELSE x / sqrt(n[1] ** 2 + n[2] ** 2 + n[3] ** 2) END) AS n FROM k),
n AS (SELECT core, n[1] * w + 0 AS nx, n[2] * w + 0 AS ny, n[3] * w + 0 AS nz FROM (SELECT *, CASE WHEN CASE WHEN n[3] <> 0 THEN n[3] WHEN n[2] <> 0 THEN n[2] ELSE n[1] END < 0 THEN -1 ELSE 1 END AS w FROM h)),
l AS (SELECT core, epoch, (p.x - c.x) * nx + (p.y - c.y) * ny + (p.z - c.z) * nz AS l, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2 AS d2 FROM n JOIN cores c USING (core) JOIN points p ON abs(p.x - c.x) <= 3.2 AND abs(p.y - c.y) <= 3.2 AND abs(p.z - c.z) <= 3.2),
g AS (SELECT core, count(*) FILTER (epoch = 0) AS n0, count(*) FILTER (epoch = 1) AS n1, avg(l) FILTER (epoch = 0) AS m0, avg(l) FILTER (epoch = 1) AS m1, stddev_samp(l) FILTER (epoch = 0) AS s0, stddev_samp(l) FILTER (epoch = 1) AS s1 FROM l WHERE abs(l) <= 3 AND d2 - l * l <= 1 GROUP BY 1),
r AS (SELECT core, nx, ny, nz, nullif(n0, 0) AS n_ref, nullif(n1, 0) AS n_now, m1 - m0 AS distance, 1.96 * (sqrt(s0 ** 2 / n0 + s1 ** 2 / n1) + 0.02) AS lod FROM n LEFT JOIN g USING (core))
SELECT core, round(nx, 4) AS nx, round(ny, 4) AS ny, round(nz, 4) AS nz, n_ref, n_now, round(distance, 4) AS distance, round(lod, 4) AS lod, abs(distance) > lod AS significant FROM r""")
def change_m3c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.points(spark, sf_dir)
    cores = po.decimate(p, 10.0).select(F.concat_ws(":", "vx", "vy", "vz").alias("core"), "x", "y", "z")
    return rounded(ne.m3c2(cores, p.filter("epoch = 0"), p.filter("epoch = 1"), 4.0, 2.0, 3.0), 4)


def _ramped(low: float, high: float) -> str:
    return "CASE stratum " + " ".join(f"WHEN {k} THEN {ne.ramp(low, high, (k + 0.5) / 5, 0.6, 0.75)!r}::DOUBLE" for k in range(5)) + " END"


@query(f"""WITH {POINTS_SQL}, size AS (SELECT tree_id, min(z) AS low, max(z) AS high FROM points WHERE tree_id > 0 GROUP BY 1 HAVING count(*) >= 50),
p AS (SELECT points.*, intensity / 4.0::DOUBLE - 15 AS refl, least(4, CAST(floor(coalesce((z - low) / nullif(high - low, 0), 0) * 5) AS INT)) AS stratum FROM points JOIN size USING (tree_id)),
g AS (SELECT * FROM p WHERE refl BETWEEN -12 AND 5), gm AS (SELECT tree_id, count(*) AS m FROM g GROUP BY 1),
h AS (SELECT a.point_id, count(*) AS k FROM g a JOIN g b ON a.tree_id = b.tree_id AND a.point_id <> b.point_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= {_ramped(4.0, 6.0).replace("stratum", "a.stratum")} GROUP BY 1),
s AS (SELECT g.* FROM g JOIN gm USING (tree_id) LEFT JOIN h USING (point_id) WHERE m <= 3 OR coalesce(k, 0) >= 3),
sm AS (SELECT tree_id, count(*) AS m, count(DISTINCT scan) AS scans FROM s GROUP BY 1),
w AS (SELECT a.point_id, count(DISTINCT b.scan) AS k FROM s a JOIN s b ON a.tree_id = b.tree_id AND a.scan <> b.scan AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= {_ramped(4.0, 6.0).replace("stratum", "a.stratum")} GROUP BY 1),
t AS (SELECT s.point_id, m > 3 AND scans > 1 AND coalesce(k, 0) < floor({_ramped(2.0, 1.0)} + 0.5) AS wind FROM s JOIN sm USING (tree_id) LEFT JOIN w USING (point_id))
SELECT points.point_id, CASE WHEN p.point_id IS NULL THEN 0 WHEN g.point_id IS NULL THEN 2 WHEN t.point_id IS NULL THEN 3 WHEN t.wind THEN 4 ELSE 1 END AS label FROM points LEFT JOIN p USING (point_id) LEFT JOIN g USING (point_id) LEFT JOIN t USING (point_id)""")
def qc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.points(spark, sf_dir).withColumns({"hag": F.col("z"), "refl": F.col("intensity") / 4.0 - 15.0})
    return ne.point_quality(p, refl_min=-12.0, outlier_radius_min=4.0, outlier_radius_max=6.0, wind_radius_min=4.0, wind_radius_max=6.0).select("point_id", "label")


@query(f"WITH {TREES_SQL} SELECT tree_id::BIGINT AS a, tree_id::BIGINT AS b, 0.3::DOUBLE AS distance FROM trees WHERE x IS NOT NULL AND tree_id % 7 <> 0")
def match_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _placed(spark, sf_dir)
    a = t.select(F.col("tree_id").alias("a"), "x", "y")
    b = t.filter("tree_id % 7 <> 0").select(F.col("tree_id").alias("b"), (F.col("x") + 0.3).alias("x"), "y")
    return rounded(ne.match_positions(a, b, 1.0))


@query(f"""WITH RECURSIVE {POINTS_SQL}, p AS (SELECT row_number() OVER (ORDER BY point_id) AS n, point_id, x, y, z, CAST(floor(x) AS BIGINT) AS cx, CAST(floor(y) AS BIGINT) AS cy, CAST(floor(z) AS BIGINT) AS cz FROM points),
o AS (SELECT unnest([-1, 0, 1]) AS d), spread AS (SELECT p.*, cx + i.d AS sx, cy + j.d AS sy, cz + k.d AS sz FROM p, o i, o j, o k),
pairs AS (SELECT a.n AS a, b.n AS b FROM p a JOIN spread b ON a.cx = b.sx AND a.cy = b.sy AND a.cz = b.sz WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1.0),
core AS (SELECT a AS n FROM pairs GROUP BY 1 HAVING count(*) >= 4), links AS (SELECT a, b FROM pairs SEMI JOIN core c ON c.n = a SEMI JOIN core d ON d.n = b),
cc(node, root) USING KEY (node) AS (SELECT n, n FROM core UNION SELECT l.b, min(c.root) FROM cc c JOIN links l ON l.a = c.node JOIN recurring.cc k ON k.node = l.b WHERE c.root < k.root GROUP BY l.b),
member AS (SELECT a AS n, min(root) AS root FROM pairs JOIN cc ON node = b GROUP BY 1)
SELECT q.point_id, s.point_id AS cluster FROM member m LEFT JOIN cc ON node = m.n JOIN p q ON q.n = m.n JOIN p s ON s.n = coalesce(cc.root, m.root)""")
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ne.dbscan(ad.points(spark, sf_dir), 1.0, 4)


# ---------------------------------------------------------------- measurement and segmentation

from ..operators import registration as rg  # noqa: E402
from ..operators import segmentation as sg  # noqa: E402
from ..operators import trees as tr  # noqa: E402


def _stand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with heights, and stems: each supplier's lines set on circles of 5 to 30 cm about a lattice position."""
    p = ad.points(spark, sf_dir)
    a = F.col("z") * 0.7 + F.col("x") * 2.1
    r = 0.05 + (F.col("tree_id") % 6) * 0.05
    return p.withColumns({"hag": F.col("z") * 0.2, "x": (F.col("tree_id") % 10) * 5.0 + r * F.cos(a), "y": F.floor(F.col("tree_id") / 10) * 5.0 + r * F.sin(a)})


_STAND = f"{POINTS_SQL}, stand AS (SELECT point_id, tree_id, z, z * 0.2 AS hag, (tree_id % 10) * 5.0 + (0.05 + (tree_id % 6) * 0.05) * cos(z * 0.7 + x * 2.1) AS x, floor(tree_id / 10) * 5.0 + (0.05 + (tree_id % 6) * 0.05) * sin(z * 0.7 + x * 2.1) AS y FROM points)"


@query(f"WITH {_STAND} SELECT tree_id, count(*) AS n, round(max(hag), 6) AS height, round(2 * (0.05 + (tree_id % 6) * 0.05), 6) AS dbh, round(pi() * (0.05 + (tree_id % 6) * 0.05) ** 2, 6) AS basal_area, count(DISTINCT (floor(x / 0.25), floor(y / 0.25))) * 0.0625::DOUBLE AS crown_area, round(2 * sqrt(count(DISTINCT (floor(x / 0.25), floor(y / 0.25))) * 0.0625 / pi()), 6) AS crown_diameter, min(z) AS base_z FROM stand WHERE tree_id > 0 GROUP BY tree_id")
def metrics_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tr.tree_metrics(_stand(spark, sf_dir), 1.0, 3.0)
    return rounded(t.select("tree_id", F.col("count").alias("n"), "height", "dbh", "basal_area", "crown_area", "crown_diameter", "base_z"))


@query(f"WITH {_STAND} SELECT tree_id, round(2 * (0.05 + (tree_id % 6) * 0.05), 4) AS dbh, count(*) AS band_count FROM stand WHERE tree_id > 0 AND hag BETWEEN 1 AND 3 GROUP BY tree_id HAVING count(*) >= 12")
def metrics_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tr.fit_stems(_stand(spark, sf_dir)).filter("dbh IS NOT NULL")
    return rounded(t.select("tree_id", "dbh", F.col("band_count").cast("long").alias("band_count")), 4)


_SECTOR = "CAST(floor(((degrees(atan2(y - floor(tree_id / 10) * 5.0, x - (tree_id % 10) * 5.0)) + 360) % 360) / 30) AS INT) % 12"
_SLICED = f"""WITH {_STAND}, sl AS (SELECT tree_id, CAST(floor(hag / 0.5) AS INT) AS slice, count(*) AS n, count(DISTINCT (x, y)) AS places, bit_or(1 << ({_SECTOR})) AS sectors FROM stand WHERE tree_id > 0 AND hag >= 0 GROUP BY 1, 2),
acc AS (SELECT *, 0.05 + (tree_id % 6) * 0.05 AS r, slice * 0.5 AS hag FROM sl WHERE n >= 5 AND places >= 3)"""


@query(_SLICED + """, v AS (SELECT *, coalesce(pi() * r * r * (lead(hag) OVER w - hag), 0.0::DOUBLE) + CASE WHEN lag(hag) OVER w IS NULL THEN pi() * r * r * (hag + 0.25) ELSE 0.0::DOUBLE END AS vol FROM acc WINDOW w AS (PARTITION BY tree_id ORDER BY slice)), k AS (SELECT tree_id, count(*) AS slices FROM sl GROUP BY 1)
SELECT tree_id, round(sum(vol), 6) AS stem_volume, 0.0::DOUBLE AS stem_volume_std, 0.0::DOUBLE AS stem_volume_ci95, round(avg(bit_count(sectors) / 12.0::DOUBLE), 6) AS confidence, round(count(*) / (floor(max(hag) / 0.5) + 1), 6) AS completeness, count(*) AS accepted_slices, any_value(slices) - count(*) AS rejected_slices FROM v JOIN k USING (tree_id) GROUP BY tree_id""")
def metrics_qsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.stem_model(tr.slices(_stand(spark, sf_dir), 0.5, 5), 0.5))


@query(_SLICED + " SELECT tree_id, CAST(count(*) AS INT) AS vertices, round(avg(hag), 6) AS mean_hag, round(avg(r), 6) AS mean_r FROM acc GROUP BY tree_id")
def stem_centerlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tr.center_lines(tr.slices(_stand(spark, sf_dir), 0.5, 5))
    mean = lambda f: F.aggregate(F.transform("line", lambda p: p[f]), F.lit(0.0), lambda a, x: a + x) / F.size("line")
    return rounded(t.select("tree_id", F.size("line").alias("vertices"), mean("hag").alias("mean_hag"), mean("r").alias("mean_r")))


_CALIPER = f"""WITH {_STAND}, near AS (SELECT tree_id AS click, x - ((tree_id % 10) * 5.0 + 0.02) AS du, y - (floor(tree_id / 10) * 5.0 - 0.01) AS dv FROM stand WHERE tree_id > 0 AND abs(z - 25) <= 4),
mean AS (SELECT click, avg(du) AS mu, avg(dv) AS mv FROM near WHERE du * du + dv * dv <= 0.36 GROUP BY 1), p AS (SELECT click, -(du - mu) AS u, -(dv - mv) AS v FROM near JOIN mean USING (click) WHERE (du - mu) ** 2 + (dv - mv) ** 2 <= 0.36),
k AS (SELECT click, k, max(u * cos(radians(k)) + v * sin(radians(k))) - min(u * cos(radians(k)) + v * sin(radians(k))) AS w FROM p, (SELECT unnest(range(180)) AS k) GROUP BY 1, 2)"""


@query(_CALIPER + """ SELECT click, (SELECT count(*) FROM p WHERE p.click = k.click) AS n, round(min(w), 5) AS least_width, round(max(w), 5) AS widest FROM k GROUP BY click""")
def branch_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections across upright axes at a click beside each stem: the least and the widest reading, degree by degree."""
    p = _stand(spark, sf_dir).filter("tree_id > 0").select(F.col("tree_id").alias("branch"), "x", "y", "z")
    c = p.select("branch").distinct().select(F.col("branch").alias("click"), "branch", ((F.col("branch") % 10) * 5.0 + 0.02).alias("x"), (F.floor(F.col("branch") / 10) * 5.0 - 0.01).alias("y"), F.lit(25.0).alias("z"))
    axes = c.withColumns({"mx": F.col("x"), "my": F.col("y"), "mz": F.col("z"), "ax": F.lit(0.0), "ay": F.lit(0.0), "az": F.lit(1.0)})
    section = ne.cut_lineage(br.section_places(axes, p, 4.0, 0.6))
    w = section.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(179)))).groupBy("click", "k").agg((F.max(F.col("u") * F.cos(F.radians("k")) + F.col("v") * F.sin(F.radians("k"))) - F.min(F.col("u") * F.cos(F.radians("k")) + F.col("v") * F.sin(F.radians("k")))).alias("w"))
    out = w.groupBy("click").agg(F.min("w").alias("least_width"), F.max("w").alias("widest")).join(section.groupBy("click").agg(F.sum("m").alias("n")), "click")
    return rounded(out.select("click", "n", "least_width", "widest"), 5)


@query(None)
def crown_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.crown_volumes(_stand(spark, sf_dir), 1.0))


@query(_SLICED + """, m AS (SELECT tree_id, bit_or(CASE WHEN places >= 3 THEN sectors END) AS mask FROM sl GROUP BY 1), r AS (SELECT *, unnest(range(12)) AS s FROM m),
g AS (SELECT *, CASE WHEN mask = 0 THEN 12 ELSE list_filter(range(12), lambda d: (mask >> CAST((s + d) % 12 AS INT)) & 1 = 1)[1] END AS len FROM r),
b AS (SELECT tree_id, max(len) AS len, arg_min(s, (-len, s + len)) AS s FROM g WHERE (mask >> CAST((s + 11) % 12 AS INT)) & 1 = 1 OR mask = 0 GROUP BY 1)
SELECT m.tree_id, 12 - bit_count(m.mask) AS unseen, CASE WHEN coalesce(len, 0) = 0 THEN 0 ELSE s * 30 END AS gap_from_deg, coalesce(len, 0) * 30 AS gap_deg FROM m LEFT JOIN b USING (tree_id)""")
def rescan_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.shadows(tr.slices(_stand(spark, sf_dir), 0.5, 5))


@query(f"WITH {_STAND} SELECT count(*) AS n, 0.1::DOUBLE AS diameter, 10.0::DOUBLE AS cx, 5.0::DOUBLE AS cy, 0.0::DOUBLE AS rmse, round(bit_count(bit_or(1 << ({_SECTOR}))) / 12.0::DOUBLE, 6) AS coverage FROM stand WHERE z BETWEEN 4 AND 16 AND sqrt((x - 10) ** 2 + (y - 5) ** 2) <= 1")
def virtual_caliper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.caliper(_stand(spark, sf_dir), 10.0, 5.0, 10.0, 1.0, 12.0))


@query(f"""WITH {TREES_SQL}, p AS (SELECT ln(height) AS x, ln(0.4 * dbh * dbh * height * (1 + (tree_id % 5) / 50.0::DOUBLE)) AS y FROM trees WHERE height > 0 AND dbh > 0)
SELECT count(*) AS n, round(regr_intercept(y, x), 4) AS b0, round(regr_slope(y, x), 4) AS b1, round(regr_r2(y, x), 4) AS r2, round((SELECT avg(exp(y - a - b * x)) FROM p, (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM p)), 4) AS smearing FROM p""")
def change_cross_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.trees(spark, sf_dir).filter("height > 0 AND dbh > 0")
    v = 0.4 * F.col("dbh") * F.col("dbh") * F.col("height") * (1 + F.col("tree_id") % 5 / F.lit(50.0))
    m = tr.volume_model(t.select(F.col("tree_id").alias("seq"), "height", v.alias("volume")), ["height"])
    return rounded(spark.createDataFrame([(m["n"], *m["coefficients"], m["r2"], m["smearing"])], "n long, b0 double, b1 double, r2 double, smearing double"), 4)


@query(None)
def ground_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.classify_ground(ad.points(spark, sf_dir), 1.0, 2.0, window=10.0, tile=25.0)


@query(None)
def ground_classify_cloth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.classify_cloth(ad.points(spark, sf_dir), 1.0, 2.0, tile=25.0)


@query(None)
def terrain_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sg.flow_accumulation(_grid(spark, sf_dir), 2.0, "mean"))


@query(None)
def segment_chm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.segment_chm(_stand(spark, sf_dir), 0.5, tile=25.0)


@query(None)
def segment_li2012(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.points import decimate

    v = decimate(_stand(spark, sf_dir), 0.5).select(F.concat_ws(":", "vx", "vy", "vz").alias("point_id"), "x", "y", (F.col("z") * 0.2).alias("hag"))
    return sg.segment_li2012(v, min_points=5, tile=25.0)


@query(None)
def segment_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.segment_graph(_stand(spark, sf_dir), 0.25, 0.6, tile=25.0)


@query(None)
def segment_deadwood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.segment_deadwood(_stand(spark, sf_dir), high=2.0, linear=0.2, eps=0.5, least=5, length=0.1)


@query("""WITH n AS (SELECT CAST(p_partkey AS INT) AS tree_id, CAST(least(floor((p_size * 0.1::DOUBLE) / 0.25), 1000000) AS INT) AS k, p_size * 0.1::DOUBLE AS len FROM part), s AS (SELECT tree_id, k, len, unnest(range(k)) AS i FROM n WHERE k >= 1)
SELECT tree_id, round(len * CASE WHEN k = 1 THEN 1.0 ELSE i / (k - 1)::DOUBLE END, 6) AS z FROM s""")
def skeleton_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("tree_id"), F.lit(0).alias("branch_order"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("start"), F.array(F.lit(0.0), F.lit(0.0), F.col("p_size") * F.lit(0.1)).alias("end"))
    return rounded(sg.sample_skeletons(t, 0.25).select("tree_id", "z"))


@query(f"""WITH {_STAND}, k AS (SELECT range AS tree, (range % 10) * 5.0::DOUBLE AS kx, floor(range / 10) * 5.0::DOUBLE AS ky FROM range(97)),
d AS (SELECT point_id, tree, unnest([greatest(0, least(99, floor(z / (50.0 / 99)))), greatest(0, least(99, floor(z / (50.0 / 99)) + 1))]) AS i, x, y, z, kx, ky FROM stand, k),
n AS (SELECT point_id, min(struct_pack(d := sqrt((x - kx) ** 2 + (y - ky) ** 2 + (z - i * 50.0 / 99) ** 2), t := tree)) AS m FROM d GROUP BY 1)
SELECT point_id, CASE WHEN inside THEN CAST(m.t AS INT) ELSE 0 END AS tree_id, CASE WHEN inside AND m.d <= 0.4 THEN CASE WHEN m.t % 2 = 0 THEN 1 ELSE 2 END ELSE 0 END AS semantic
FROM (SELECT n.*, x BETWEEN 0 AND 45 AND y BETWEEN 0 AND 45 AND {_sql_in_polygon([(0.0, 0.0), (45.0, 0.0), (45.0, 40.0), (30.0, 45.0), (0.0, 45.0)])} AS inside FROM n JOIN stand USING (point_id))""")
def transfer_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sk = spark.range(97).select(F.col("id").cast("int").alias("tree_id"), (F.col("id") % 2).cast("int").alias("branch_order"), *(F.array((F.col("id") % 10) * 5.0, F.floor(F.col("id") / 10) * 5.0, F.lit(z)).alias(n) for n, z in (("start", 0.0), ("end", 50.0))))
    return sg.transfer_labels(_stand(spark, sf_dir), sg.sample_skeletons(sk, 0.5), 0.4)


@query(None)
def change_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.points(spark, sf_dir)
    got = rg.icp(po.transform(p, [1, 0, 0, 0.1, 0, 1, 0, -0.05, 0, 0, 1, 0.02, 0, 0, 0, 1]), p, 0.25, 1.0, 10)
    return spark.createDataFrame([(i, round(v, 4)) for i, v in enumerate(got["matrix"])], "i int, v double")


@query("SELECT i, v FROM (VALUES (0, 0.8), (1, -0.6), (2, 0.0), (3, 5.0), (4, 0.6), (5, 0.8), (6, 0.0), (7, 2.0), (8, 0.0), (9, 0.0), (10, 1.0), (11, 1.0), (12, 0.0), (13, 0.0), (14, 0.0), (15, 1.0)) t(i, w), LATERAL (SELECT w::DOUBLE AS v)")
def preprocess_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.points(spark, sf_dir).select("point_id", "x", "y", "z")
    q = po.transform(p, [0.8, -0.6, 0, 5, 0.6, 0.8, 0, 2, 0, 0, 1, 1, 0, 0, 0, 1]).select("point_id", *(F.col(c).alias("r" + c) for c in "xyz"))
    return spark.createDataFrame([(i, round(v, 6) + 0.0) for i, v in enumerate(rg.kabsch(p.join(q, "point_id")))], "i int, v double")


@query(f"""WITH {TREES_SQL}, t AS (SELECT tree_id, x, y, x + 2.0 AS rx, y - 1.0 AS ry FROM trees WHERE x IS NOT NULL),
p AS (SELECT a.tree_id AS a, a.x, a.y, b.rx, b.ry, b.rx - a.x AS dx, b.ry - a.y AS dy FROM t a JOIN t b ON abs(b.rx - a.x) <= 3 AND abs(b.ry - a.y) <= 3 AND sqrt((b.rx - a.x) ** 2 + (b.ry - a.y) ** 2) <= 3),
s AS (SELECT *, k.range AS k, floor(dx / 0.5 + CASE WHEN k.range >= 2 THEN 0.5 ELSE 0.0 END) AS i, floor(dy / 0.5 + CASE WHEN k.range % 2 = 1 THEN 0.5 ELSE 0.0 END) AS j FROM p, range(4) k),
v AS (SELECT k, i, j, count(DISTINCT a) AS votes, avg(rx) - avg(x) AS dx, avg(ry) - avg(y) AS dy FROM s GROUP BY 1, 2, 3 ORDER BY votes DESC, k, i, j LIMIT 1)
SELECT 0.0::DOUBLE AS yaw_deg, round(dx, 6) AS dx, round(dy, 6) AS dy, votes FROM v""")
def transfer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.trees(spark, sf_dir).filter("x IS NOT NULL").select(F.col("tree_id").alias("id"), "x", "y")
    got = rg.align_stems(t, t.select("id", (F.col("x") + 2.0).alias("x"), (F.col("y") - 1.0).alias("y")), 3.0, allow_rotation=False)
    return rounded(spark.createDataFrame([(got["yaw_deg"], got["dx"], got["dy"], got["votes"])], "yaw_deg double, dx double, dy double, votes long"))


@query(None)
def segment_treeiso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.segment_treeiso(_stand(spark, sf_dir), voxel=0.3, tile=25.0)


# ---------------------------------------------------------------- keys, tapers, unions, sidecars, events

from ..streaming import events as ev  # noqa: E402


@query(f"WITH {POINTS_SQL} SELECT point_id, ((CAST(floor(x / 0.5) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y / 0.5) AS BIGINT) + 1048576) << 21) | (CAST(floor(z / 0.5) AS BIGINT) + 1048576) AS key FROM points")
def voxel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.points(spark, sf_dir).select("point_id", S.voxel_key(F.col("x"), F.col("y"), F.col("z"), 0.5).alias("key"))


@query(f"""WITH {TREES_SQL}, p AS (SELECT tree_id, i, height * i / 10.0 AS h, dbh * 1.1 * (1 - i / 10.0) AS d FROM trees, (SELECT unnest(range(11)) AS i) WHERE dbh > 0 AND height > 0),
n AS (SELECT *, lead(h) OVER w AS nh, lead(d) OVER w AS nd FROM p WINDOW w AS (PARTITION BY tree_id ORDER BY i))
SELECT tree_id, round(sum(pi() / 12 * (nh - h) * (d * d + d * nd + nd * nd)), 6) AS volume, max(d) AS base_d FROM n GROUP BY tree_id""")
def stem_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = ad.trees(spark, sf_dir).filter("dbh > 0 AND height > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10))))
    t = t.select("tree_id", "i", (F.col("height") * F.col("i") / 10.0).alias("h"), (F.col("dbh") * 1.1 * (1 - F.col("i") / 10.0)).alias("d"))
    w = Window.partitionBy("tree_id").orderBy("i")
    v = S.frustum(F.lead("h").over(w) - F.col("h"), F.col("d"), F.lead("d").over(w))
    return t.withColumn("v", v).groupBy("tree_id").agg(F.round(F.sum("v"), 6).alias("volume"), F.max("d").alias("base_d"))


@query("SELECT cloud, count(*) AS n, count(q) AS with_q, round(sum(coalesce(q, 0)), 4) AS q FROM (SELECT 'a' AS cloud, l_quantity AS q FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT 'b', NULL FROM lineitem WHERE l_linenumber % 2 = 1) GROUP BY cloud")
def merge_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.read(spark, sf_dir, "lineitem")
    a = t.filter("l_linenumber % 2 = 0").select(F.lit("a").alias("cloud"), F.col("l_quantity").alias("q"))
    m = po.merge_clouds(a, t.filter("l_linenumber % 2 = 1").select(F.lit("b").alias("cloud")))
    return m.groupBy("cloud").agg(F.count("*").alias("n"), F.count("q").alias("with_q"), F.round(F.sum(F.coalesce("q", F.lit(0.0))), 4).alias("q"))


@query("SELECT user_id AS tree_id, arg_max(event_type, (ts, event_id)) AS verdict, count(*) AS edits FROM events GROUP BY user_id")
def review_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("tree_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("verdict"), F.count("*").alias("edits"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.window_counts(ad.read(spark, sf_dir, "events")), 4)


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(ad.read(spark, sf_dir, "events"))
