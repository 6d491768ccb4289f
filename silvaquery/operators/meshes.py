"""Closed surfaces around voxels as tables of corners and triangles, smoothed and thinned by joins and aggregates.

A face between a voxel and an empty neighbour becomes a square whose corners are shared with all faces around them; a corner lies at
the mean of its faces' middles (surface nets of a filled grid). Every edge is used as often one way as the other, so the surface has no
border whatever the voxels are. A corner is named by its place in the grid, so nothing is numbered before a file is written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import neighbours as ne

#: The six sides of a voxel, each with its four corners anticlockwise as seen from outside.
SIDES = {
    (1, 0, 0): ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)), (-1, 0, 0): ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)),
    (0, 1, 0): ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), (0, -1, 0): ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)),
    (0, 0, 1): ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)), (0, 0, -1): ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)),
}


def _place(i: int, j: int, k: int):
    return F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(k).cast("long").alias("k"))


def surface_squares(points: DataFrame, size: float, least: int = 1) -> DataFrame:
    """``(corners array<struct<i, j, k>>, mx, my, mz)``: a square for each side of an occupied voxel whose neighbour is empty; its middle."""
    cells = points.groupBy(*(S.cell(F.col(c), size).alias(k) for c, k in zip("xyz", "ijk"))).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("i", "j", "k")
    cells = ne.cut_lineage(cells)
    sides = F.array(*(F.struct(_place(*d).alias("to"), F.array(*(_place(*c) for c in corners)).alias("corners")) for d, corners in SIDES.items()))
    open_ = cells.select("i", "j", "k", F.explode(sides).alias("s")).withColumns({f"o{k}": F.col(k) + F.col(f"s.to.{k}") for k in "ijk"})
    there = cells.select(*(F.col(k).alias(f"o{k}") for k in "ijk"))
    faces = open_.join(there, ["oi", "oj", "ok"], "left_anti")
    corners = F.transform("s.corners", lambda c: F.struct(*((F.col(k) + c[k]).alias(k) for k in "ijk")))
    return faces.select(corners.alias("corners"), *(((F.col(k) + 0.5 + F.col(f"s.to.{k}") * 0.5) * size).alias(f"m{x}") for k, x in zip("ijk", "xyz")))


def corner_places(squares: DataFrame) -> DataFrame:
    """``(v, x, y, z)``: each corner at the mean of the middles of its squares."""
    return squares.select(F.explode("corners").alias("v"), "mx", "my", "mz").groupBy("v").agg(*(F.avg(f"m{c}").alias(c) for c in "xyz"))


def triangles(squares: DataFrame) -> DataFrame:
    """``(a, b, c)``: two for each square."""
    c = F.col("corners")
    return squares.select(F.explode(F.array(F.struct(c[0].alias("a"), c[1].alias("b"), c[2].alias("c")), F.struct(c[0].alias("a"), c[2].alias("b"), c[3].alias("c")))).alias("t")).select("t.*")


def edges(faces: DataFrame) -> DataFrame:
    """``(u, v)``: both directions of every edge, once each."""
    sides = F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "bc", "ca", "ba", "cb", "ac"))))
    return faces.select(sides.alias("e")).select("e.*").distinct()


def smoothed(corners: DataFrame, faces: DataFrame, rounds: int, shrink: float = 0.5, swell: float = -0.53) -> DataFrame:
    """Taubin's smoothing: a step towards the neighbours' mean and one away from it a round, so that volume stays."""
    near = ne.cut_lineage(edges(faces))
    for _ in range(rounds):
        for step in (shrink, swell):
            mean = near.join(corners.withColumnRenamed("v", "to"), near.v == F.col("to")).groupBy(F.col("u").alias("v")).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
            corners = ne.cut_lineage(corners.join(mean, "v").select("v", *((F.col(c) + step * (F.col(f"m{c}") - F.col(c))).alias(c) for c in "xyz")))
    return corners


def clustered(corners: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Corners of one cell merge at their mean; triangles that lose a side, and pairs that lie on one another back to back, go."""
    cell = F.struct(*(S.cell(F.col(c), size).alias(k) for c, k in zip("xyz", "ijk")))
    named = ne.cut_lineage(corners.withColumn("w", cell))
    new = named.groupBy(F.col("w").alias("v")).agg(*(F.avg(c).alias(c) for c in "xyz"))
    for k in "abc":
        faces = faces.join(named.select(F.col("v").alias("old"), F.col("w").alias(f"w{k}")), F.col(k) == F.col("old")).drop("old", k).withColumnRenamed(f"w{k}", k)
    faces = faces.filter("a <> b AND b <> c AND c <> a")
    # Turned so that the least corner comes first, the two ways round are told apart by the order of the others.
    least = F.least("a", "b", "c")
    turned = faces.select(least.alias("a"), F.when(least == F.col("a"), F.col("b")).when(least == F.col("b"), F.col("c")).otherwise(F.col("a")).alias("b"), F.when(least == F.col("a"), F.col("c")).when(least == F.col("b"), F.col("a")).otherwise(F.col("b")).alias("c"))
    one_way = F.when(F.col("b") < F.col("c"), 1).otherwise(-1)
    net = turned.groupBy("a", F.least("b", "c").alias("p"), F.greatest("b", "c").alias("q")).agg(F.sum(one_way).alias("n"))
    left = net.filter("n <> 0").select("a", F.when(F.col("n") > 0, F.col("p")).otherwise(F.col("q")).alias("b"), F.when(F.col("n") > 0, F.col("q")).otherwise(F.col("p")).alias("c"), F.explode(F.sequence(F.lit(1), F.abs("n").cast("int"))).alias("copy")).drop("copy")
    used = left.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    return new.join(used, "v", "left_semi"), left


def located(corners: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners: ``ax .. cz``."""
    for k in "abc":
        faces = faces.join(corners.select(F.col("v").alias("old"), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), F.col(k) == F.col("old")).drop("old")
    return faces


def mesh_measures(corners: DataFrame, faces: DataFrame) -> dict:
    """``{corners, triangles, area, volume, border_edges}``; the volume of a closed mesh, positive where faces look outward."""
    t = located(corners, faces)
    d = lambda p, q: [F.col(f"{q}{c}") - F.col(f"{p}{c}") for c in "xyz"]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    n = cross(d("a", "b"), d("a", "c"))
    area = F.sqrt(sum((x * x for x in n), F.lit(0.0))) / 2
    volume = sum((F.col(f"a{c}") * x for c, x in zip("xyz", n)), F.lit(0.0)) / 6
    r = t.agg(F.count(F.lit(1)).alias("triangles"), F.sum(area).alias("area"), F.sum(volume).alias("volume")).first()
    ways = faces.select(F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "bc", "ca")))).alias("e")).select(F.least("e.u", "e.v").alias("u"), F.greatest("e.u", "e.v").alias("v"), F.when(F.col("e.u") < F.col("e.v"), 1).otherwise(-1).alias("way"))
    border = ways.groupBy("u", "v").agg(F.sum("way").alias("n")).filter("n <> 0").count()
    return {"corners": corners.count(), "triangles": r["triangles"], "area": r["area"] or 0.0, "volume": r["volume"] or 0.0, "border_edges": border}


def closed_surface(points: DataFrame, size: float, least: int = 1, smooth: int = 0, decimate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(corners, triangles) of the closed surface around the points' voxels."""
    squares = ne.cut_lineage(surface_squares(points, size, least))
    corners, faces = ne.cut_lineage(corner_places(squares)), ne.cut_lineage(triangles(squares))
    if smooth:
        corners = smoothed(corners, faces, smooth)
    if decimate > 0:
        corners, faces = (ne.cut_lineage(t) for t in clustered(corners, faces, decimate))
    return corners, faces


def arrays(corners: DataFrame, faces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A mesh of bounded size as arrays, for a file."""
    v = corners.select("v.i", "v.j", "v.k", "x", "y", "z").orderBy("i", "j", "k").toPandas()
    number = pd.Series(np.arange(len(v)), index=pd.MultiIndex.from_frame(v[["i", "j", "k"]]))
    f = faces.select(*(F.col(f"{t}.{k}").alias(f"{t}{k}") for t in "abc" for k in "ijk")).toPandas()
    own = [number.reindex(pd.MultiIndex.from_frame(f[[f"{t}{k}" for k in "ijk"]])).to_numpy() for t in "abc"]
    return v[["x", "y", "z"]].to_numpy(float), np.stack(own, axis=1).astype(int) if len(f) else np.zeros((0, 3), int)
