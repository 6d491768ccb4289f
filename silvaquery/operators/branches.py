"""Branches as callipers measure them: sections across the local axis at many clicks at once, least widths, readings at right angles, circles.

A section is a slab across the axis; a reading in a direction is the extent of its points projected on it. Axes come from
moments in blocks, sections from one join of clicks with near points, widths from grouped extremes (or percentiles) over directions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as bl
from . import neighbours as ne
from . import trees as tr


def local_axes(clicks: DataFrame, points: DataFrame, radius: float, least: int = 12) -> DataFrame:
    """``clicks(click, branch, x, y, z)`` with ``ax, ay, az``, the direction of most spread of the branch's points around, and their mean ``mx, my, mz``.

    The radius is doubled, up to three times, where fewer than ``least`` points are near; clicks with fewer than three points then have no row.
    """

    @F.pandas_udf("array<double>")
    def most(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        v = np.linalg.eigh(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3))[1][:, :, 2]
        # One of both ways: upward, or towards y, or x.
        v = np.where(np.abs(v) < 1e-9, 0.0, v)
        lead = np.where(v[:, 2] != 0, v[:, 2], np.where(v[:, 1] != 0, v[:, 1], v[:, 0]))
        return pd.Series(list(np.where(lead[:, None] < 0, -v, v)))

    todo, found = clicks.select("click", "branch", "x", "y", "z"), None
    for k in range(4):
        got = ne.cut_lineage(bl.moments_within(todo, points.select("branch", "x", "y", "z"), radius * 2**k, by=("branch",)))
        done = got.filter(F.col("n") >= (least if k < 3 else 3))
        done = done.select("click", "branch", "x", "y", "z", "mx", "my", "mz", most("cxx", "cxy", "cxz", "cyy", "cyz", "czz").alias("a"))
        found = done if found is None else found.unionByName(done)
        todo = got.filter(F.col("n") < least).select("click", "branch", "x", "y", "z")
        if k < 3 and todo.isEmpty():
            break
    return found.select("click", "branch", "x", "y", "z", "mx", "my", "mz", *(F.col("a")[i].alias(f"a{c}") for i, c in enumerate("xyz")))


def sections(axes: DataFrame, points: DataFrame, half: float = 0.02, reach: float = 0.3) -> DataFrame:
    """``(click, u, v, cx, cy, cz)``: the points of each click's section in its plane, about their mean."""
    s = section_places(axes, points, half, reach)
    return s.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("i", "m")


def section_places(axes: DataFrame, points: DataFrame, half: float = 0.02, reach: float = 0.3) -> DataFrame:
    """The places of ``sections``, each with ``m``, how many points it has.

    ``axes`` as ``local_axes`` gives them. The centre is the click moved onto the axis, then once to the mean of the section's own points; ``half``
    is half the slab's thickness, ``reach`` the largest distance from the axis. u is level where it can be.
    """
    dot = lambda p, q: sum((F.col(f"{p}{c}") * F.col(f"{q}{c}") for c in "xyz"), F.lit(0.0))
    t = axes.withColumns({f"d{c}": F.col(c) - F.col(f"m{c}") for c in "xyz"}).withColumn("t", dot("d", "a"))
    t = t.withColumns({f"o{c}": F.col(f"m{c}") + F.col("t") * F.col(f"a{c}") for c in "xyz"})
    flat = F.hypot("ax", "ay")
    level = flat >= 1e-6
    # Across the axis and the vertical; for a vertical axis, towards -x.
    u = {"ux": F.when(level, F.col("ay") / flat).otherwise(-1.0), "uy": F.when(level, -F.col("ax") / flat).otherwise(0.0), "uz": F.lit(0.0)}
    t = t.withColumns(u).withColumns({"vx": F.col("ay") * F.col("uz") - F.col("az") * F.col("uy"), "vy": F.col("az") * F.col("ux") - F.col("ax") * F.col("uz"), "vz": F.col("ax") * F.col("uy") - F.col("ay") * F.col("ux")})
    base = t.select("click", "branch", *(F.col(f"o{c}").alias(c) for c in "xyz"), *(f"{p}{c}" for p in "auv" for c in "xyz"))
    # The second centre is at most one reach from the first.
    # Points of a branch in one place are one row; the clicks are few, so they are spread over cells, and the points are not.
    p = bl.spots(points, "branch", "x", "y", "z").select("branch", F.struct("x", "y", "z", "m").alias("a"), "x", "y", "z")
    spread = base.select("branch", "x", "y", "z", F.struct(*(c for c in base.columns if c != "branch")).alias("b"))
    near = ne.radius_pairs(p, spread, math.hypot(half, 2 * reach), by=("branch",)).select("b.*", "a.m", *(F.col(f"a.{c}").alias(f"r{c}") for c in "xyz")).withColumns({f"d{c}": F.col(f"r{c}") - F.col(c) for c in "xyz"})
    near = near.withColumns({"t": dot("d", "a"), "u": dot("d", "u"), "v": dot("d", "v")}).filter(F.abs("t") <= half)
    near = ne.cut_lineage(near.select("click", "u", "v", "m"))
    mean = near.filter(F.col("u") * F.col("u") + F.col("v") * F.col("v") <= reach * reach).groupBy("click").agg(*((F.sum(F.col("m") * F.col(c)) / F.sum("m")).alias(f"m{c}") for c in "uv"))
    mean = mean.join(base.select("click", "x", "y", "z", *(f"{p}{c}" for p in "uv" for c in "xyz")), "click")
    own = near.join(mean, "click").withColumns({"u": F.col("u") - F.col("mu"), "v": F.col("v") - F.col("mv")}).filter(F.col("u") * F.col("u") + F.col("v") * F.col("v") <= reach * reach)
    return own.select("click", "u", "v", "m", *((F.col(c) + F.col("mu") * F.col(f"u{c}") + F.col("mv") * F.col(f"v{c}")).alias(f"c{c}") for c in "xyz"))


def _widths(rows: DataFrame, angle: Column, trim: float, *keys: str) -> DataFrame:
    p = F.col("u") * F.cos(angle) + F.col("v") * F.sin(angle)
    if trim:
        ends = F.percentile(p, F.array(F.lit(trim), F.lit(1 - trim)))
        return rows.groupBy(*keys).agg((ends[1] - ends[0]).alias("width"))
    return rows.groupBy(*keys).agg((F.max(p) - F.min(p)).alias("width"))


def caliper_readings(section: DataFrame, trim: float = 0.0, fine: int = 50) -> DataFrame:
    """``(click, n, angle_deg, least_width, cross_width, mean_width, circle_diameter, coverage, cx, cy, cz)`` of each section.

    The least width is sought degree by degree, then in ``fine`` steps a degree around; the cross reading is at right angles to it.
    ``trim``: the share of points that may lie outside each jaw.
    """
    least = Window.partitionBy("click").orderBy("width", "k")
    turn = lambda k: F.radians(F.col(k))
    rough = _widths(section.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(179)))).withColumn("k", F.col("k").cast("double")), turn("k"), trim, "click", "k")
    best = ne.cut_lineage(rough.withColumn("r", F.row_number().over(least)).filter("r = 1").select("click", F.col("k").alias("k0")))
    near = section.join(best, "click").withColumn("i", F.explode(F.sequence(F.lit(-fine), F.lit(fine)))).withColumn("k", F.col("k0") + F.col("i") / max(fine, 1))
    exact = _widths(near, turn("k"), trim, "click", "k").withColumn("r", F.row_number().over(least)).filter("r = 1").select("click", F.col("k"), F.col("width").alias("least_width"))
    exact = ne.cut_lineage(exact)
    cross = _widths(section.join(exact.select("click", "k"), "click"), F.radians(F.col("k") + 90), trim, "click").withColumnRenamed("width", "cross_width")
    fit = tr.circles(section.select("click", F.col("u").alias("x"), F.col("v").alias("y")), "click").select("click", (2 * F.col("r")).alias("circle_diameter"), (F.bit_count("sectors") / 12).alias("coverage"))
    n = section.groupBy("click").agg(F.count(F.lit(1)).alias("n"), *(F.first(f"c{c}").alias(f"c{c}") for c in "xyz"))
    t = exact.join(cross, "click").join(n, "click").join(fit, "click", "left")
    return t.select("click", "n", F.pmod(F.col("k"), F.lit(180.0)).alias("angle_deg"), "least_width", "cross_width", ((F.col("least_width") + F.col("cross_width")) / 2).alias("mean_width"), "circle_diameter", "coverage", "cx", "cy", "cz")


def measured_branches(clicks: DataFrame, points: DataFrame, axis_radius: float = 0.15, half: float = 0.02, reach: float = 0.3, trim: float = 0.0) -> DataFrame:
    """Readings at ``clicks(click, branch, x, y, z)`` on ``points(branch, x, y, z)``; a click far from its branch has no row."""
    return caliper_readings(ne.cut_lineage(sections(ne.cut_lineage(local_axes(clicks, points, axis_radius)), points, half, reach)), trim)
