"""Grid shifts with nested sub-grids: the NTv2 file format, and the finest grid's value at a point."""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lattice(NamedTuple):
    """Nodes at ``x0 + i dx``, ``y0 + j dy`` for i up to ``nx - 1`` and j up to ``ny - 1``."""

    grid: int
    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int


def read_ntv2(data: bytes) -> tuple[list[Lattice], pd.DataFrame]:
    """(lattices in degrees, longitude to the east; nodes ``(grid, i, j, dx, dy)`` with shifts in degrees) of an NTv2 file of either byte order."""
    order = "<" if struct.unpack_from("<i", data, 8)[0] == 11 else ">"
    if struct.unpack_from(f"{order}i", data, 8)[0] != 11 or data[:8] != b"NUM_OREC":
        raise ValueError("not an NTv2 file")
    many, = struct.unpack_from(f"{order}i", data, 40)
    unit = {b"SECONDS": 3600.0, b"MINUTES": 60.0, b"DEGREES": 1.0}[data[56:64].strip()]
    at, lattices, parts = 176, [], []
    for g in range(many):
        head = {data[at + 16 * k:at + 16 * k + 8].strip(): data[at + 16 * k + 8:at + 16 * k + 16] for k in range(11)}
        south, north, east, west, dlat, dlon = (struct.unpack(f"{order}d", head[k])[0] / unit for k in (b"S_LAT", b"N_LAT", b"E_LONG", b"W_LONG", b"LAT_INC", b"LONG_INC"))
        n, = struct.unpack_from(f"{order}i", head[b"GS_COUNT"])
        ny, nx = round((north - south) / dlat) + 1, round((west - east) / dlon) + 1
        if nx * ny != n:
            raise ValueError(f"sub-grid {g} has {n} nodes, not {nx} x {ny}")
        v = np.frombuffer(data, f"{order}f4", 4 * n, at + 176).reshape(ny, nx, 4).astype(float) / unit
        # The file counts longitudes to the west, and its rows run from east to west.
        j, i = np.mgrid[0:ny, 0:nx]
        parts.append(pd.DataFrame({"grid": g, "i": (nx - 1 - i).ravel(), "j": j.ravel(), "dx": -v[:, :, 1].ravel(), "dy": v[:, :, 0].ravel()}))
        lattices.append(Lattice(g, -west, south, dlon, dlat, nx, ny))
        at += 176 + 16 * n
    return lattices, pd.concat(parts, ignore_index=True)


def nested_values(points: DataFrame, lattices: list[Lattice], nodes: DataFrame, values: list[str]) -> DataFrame:
    """``points`` with ``values``: of the finest lattice that a point lies in, between its four nodes around (bilinear); null beyond all of them.

    ``nodes(grid, i, j, values...)``. The lattice is chosen by an expression over their bounds, so one equal-key join gives all values.
    """
    x, y = F.col("x"), F.col("y")
    pick, i, j, u, v = (F.lit(None).cast(t) for t in ("int", "long", "long", "double", "double"))
    # Of equal sizes the first one; the last of these tests is looked at first.
    for g in sorted(lattices, key=lambda g: (-g.dx * g.dy, -g.grid)):
        p, q = (x - g.x0) / g.dx, (y - g.y0) / g.dy
        inside = (p >= 0) & (p <= g.nx - 1) & (q >= 0) & (q <= g.ny - 1)
        at_i, at_j = F.least(F.floor(p), F.lit(g.nx - 2)), F.least(F.floor(q), F.lit(g.ny - 2))
        pick, i, j, u, v = (F.when(inside, new).otherwise(old) for new, old in ((F.lit(g.grid), pick), (at_i.cast("long"), i), (at_j.cast("long"), j), (p - at_i, u), (q - at_j, v)))
    corners = nodes.select("grid", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("o"), "i", "j", *values)
    at = lambda c, a, b: F.max(F.when((F.col("o.a") == a) & (F.col("o.b") == b), F.col(c))).alias(f"{c}_{a}{b}")
    squares = corners.groupBy("grid", (F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j")).agg(*(at(c, a, b) for c in values for a in (0, 1) for b in (0, 1)))
    keyed = points.withColumns({"grid": pick, "i": i, "j": j, "u_": u, "v_": v}).join(squares, ["grid", "i", "j"], "left")
    w = {(0, 0): (1 - F.col("u_")) * (1 - F.col("v_")), (1, 0): F.col("u_") * (1 - F.col("v_")), (0, 1): (1 - F.col("u_")) * F.col("v_"), (1, 1): F.col("u_") * F.col("v_")}
    mean = lambda c: sum((F.col(f"{c}_{a}{b}") * w[a, b] for a, b in w), F.lit(0.0))
    return keyed.select(*(F.col(c) for c in points.columns), *(mean(c).alias(c) for c in values))


def shifted(spark: SparkSession, points: DataFrame, data: bytes) -> DataFrame:
    """Geographic points (degrees) moved by an NTv2 file; those beyond its grids stay, as ``moved`` tells."""
    lattices, nodes = read_ntv2(data)
    got = nested_values(points, lattices, spark.createDataFrame(nodes), ["dx", "dy"])
    return got.select(*[c for c in points.columns if c not in ("x", "y")], (F.col("x") + F.coalesce("dx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("dy", F.lit(0.0))).alias("y"), F.col("dx").isNotNull().alias("moved"))
