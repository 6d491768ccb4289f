"""Column expressions shared by the operators: geometry, keys, forestry formulas. All stay inside whole-stage codegen or higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Laasasenaho (1982) stem volume, V[dm3] = a1 d^a2 a3^d h^a4 (h - 1.3)^a5, d in cm, h in m.
LAASASENAHO = {
    "pine": (0.036089, 2.01395, 0.99676, 2.07025, -1.07209),
    "spruce": (0.022927, 1.91505, 0.99146, 2.82541, -1.53547),
    "birch": (0.011197, 2.10253, 0.98600, 3.98519, -2.65900),
}
# Names that stand for the three species.
ALIASES = {"pine": "pine", "manty": "pine", "mänty": "pine", "spruce": "spruce", "kuusi": "spruce", "birch": "birch", "koivu": "birch"}
# Wood density and its deviation in kg/m3, carbon fraction, by species.
WOOD = {"pine": (400.0, 25.0, 0.50), "spruce": (385.0, 25.0, 0.50), "birch": (490.0, 30.0, 0.50), "aspen": (400.0, 30.0, 0.50), "oak": (650.0, 40.0, 0.48)}


def measured(c: Column) -> Column:
    """A number, or null where it is NaN or infinite: what was not measured is null, never zero."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def cell(v: Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((v - F.lit(origin)) / F.lit(size)).cast("long")


def voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """21 bits per axis with bias 2^20; null outside."""
    parts = [cell(v, size) + (1 << 20) for v in (x, y, z)]
    inside = F.lit(True)
    for p in parts:
        inside = inside & (p >= 0) & (p < (1 << 21))
    return F.when(inside, F.shiftleft(parts[0], 42).bitwiseOR(F.shiftleft(parts[1], 21)).bitwiseOR(parts[2]))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule with an implicit closing edge; the bounding box comes first, for Parquet's statistics. No polygon: everywhere."""
    if len(polygon) < 3:
        return F.lit(True)
    xs, ys = zip(*polygon)
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(float(x2 - x1)) * (y - F.lit(y1)) / F.lit(float(y2 - y1)) + F.lit(x1))
            odd = odd + F.when(crosses, 1).otherwise(0)
    return box & (odd % 2 == 1)


def in_slab(x: Column, y: Column, z: Column, anchor: tuple, normal: tuple, thickness: float) -> Column:
    """Within half the thickness of a plane; a degenerate normal or no thickness filters nothing."""
    n = math.sqrt(sum(v * v for v in normal))
    if not n or not thickness > 0 or not math.isfinite(n):
        return F.lit(True)
    d = sum(((c - F.lit(float(a))) * F.lit(v / n) for c, a, v in zip((x, y, z), anchor, normal)), F.lit(0.0))
    return F.abs(d) <= thickness / 2


def species_key(species: Column) -> Column:
    s, out = F.lower(F.trim(species)), F.lit(None).cast("string")
    for name, known in ALIASES.items():
        out = F.when(s == name, known).otherwise(out)
    return out


def laasasenaho(species: Column, dbh: Column, height: Column) -> Column:
    """Stem volume in m3 for the three species it is known for, from 4 m of height; dbh in m."""
    d, out = dbh * 100, F.lit(None).cast("double")
    for name, (a1, a2, a3, a4, a5) in LAASASENAHO.items():
        v = F.lit(a1) * F.pow(d, F.lit(a2)) * F.pow(F.lit(a3), d) * F.pow(height, F.lit(a4)) * F.pow(height - F.lit(1.3), F.lit(a5)) / F.lit(1000.0)
        out = F.when((species == name) & (height >= 4) & (dbh > 0), v).otherwise(out)
    return out


def basal_area(dbh: Column) -> Column:
    return F.lit(math.pi) * (dbh * 0.5) * (dbh * 0.5)


def frustum(length: Column, d1: Column, d2: Column) -> Column:
    return F.lit(math.pi / 12) * length * (d1 * d1 + d1 * d2 + d2 * d2)


def jitter(tree_id: Column) -> Column:
    """Knuth's multiplicative hash of the id read as unsigned 32 bits, in [0, 1); in decimals, as ids below zero would overflow."""
    u = F.pmod(tree_id.cast("decimal(20,0)"), F.lit(4294967296).cast("decimal(20,0)"))
    return F.pmod(u * F.lit(2654435761).cast("decimal(10,0)"), F.lit(4294967296).cast("decimal(20,0)")).cast("double") / F.lit(4294967296.0)


def inside_boundary(x: Column, y: Column, b: dict) -> Column:
    if b["kind"] == "circular":
        dx, dy = x - F.lit(float(b["center"][0])), y - F.lit(float(b["center"][1]))
        return dx * dx + dy * dy <= F.lit(float(b["radius"]) ** 2)
    return x.between(float(b["min"][0]), float(b["max"][0])) & y.between(float(b["min"][1]), float(b["max"][1]))


def boundary_area_ha(b: dict) -> float:
    if b["kind"] == "circular":
        return math.pi * b["radius"] ** 2 / 10_000
    return max(0.0, b["max"][0] - b["min"][0]) * max(0.0, b["max"][1] - b["min"][1]) / 10_000


def signed_distance(x: Column, y: Column, b: dict) -> Column:
    """Below zero inside."""
    if b["kind"] == "circular":
        return F.sqrt(F.pow(x - F.lit(float(b["center"][0])), F.lit(2)) + F.pow(y - F.lit(float(b["center"][1])), F.lit(2))) - F.lit(float(b["radius"]))
    zero = F.lit(0.0)
    (x0, y0), (x1, y1) = b["min"], b["max"]
    ex, ey = F.greatest(F.lit(float(x0)) - x, x - F.lit(float(x1))), F.greatest(F.lit(float(y0)) - y, y - F.lit(float(y1)))
    return F.when(F.greatest(ex, ey) > 0, F.hypot(F.greatest(ex, zero), F.greatest(ey, zero))).otherwise(F.greatest(ex, ey))


def crown_lattice(n: int = 64) -> list[tuple[float, float]]:
    """A Fibonacci lattice on the unit disc."""
    golden = math.pi * (3 - math.sqrt(5))
    return [(math.sqrt((i + 0.5) / n) * math.cos(i * golden), math.sqrt((i + 0.5) / n) * math.sin(i * golden)) for i in range(n)]


def edge_weight(x: Column, y: Column, crown_area: Column, b: dict, method: str = "crownArea", buffer: float = 1.0) -> Column:
    """A tree's weight by edge correction: none, halfcount, or the share of its crown inside."""
    stem = F.when(inside_boundary(x, y, b), 1.0).otherwise(0.0)
    if method == "none":
        return stem
    if method == "halfcount":
        d = signed_distance(x, y, b)
        return F.when(d > 0, 0.0).when(F.abs(d) <= buffer, 0.5).otherwise(1.0)
    if method != "crownArea":
        raise ValueError(f"unknown edge correction {method!r}")
    r = F.sqrt(crown_area / F.lit(math.pi))
    spots = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in crown_lattice()))
    share = F.aggregate(spots, F.lit(0.0), lambda a, p: a + F.when(inside_boundary(x + r * p["u"], y + r * p["v"], b), 1.0 / 64).otherwise(0.0))
    return F.when(crown_area > 0, share).otherwise(stem)
