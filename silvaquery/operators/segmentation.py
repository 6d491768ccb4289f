"""Ground, terrain and segmentation. Sequential algorithms run tile by tile with a halo, in NumPy; what is per cell or per point stays in DataFrames.

Tiles bound memory: a task holds one tile and its halo. Where neighbouring tiles must agree (segments), a point is labelled by the
tile that holds it, and a tree is named by the place of its seed in the world, so tiles that see a tree whole name it alike; the
halo must be wider than a crown. Flow is exact whatever the tiles: what crosses their borders is passed on until nothing changes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.geometry import convex_hull, delaunay
from . import blocks as bl
from . import neighbours as ne
from .cuts import cut_pursuit


def tiled(df: DataFrame, size: float, halo: float, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``work`` on every tile with its halo; rows carry ``core`` (inside the tile itself) and ``tile_x``, ``tile_y``."""
    tx, ty = S.cell(F.col("x"), size), S.cell(F.col("y"), size)
    reach = math.ceil(halo / size)
    spots = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    p = df.withColumn("o", F.explode(spots)).withColumns({"tile_x": tx + F.col("o.i"), "tile_y": ty + F.col("o.j")})
    near = (F.col("x") >= F.col("tile_x") * size - halo) & (F.col("x") < (F.col("tile_x") + 1) * size + halo) & (F.col("y") >= F.col("tile_y") * size - halo) & (F.col("y") < (F.col("tile_y") + 1) * size + halo)
    p = p.filter(near).withColumn("core", (F.col("o.i") == 0) & (F.col("o.j") == 0)).drop("o")
    return p.groupBy("tile_x", "tile_y").applyInPandas(work, schema)


def tiled_cells(points: DataFrame, cell: float, value: Column, size: float, halo: float, work: Callable[[np.ndarray, int, int], np.ndarray], kind: str) -> DataFrame:
    """``points`` with ``found``, what ``work(raster, first column, first row)`` gives their cell in the tile that holds its centre.

    A raster has ``value``, an aggregate, of each cell of the tile and its halo, nan where there is none. Tasks hold cells, never points.
    """
    at = {"col": S.cell(F.col("x"), cell), "row": S.cell(F.col("y"), cell)}
    cells = bl.spots(points.withColumns(at), "col", "row", value=value).select("col", "row", "value", *(((F.col(c) + 0.5) * cell).alias(k) for c, k in (("col", "x"), ("row", "y"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        c, r, own = pdf["col"].to_numpy(), pdf["row"].to_numpy(), pdf["core"].to_numpy(bool)
        out = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        out[r - r.min(), c - c.min()] = pdf["value"].to_numpy(float)
        out[~np.isfinite(out)] = np.nan
        # A tile without a cell of its own has no result.
        found = work(out, int(c.min()), int(r.min()))[r - r.min(), c - c.min()][own] if own.any() else []
        return pd.DataFrame({"col": c[own], "row": r[own], "found": found})

    got = ne.cut_lineage(tiled(cells, size, halo, one, f"col long, row long, found {kind}"))
    return points.withColumns(at).join(got, ["col", "row"]).select(*points.columns, "found")


def _filled(a: np.ndarray) -> np.ndarray:
    """Gaps take the mean of their known neighbours, ring by ring."""
    a = a.copy()
    while np.isnan(a).any() and not np.isnan(a).all():
        p = np.pad(a, 1, constant_values=np.nan)
        near = np.stack([p[i:i + a.shape[0], j:j + a.shape[1]] for i in range(3) for j in range(3)])
        known = ~np.isnan(near)
        with np.errstate(all="ignore"):
            mean = np.where(known, near, 0).sum(0) / known.sum(0)
        a = np.where(np.isnan(a), mean, a)
    return a


def _window(a: np.ndarray, half: int, pick: Callable) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(a, [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = pick(np.lib.stride_tricks.sliding_window_view(p, 2 * half + 1, axis), axis=-1)
    return a


def classify_ground(points: DataFrame, cell: float = 0.5, tolerance: float = 0.2, slope: float = 0.2, first: float = 0.3, most: float = 2.5, window: float = 20.0, tile: float = 50.0, key: str = "point_id") -> DataFrame:
    """Progressive morphological filter (Zhang et al. 2003): ``(point_id, cls)``, 2 for ground, else 1.

    Openings with growing windows take off what rises above them by more than a threshold that grows with slope and window.
    """

    def work(low: np.ndarray, c0: int, r0: int) -> np.ndarray:
        surface, ground = _filled(low), np.ones(low.shape, bool)
        half, last = 1, 0
        while half * cell <= window / 2:
            opened = _window(_window(surface, half, np.min), half, np.max)
            limit = min(most, first + slope * (half - last) * cell * 2) if last else first
            ground &= surface - opened <= limit
            surface, last, half = opened, half, half * 2
        return _filled(np.where(ground, low, np.nan))

    found = tiled_cells(points.select(key, "x", "y", "z"), cell, F.min("z"), tile, window, work, "double")
    return found.select(key, F.when(F.col("z") - F.col("found") <= tolerance, 2).otherwise(1).alias("cls"))


def classify_cloth(points: DataFrame, cell: float = 0.5, tolerance: float = 0.2, rigidity: int = 2, rounds: int = 500, step: float = 0.65, tile: float = 50.0, halo: float = 10.0, key: str = "point_id") -> DataFrame:
    """Cloth simulation (Zhang et al. 2016): ``(point_id, cls)``, 2 for ground, else 1.

    The cloud is turned over and a cloth of square cells falls on it: a particle that meets the cloud stays, the others are drawn
    to their neighbours, ``rigidity`` times a round, by halves of what is left. Points near the cloth at rest are ground.
    """

    def work(low: np.ndarray, c0: int, r0: int) -> np.ndarray:
        floor = -_filled(low)  # the cloud turned over
        cloth = np.full(floor.shape, np.nanmax(floor) + 0.05)
        before, free = cloth.copy(), np.ones(floor.shape, bool)
        for _ in range(rounds):
            now = np.where(free, cloth + 0.99 * (cloth - before) - 0.2 * step * step, cloth)
            before, cloth = cloth, now
            for _ in range(rigidity):
                p = np.pad(cloth, 1, mode="edge")
                pull = sum(p[1 + i:p.shape[0] - 1 + i, 1 + j:p.shape[1] - 1 + j] - cloth for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))) / 4
                cloth = np.where(free, cloth + pull / 2, cloth)
            landed = free & (cloth <= floor)
            cloth[landed] = floor[landed]
            free &= ~landed
            if not free.any() or np.abs(cloth - before)[free].max(initial=0.0) < 1e-4:
                break
        return cloth

    found = tiled_cells(points.select(key, "x", "y", "z"), cell, F.min("z"), tile, halo, work, "double")
    return found.select(key, F.when(F.abs(F.col("z") + F.col("found")) <= tolerance, 2).otherwise(1).alias("cls"))


#: Neighbours of a cell, in the order that settles ties.
AROUND = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj]


class FlowTile:
    """Cells of a tile and one ring around it, as arrays: surface, filled level, steps to a lower level, and which cells are the tile's own."""

    def __init__(self, pdf: pd.DataFrame):
        c, r = pdf["col"].to_numpy(int), pdf["row"].to_numpy(int)
        self.c0, self.r0 = c.min() - 1, r.min() - 1
        shape = (r.max() - self.r0 + 2, c.max() - self.c0 + 2)
        self.at = (r - self.r0, c - self.c0)
        self.z, self.fill, self.steps = np.full(shape, np.nan), np.full(shape, np.inf), np.zeros(shape, np.int64)
        self.own = np.zeros(shape, bool)
        self.z[self.at], self.fill[self.at], self.steps[self.at], self.own[self.at] = pdf["v"], pdf["fill"], pdf["steps"], pdf["core"]
        self.known = ~np.isnan(self.z)

    def relax(self) -> None:
        """Lowest level at which water leaves, and the fewest steps on that level, from what is known around (Planchon and Darboux's surface, by a heap)."""
        h, w = self.z.shape
        all_around = np.ones((h, w), bool)
        for di, dj in AROUND:
            all_around[1:-1, 1:-1] &= self.known[1 + di:h - 1 + di, 1 + dj:w - 1 + dj]
        rim = self.own & ~all_around
        better = rim & ((self.fill > self.z) | (self.steps > 0))
        self.fill[better], self.steps[better] = self.z[better], 0
        heap = [(self.fill[i, j], self.steps[i, j], i, j) for i, j in zip(*np.nonzero(self.known & np.isfinite(self.fill)))]
        heapq.heapify(heap)
        z, fill, steps, own = self.z, self.fill, self.steps, self.own
        while heap:
            v, n, i, j = heapq.heappop(heap)
            if (v, n) > (fill[i, j], steps[i, j]):
                continue
            for di, dj in AROUND:
                a, b = i + di, j + dj
                if 0 <= a < h and 0 <= b < w and own[a, b]:
                    level = max(z[a, b], v)
                    new = (level, n + 1 if level == v else 0)
                    if new < (fill[a, b], steps[a, b]):
                        fill[a, b], steps[a, b] = new
                        heapq.heappush(heap, (*new, a, b))

    def downstream(self) -> dict[tuple[int, int], tuple[int, int] | None]:
        """The neighbour each own cell drains to: the steepest lower one, else on a flat the one with fewest steps; cells of the rim drain out."""
        out = {}
        for i, j in zip(*np.nonzero(self.own)):
            best, flat = (0.0, None), (self.steps[i, j], None)
            edge = False
            for di, dj in AROUND:
                a, b = i + di, j + dj
                if not self.known[a, b]:
                    edge = True
                    continue
                drop = (self.fill[i, j] - self.fill[a, b]) / math.hypot(di, dj)
                if drop > best[0]:
                    best = (drop, (a, b))
                elif drop == 0 and self.steps[a, b] < flat[0]:
                    flat = (self.steps[a, b], (a, b))
            out[i, j] = best[1] or (None if edge else flat[1])
        return out

    def order(self) -> list[tuple[int, int]]:
        """Own cells from the highest down."""
        i, j = np.nonzero(self.own)
        k = np.lexsort((-self.steps[i, j], -self.fill[i, j]))
        return list(zip(i[k].tolist(), j[k].tolist()))

    def world(self, cell: tuple[int, int]) -> tuple[int, int]:
        return int(cell[1] + self.c0), int(cell[0] + self.r0)

    def steepness(self, cell: float) -> np.ndarray:
        """Length of the gradient of the filled surface: central differences, one-sided where a neighbour is missing."""
        f = np.where(self.known, self.fill, np.nan)
        total = np.zeros(f.shape)
        for axis in (0, 1):
            up, down = np.roll(f, -1, axis), np.roll(f, 1, axis)
            both = (up - down) / (2 * cell)
            one = np.where(np.isnan(up), f - down, up - f) / cell
            total += np.nan_to_num(np.where(np.isnan(both), one, both)) ** 2
        return np.sqrt(total)


def flow_accumulation(grid: DataFrame, cell: float, value: str = "lowest", tile_cells: int = 512) -> DataFrame:
    """Filled sinks, D8 flow, cells accumulated, wetness index: ``(col, row, filled, accumulation, twi)``; the tiles don't show in the result.

    Tiles are filled from what their neighbours' borders say, again and again until no border changes. Then every tile adds up its own
    cells; sums that leave a tile are passed down the graph of border cells by doubling steps, and each tile adds
    what comes in. Only border cells travel.
    """
    tc, tr = F.floor(F.col("col") / tile_cells).cast("long"), F.floor(F.col("row") / tile_cells).cast("long")
    state = ne.cut_lineage(grid.select(F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").select("*", F.lit(float("inf")).alias("fill"), F.lit(0).cast("long").alias("steps"), tc.alias("tc"), tr.alias("tr")))
    moves = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))

    def with_ring(s: DataFrame) -> DataFrame:
        """Every tile's cells and those of its neighbours that touch it."""
        low, high = F.lit(0), F.lit(tile_cells - 1)
        c, r = F.col("col") - F.col("tc") * tile_cells, F.col("row") - F.col("tr") * tile_cells
        near = lambda x, d: F.when(d == 0, True).when(d < 0, x == low).otherwise(x == high)
        ring = s.filter((c == low) | (c == high) | (r == low) | (r == high)).withColumn("o", F.explode(moves)).filter(near(c, F.col("o.i")) & near(r, F.col("o.j")))
        ring = ring.select("col", "row", "v", "fill", "steps", (F.col("tc") + F.col("o.i")).alias("tc"), (F.col("tr") + F.col("o.j")).alias("tr"), F.lit(False).alias("core"))
        return s.select("col", "row", "v", "fill", "steps", "tc", "tr", F.lit(True).alias("core")).unionByName(ring)

    def per_tile(s: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        empty = pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])
        return with_ring(s).groupBy("tc", "tr").applyInPandas(lambda pdf: work(pdf) if pdf["core"].any() else empty, schema)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        t = FlowTile(pdf)
        t.relax()
        out = pdf[["col", "row", "v"]].assign(fill=t.fill[t.at], steps=t.steps[t.at], tc=pdf["tc"], tr=pdf["tr"])
        return out.assign(changed=(out["fill"] != pdf["fill"]) | (out["steps"] != pdf["steps"]))[pdf["core"].to_numpy()]

    while True:
        new = ne.cut_lineage(per_tile(state, fill, "col long, row long, v double, fill double, steps long, tc long, tr long, changed boolean"))
        state = new.drop("changed")
        if new.filter("changed").isEmpty():
            break

    def leaving(pdf: pd.DataFrame) -> pd.DataFrame:
        """Border cells: where they drain to in the next tile with what sum, and which border cell water that enters here leaves by."""
        t = FlowTile(pdf)
        down, total, exit_ = t.downstream(), {}, {}
        for c in t.order():
            total[c] = total.get(c, 0.0) + 1.0
            d = down[c]
            if d and t.own[d]:
                total[d] = total.get(d, 0.0) + total[c]
        for c in reversed(t.order()):
            d = down[c]
            exit_[c] = None if not d else exit_[d] if t.own[d] else c
        rows = [(*t.world(c), *t.world(down[c]), total[c]) for c in total if down[c] and not t.own[down[c]]]
        h, w = t.z.shape
        inner = lambda c: all(t.own[c[0] + i, c[1] + j] or not t.known[c[0] + i, c[1] + j] for i, j in AROUND)
        rows += [(*t.world(c), *t.world(exit_[c]), None) for c in total if exit_[c] and not inner(c)]
        return pd.DataFrame(rows, columns=["col", "row", "to_col", "to_row", "total"])

    name = lambda c, r: F.struct(F.col(c).alias("c"), F.col(r).alias("r"))
    border = ne.cut_lineage(per_tile(state, leaving, "col long, row long, to_col long, to_row long, total double").select(name("col", "row").alias("u"), name("to_col", "to_row").alias("v"), "total"))
    exits, through = border.filter("total IS NOT NULL"), border.filter("total IS NULL").select(F.col("u").alias("v"), F.col("v").alias("next"))
    # Sums of everything up to 2^k border crossings upstream.
    sums, hop = exits.select("u", F.col("total").alias("s")), ne.cut_lineage(exits.join(through, "v").select("u", "next"))
    while not hop.isEmpty():
        more = sums.join(hop, "u").groupBy(F.col("next").alias("u")).agg(F.sum("s").alias("more"))
        sums = ne.cut_lineage(sums.join(more, "u", "left").select("u", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s")))
        after = hop.select(F.col("u").alias("next"), F.col("next").alias("far"))
        hop = ne.cut_lineage(hop.join(after, "next").select("u", F.col("far").alias("next")))
    inflow = ne.cut_lineage(exits.select("u", "v").join(sums, "u").groupBy("v").agg(F.sum("s").alias("inflow")).select(F.col("v.c").alias("col"), F.col("v.r").alias("row"), "inflow"))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        t = FlowTile(pdf)
        extra = np.zeros(t.z.shape)
        extra[t.at] = pdf["inflow"].fillna(0.0)
        down, acc = t.downstream(), np.where(t.own, 1.0 + extra, 0.0)
        for c in t.order():
            if down[c] and t.own[down[c]]:
                acc[down[c]] += acc[c]
        twi = np.log(np.maximum(acc * cell, 1e-9) / np.maximum(t.steepness(cell), 1e-3))
        return pd.DataFrame({"col": pdf["col"], "row": pdf["row"], "filled": t.fill[t.at], "accumulation": acc[t.at], "twi": twi[t.at]})[pdf["core"].to_numpy()]

    ringed = with_ring(state).join(inflow, ["col", "row"], "left")
    schema = "col long, row long, filled double, accumulation double, twi double"
    none = pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])
    return ringed.groupBy("tc", "tr").applyInPandas(lambda pdf: finish(pdf) if pdf["core"].any() else none, schema)


def segment_chm(points: DataFrame, cell: float = 0.5, smooth: float = 1.0, least: float = 2.0, base: float = 1.5, per_m: float = 0.05, widest: float = 5.0, tile: float = 50.0, key: str = "point_id") -> DataFrame:
    """Watershed of the canopy height model from maxima in windows that grow with height: ``(point_id, tree_id)``, 0 for none."""

    def work(chm: np.ndarray, c0: int, r0: int) -> np.ndarray:
        h = np.nan_to_num(chm, nan=0.0)
        if smooth > 0:
            half = max(1, round(2 * smooth))
            k = np.exp(-0.5 * (np.arange(-half, half + 1) / smooth) ** 2)
            k /= k.sum()
            for axis in (0, 1):
                h = np.apply_along_axis(lambda v: np.convolve(np.pad(v, half, mode="edge"), k, "valid"), axis, h)
        label, heap = np.zeros(h.shape, np.int64), []
        for i, j in zip(*np.nonzero(h >= least)):
            n = int(min(widest, base + per_m * h[i, j]) / cell)
            near = h[max(0, i - n):i + n + 1, max(0, j - n):j + n + 1]
            # Of equal heights in a window the first in raster order is the seed.
            first = np.unravel_index(int(near.argmax()), near.shape)
            if h[i, j] >= near.max() and (first[0] + max(0, i - n), first[1] + max(0, j - n)) == (i, j):
                label[i, j] = i * h.shape[1] + j + 1
                heapq.heappush(heap, (-h[i, j], i, j))
        while heap:
            v, i, j = heapq.heappop(heap)
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < h.shape[0] and 0 <= b < h.shape[1] and not label[a, b] and h[a, b] >= least:
                    label[a, b] = label[i, j]
                    heapq.heappush(heap, (-h[a, b], a, b))
        # A seed's world cell names its tree, so tiles agree on trees that both see.
        seed = label - 1
        return np.where(seed >= 0, ((seed // h.shape[1] + r0) << 24) + (seed % h.shape[1] + c0) + (1 << 23), 0)

    found = tiled_cells(points.select(key, "x", "y", "hag"), cell, F.max("hag"), tile, 2 * widest, work, "long")
    return found.select(key, F.when(F.col("hag") >= least, F.col("found")).otherwise(0).alias("tree_id"))


def place_name(x: float, y: float, step: float) -> int:
    """A number above zero for a place in the world, to the step."""
    return ((math.floor(y / step) + (1 << 29)) << 31) + math.floor(x / step) + (1 << 29)


def segment_li2012(points: DataFrame, dt1: float = 1.5, dt2: float = 2.0, zu: float = 15.0, window: float = 2.0, least: float = 2.0, min_points: int = 30, tile: float = 40.0, halo: float = 20.0, key: str = "point_id") -> DataFrame:
    """Top-down growth (Li et al. 2012) by tile: ``(point_id, tree_id)``; ``window`` is a diameter, groups too small become 0 and are not tried again. A tree is named by its highest point."""
    far = max(10.0, dt1, dt2)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hag", key], ascending=[False, True]).reset_index(drop=True)
        x, y, z = (pdf[k].to_numpy(float) for k in ("x", "y", "hag"))
        live = np.flatnonzero(z >= least)
        peak, flat = np.ones(len(x), bool), np.column_stack([x, y])
        if window > 0:
            for i, j, _ in bl.close_pairs(flat[live], flat[live], window / 2):
                peak[live[i[z[live[j]] > z[live[i]]]]] = False
        limits = np.where(peak, np.where(z > zu, dt2, dt1), far)
        out = np.zeros(len(x), np.int64)
        while len(live):
            # Members of the tree and of the rest, as growing prefixes of two arrays.
            sides, size = np.empty((2, len(live), 2)), [1, 0]
            sides[0, 0] = flat[live[0]]
            mine = np.zeros(len(live), bool)
            mine[0] = True
            west, south = east, north = tuple(flat[live[0]].tolist())
            for n, (px, py, limit) in enumerate(zip(x[live[1:]].tolist(), y[live[1:]].tolist(), limits[live[1:]].tolist()), 1):
                # Whatever is farther than its limit from the tree's box is of the rest, without a look at its points.
                if west - limit <= px <= east + limit and south - limit <= py <= north + limit:
                    to_tree = _nearest2(sides[0, :size[0]], px, py)
                    if to_tree <= limit * limit and to_tree <= _nearest2(sides[1, :size[1]], px, py):
                        sides[0, size[0]] = px, py
                        size[0] += 1
                        mine[n] = True
                        west, east, south, north = min(west, px), max(east, px), min(south, py), max(north, py)
                        continue
                sides[1, size[1]] = px, py
                size[1] += 1
            if size[0] >= max(1, min_points):
                out[live[mine]] = place_name(x[live[0]], y[live[0]], 0.01)
            live = live[~mine]
        own = pdf["core"].to_numpy()
        return pd.DataFrame({key: pdf[key][own], "tree_id": out[own]})

    kind = dict(points.dtypes)[key]
    return tiled(points.select(key, "x", "y", "hag"), tile, halo, work, f"{key} {kind}, tree_id long")


def _nearest2(points: np.ndarray, x: float, y: float) -> float:
    """Least squared distance to any of the points."""
    if not len(points):
        return math.inf
    d = points - (x, y)
    return float(np.einsum("ij,ij->i", d, d).min())


def by_voxel(points: DataFrame, voxel: float, segment: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Labels of points through labels of their voxels (``v`` names a voxel by its three cells), so tiles hold voxels only: ``(key, tree_id)``."""
    cells = [S.cell(F.col(c), voxel).alias(f"v{c}") for c in ("x", "y", "hag")]
    p = points.filter(F.col("hag") >= 0).select(key, *cells)
    v = p.select("vx", "vy", "vhag").distinct().select(F.concat_ws(":", "vx", "vy", "vhag").alias("v"), *(((F.col(f"v{c}") + 0.5) * voxel).alias(c) for c in ("x", "y", "hag")))
    return p.select(key, F.concat_ws(":", "vx", "vy", "vhag").alias("v")).join(segment(v), "v").select(key, "tree_id")


def stem_seeds(voxels: DataFrame, reach: float, cut: float, stem_high: float, least: int, step: float) -> DataFrame:
    """``(v, seed)``: voxels of the low band in clusters of at least ``least``, whatever tiles they cross; a seed is named by its lowest voxel's place."""
    low = voxels.filter(F.col("hag").between(cut, stem_high))
    found = ne.cut_lineage(low.join(ne.dbscan(low.select("v", "x", "y", F.col("hag").alias("z")), reach, 1, key="v"), "v"))
    foot = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hag", "y", "x")).alias("f")).filter(F.col("n") >= least)
    name = ((F.floor(F.col("f.y") / step) + (1 << 29)) * F.lit(1 << 31) + F.floor(F.col("f.x") / step) + (1 << 29)).cast("long")
    return found.join(foot.select("cluster", name.alias("seed")), "cluster").select("v", "seed")


def grown(place: np.ndarray, best: np.ndarray, label: np.ndarray, front: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Least distances along links of at most ``reach``, and the labels they bring (the smaller where equal), from rows ``front`` on, until nothing changes."""
    links = [np.stack([i, j]) for i, j, _ in bl.close_pairs(place, place, reach)]
    u, v = np.concatenate(links, axis=1) if links else np.zeros((2, 0), int)
    first, far = np.searchsorted(u, np.arange(len(place) + 1)), np.sqrt(((place[u] - place[v]) ** 2).sum(1))
    best, label = best.copy(), label.copy()
    while len(front):
        n = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        to, way, name = v[at], np.repeat(best[front], n) + far[at], np.repeat(label[front], n)
        # Of all ways to a row the shortest counts, then the smaller label.
        order = np.lexsort((name, way, to))
        to, way, name = to[order], way[order], name[order]
        one = np.flatnonzero(np.diff(to, prepend=-1))
        to, way, name = to[one], way[one], name[one]
        nearer = (way < best[to] - 1e-9) | ((np.abs(way - best[to]) <= 1e-9) & (name < label[to]))
        front = to[nearer]
        best[front], label[front] = way[nearer], name[nearer]
    return best, label


def geodesic_labels(voxels: DataFrame, seeds: DataFrame, reach: float, cut: float, tile: float) -> DataFrame:
    """``(v, tree_id, distance)``: each voxel's nearest seed along the graph of voxels at most ``reach`` apart, above ``cut``.

    Tiles see a border of one reach only: distances cross it and are passed on, round after round, until none changes, so a tree may be as
    wide as it likes and the tiles do not show.
    """
    kind = "v string, x double, y double, hag double, best double, label long, moved boolean"
    state = voxels.filter(F.col("hag") >= cut).select("v", "x", "y", "hag").join(seeds, "v", "left")
    state = ne.cut_lineage(state.select("v", "x", "y", "hag", F.when(F.col("seed").isNull(), float("inf")).otherwise(0.0).alias("best"), F.coalesce("seed", F.lit(0)).alias("label"), F.col("seed").isNotNull().alias("moved")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v").reset_index(drop=True)
        own, was, name = pdf["core"].to_numpy(bool), pdf["best"].to_numpy(float), pdf["label"].to_numpy(np.int64)
        # What did not move since the round before was passed on then.
        best, label = grown(pdf[["x", "y", "hag"]].to_numpy(float), was, name, np.flatnonzero(pdf["moved"].to_numpy(bool) & np.isfinite(was)), reach)
        out = pdf.loc[own, ["v", "x", "y", "hag"]].copy()
        out["best"], out["label"], out["moved"] = best[own], label[own], ((best != was) | (label != name))[own]
        return out

    while True:
        state = ne.cut_lineage(tiled(state, tile, reach, work, kind))
        if state.filter("moved").isEmpty():
            return state.select("v", F.col("label").alias("tree_id"), F.col("best").alias("distance"))


def segment_graph(points: DataFrame, voxel: float = 0.1, reach: float = 0.5, cut: float = 0.25, stem_high: float = 1.5, least: int = 8, tile: float = 50.0, key: str = "point_id") -> DataFrame:
    """Voxel graph segmentation: stems are clusters of the low band, and every voxel goes to the stem nearest along the graph, however far.

    A simpler relative of the published forest pipelines (voxels, neighbour graph, stem seeds, geodesic growth); it makes no
    claim of parity with any of them. A tree is named by the lowest voxel of its stem. ``(point_id, tree_id)``.
    """

    def segment(v: DataFrame) -> DataFrame:
        v = ne.cut_lineage(v)
        near = geodesic_labels(v, ne.cut_lineage(stem_seeds(v, reach, cut, stem_high, least, voxel)), reach, cut, tile)
        return v.select("v").join(near, "v", "left").select("v", F.coalesce("tree_id", F.lit(0)).cast("long").alias("tree_id"))

    return by_voxel(points, voxel, segment, key)


def segment_deadwood(points: DataFrame, low: float = 0.05, high: float = 1.5, radius: float = 0.4, linear: float = 0.6, eps: float = 0.3, least: int = 20, length: float = 0.6, key: str = "point_id") -> DataFrame:
    """Lying logs: low points of linear neighbourhoods, clustered, long enough: ``(point_id, log_id)``."""
    p = points.filter(F.col("hag").between(low, high))
    f = ne.shape_features(p, radius, 4, key).filter(F.col("linearity") >= linear).select(key)
    c = ne.dbscan(p.join(f, key, "left_semi"), eps, least, key).join(p.select(key, "x", "y"), key)
    big = c.groupBy("cluster").agg(F.count("*").alias("n"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("len")).filter((F.col("n") >= least) & (F.col("len") >= length))
    return c.join(big.select("cluster"), "cluster", "left_semi").select(key, F.col("cluster").alias("log_id"))


# ---------------------------------------------------------------- skeletons


def sample_skeletons(cylinders: DataFrame, spacing: float = 0.02) -> DataFrame:
    """``cylinders(tree_id, branch_order, start, end)`` -> points along them: floor(length / spacing), ends included; a single one at the far end."""
    s, e = F.col("start"), F.col("end")
    length = F.sqrt(sum((F.pow(e[k] - s[k], F.lit(2)) for k in range(3)), F.lit(0.0)))
    n = F.least(F.floor(length / spacing), F.lit(1_000_000)).cast("int")
    p = cylinders.withColumn("n", n).filter("n >= 1").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    t = F.when(F.col("n") == 1, 1.0).otherwise(F.try_divide(F.col("i"), F.col("n") - 1))
    return p.select("tree_id", "branch_order", *((s[k] + t * (e[k] - s[k])).alias(c) for k, c in enumerate("xyz")))


def hull_of(points: DataFrame) -> list[tuple[float, float]]:
    """Convex hull in plan: of each partition first, whose corners are few, then of those."""

    def some(parts):
        for p in parts:
            yield pd.DataFrame(convex_hull(p[["x", "y"]].to_numpy(float)), columns=["x", "y"])

    corners = points.select("x", "y").mapInPandas(some, "x double, y double").toPandas().to_numpy()
    return [tuple(p) for p in convex_hull(corners)]


def drawn_triangles(v: np.ndarray, tri: np.ndarray, size: float, low: tuple[int, int], shape: tuple[int, int]) -> np.ndarray:
    """Heights at cell centres inside the triangles of ``v`` (x, y, height), the highest where several meet; NaN elsewhere."""
    out = np.full(shape, -np.inf)
    for t in v[tri]:
        (c0, r0), (c1, r1) = np.floor(t[:, :2].min(0) / size).astype(int) - low, np.floor(t[:, :2].max(0) / size).astype(int) - low + 1
        c0, r0, c1, r1 = max(c0, 0), max(r0, 0), min(c1, shape[0]), min(r1, shape[1])
        if c0 >= c1 or r0 >= r1:
            continue
        x, y = np.meshgrid((np.arange(c0, c1) + low[0] + 0.5) * size, (np.arange(r0, r1) + low[1] + 0.5) * size, indexing="ij")
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = t
        whole = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
        if abs(whole) < 1e-12:
            continue
        p = ((bx - x) * (cy - y) - (cx - x) * (by - y)) / whole
        q = ((cx - x) * (ay - y) - (ax - x) * (cy - y)) / whole
        inside = (p >= -1e-9) & (q >= -1e-9) & (p + q <= 1 + 1e-9)
        h = p * az + q * bz + (1 - p - q) * cz
        part = out[c0:c1, r0:r1]
        part[inside] = np.maximum(part[inside], h[inside])
    return np.where(np.isfinite(out), out, np.nan)


def pit_free(points: DataFrame, size: float = 0.5, layers: tuple[float, ...] = (2.0, 5.0, 10.0, 15.0, 20.0), longest: float | None = None, tile: float = 20.0, halo: float = 5.0) -> DataFrame:
    """Canopy heights without pits ``(col, row, chm)`` (after Khosravipour et al. 2014): triangulated surfaces of all points and of those above each
    height, whose triangles have sides of at most ``longest`` (three cells, 1.5 m at least), and their maximum.

    Points ``(x, y, hag)``; the highest of each cell stands for it. Gaps in all points that are wider than the halo are bridged tile by tile.
    """
    longest, high = max(1.5, 3 * size) if longest is None else longest, sorted(layers)
    top = points.filter("hag IS NOT NULL").groupBy(S.cell(F.col("x"), size).alias("col"), S.cell(F.col("y"), size).alias("row")).agg(F.max(F.struct("hag", "x", "y")).alias("p")).select("p.x", "p.y", "p.hag")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["x", "y"])[["x", "y", "hag"]].to_numpy(float)
        low = tuple(round(int(pdf[f"tile_{c}"].iloc[0]) * tile / size) for c in "xy")
        n = round(tile / size)
        best = np.full((n, n), np.nan)
        for at in (-np.inf, *high):
            own = v[v[:, 2] >= at]
            tri = delaunay(own[:, :2])
            if np.isfinite(at) and len(tri):
                a, b, c = (own[tri[:, k], :2] for k in range(3))
                tri = tri[np.max([np.linalg.norm(p - q, axis=1) for p, q in ((a, b), (b, c), (c, a))], axis=0) <= longest]
            best = np.fmax(best, drawn_triangles(own, tri, size, low, (n, n)))
        c, r = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"col": c + low[0], "row": r + low[1], "chm": best[c, r]})

    if abs(tile / size - round(tile / size)) > 1e-9:
        tile = size * round(tile / size)
    return tiled(top, tile, halo, work, "col long, row long, chm double")


def transfer_labels(points: DataFrame, skeleton: DataFrame, threshold: float = 0.3, beyond: bool = True, hull: list | None = None, key: str = "point_id") -> DataFrame:
    """Labels of the nearest skeleton point, however far: outside the skeleton's hull none; near, tree and stem (1) or branch (2); farther, the tree alone if ``beyond``.

    A hull of fewer than three corners gates nothing.
    """
    hull = hull_of(skeleton) if hull is None else hull
    at = ["x", "y", "z"]
    # Points in one place have one label.
    a = bl.spots(points, *at).filter(S.in_polygon(F.col("x"), F.col("y"), hull)).select(F.struct(*at).alias("a"), *at)
    b = skeleton.select(F.struct("tree_id", "branch_order").alias("b"), *at)
    near = ne.k_nearest(a, b, 1)
    close = F.col("distance") <= threshold
    t = near.select("a.*", F.when(close | F.lit(beyond), F.col("b.tree_id")).otherwise(0).alias("new_tree"), F.when(close, F.when(F.col("b.branch_order") == 0, 1).otherwise(2)).otherwise(0).alias("semantic"))
    return points.select(key, *at).join(t, at, "left").select(key, F.coalesce("new_tree", F.lit(0)).alias("tree_id"), F.coalesce("semantic", F.lit(0)).alias("semantic"))


# ---------------------------------------------------------------- isolation by cut pursuit


def neighbour_graph(x: np.ndarray, k: int, reach: float) -> np.ndarray:
    """Edges to the k nearest rows within reach, found by cells as wide as it."""
    cells = np.floor(x / reach).astype(int)
    where: dict[tuple, list[int]] = {}
    for i, c in enumerate(map(tuple, cells.tolist())):
        where.setdefault(c, []).append(i)
    shifts = np.stack(np.meshgrid(*[(-1, 0, 1)] * x.shape[1], indexing="ij"), -1).reshape(-1, x.shape[1]).tolist()
    out = []
    for c, own in where.items():
        other = np.array([j for s in shifts for j in where.get(tuple(a + b for a, b in zip(c, s)), ())])
        for at in range(0, len(own), 256):
            part = own[at:at + 256]
            d = ((x[part][:, None] - x[other][None]) ** 2).sum(2)
            d[np.array(part)[:, None] == other[None]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            ok = np.take_along_axis(d, order, 1) <= reach * reach
            out += [(i, int(other[j])) for i, row, good in zip(part, order, ok) for j, g in zip(row, good) if g]
    return np.array(out, int).reshape(-1, 2)


def joined_pieces(v: np.ndarray, label: np.ndarray, k3: int, gap: float, rho: float, weight: float, least: int, voxel: float) -> np.ndarray:
    """Pieces without a foot go to the one of their k3 nearest pieces, in plan, that overlaps them most in height and lies nearest."""
    label = np.unique(label, return_inverse=True)[1]
    while True:
        n = int(label.max()) + 1
        many = np.bincount(label, minlength=n)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, label, v[:, 2])
        np.maximum.at(high, label, v[:, 2])
        mid = np.stack([np.bincount(label, v[:, i], n) / many for i in (0, 1)], axis=1)
        loose = np.flatnonzero((low > np.maximum(1.0, rho * high * 0.2)) | (many < least))
        target = np.arange(n)
        for s in loose[np.argsort(-low[loose], kind="stable")].tolist():
            d = np.hypot(*(mid - mid[s]).T)
            d[s] = np.inf
            near = np.argpartition(d, min(k3, n - 1) - 1)[:k3] if n > 1 else np.zeros(0, int)
            near = near[(d[near] <= 2 * gap) & ((low[near] < low[s]) | (many[s] < least))]
            if len(near):
                lap = np.clip(np.minimum(high[s], high[near]) - np.maximum(low[s], low[near]), 0.0, None) / max(high[s] - low[s], voxel)
                score = weight * lap - (1 - weight) * d[near] / gap
                target[s] = near[np.lexsort((near, -score))[0]]
                break
        if (target == np.arange(n)).all():
            return label
        label = np.unique(target[label], return_inverse=True)[1]


def segment_treeiso(points: DataFrame, k1: int = 5, lambda1: float = 1.0, k2: int = 20, lambda2: float = 20.0, decimate2: float = 0.1, gap: float = 2.0, k3: int = 20, rho: float = 0.5, weight: float = 0.5, voxel: float = 0.1, least: int = 20, tile: float = 50.0, halo: float = 15.0, key: str = "point_id") -> DataFrame:
    """Three-stage tree isolation (after Xi and Hopkinson 2022) by cut pursuit: small regions in 3D, regions of those in plan, then
    pieces without a foot joined to one of their ``k3`` nearest pieces, which overlaps them most in height and lies nearest. ``(point_id, tree_id)``."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "hag"]).reset_index(drop=True)
        v = pdf[["x", "y", "hag"]].to_numpy(float)
        e = neighbour_graph(v, k1, max(gap / 4, 3 * voxel))
        small = cut_pursuit(v, e, np.ones(len(e)), lambda1)
        # Second stage: thinned in plan, links between pieces that stand close.
        flat, flat_of = np.unique(np.column_stack([np.floor(v[:, :2] / max(decimate2, voxel)).astype(np.int64), small]), axis=0, return_inverse=True)
        flat_of, spots = flat_of.ravel(), (flat[:, :2] + 0.5) * max(decimate2, voxel)
        e = neighbour_graph(spots, k2, gap)
        big = cut_pursuit(spots, e, np.full(len(e), 1 / k2), lambda2)
        label = joined_pieces(v, big[flat_of], k3, gap, rho, weight, least, voxel)
        out = np.zeros(len(v), np.int64)
        for s in np.unique(label):
            own = label == s
            if own.sum() >= least:
                foot = v[own][np.argmin(v[own, 2]), :2]
                out[own] = place_name(foot[0], foot[1], voxel)
        own = pdf["core"].to_numpy()
        return pd.DataFrame({"v": pdf["v"][own], "tree_id": out[own]})

    return by_voxel(points, voxel, lambda v: tiled(v, tile, halo, work, "v string, tree_id long"), key)
