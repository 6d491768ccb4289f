"""Per-tree measurement from points: heights, crowns, diameters, stems, stem models, tapers, centre lines, rescan advice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import circle
from ..functions import scalar as S
from ..functions.geometry import alpha_volume
from .forestry import whole_groups
from .neighbours import cut_lineage


def circles(points: DataFrame, *keys: str) -> DataFrame:
    """Taubin circle of each group: ``(keys, n, cx, cy, r, rmse, sectors)``; moments are partial aggregates about the group's mean."""
    mean = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(mean, list(keys)).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")}).withColumn("q", F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    cov = lambda a, b: F.covar_pop(a, b)
    m = p.groupBy(*keys).agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), cov("u", "u").alias("uu"), cov("v", "v").alias("vv"), cov("u", "v").alias("uv"), cov("q", "u").alias("zu"), cov("q", "v").alias("zv"), cov("q", "q").alias("zz"), F.avg("q").alias("mz"))

    def solve(batches):
        for b in batches:
            cx, cy, r = circle.taubin_from_moments(*(b[c].to_numpy(float) for c in ("uu", "vv", "uv", "zu", "zv", "zz", "mz")))
            uu, vv, uv = (b[c].to_numpy(float) for c in ("uu", "vv", "uv"))
            # Points in fewer than three places, or on a line, have no circle.
            ok = np.isfinite(r) & (b["n"].to_numpy() >= 3) & (uu * vv - uv * uv > 1e-10 * (uu + vv) ** 2)
            b = b[[*keys, "n", "mx", "my"]].copy()
            b["cx"], b["cy"], b["r"] = (pd.Series(np.where(ok, v, np.nan), index=b.index) for v in (cx + b["mx"], cy + b["my"], r))
            yield b.drop(columns=["mx", "my"])

    kinds = dict(m.dtypes)
    fit = m.mapInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, cx double, cy double, r double")
    fit = fit.select(*keys, "n", *(S.measured(F.col(c)).alias(c) for c in ("cx", "cy", "r")))
    back = points.join(fit.drop("n"), list(keys)).withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r"))
    sector = F.pmod(F.floor(F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))) / 30).cast("int"), F.lit(12))
    extra = back.withColumn("s", F.pow(F.lit(2), sector).cast("int")).groupBy(*keys).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.bit_or("s").alias("sectors"))
    return fit.join(extra, list(keys), "left")


def tree_metrics(points: DataFrame, low: float = 1.2, high: float = 1.4, crown_cell: float = 0.25) -> DataFrame:
    """``points`` with hag -> one row per tree: count, height, dbh, basal area, crown area and diameter, base, lean."""
    p = points.filter("tree_id > 0")
    t = p.groupBy("tree_id").agg(F.count("*").alias("count"), F.max("hag").alias("height"), F.min("z").alias("base_z"), F.max_by(F.struct("x", "y"), "hag").alias("top"))
    cells = p.select("tree_id", S.cell(F.col("x"), crown_cell).alias("c"), S.cell(F.col("y"), crown_cell).alias("r")).distinct().groupBy("tree_id").agg((F.count("*") * crown_cell**2).alias("crown_area"))
    band = circles(p.filter(F.col("hag").between(low, high)), "tree_id").select("tree_id", (2 * F.col("r")).alias("dbh"), "cx", "cy")
    foot = p.filter("hag < 1").groupBy("tree_id").agg(F.avg("x").alias("fx"), F.avg("y").alias("fy"))
    t = t.join(cells, "tree_id", "left").join(band, "tree_id", "left").join(foot, "tree_id", "left")
    x, y = F.coalesce("cx", "fx"), F.coalesce("cy", "fy")
    lean = F.degrees(F.atan2(F.hypot(F.col("top.x") - x, F.col("top.y") - y), F.col("height")))
    return t.select("tree_id", "count", "height", "dbh", S.basal_area(F.col("dbh")).alias("basal_area"), "crown_area", (2 * F.sqrt(F.col("crown_area") / math.pi)).alias("crown_diameter"), x.alias("x"), y.alias("y"), "base_z", lean.alias("lean_deg"))


def fit_stems(points: DataFrame, low: float = 1.0, high: float = 3.0, tol: float = 0.03, rounds: int = 600, least: int = 12) -> DataFrame:
    """RANSAC circle per tree in a band, seeded by the tree's id."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n = int(pdf["tree_id"].iloc[0]), int(pdf["m"].sum())
        got = circle.ransac(pdf["x"].to_numpy(), pdf["y"].to_numpy(), tol, rounds, least, k & 0xFFFFFFFF, pdf["m"].to_numpy())
        row = (k, None, None, None, 0, n, None) if got is None else (k, 2 * got[2], got[0], got[1], got[3], n, got[4])
        return pd.DataFrame([row], columns=["tree_id", "dbh", "center_x", "center_y", "inlier_count", "band_count", "rmse"])

    band = points.filter((F.col("tree_id") > 0) & F.col("hag").between(low, high))
    # Points in one place are one row, so a task holds a tree's places.
    band = band.groupBy("tree_id", "x", "y", "z").agg(F.count(F.lit(1)).alias("m"))
    return band.groupBy("tree_id").applyInPandas(lambda pdf: fit(pdf.sort_values(["x", "y", "z"])), "tree_id int, dbh double, center_x double, center_y double, inlier_count int, band_count int, rmse double")


def slices(points: DataFrame, step: float = 0.25, least: int = 15) -> DataFrame:
    """Circles per tree and height slice; ``accepted`` where there are points enough and the fit is a stem's."""
    p = points.filter((F.col("tree_id") > 0) & (F.col("hag") >= 0)).withColumn("slice", F.floor(F.col("hag") / step).cast("int"))
    c = circles(p, "tree_id", "slice")
    ok = (F.col("n") >= least) & F.col("r").between(0.02, 1.2) & (F.col("rmse") <= F.greatest(F.lit(0.02), 0.25 * F.col("r")))
    return c.select("tree_id", "slice", (F.col("slice") * step).alias("hag"), "n", "cx", "cy", "r", "rmse", "sectors", (F.bit_count("sectors") / 12).alias("coverage"), F.coalesce(ok, F.lit(False)).alias("accepted"))


def stem_model(sliced: DataFrame, step: float = 0.25) -> DataFrame:
    """Per tree: stem volume as frustums between accepted slices (a cylinder below the first), its deviation, confidence, completeness."""
    w = Window.partitionBy("tree_id").orderBy("slice")
    a = sliced.filter("accepted").withColumns({"h": F.col("hag") + step / 2, "d": 2 * F.col("r")}).withColumns({"nh": F.lead("hag").over(w) + step / 2, "nd": 2 * F.lead("r").over(w), "first": F.lag("hag").over(w).isNull()})
    v = F.coalesce(S.frustum(F.col("nh") - F.col("h"), F.col("d"), F.col("nd")), F.lit(0.0)) + F.when(F.col("first"), S.basal_area(F.col("d")) * F.col("h")).otherwise(0.0)
    error = 2 * F.col("rmse") / F.sqrt("n") / F.col("r") * v
    t = a.groupBy("tree_id").agg(F.sum(v).alias("stem_volume"), F.sqrt(F.sum(error * error)).alias("stem_volume_std"), F.avg("coverage").alias("confidence"), F.count("*").alias("accepted_slices"), F.max("hag").alias("top"))
    n = sliced.groupBy("tree_id").agg(F.count("*").alias("slices"))
    return t.join(n, "tree_id").select("tree_id", "stem_volume", "stem_volume_std", (1.96 * F.col("stem_volume_std")).alias("stem_volume_ci95"), "confidence", (F.col("accepted_slices") / (F.floor(F.col("top") / step) + 1)).alias("completeness"), "accepted_slices", (F.col("slices") - F.col("accepted_slices")).alias("rejected_slices"))


def center_lines(sliced: DataFrame) -> DataFrame:
    """Trunk polylines: a tree's accepted slice centres upward."""
    return sliced.filter("accepted").groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("hag", "cx", "cy", "r"))).alias("line"))


def caliper(points: DataFrame, x: float, y: float, z: float, reach: float = 1.0, thickness: float = 0.1) -> DataFrame:
    """Circle of the points in a slab about a click."""
    near = points.filter(F.col("z").between(z - thickness / 2, z + thickness / 2) & (F.hypot(F.col("x") - x, F.col("y") - y) <= reach)).withColumn("k", F.lit(0))
    return circles(near, "k").select("n", (2 * F.col("r")).alias("diameter"), "cx", "cy", "rmse", (F.bit_count("sectors") / 12).alias("coverage"))


def shadows(sliced: DataFrame) -> DataFrame:
    """Rescan advice per tree: unseen sectors over all its slices, where the widest gap begins, and how wide it is, in degrees."""
    seen = sliced.filter("n > 0").groupBy("tree_id").agg(F.bit_or("sectors").alias("mask"))
    # The circle twice over, so a gap across sector 0 is one run.
    run = F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("at")), lambda a, i: F.struct(
        F.when(F.getbit(F.col("mask").cast("int"), F.pmod(i, F.lit(12))) == 0, F.least(F.lit(12), a["now"] + 1)).otherwise(0).alias("now"),
        F.when((F.getbit(F.col("mask").cast("int"), F.pmod(i, F.lit(12))) == 0) & (a["now"] + 1 > a["best"]), F.least(F.lit(12), a["now"] + 1)).otherwise(a["best"]).alias("best"),
        F.when((F.getbit(F.col("mask").cast("int"), F.pmod(i, F.lit(12))) == 0) & (a["now"] + 1 > a["best"]), F.pmod(i - a["now"], F.lit(12))).otherwise(a["at"]).alias("at")))
    return seen.withColumn("g", run).select("tree_id", (12 - F.bit_count("mask")).alias("unseen"), (F.col("g.at") * 30).alias("gap_from_deg"), (F.col("g.best") * 30).alias("gap_deg"))


def volume_model(pairs: DataFrame, predictors: list[str], form: str = "loglog", folds: int = 5) -> dict | None:
    """OLS of volume on predictors: coefficients, R2, Duan's smearing, striped cross-validation by ``seq``, ranges.

    ``pairs(seq, volume, predictors)``. Normal equations of each fold are summed in the cluster (numbers, however many pairs);
    the solve is on the driver. None below 8 pairs per predictor.
    """
    good = F.col("volume") > 0
    for p in predictors:
        good = good & (F.col(p) > 0)
    t = pairs.filter(F.coalesce(good, F.lit(False)))
    log = form == "loglog"
    cols = [F.lit(1.0), *(F.log(p) if log else F.col(p).cast("double") for p in predictors), F.log("volume") if log else F.col("volume").cast("double")]
    k = len(cols) - 1
    # Rows are numbered by counts below them, so the stripes need no single task: seq is dense already or made so by rank.
    t = t.withColumn("fold", F.pmod(F.col("seq"), F.lit(folds)))
    sums = t.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1))).collect()
    n = sum(r["n"] for r in sums)
    if not predictors or n < 8 * len(predictors):
        return None

    def solve(rows):
        m = np.zeros((k + 1, k + 1))
        for r in rows:
            for i in range(k + 1):
                for j in range(i, k + 1):
                    m[i, j] += r[f"s{i}_{j}"]
        m = np.triu(m) + np.triu(m, 1).T
        return np.linalg.solve(m[:k, :k], m[:k, k]), m

    full, m = solve(sums)
    rss = m[k, k] - 2 * full @ m[:k, k] + full @ m[:k, :k] @ full
    tss = m[k, k] - m[0, k] ** 2 / n
    by_fold = {r["fold"]: solve([q for q in sums if q["fold"] != r["fold"]])[0] for r in sums}
    guess = lambda c: sum((F.lit(float(v)) * x for v, x in zip(c, cols[:k])), F.lit(0.0))
    res = [F.avg(F.exp(cols[k] - guess(full))).alias("all")] + [F.avg(F.when(F.col("fold") != f, F.exp(cols[k] - guess(c)))).alias(f"f{f}") for f, c in by_fold.items()]
    smear = t.agg(*res).first() if log else None
    err = F.lit(None).cast("double")
    for f, c in by_fold.items():
        v = F.exp(guess(c)) * F.lit(float(smear[f"f{f}"])) if log else guess(c)
        err = F.when(F.col("fold") == f, v - F.col("volume")).otherwise(err)
    cv = t.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"), *(x for p in predictors for x in (F.min(p).alias(f"lo_{p}"), F.max(p).alias(f"hi_{p}")))).first()
    return {"coefficients": full.tolist(), "n": n, "r2": float(1 - rss / tss) if tss > 0 else None, "smearing": float(smear["all"]) if log else 1.0, "cv_rmse": cv["rmse"], "cv_bias": cv["bias"], "ranges": {p: (cv[f"lo_{p}"], cv[f"hi_{p}"]) for p in predictors}, "form": form, "predictors": predictors}


def predict_volume(trees: DataFrame, model: dict) -> DataFrame:
    """``predicted`` (null where a predictor is missing) and ``extrapolated``."""
    log, out, beyond = model["form"] == "loglog", F.lit(float(model["coefficients"][0])), F.lit(False)
    for p, c in zip(model["predictors"], model["coefficients"][1:]):
        out = out + F.lit(float(c)) * (F.log(F.when(F.col(p) > 0, F.col(p))) if log else F.when(F.col(p) > 0, F.col(p)))
        lo, hi = model["ranges"][p]
        beyond = beyond | F.coalesce(~F.col(p).between(lo, hi), F.lit(False))
    v = F.exp(out) * model["smearing"] if log else out
    return trees.withColumn("predicted", F.when(v > 0, v)).withColumn("extrapolated", F.col("predicted").isNotNull() & beyond)


def crown_volumes(points: DataFrame, alpha: float = 1.0, base: float = 0.4, voxel: float = 0.25) -> DataFrame:
    """``(tree_id, n, hull_volume, alpha_volume)`` of each crown: the points above ``base`` of the tree's height, one a voxel.

    The alpha volume is that of the Delaunay tetrahedra that fit a sphere of radius ``alpha``: gaps between branches wider than it are air. A
    crown's voxels are one group, bounded by its size; its points are not.
    """
    top = points.filter("tree_id > 0 AND hag IS NOT NULL").groupBy("tree_id").agg(F.max("hag").alias("top"))
    crown = points.join(top, "tree_id").filter(F.col("hag") >= base * F.col("top"))
    thin = cut_lineage(crown.groupBy("tree_id", *(F.floor(F.col(c) / voxel).alias(f"v{c}") for c in ("x", "y", "hag"))).agg(*(F.avg(c).alias(c) for c in ("x", "y", "hag"))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in whole_groups(parts, "tree_id"):
            rows = [(int(k), len(g), alpha_volume(v, np.inf), alpha_volume(v, alpha)) for k, g in t.groupby("tree_id") for v in [g[["x", "y", "hag"]].to_numpy(float)]]
            yield pd.DataFrame(rows, columns=["tree_id", "n", "hull_volume", "alpha_volume"])

    rows = thin.select("tree_id", "x", "y", "hag").repartition("tree_id").sortWithinPartitions("tree_id", "x", "y", "hag")
    return rows.mapInPandas(run, "tree_id int, n long, hull_volume double, alpha_volume double")
