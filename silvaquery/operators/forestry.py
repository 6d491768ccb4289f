"""Tree-level forestry: volumes, biomass, plot statistics, flags, thinning, bucking, growth. All but bucking in DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import stats

# ---------------------------------------------------------------- joins onto trees


def merge_stem_fits(trees: DataFrame, fits: DataFrame) -> DataFrame:
    """A finite positive fitted dbh replaces the measured one, with its basal area; the source is recorded."""
    f = fits.select(F.col("tree_id"), S.measured(F.col("dbh")).alias("fit_dbh"))
    t = trees.join(f, "tree_id", "left")
    fitted = F.coalesce(F.col("fit_dbh") > 0, F.lit(False))
    dbh = F.when(fitted, F.col("fit_dbh")).otherwise(F.col("dbh"))
    source = F.when(fitted, "ransac").when(F.col("dbh").isNotNull(), "band").otherwise("none")
    return t.withColumn("dbh_source", source).withColumn("dbh", dbh).withColumn("basal_area", S.basal_area(F.col("dbh"))).drop("fit_dbh")


def volumes(trees: DataFrame, qsm: DataFrame | None = None, default_species: str | None = "pine", form_factor: float = 0.5) -> DataFrame:
    """``(tree_id, volume, volume_source)``: QSM stem volume, else Laasasenaho by species, else form factor, else none."""
    t = trees.join(qsm.select("tree_id", F.col("stem_volume").alias("qsm_volume")), "tree_id", "left") if qsm is not None else trees.withColumn("qsm_volume", F.lit(None).cast("double"))
    named = S.species_key(F.col("species"))
    kind = F.when(F.col("species").isNull(), F.lit(default_species)).otherwise(named)
    model = S.laasasenaho(kind, F.col("dbh"), F.col("height"))
    form = F.when((F.col("dbh") > 0) & (F.col("height") > 0), S.basal_area(F.col("dbh")) * F.col("height") * form_factor)
    scanned = F.when(F.col("qsm_volume") > 0, F.col("qsm_volume"))
    source = F.when(scanned.isNotNull(), "qsm").when(model.isNotNull(), "laasasenaho").when(form.isNotNull(), "formFactor").otherwise("none")
    return t.select("tree_id", F.coalesce(scanned, model, form).alias("volume"), source.alias("volume_source"))


def biomass(qsm: DataFrame, species: DataFrame, density: float = 400.0, density_std: float = 25.0, carbon: float = 0.5, carbon_std: float = 0.02, branch_unc: float = 0.25, fallback: str = "pine") -> DataFrame:
    """Per tree: volume, biomass, carbon and CO2 with deviations; relative errors add in quadrature."""
    known = species.select("tree_id", F.lower(F.trim("species")).alias("sp"))
    t = qsm.join(known, "tree_id", "left").withColumn("sp", F.coalesce(S.species_key(F.col("sp")), F.col("sp"), F.lit(fallback)))
    rho, rho_std, cf = F.lit(density), F.lit(density_std), F.lit(carbon)
    for name, (r, s, c) in S.WOOD.items():
        rho, rho_std, cf = (F.when(F.col("sp") == name, v).otherwise(e) for v, e in ((r, rho), (s, rho_std), (c, cf)))
    t = t.select("tree_id", "stem_volume", "stem_volume_std", "branch_volume", rho.alias("rho"), rho_std.alias("rho_std"), cf.alias("cf"), F.lit(carbon_std).alias("cf_std"))
    t = t.withColumn("volume", F.col("stem_volume") + F.coalesce("branch_volume", F.lit(0.0)))
    t = t.withColumn("volume_std", F.sqrt(F.pow(F.coalesce("stem_volume_std", F.lit(0.0)), F.lit(2)) + F.pow(F.coalesce("branch_volume", F.lit(0.0)) * branch_unc, F.lit(2))))
    t = t.withColumn("biomass", F.col("rho") * F.col("volume")).withColumn("carbon", F.col("cf") * F.col("rho") * F.col("volume"))
    rel_v, rel_r, rel_c = F.try_divide(F.col("volume_std"), F.col("volume")), F.col("rho_std") / F.col("rho"), F.col("cf_std") / F.col("cf")
    t = t.withColumn("biomass_std", F.col("biomass") * F.sqrt(rel_v * rel_v + rel_r * rel_r)).withColumn("carbon_std", F.col("carbon") * F.sqrt(rel_v * rel_v + rel_r * rel_r + rel_c * rel_c))
    return t.withColumn("co2e", F.col("carbon") * F.lit(44 / 12)).withColumn("co2e_std", F.col("carbon_std") * F.lit(44 / 12))


def biomass_totals(trees: DataFrame) -> DataFrame:
    """Plot totals of ``biomass``: volume errors are independent, those of density and carbon fraction fully correlated within a species."""
    by = trees.groupBy("rho", "rho_std", "cf", "cf_std").agg(F.count("*").alias("n"), F.sum("volume").alias("v"), F.sum("biomass").alias("b"), F.sum("carbon").alias("c"), F.sum(F.pow("volume_std", F.lit(2))).alias("vv"), F.sum(F.pow(F.col("rho") * F.col("volume_std"), F.lit(2))).alias("bv"))
    rho = by.groupBy("rho", "rho_std").agg(F.pow(F.first("rho_std") / F.first("rho") * F.sum("b"), F.lit(2)).alias("e")).agg(F.sum("e").alias("rho_var"))
    cf = by.groupBy("cf", "cf_std").agg(F.pow(F.first("cf_std") / F.first("cf") * F.sum("c"), F.lit(2)).alias("e")).agg(F.sum("e").alias("cf_var"))
    one = by.agg(F.sum("n").alias("n_trees"), F.sum("v").alias("volume"), F.sqrt(F.sum("vv")).alias("volume_std"), F.sum("b").alias("biomass"), F.sum("c").alias("carbon"), F.sum("bv").alias("bv"))
    one = one.crossJoin(rho).crossJoin(cf)  # three single rows
    b_std = F.sqrt(F.col("bv") + F.col("rho_var"))
    c_std = F.sqrt(F.pow(F.try_divide(b_std, F.col("biomass")) * F.col("carbon"), F.lit(2)) + F.col("cf_var"))
    return one.select("n_trees", "volume", "volume_std", "biomass", b_std.alias("biomass_std"), "carbon", c_std.alias("carbon_std"), (F.col("carbon") * F.lit(44 / 12)).alias("co2e"), (c_std * F.lit(44 / 12)).alias("co2e_std"))


# ---------------------------------------------------------------- plots


def plot_stats(trees: DataFrame, boundary: dict, edge: str = "crownArea", halfcount_buffer: float = 1.0, qsm: DataFrame | None = None) -> DataFrame:
    """One row of per-hectare figures; trees without a position are out."""
    t = trees.join(qsm.select("tree_id", "stem_volume", "stem_volume_ci95"), "tree_id", "left") if qsm is not None else trees.withColumns({"stem_volume": F.lit(None).cast("double"), "stem_volume_ci95": F.lit(None).cast("double")})
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    t = t.withColumn("w", F.when(placed, S.edge_weight(F.col("x"), F.col("y"), F.col("crown_area"), boundary, edge, halfcount_buffer)).otherwise(0.0))
    w, g = F.col("w"), F.when(F.col("dbh") > 0, S.basal_area(F.col("dbh")))
    tall = F.when(F.col("height") > 0, g)
    area = F.lit(max(S.boundary_area_ha(boundary), 1e-6))
    return t.agg(
        F.lit(S.boundary_area_ha(boundary)).alias("area_ha"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("n_weighted"), F.count_if(w == 1).alias("n_fully_in"), F.count_if((w > 0) & (w < 1)).alias("n_partial"), F.count_if(w == 0).alias("n_out"),
        (F.coalesce(F.sum("w"), F.lit(0.0)) / area).alias("stems_per_ha"), (F.coalesce(F.sum(w * g), F.lit(0.0)) / area).alias("basal_area_per_ha"),
        F.try_divide(F.sum(w * tall * F.col("height")), F.sum(w * tall)).alias("lorey_mean_height"), F.count_if((w > 0) & g.isNotNull() & tall.isNull()).alias("n_no_height"),
        (F.coalesce(F.sum(w * F.col("stem_volume")), F.lit(0.0)) / area).alias("stem_volume_per_ha"), (F.sqrt(F.coalesce(F.sum(F.pow(w * F.col("stem_volume_ci95"), F.lit(2))), F.lit(0.0))) / area).alias("stem_volume_ci95_per_ha"))


def fit_boundary(trees: DataFrame, kind: str, margin: float = 0.0) -> dict | None:
    """Boundary fitted to the stems: their box less the margin, or the circle about its centre, at least 1 m."""
    t = trees.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    x0, y0, x1, y1 = t.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if x0 is None:
        return None
    cx, cy, m = (x0 + x1) / 2, (y0 + y1) / 2, max(margin, 0.0)
    if kind == "rectangular":
        return {"kind": kind, "min": [min(x0 + m, cx), min(y0 + m, cy)], "max": [max(x1 - m, cx), max(y1 - m, cy)]}
    far = t.agg(F.max(F.hypot(F.col("x") - cx, F.col("y") - cy))).first()[0]
    return {"kind": "circular", "center": [cx, cy], "radius": max(far - margin, 1.0)}


def estimated_area_ha(trees: DataFrame) -> DataFrame:
    w = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / 10_000
    return trees.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).agg(F.greatest(w, F.lit(0.0025)).alias("area_ha"))


def dominant_height(trees: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Mean of the tallest tenth, at least one tree.

    Heights are counted by centimetre, which is a short table; only the centimetre where the tenth ends is looked into tree by tree.
    """
    h = trees.filter(F.col("height").isNotNull()).select("height", F.floor(F.col("height") * 100).cast("long").alias("bin"))
    bins = h.groupBy("bin").agg(F.count("*").alias("n"), F.sum("height").alias("s"))
    want = F.greatest(F.lit(1), F.ceil(F.sum("n").over(Window.partitionBy()) * F.lit(fraction))).cast("long")
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumns({"want": want, "before": before}).filter("before < want")
    whole = bins.filter("before + n <= want").select(F.col("n").alias("k"), "s")
    cut = h.join(bins.filter("before + n > want").select("bin", (F.col("want") - F.col("before")).alias("rest")), "bin").groupBy("height").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.col("rest") - above))
    part = cut.select(take.alias("k"), (take * F.col("height")).alias("s"))
    return whole.unionByName(part).agg((F.sum("s") / F.sum("k")).alias("dominant_height"), F.sum("k").alias("n_dominant"))


def tree_stats(trees: DataFrame) -> DataFrame:
    t = trees.agg(F.count("*").alias("n"), F.avg("dbh").alias("mean_dbh"), F.avg("height").alias("mean_height"), F.sqrt(F.avg(F.col("dbh") * F.col("dbh"))).alias("quadratic_mean_dbh"), F.sum(S.basal_area(F.col("dbh"))).alias("basal_area"))
    return t.crossJoin(dominant_height(trees))  # two single rows


# ---------------------------------------------------------------- quality


def height_curve(trees: DataFrame) -> DataFrame:
    """One row ``(hd_b0, hd_b1)`` of Näslund's curve: d / sqrt(h - 1.3) on d, refitted within 2.5 robust deviations; null below 15 trees, or 10 at the refit."""
    p = trees.filter((F.col("dbh") > 0) & (F.col("height") > 1.8)).select((F.col("dbh") * 100).alias("d"), (F.col("dbh") * 100 / F.sqrt(F.col("height") - 1.3)).alias("q"))
    res = p.crossJoin(F.broadcast(stats.line(p, "d", "q"))).withColumn("r", F.col("q") - (F.col("b0") + F.col("b1") * F.col("d")))
    kept = res.crossJoin(F.broadcast(stats.robust(res, "r"))).filter((F.col("r_sig") <= 0) | (F.abs(F.col("r") - F.col("r_med")) <= 2.5 * F.col("r_sig"))).filter("n >= 15")
    fit = stats.line(kept.select("d", "q"), "d", "q")
    good = (F.col("n") >= 10) & (F.col("b0") > 0)
    return fit.select(F.when(good, F.col("b0")).alias("hd_b0"), F.when(good, F.col("b1")).alias("hd_b1"))


def flags(trees: DataFrame, qsm: DataFrame | None = None) -> DataFrame:
    """``(tree_id, code, severity)`` of every check that fires; plot-level scalars are one broadcast row."""
    t = trees.withColumn("n", F.col("count").cast("double"))
    plot = stats.robust(t, "height", "crown_area", "n").crossJoin(height_curve(trees))
    if qsm is not None:
        t = t.join(qsm.select("tree_id", "confidence", "completeness", "stem_volume"), "tree_id", "left")
        plot = plot.crossJoin(stats.robust(qsm, "stem_volume"))
    t = t.crossJoin(F.broadcast(plot))
    c = F.col

    def z(name: str) -> Column:
        return (c(name) - c(f"{name}_med")) / F.when(c(f"{name}_sig") > 0, c(f"{name}_sig"))

    crown = F.when(c("crown_area_sig") > 0, z("crown_area") > 3).otherwise((c("crown_area_med") > 0) & (c("crown_area") > 3 * c("crown_area_med")))
    s = F.sqrt(F.when(c("height") > 1.8, c("height") - 1.3))
    den = 1 - c("hd_b1") * s
    ratio = c("dbh") * 100 / (c("hd_b0") * s / F.when(den > 0.05, den))
    slender = c("dbh") * 100 / F.when(c("height") > 0, c("height"))
    # Codes, severities and thresholds of the checks.
    checks = [
        ("no-dbh", "critical", c("dbh").isNull()),
        ("crown-large", "warning", crown),
        ("crown-small", "warning", (c("crown_area") < c("crown_area_med") * 0.15) & (c("n") < c("n_med") * 0.10)),
        ("slenderness", "warning", (c("dbh") > 0) & ((slender < 0.3) | (slender > 4.0))),
        ("height-high", "info", z("height") > 4),
        ("height-low", "info", (z("height") < -3) & (c("height") < 3)),
        ("few-points", "info", (c("n_med") > 0) & (c("n") < c("n_med") * 0.05)),
        ("hd-curve", "warning", (c("dbh") > 0) & ((ratio < 0.6) | (ratio > 1.6))),
    ]
    if qsm is not None:
        checks += [
            ("qsm-coverage", "warning", c("confidence") < 0.5),
            ("qsm-completeness", "warning", c("completeness") < 0.5),
            ("qsm-volume", "warning", z("stem_volume") > 4),
        ]
    fired = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(k).alias("code"), F.lit(v).alias("severity"))) for k, v, test in checks)))
    return t.select("tree_id", F.explode(fired).alias("f")).select("tree_id", "f.code", "f.severity")


def worst_flag(flagged: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return flagged.groupBy("tree_id").agg(F.max_by("severity", rank).alias("severity"), F.count("*").alias("n_flags"))


# ---------------------------------------------------------------- thinning

# Weights of (quality, small, large) by strategy.
STRATEGIES = {"low": (0.3, 0.7, 0.0), "high": (0.3, 0.0, 0.7), "quality": (0.8, 0.2, 0.0), "mixed": (0.5, 0.5, 0.0)}


def thinning(trees: DataFrame, qsm: DataFrame, area_ha: float, target: float = 18.0, heading: float = 0.0, spacing: float = 20.0, width: float = 4.0, reach: float = 10.0, strategy: str = "low", default_species: str | None = "pine") -> DataFrame:
    """Per tree with a diameter: ``(tree_id, ba, volume, road_distance, group, score, removed)``; group is forced, candidate or unreachable.

    A candidate is taken while the basal area taken before it is below what must go: a running sum over the candidates of
    the plot, by descending score and then tree_id, so it is one task for one plot.
    """
    vol = volumes(trees, qsm, default_species)
    t = trees.filter(F.col("dbh") > 0).join(vol, "tree_id").join(qsm.select("tree_id", "confidence"), "tree_id", "left").withColumn("ba", S.basal_area(F.col("dbh")))
    x0, y0, x1, y1, dmax, total, quality = t.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.max("dbh"), F.sum("ba"), F.count("confidence")).first()
    if x0 is None:
        raise ValueError("no tree with a diameter and a position")
    # Roads run along the heading, at whole multiples of the spacing from the centre of the padded box.
    a = math.radians(heading)
    nx, ny, cx, cy = -math.sin(a), math.cos(a), (x0 + x1) / 2, (y0 + y1) / 2
    hx, hy = (x1 - x0) / 2 + width, (y1 - y0) / 2 + width
    half_n, half_d = abs(nx) * hx + abs(ny) * hy, abs(ny) * hx + abs(nx) * hy
    rx, ry = F.col("x") - F.lit(cx), F.col("y") - F.lit(cy)
    n, d = rx * F.lit(nx) + ry * F.lit(ny), rx * F.lit(ny) - ry * F.lit(nx)
    low, high = math.ceil(-half_n / spacing), math.floor(half_n / spacing)
    k = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.round(n / F.lit(spacing))))
    beyond = F.greatest(F.abs(d) - F.lit(half_d), F.lit(0.0))
    t = t.withColumn("road_distance", F.hypot(n - k * F.lit(spacing), beyond) if low <= high else F.lit(float("inf")))
    far = F.coalesce(F.col("road_distance"), F.lit(float("inf")))
    t = t.withColumn("group", F.when(far <= width / 2, "forced").when(far <= reach, "candidate").otherwise("unreachable"))
    wq, ws, wl = STRATEGIES[strategy]
    if not quality:
        wq, ws, wl = (0.0, ws / (ws + wl), wl / (ws + wl))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    share = F.col("dbh") / F.lit(dmax)
    t = t.withColumn("score", F.lit(wq) * (1 - conf) + F.lit(ws) * (1 - share) + F.lit(wl) * share + 0.05 * S.jitter(F.col("tree_id")))
    forced = t.agg(F.sum(F.when(F.col("group") == "forced", F.col("ba")))).first()[0] or 0.0
    must = max(total / area_ha - forced / area_ha - target, 0.0)
    before = F.coalesce(F.sum("ba").over(Window.partitionBy("group").orderBy(F.desc("score"), "tree_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    removed = (F.col("group") == "forced") | ((F.col("group") == "candidate") & (before / F.lit(area_ha) < F.lit(must)))
    return t.select("tree_id", "ba", "volume", "road_distance", "group", "score", removed.alias("removed"))


# ---------------------------------------------------------------- epochs and sensors


def growth_summary(pairs: DataFrame, harvested: DataFrame, ingrowth: DataFrame, form_factor: float = 0.5) -> DataFrame:
    """``pairs`` has dbh, height and basal_area of both epochs (suffixes _ref, _now). Means without usable pairs are 0, unmeasured volumes are counted."""
    v = lambda s: F.col(f"basal_area{s}") * F.col(f"height{s}") * form_factor
    dd, dh, dv = F.col("dbh_now") - F.col("dbh_ref"), F.col("height_now") - F.col("height_ref"), v("_now") - v("_ref")
    zero = F.lit(0.0)
    p = pairs.agg(F.count("*").alias("n"), F.count(dd).alias("n_dbh_pairs"), F.count(dv).alias("n_vol_pairs"), F.coalesce(F.avg(dd), zero).alias("mean_ddbh"), F.coalesce(F.avg(dh), zero).alias("mean_dh"), F.coalesce(F.sum(dv), zero).alias("sum_dv"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{name}_count"), F.coalesce(F.sum(v("")), zero).alias(f"{name}_vol"), (F.count("*") - F.count(v(""))).alias(f"{name}_unmeasured"))

    return p.crossJoin(side(harvested, "harvested")).crossJoin(side(ingrowth, "ingrowth"))  # single rows


def matched_growth(before: DataFrame, after: DataFrame, radius: float = 1.5, form_factor: float = 0.5) -> DataFrame:
    """``growth_summary`` of two inventories ``(tree_id, x, y, dbh, height, basal_area)`` whose trees are paired by place; trees without a place pair with none."""
    from . import neighbours as ne

    m = ne.cut_lineage(ne.match_positions(before.select(F.col("tree_id").alias("a"), "x", "y"), after.select(F.col("tree_id").alias("b"), "x", "y"), radius))
    tag = lambda t, key, s: t.select(F.col("tree_id").cast("long").alias(key), *(F.col(c).alias(c + s) for c in ("dbh", "height", "basal_area")))
    # Both inventories are as long as the pairs: they are sorted and merged, so none is collected at the driver.
    pairs = m.join(tag(before, "a", "_ref").hint("merge"), "a").join(tag(after, "b", "_now").hint("merge"), "b")
    gone, new = (t.join(m.select(F.col(k).alias("tree_id")).hint("merge"), "tree_id", "left_anti") for t, k in ((before, "a"), (after, "b")))
    return growth_summary(pairs, gone, new, form_factor)


def found_by_place(reference: DataFrame, detected: DataFrame, radius: float, edges: tuple[float, ...], method: str = "optimal") -> tuple[DataFrame, DataFrame]:
    """(pairs ``(a, b, distance)`` of detected and reference trees, ``(size_class, found)`` of all trees of both by diameter)."""
    from . import neighbours as ne

    m = ne.cut_lineage(ne.match_positions(detected.select(F.col("tree_id").alias("a"), "x", "y"), reference.select(F.col("tree_id").alias("b"), "x", "y"), radius, method))
    # Sorted and merged, so no list of trees is collected at the driver.
    both = m.join(reference.select(F.col("tree_id").cast("long").alias("b"), "dbh").hint("merge"), "b").select(size_class(F.col("dbh"), edges).alias("size_class"), F.lit("both").alias("found"))
    only = lambda t, k, w: t.join(m.select(F.col(k).alias("tree_id")).hint("merge"), "tree_id", "left_anti").select(size_class(F.col("dbh"), edges).alias("size_class"), F.lit(w).alias("found"))
    return m, both.unionByName(only(reference, "b", "onlyReference")).unionByName(only(detected, "a", "onlyDetected"))


def size_class(dbh: Column, edges: tuple[float, ...] = (0.05, 0.15, 0.25, 0.35, 0.45)) -> Column:
    """Number of the class that holds a diameter, the last open; null below the first or unmeasured."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        out = F.when(dbh >= e, i).otherwise(out)
    return out


def detection(matched: DataFrame) -> DataFrame:
    """``matched(class, found)`` with found in both, onlyReference, onlyDetected -> recall, precision and F1 by class, and overall (class null)."""
    by = matched.groupBy("size_class", "found").agg(F.count("*").alias("k"))
    both = by.unionByName(by.groupBy("found").agg(F.sum("k").alias("k")).withColumn("size_class", F.lit(-1)), allowMissingColumns=True)
    s = lambda w: F.coalesce(F.sum(F.when(F.col("found") == w, F.col("k"))), F.lit(0))
    t = both.groupBy("size_class").agg(s("both").alias("tp"), s("onlyReference").alias("fn"), s("onlyDetected").alias("fp"))
    recall, precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return t.withColumn("recall", recall).withColumn("precision", precision).withColumn("f1", F.try_divide(2 * recall * precision, recall + precision))


# ---------------------------------------------------------------- bucking

# Fixed values: (id, least top diameter in cm, log lengths in m, price per m3), in order of priority.
ASSORTMENTS = [
    ("saw", 16.0, [3.7, 4.0, 4.3, 4.6, 4.9, 5.2, 5.5], 60.0),
    ("pulp", 7.0, [2.7, 3.0, 3.3, 3.6, 3.9, 4.2, 4.5, 4.8, 5.0], 30.0),
    ("energy", 5.0, [2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0], 15.0),
]


def buck(taper: DataFrame, stump: float = 0.1, assortments: list = ASSORTMENTS) -> DataFrame:
    """``taper(tree_id, h, d)`` (m, m) -> logs ``(tree_id, nth, assortment, from_h, to_h, top_d, volume, value)``; stump and residue are rows too.

    Cutting up a stem is sequential, so it goes tree by tree; a batch holds many whole trees.
    """
    def volume(h: np.ndarray, d: np.ndarray, a: float, b: float) -> float:
        # The stem is a cylinder below its first point and frustums between points.
        edges = np.unique(np.concatenate(([a, b], h[(h > a) & (h < b)])))
        at = np.interp(edges, h, d)
        return float((np.pi / 12 * np.diff(edges) * (at[:-1] ** 2 + at[:-1] * at[1:] + at[1:] ** 2)).sum())

    def cut(tree: int, h: np.ndarray, d: np.ndarray) -> list[tuple]:
        top, at = float(h[-1]), min(stump, float(h[-1]))
        rows = [(tree, 0, "stump", 0.0, at, float(np.interp(at, h, d)), volume(h, d, 0.0, at), 0.0)]
        while True:
            pick = next(((k, n, p) for k, least, lengths, p in assortments for n in sorted(lengths, reverse=True) if at + n <= top + 1e-9 and np.interp(at + n, h, d) * 100 >= least), None)
            if not pick:
                break
            k, n, price = pick
            v = volume(h, d, at, at + n)
            rows.append((tree, len(rows), k, at, at + n, float(np.interp(at + n, h, d)), v, v * price))
            at += n
        if top > at:
            rows.append((tree, len(rows), "residue", at, top, float(d[-1]), volume(h, d, at, top), 0.0))
        return rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in whole_groups(parts, "tree_id"):
            first = np.flatnonzero(np.diff(t["tree_id"], prepend=t["tree_id"].iloc[0] - 1)).tolist()
            h, d, rows = t["h"].to_numpy(), t["d"].to_numpy(), []
            for a, b in zip(first, [*first[1:], len(t)]):
                # Of points at one height the first one counts.
                at, keep = np.unique(h[a:b], return_index=True)
                rows += cut(int(t["tree_id"].iloc[a]), at, d[a:b][keep])
            yield pd.DataFrame(rows, columns=["tree_id", "nth", "assortment", "from_h", "to_h", "top_d", "volume", "value"])

    rows = taper.select(F.col("tree_id").cast("int").alias("tree_id"), F.col("h").cast("double").alias("h"), F.col("d").cast("double").alias("d")).dropna()
    return rows.repartition("tree_id").sortWithinPartitions("tree_id", "h", "d").mapInPandas(run, "tree_id int, nth int, assortment string, from_h double, to_h double, top_d double, volume double, value double")


def whole_groups(parts: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``key`` that cut no group: the last one of a batch goes to the next."""
    held = None
    for t in parts:
        t = t if held is None else pd.concat([held, t], ignore_index=True)
        if len(t):
            open_ = (t[key] == t[key].iloc[-1]).to_numpy()
            held = t[open_]
            if not open_.all():
                yield t[~open_]
    if held is not None and len(held):
        yield held


def taper_of(slices: DataFrame) -> DataFrame:
    """``slices(tree_id, hag, r)`` -> ``(tree_id, h, d)``: one point per slice at its middle; a tree's slice height is the gap between its first two (0.25 m for one)."""
    w = Window.partitionBy("tree_id").orderBy("hag")
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value("hag", 2).over(all_of)
    gap = F.when(second.isNotNull(), F.greatest(second - F.first("hag").over(all_of), F.lit(0.05))).otherwise(0.25)
    return slices.select("tree_id", (F.col("hag") + gap / 2).alias("h"), (2 * F.col("r")).alias("d"))


def bucking_totals(logs: DataFrame, heights: DataFrame) -> DataFrame:
    """One row of the plot: volume and value by class (a map), waste, totals, and trees measured to less than 80 % of ``heights(tree_id, height)``."""
    cut = ~F.col("assortment").isin("stump", "residue")
    by = logs.filter(cut).groupBy("assortment").agg(F.sum("volume").alias("v"), F.sum("value").alias("w"))
    maps = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("assortment", "v")))).alias("per_class"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("assortment", "w")))).alias("value_per_class"))
    one = logs.agg(F.coalesce(F.sum(F.when(~cut, F.col("volume"))), F.lit(0.0)).alias("waste"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    tops = logs.groupBy("tree_id").agg(F.max("to_h").alias("top")).join(heights.select(F.col("tree_id").cast("int").alias("tree_id"), "height"), "tree_id")
    return one.crossJoin(maps).crossJoin(tops.agg(F.count_if((F.col("height") > 0) & (F.col("top") < 0.8 * F.col("height"))).alias("n_partially_measured")))  # single rows
