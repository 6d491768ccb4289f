"""The catalogue of named operations over datasets on disk.

A dataset is a folder with ``points/`` (Parquet) and JSON sidecars. ``run(spark, name, params)`` takes parameters in
camelCase, as documented for each operation; a name or parameter that is not known is an error. Tables come back
as DataFrames, everything else as plain values. Operations that rewrite points write a new version of them and switch.
"""

from __future__ import annotations

import ast
import inspect
import json
import re
import textwrap
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import stats
from ..operators import features as ft
from ..operators import forestry as fo
from ..operators import meshes as me
from ..operators import neighbours as ne
from ..operators import planes as pl
from ..operators import points as po
from ..operators import registration as rg
from ..operators import segmentation as sg
from ..operators import trees as tr
from ..sources import formats as fm
from ..sources import scans as sc

OPS: dict[str, Callable] = {}


def op(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if name in OPS:
            raise ValueError(f"{name} is registered twice")
        OPS[name] = f
        return f

    return add


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def parameters(name: str) -> dict[str, Any]:
    """Parameters of an operation with their defaults (``inspect._empty`` where required)."""
    return {k: p.default for k, p in list(inspect.signature(OPS[name]).parameters.items())[1:]}


def idle(name: str) -> set[str]:
    """Parameters that the operation's body does not read: they take their default only."""
    body = ast.parse(textwrap.dedent(inspect.getsource(OPS[name]))).body[0]
    read = {n.id for n in ast.walk(body) if isinstance(n, ast.Name)}
    return set() if any(isinstance(a, ast.arguments) and a.kwarg for a in ast.walk(body)) else set(parameters(name)) - read


def run(spark: SparkSession, name: str, params: dict[str, Any] | None = None) -> Any:
    if name not in OPS:
        raise KeyError(f"no operation {name!r}")
    given, known = {snake(k): v for k, v in (params or {}).items()}, parameters(name)
    if extra := sorted(set(given) - set(known)):
        raise TypeError(f"{name}: unknown parameters {extra}")
    if lack := sorted(k for k, v in known.items() if v is inspect.Parameter.empty and k not in given):
        raise TypeError(f"{name}: missing parameters {lack}")
    for k in sorted(idle(name) & set(given)):
        if given[k] != known[k]:
            raise ValueError(f"{name}: {k} is not supported, only its default {known[k]!r} is")
    spark.sparkContext.addJobTag(stage_tag(name))
    try:
        return OPS[name](spark, **given)
    finally:
        spark.sparkContext.removeJobTag(stage_tag(name))


def stage_tag(name: str) -> str:
    return "stage-" + re.sub(r"\W", "-", name)


# ---------------------------------------------------------------- storage


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def load(path: str, name: str, default: Any = None) -> Any:
    store, base = _fs(path)
    from pyarrow import fs

    if store.get_file_info(f"{base}/{name}.json").type == fs.FileType.NotFound:
        return default
    with store.open_input_file(f"{base}/{name}.json") as f:
        return json.loads(f.read())


def save(path: str, name: str, value: Any) -> Any:
    store, base = _fs(path)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}.json") as f:
        f.write(json.dumps(value, allow_nan=False, default=str).encode())
    return value


def put(path: str, data: str | bytes) -> str:
    store, base = _fs(path)
    store.create_dir(base.rsplit("/", 1)[0] or "/", recursive=True)
    with store.open_output_stream(base) as f:
        f.write(data.encode() if isinstance(data, str) else data)
    return path


def drop(path: str) -> None:
    store, base = _fs(path)
    store.delete_dir(base)


def points_of(spark: SparkSession, octree_dir: str) -> DataFrame:
    meta = load(octree_dir, "meta")
    if meta is None:
        raise FileNotFoundError(f"{octree_dir} is not a dataset")
    p = spark.read.parquet(f"{octree_dir}/{meta['version']}")
    edits = load(octree_dir, "edits")
    return po.apply_overlay(p, spark.createDataFrame(edits, "point_id string, new_tree int, semantic int, deleted int")) if edits else p


def store_points(spark: SparkSession, points: DataFrame, octree_dir: str, **meta: Any) -> dict:
    """Write a version partitioned by coarse tile and make it the dataset's."""
    version = f"points-{uuid.uuid4().hex[:12]}"
    out = points
    for c, kind in (("point_id", None), ("tree_id", "int"), ("intensity", "int"), ("cls", "int"), ("semantic", "int")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0).cast(kind) if kind else F.concat_ws("-", *(F.round(k, 4).cast("string") for k in "xyz"), F.monotonically_increasing_id().cast("string")))
    out.drop("tile").withColumn("tile", F.concat_ws("_", F.floor(F.col("x") / 100).cast("string"), F.floor(F.col("y") / 100).cast("string"))).write.partitionBy("tile").parquet(f"{octree_dir}/{version}")
    return save(octree_dir, "meta", (load(octree_dir, "meta") or {}) | meta | {"version": version})


def heights_of(spark: SparkSession, octree_dir: str, cell: float = 0.5) -> DataFrame:
    p = points_of(spark, octree_dir)
    return p if "hag" in p.columns else po.normalize_filled(p, cell)


def trees_of(spark: SparkSession, octree_dir: str, bh_low: float = 1.2, bh_high: float = 1.4, crown_cell: float = 0.25, dtm_cell: float = 0.5, merge_stems: bool = True) -> DataFrame:
    h = heights_of(spark, octree_dir, dtm_cell)
    t = tr.tree_metrics(h, bh_low, bh_high, crown_cell)
    if merge_stems and load(octree_dir, "stems"):
        fits = spark.createDataFrame(load(octree_dir, "stems"), "tree_id int, dbh double")
        t = fo.merge_stem_fits(t, fits)
    species = load(octree_dir, "species") or {}
    s = spark.createDataFrame([(int(k), v) for k, v in species.items()], "tree_id int, species string")
    return t.join(s, "tree_id", "left")


def store_table(octree_dir: str, name: str, df: DataFrame) -> str:
    """A table of per-tree results beside the points, as Parquet, under a name of its own that replaces the one before."""
    folder = f"{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{octree_dir}/{folder}")
    save(octree_dir, "meta", (load(octree_dir, "meta") or {}) | {name: folder})
    return folder


def stored_table(spark: SparkSession, octree_dir: str, name: str) -> DataFrame | None:
    folder = (load(octree_dir, "meta") or {}).get(name)
    return spark.read.parquet(f"{octree_dir}/{folder}") if folder else None


def _slices(spark: SparkSession, octree_dir: str) -> DataFrame:
    s = stored_table(spark, octree_dir, "slices")
    return spark.createDataFrame([], "tree_id int, hag double, z double, cx double, cy double, r double") if s is None else s


def qsm_of(spark: SparkSession, octree_dir: str) -> DataFrame:
    kept = stored_table(spark, octree_dir, "qsm")
    if kept is not None:
        return kept.withColumn("branch_volume", F.lit(None).cast("double"))
    rows: list = []
    kind = "tree_id int, stem_volume double, stem_volume_std double, stem_volume_ci95 double, branch_volume double, confidence double, completeness double"
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in kind.split(", ")) for r in rows], kind)




# ---------------------------------------------------------------- projects and datasets


@op("project.create")
def _(spark, folder: str, name: str, crs_name: str | None = None, epsg: int | None = None, notes: str | None = None):
    return save(folder, "project", {"name": name, "crsName": crs_name, "epsg": epsg, "notes": notes, "datasets": []})


CURRENT: dict[str, Any] = {"folder": None, "recent": []}


@op("project.open")
def _(spark, folder: str):
    got = load(folder, "project")
    if got is None:
        raise FileNotFoundError(folder)
    CURRENT["folder"], CURRENT["recent"] = folder, [folder, *(x for x in CURRENT["recent"] if x != folder)]
    return got


@op("project.current")
def _(spark):
    return CURRENT["folder"]


@op("project.close")
def _(spark):
    CURRENT["folder"] = None


@op("project.recent")
def _(spark):
    return list(CURRENT["recent"])


@op("project.rename")
def _(spark, name: str, project_folder: str | None = None):
    folder = project_folder or CURRENT["folder"]
    return save(folder, "project", load(folder, "project") | {"name": name})


@op("project.datasets")
def _(spark, project_folder: str | None = None):
    return load(project_folder or CURRENT["folder"], "project")["datasets"]


@op("dataset.probe")
def _(spark, path: str):
    return fm.probe(spark, path)


@op("dataset.import")
def _(spark, src_path: str, extra_names: list = [], include_deadwood: bool = False, laying_deadwood_extra_name: str | None = None, mapping: dict | None = None, max_depth: int = 14, name: str | None = None, out_dir: str | None = None, project_folder: str | None = None, root_spacing: float = 0.0, scanner_type: str = "other", semantic_extra_name: str | None = None, standing_deadwood_extra_name: str | None = None, tree_id_extra_name: str | None = None):
    p = fm.read_points(spark, src_path, mapping)
    folder = project_folder or CURRENT["folder"]
    where = out_dir or f"{folder}/{name or re.sub(r'[^A-Za-z0-9_-]', '_', src_path.rsplit('/', 1)[-1].rsplit('.', 1)[0])}"
    store_points(spark, p, where, scannerType=scanner_type, source=src_path)
    if folder and load(folder, "project"):
        project = load(folder, "project")
        save(folder, "project", project | {"datasets": [*project["datasets"], where]})
    return where


@op("dataset.info")
def _(spark, octree_dir: str):
    return po.info(points_of(spark, octree_dir)).first().asDict() | {"meta": load(octree_dir, "meta")}


@op("dataset.remove")
def _(spark, octree_dir: str):
    drop(octree_dir)


@op("dataset.realignToSource")
def _(spark, las_path: str, octree_dir: str):
    layout = sc.las_layout(sc.read_bytes(sc.files_of(spark, las_path)[0][0], 0, 375))
    return store_points(spark, po.realign(points_of(spark, octree_dir), layout["scale"][0], layout["offset"]), octree_dir)


@op("dataset.setCrs")
def _(spark, crs: Any, octree_dir: str):
    return save(octree_dir, "meta", load(octree_dir, "meta") | {"crs": crs})


@op("dataset.clean")
def _(spark, name: str, src_dir: str, k: int | None = None, method: str = "sor", min_neighbours: int | None = None, out_dir: str | None = None, radius: float | None = None, scanner_type: str = "other", std_mult: float | None = None):
    p = points_of(spark, src_dir)
    if method not in ("sor", "radius"):
        raise ValueError(f"unknown method {method!r}")
    one = lambda v, plain: plain if v is None else v
    out = ne.clean_sor(p, one(k, 8), one(std_mult, 1.0)) if method == "sor" else ne.clean_radius(p, one(radius, 0.05), one(min_neighbours, 2))
    where = out_dir or f"{src_dir.rsplit('/', 1)[0]}/{name}"
    store_points(spark, out, where, scannerType=scanner_type)
    return where


@op("dataset.downsample")
def _(spark, name: str, src_dir: str, voxel_size: float, keep: str | None = None, out_dir: str | None = None, scanner_type: str = "other"):
    where = out_dir or f"{src_dir.rsplit('/', 1)[0]}/{name}"
    store_points(spark, po.downsample(points_of(spark, src_dir), voxel_size, keep or "first"), where, scannerType=scanner_type)
    return where


@op("dataset.transform")
def _(spark, name: str, octree_dir: str, matrix: list | None = None, out_dir: str | None = None, registration_json: str | None = None):
    m = matrix or load(registration_json.rsplit("/", 1)[0], registration_json.rsplit("/", 1)[1].removesuffix(".json"))["matrix"]
    where = out_dir or f"{octree_dir.rsplit('/', 1)[0]}/{name}"
    store_points(spark, po.transform(points_of(spark, octree_dir), m), where)
    return where


# ---------------------------------------------------------------- scanner projects


def _scans(folder: str | None) -> tuple[str, list]:
    where = folder or CURRENT["folder"]
    return where, load(where, "scans", [])


@op("preprocess.projects")
def _(spark, project_folder: str | None = None):
    return _scans(project_folder)[1]


@op("preprocess.import")
def _(spark, source_path: str, format: str | None = None, name: str | None = None, project_folder: str | None = None):
    where, scans = _scans(project_folder)
    kind = format or source_path.rsplit(".", 1)[-1].lower()
    if kind == "e57":
        raise ValueError("no decoder for E57 here")
    own = name or source_path.rsplit("/", 1)[-1]
    entry = lambda **more: {"id": uuid.uuid4().hex[:8], "format": kind, "name": own, "path": source_path, "mapping": None, "poses": {}} | more
    # Each scan of a PTX file is a scan position with the pose that the file gives it.
    new = [entry(name=f"{own} {s['number']}", section=s["number"], poses={"pose": s["pose"]}) for s in sc.ptx_scans(spark, source_path)[0]] if kind == "ptx" else [entry()]
    save(where, "scans", [*scans, *new])
    return new if kind == "ptx" else new[0]


@op("preprocess.remove")
def _(spark, format: str, id: str, project_folder: str | None = None):
    where, scans = _scans(project_folder)
    return save(where, "scans", [s for s in scans if s["id"] != id or s["format"] != format])


@op("preprocess.xyzMapping")
def _(spark, id: str, mapping: dict, project_folder: str | None = None):
    where, scans = _scans(project_folder)
    return save(where, "scans", [s | {"mapping": mapping} if s["id"] == id else s for s in scans])


@op("preprocess.scans")
def _(spark, project_folder: str | None = None):
    return [s["id"] for s in _scans(project_folder)[1]]


IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]


def _scan_points(spark, project_folder: str | None, id: str) -> DataFrame:
    s = next((s for s in _scans(project_folder)[1] if s["id"] == id), None)
    if s is None:
        raise KeyError(f"no scan {id!r}")
    return po.transform(_own_points(spark, s), s["poses"].get("pose", IDENTITY))


def _own_points(spark, s: dict) -> DataFrame:
    """A scan's points in its own frame."""
    if s["format"] == "ptx":
        return sc.read_ptx(spark, s["path"], posed=False).filter(F.col("scan") == s["section"]).drop("scan")
    return fm.read_points(spark, s["path"], s["mapping"])


@op("preprocess.export")
def _(spark, format: str, id: str, out_path: str, project_folder: str | None = None, scan_position_ids: list | None = None, x_max: float | None = None, x_min: float | None = None, y_max: float | None = None, y_min: float | None = None, z_max: float | None = None, z_min: float | None = None):
    """Scans of a project in one cloud; each point's ``point_source_id`` is its scan's number, from 1."""
    names = scan_position_ids or [id]
    kinds = {s["id"]: s["format"] for s in _scans(project_folder)[1]}
    if wrong := [n for n in names if kinds.get(n) != format]:
        raise ValueError(f"no scans {wrong} of format {format!r}")
    p = po.merge_clouds(*(_scan_points(spark, project_folder, n).withColumn("point_source_id", F.lit(i + 1)) for i, n in enumerate(names)))
    fm.write_las(po.subset(p, {"x": (x_min, x_max), "y": (y_min, y_max), "z": (z_min, z_max)}), out_path)
    return out_path


@op("preprocess.solve")
def _(spark, ties: list, apply_to: str | None = None, project_folder: str | None = None):
    """``ties``: [[x, y, z], [rx, ry, rz]] pairs."""
    m = rg.kabsch(spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in ties], "x double, y double, z double, rx double, ry double, rz double"))
    if apply_to:
        OPS["preprocess.apply"](spark, m, apply_to, project_folder=project_folder)
    return m


@op("preprocess.apply")
def _(spark, pose: list, scan: str, delta: bool = False, project_folder: str | None = None):
    import numpy as np

    where, scans = _scans(project_folder)
    new = lambda s: (np.array(pose).reshape(4, 4) @ np.array(s["poses"].get("pose", IDENTITY)).reshape(4, 4)).ravel().tolist() if delta else pose
    return save(where, "scans", [s | {"poses": {"pose": new(s)}} if s["id"] == scan else s for s in scans])


@op("preprocess.icp")
def _(spark, source: str, target: str, apply: bool = False, max_corr_dist: float = 0.5, max_iters: int = 30, method: str = "pointToPoint", normal_k: int = 12, project_folder: str | None = None, sample_points: int = 60000):
    a, b = _scan_points(spark, project_folder, source), _scan_points(spark, project_folder, target)
    # About so many points of each: the voxel grows until few enough are left.
    voxel = 0.05
    while max(po.decimate(d, voxel).count() for d in (a, b)) > sample_points:
        voxel *= 1.5
    got = rg.icp(a, b, voxel, max_corr_dist, max_iters, method=method, normal_k=normal_k)
    if apply:
        OPS["preprocess.apply"](spark, got["matrix"], source, True, project_folder)
    return got


# ---------------------------------------------------------------- ground and survey


@op("ground.classify")
def _(spark, octree_dir: str, cell_size: float = 0.5, initial_threshold: float = 0.3, max_threshold: float = 2.5, max_window_m: float = 20.0, method: str = "pmf", rigidity: float = 2.0, slope: float = 0.2, tolerance: float = 0.2):
    if method not in ("pmf", "csf"):
        raise ValueError(f"unknown method {method!r} (pmf, csf)")
    p = points_of(spark, octree_dir)
    cls = sg.classify_ground(p, cell_size, tolerance, slope, initial_threshold, max_threshold, max_window_m) if method == "pmf" else sg.classify_cloth(p, cell_size, tolerance, max(1, round(rigidity)))
    return store_points(spark, p.drop("cls").join(cls, "point_id"), octree_dir)


@op("ground.reset")
def _(spark, from_class: int, octree_dir: str, to_class: int = 1):
    return store_points(spark, po.reset_label(points_of(spark, octree_dir), "cls", from_class, to_class), octree_dir)


@op("ground.normalize")
def _(spark, octree_dir: str, cell_size: float = 0.5):
    return store_points(spark, po.normalize(points_of(spark, octree_dir).drop("hag"), cell_size), octree_dir)


@op("ground.terrain")
def _(spark, octree_dir: str, cell_size: float = 0.5, dsm_layers: list = [], dsm_method: str = "p2r", epsg: int | None = None, hillshade_altitude_deg: float = 45.0, hillshade_azimuth_deg: float = 315.0, hli_latitude_deg: float = 60.0, stream_fraction: float = 0.01):
    """Ground, surface and canopy heights and the layers made of the ground, as one long table."""
    if dsm_method not in ("p2r", "pit_free"):
        raise ValueError(f"unknown method {dsm_method!r} (p2r, pit_free)")
    g = ne.cut_lineage(po.surface_grid(points_of(spark, octree_dir), cell_size))
    dtm = g.filter("ground IS NOT NULL")
    out = g.select("col", "row", F.col("ground").alias("dtm"), F.col("top").alias("dsm"), (F.col("top") - F.col("ground")).alias("chm"))
    if dsm_method == "pit_free":
        # The surface stands on the ground model with its gaps filled.
        chm = sg.pit_free(heights_of(spark, octree_dir, cell_size), cell_size, tuple(dsm_layers) or (2.0, 5.0, 10.0, 15.0, 20.0))
        model = po.ground_model(points_of(spark, octree_dir), cell_size).select("col", "row", F.col("dtm").alias("model"))
        out = ne.cut_lineage(g.select("col", "row", F.col("ground").alias("dtm")).join(chm, ["col", "row"], "full").join(model, ["col", "row"], "left").select("col", "row", "dtm", (F.col("model") + F.col("chm")).alias("dsm"), "chm"))
    flow = po.streams(ne.cut_lineage(sg.flow_accumulation(dtm, cell_size, "ground")), stream_fraction)
    return out.join(po.terrain_layers(dtm, cell_size, "ground", hillshade_azimuth_deg, hillshade_altitude_deg, hli_latitude_deg), ["col", "row"], "left").join(flow, ["col", "row"], "left")


@op("ground.contours")
def _(spark, octree_dir: str, cell_size: float = 0.5, index_every: int = 5, interval: float = 0.5, min_length: float = 2.0, polygon: list = [], smooth: int = 2):
    """Contour lines ``(level, index, length, line)``: segments joined level by level, short lines left out, corners cut ``smooth`` times."""
    import pandas as pd

    from ..functions import geometry as ge

    g = po.surface_grid(points_of(spark, octree_dir), cell_size, polygon, [2])
    seg = po.contour_segments(g, cell_size, interval, "lowest").withColumn("step", F.round(F.col("level") / interval).cast("long"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for line in ge.chained(pdf[["x1", "y1", "x2", "y2"]].to_numpy()):
            closed = len(line) > 3 and (line[0] == line[-1]).all()
            n = ge.length_of(line)
            if n >= min_length:
                fine = ge.smoothed(line[:-1] if closed else line, smooth, closed)
                rows.append((float(pdf["level"].iloc[0]), bool(pdf["step"].iloc[0] % index_every == 0), n, [list(map(float, p)) for p in ([*fine, fine[0]] if closed else fine)]))
        return pd.DataFrame(rows, columns=["level", "index", "length", "line"])

    return seg.groupBy("step").applyInPandas(join, "level double, index boolean, length double, line array<array<double>>")


@op("ground.volume")
def _(spark, octree_dir: str, cell_size: float = 0.1, classes: list = [], fill_gaps: bool = True, out_name: str = "volume", plane_z: float | None = None, polygon: list = [], reference: str = "rim", surface: str = "top"):
    """Volumes over a reference: the plane through the edge's cells, a level plane, the lowest cell, or the ground model."""
    p = points_of(spark, octree_dir)
    g = po.surface_grid(p, cell_size, polygon, classes)
    xs, ys = ([q[0] for q in polygon], [q[1] for q in polygon]) if polygon else (None, None)
    box = (min(xs), min(ys), max(xs), max(ys)) if polygon else tuple(p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())
    inside = po.cells_inside(box, cell_size, polygon, spark)
    if fill_gaps:
        g = po.fill_gaps(g, surface).join(inside, ["col", "row"], "left_semi")
    g = ne.cut_lineage(g)
    if reference == "rim":
        a, b, c = po.rim_plane(g, surface, inside).first()
        if a is None:
            raise ValueError("the area's edge has no measured cells")
        level = F.lit(a) + F.lit(b) * F.col("col") + F.lit(c) * F.col("row")
    elif reference == "plane":
        if plane_z is None:
            raise ValueError('reference "plane" needs planeZ')
        level = float(plane_z)
    elif reference == "lowest":
        level = g.agg(F.min(surface)).first()[0]
    elif reference == "dtm":
        dtm = po.surface_grid(p, cell_size).filter("ground IS NOT NULL").select("col", "row", F.col("ground").alias("level"))
        g, level = g.join(dtm, ["col", "row"]), F.col("level")
    else:
        raise ValueError(f"unknown reference {reference!r} (rim, plane, lowest, dtm)")
    out = po.volume(g, cell_size, level, surface)
    save(octree_dir, f"survey-{out_name}", out.first().asDict())
    return out


@op("change.voxels")
def _(spark, octree_dir: str, reference_dir: str, min_points: int = 1, neighbours: bool = True, voxel_size: float = 0.1, write_column: bool = True):
    now, before = points_of(spark, octree_dir), points_of(spark, reference_dir)
    out = po.voxel_change(now, before, voxel_size, min_points, neighbours)
    if write_column:
        out = ne.cut_lineage(out)
        store_points(spark, po.mark_new_voxels(now, before, voxel_size, min_points, neighbours), octree_dir)
    return out


@op("export.ortho")
def _(spark, octree_dir: str, bearing_deg: float = 0.0, color: str = "height", depth: Any = None, out_name: str = "ortho", pixel_size: float = 0.02, polygon: list = [], shade: bool = False, view: str = "top"):
    p = po.subset(points_of(spark, octree_dir), polygon=polygon)
    return po.ortho(p, pixel_size, view, "z" if color == "height" else color)


@op("export.profile")
def _(spark, line: list, octree_dir: str, max_preview: int = 200000, out_name: str = "profile", width: float = 0.5):
    return po.profile(points_of(spark, octree_dir), [tuple(x) for x in line], width)


@op("export.mesh")
def _(spark, octree_dir: str, cell_size: float = 0.1, classes: list = [], decimate: float = 0.0, fill_gaps: bool = True, formats: list = ["ply", "obj"], method: str = "2.5d", min_points: int = 1, out_name: str = "mesh", polygon: list = [], smooth: int = 0, surface: str = "top", z_range: Any = None):
    if method not in ("2.5d", "3d"):
        raise ValueError(f"unknown method {method!r} (2.5d, 3d)")
    if wrong := set(formats) - {"ply", "obj", "stl", "dxf"}:
        raise ValueError(f"unknown formats {sorted(wrong)}")
    z = {"z": tuple(z_range)} if z_range else None
    if method == "3d":
        p = po.subset(points_of(spark, octree_dir), z, classes, polygon=polygon)
        corners, faces = me.closed_surface(p, cell_size, min_points, smooth, decimate)
        n = corners.count()
    else:
        if smooth or decimate:
            raise ValueError("height fields are neither smoothed nor decimated here")
        g = po.surface_grid(po.subset(points_of(spark, octree_dir), z), cell_size, polygon, classes)
        n = g.count()
    if n > 30_000_000:
        raise ValueError(f"{n} cells or corners are too many for one mesh; take a coarser cell")
    v, f = me.arrays(corners, faces) if method == "3d" else fm.height_mesh((po.fill_gaps(g, surface) if fill_gaps else g).toPandas(), cell_size, surface)
    make = {"ply": fm.ply_mesh, "obj": fm.obj_mesh, "stl": fm.stl_mesh, "dxf": fm.dxf_mesh}
    return [put(f"{octree_dir}/{out_name}.{k}", make[k](v, f)) for k in formats]


@op("export.dxf")
def _(spark, octree_dir: str, classes: list = [], every: int = 1, max_points: int = 5_000_000, out_name: str = "points", polygon: list = [], z_range: Any = None):
    p = po.every_nth(po.subset(points_of(spark, octree_dir), {"z": tuple(z_range)} if z_range else None, classes, polygon=polygon), every)
    n = p.count()
    if n > max_points:
        raise ValueError(f"{n} points are more than {max_points}; keep every n-th only")
    return put(f"{octree_dir}/{out_name}.dxf", fm.dxf_points((f"class_{r.cls}", r.x, r.y, r.z) for r in p.select("cls", "x", "y", "z").toLocalIterator()))


@op("export.geometry")
def _(spark, octree_dir: str, points: list, closed: bool = False, name: str = "polyline"):
    rows = [(name, i, float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0) for i, p in enumerate(points)]
    put(f"{octree_dir}/{name}.geojson", fm.geojson([([tuple(p[:2]) for p in points], {"name": name})], closed))
    return po.polyline_measures(spark.createDataFrame(rows, "line string, seq int, x double, y double, z double"), closed).first().asDict()


# ---------------------------------------------------------------- segmentation


def _label(spark, octree_dir: str, labels: DataFrame) -> dict:
    p = points_of(spark, octree_dir)
    out = p.drop("tree_id").join(labels, "point_id", "left").withColumn("tree_id", F.coalesce("tree_id", F.lit(0)))
    # Wide names of trees become 1, 2, ... in order; one row per tree.
    from pyspark.sql import Window

    ids = out.filter("tree_id <> 0").select("tree_id").distinct().withColumn("new", F.row_number().over(Window.orderBy("tree_id")))
    return store_points(spark, out.join(ids, "tree_id", "left").withColumn("tree_id", F.coalesce("new", F.lit(0))).drop("new"), octree_dir)


@op("segment.forest")
def _(spark, octree_dir: str, cut: float = 0.25, dtm_cell: float = 0.5, edge_buffer: float = 2.0, understory: float = 2.0, use_reflectance: bool = False, use_saved_seeds: bool = False, voxel: float = 0.04, write_semantic: bool = False):
    if voxel < 0.04:
        raise ValueError("voxels are at least 0.04 wide")
    return _label(spark, octree_dir, sg.segment_graph(heights_of(spark, octree_dir, dtm_cell), voxel, cut=cut))


@op("segment.chm")
def _(spark, octree_dir: str, cell_size: float = 0.5, crown_base_radius: float = 1.5, crown_max_radius: float = 5.0, crown_radius_per_m: float = 0.05, min_height: float = 2.0, smooth: float = 1.0):
    return _label(spark, octree_dir, sg.segment_chm(heights_of(spark, octree_dir), cell_size, smooth, min_height, crown_base_radius, crown_radius_per_m, crown_max_radius))


@op("segment.li2012")
def _(spark, octree_dir: str, dt1: float = 1.5, dt2: float = 2.0, dtm_cell: float = 0.5, min_height: float = 2.0, min_tree_pts: int = 30, search_window: float = 2.0, voxel_size: float = 0.5, zu: float = 15.0):
    h = heights_of(spark, octree_dir, dtm_cell).withColumns({f"v{c}": S.cell(F.col(c), voxel_size) for c in "xyz"})
    key = F.concat_ws(":", "vx", "vy", "vz")
    v = h.groupBy("vx", "vy", "vz").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("hag").alias("hag")).select(key.alias("point_id"), "x", "y", "hag")
    got = sg.segment_li2012(v, dt1, dt2, zu, search_window, min_height, min_tree_pts).withColumnRenamed("point_id", "v")
    return _label(spark, octree_dir, h.select("point_id", key.alias("v")).join(got, "v").select("point_id", "tree_id"))


@op("segment.deadwood")
def _(spark, octree_dir: str, cell_size: float = 0.5, cluster_eps: float = 0.3, hag_max: float = 1.5, hag_min: float = 0.05, max_axis_verticality: float = 0.4, min_cluster_points: int = 20, min_linearity: float = 0.6, min_log_length: float = 0.6, neighbor_radius: float = 0.4):
    return sg.segment_deadwood(heights_of(spark, octree_dir, cell_size), hag_min, hag_max, neighbor_radius, min_linearity, cluster_eps, min_cluster_points, min_log_length)


@op("segment.leafwood")
def _(spark, octree_dir: str, linearity_min: float = 0.6, min_neighbors: int = 8, planarity_min: float = 0.55, scatter_max: float = 0.35, search_radius: float = 0.06, smooth_passes: int = 2):
    return store_points(spark, ne.leaf_wood(points_of(spark, octree_dir), search_radius, linearity_min, planarity_min, scatter_max, min_neighbors, smooth_passes), octree_dir)


@op("segment.reset")
def _(spark, attr: str, octree_dir: str):
    return store_points(spark, po.reset_label(points_of(spark, octree_dir), {"treeId": "tree_id"}.get(attr, attr)), octree_dir)


# ---------------------------------------------------------------- metrics


@op("metrics.trees")
def _(spark, octree_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, crown_cell: float = 0.25, dtm_cell: float = 0.5, merge_stems: bool = True):
    return trees_of(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell, merge_stems)


@op("metrics.stems")
def _(spark, octree_dir: str, band_high: float = 3.0, band_low: float = 1.0, dtm_cell: float = 0.5, inlier_tol: float = 0.03, iterations: int = 600, min_inliers: int = 12, write_semantic: bool = False):
    got = tr.fit_stems(heights_of(spark, octree_dir, dtm_cell), band_low, band_high, inlier_tol, iterations, min_inliers)
    save(octree_dir, "stems", [[r.tree_id, r.dbh] for r in got.filter("dbh IS NOT NULL").toLocalIterator()])
    return got


@op("metrics.qsm")
def _(spark, octree_dir: str, branch_method: str = "simple", branch_voxel: float = 0.1, dtm_cell: float = 0.5, enable_branches: bool = False, min_points_per_slice: int = 15, min_tree_height: float = 3.0, slice_height: float = 0.25):
    if enable_branches:
        raise ValueError("branch cylinders are not here; stems only")
    s = ne.cut_lineage(tr.slices(heights_of(spark, octree_dir, dtm_cell), slice_height, min_points_per_slice))
    got = tr.stem_model(s, slice_height)
    if min_tree_height > 0:
        tall = heights_of(spark, octree_dir, dtm_cell).groupBy("tree_id").agg(F.max("hag").alias("h")).filter(F.col("h") >= min_tree_height)
        got = got.join(tall.select("tree_id"), "tree_id", "left_semi")
    store_table(octree_dir, "qsm", got)
    ground = _ground(heights_of(spark, octree_dir, dtm_cell))
    store_table(octree_dir, "slices", s.filter("accepted").join(got.select("tree_id"), "tree_id", "left_semi").join(ground, "tree_id").select("tree_id", "hag", (F.col("g") + F.col("hag")).alias("z"), "cx", "cy", "r"))
    return stored_table(spark, octree_dir, "qsm")


def _ground(h: DataFrame) -> DataFrame:
    """``(tree_id, g)``: the ground's height at each tree."""
    return h.groupBy("tree_id").agg(F.min(F.col("z") - F.coalesce("hag", F.lit(0.0))).alias("g"))


@op("metrics.summary")
def _(spark, octree_dir: str, with_records: bool = False):
    merges = load(octree_dir, "treemap") or {}
    m = spark.createDataFrame([(int(k), int(v)) for k, v in merges.items()], "tree_id int, into int") if merges else None
    return po.summary(points_of(spark, octree_dir), m)


@op("metrics.density")
def _(spark, octree_dir: str, canopy_threshold: float = 2.0, cell_size: float = 2.0, epsg: int | None = None, min_height: float = 0.2):
    return po.density(heights_of(spark, octree_dir), cell_size, min_height, canopy_threshold)


@op("qc.flags")
def _(spark, octree_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, crown_cell: float = 0.25, dtm_cell: float = 0.5, with_boxes: bool = False, with_metrics: bool = False):
    q = qsm_of(spark, octree_dir) if stored_table(spark, octree_dir, "qsm") is not None else None
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return fo.flags(trees_of(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell), q).orderBy(F.desc(rank), "tree_id")


@op("qc.points")
def _(spark, octree_dir: str, params: dict):
    """Labels ``(point_id, label)``; ``writeColumn`` (on by default) keeps them as the points' ``point_quality``."""
    given = {snake(k): v for k, v in params.items()}
    p, write = heights_of(spark, octree_dir, given.pop("dtm_cell", 0.5)), given.pop("write_column", True)
    refl, scan = given.pop("refl_column", None) or "intensity", given.pop("scan_column", None)
    if missing := [c for c in (refl, scan) if c and c not in p.columns]:
        raise ValueError(f"no columns {missing}")
    p = p.withColumns({"refl": F.col(refl).cast("double"), "scan": F.col(scan).cast("int") if scan else F.lit(-1)})
    got = ne.cut_lineage(ne.point_quality(p, **given).select("point_id", "label"))
    if write:
        points = points_of(spark, octree_dir).drop("point_quality")
        store_points(spark, points.join(got.withColumnRenamed("label", "point_quality"), "point_id"), octree_dir)
    return got


@op("metrics.volumes")
def _(spark, octree_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, crown_cell: float = 0.25, default_species: str | None = "pine", dtm_cell: float = 0.5, form_factor: float = 0.5, merge_stems: bool = True, use_qsm: bool = True):
    return fo.volumes(trees_of(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell, merge_stems), qsm_of(spark, octree_dir) if use_qsm else None, default_species, form_factor)


@op("metrics.biomass")
def _(spark, octree_dir: str, branch_unc_fraction: float = 0.25, carbon_fraction: float = 0.5, carbon_fraction_std: float = 0.02, density: float = 400.0, density_std: float = 25.0, fallback_species: str = "pine"):
    s = spark.createDataFrame([(int(k), v) for k, v in (load(octree_dir, "species") or {}).items()], "tree_id int, species string")
    return fo.biomass(qsm_of(spark, octree_dir), s, density, density_std, carbon_fraction, carbon_fraction_std, branch_unc_fraction, fallback_species)


@op("metrics.plot")
def _(spark, octree_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, boundary: dict | None = None, crown_cell: float = 0.25, dtm_cell: float = 0.5, edge: str = "crownArea", fit: str = "rectangular", fit_margin: float = 0.0, halfcount_buffer: float = 1.0, merge_stems: bool = True, use_qsm: bool = True):
    t = trees_of(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell, merge_stems)
    b = boundary or load(octree_dir, "plot") or fo.fit_boundary(t, fit, fit_margin)
    return fo.plot_stats(t, b, edge, halfcount_buffer, qsm_of(spark, octree_dir) if use_qsm else None)


@op("metrics.thinning")
def _(spark, octree_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, boom_reach: float = 10.0, crown_cell: float = 0.25, currency: str = "€", default_species: str | None = "pine", dtm_cell: float = 0.5, heading_deg: float = 0.0, merge_stems: bool = True, out_csv: str | None = None, plot_area_ha: float | None = None, price_per_m3: float = 35.0, road_spacing: float = 20.0, road_width: float = 4.0, strategy: str = "low", target_ba_per_ha: float = 18.0, use_qsm: bool = True, with_boxes: bool = False):
    t = ne.cut_lineage(trees_of(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell, merge_stems))
    area = plot_area_ha or (S.boundary_area_ha(load(octree_dir, "plot")) if load(octree_dir, "plot") else fo.estimated_area_ha(t).first()[0])
    out = fo.thinning(t, qsm_of(spark, octree_dir), area, target_ba_per_ha, heading_deg, road_spacing, road_width, boom_reach, strategy, default_species)
    if out_csv:
        fm.write_text(out, out_csv)
    return out


@op("metrics.bucking")
def _(spark, octree_dir: str, assortments: list | None = None, currency: str = "€", out_csv: str | None = None, stump_height: float = 0.1):
    """Logs by tree; the plot's totals are kept as ``bucking``."""
    s = _slices(spark, octree_dir)
    table = [(a["id"], a["minTopDcm"], a["lengths"], a["pricePerM3"]) for a in assortments] if assortments else fo.ASSORTMENTS
    out = ne.cut_lineage(fo.buck(fo.taper_of(s), stump_height, table))
    save(octree_dir, "bucking", fo.bucking_totals(out, trees_of(spark, octree_dir)).first().asDict())
    if out_csv:
        fm.write_text(out, out_csv)
    return out


@op("qc.validate")
def _(spark, field_csv: str, octree_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, crown_cell: float = 0.25, dbh_col: int | None = None, dtm_cell: float = 0.5, height_col: int | None = None, id_col: int | None = None, merge_stems: bool = True, out_csv: str | None = None, search_radius: float = 2.0, x_col: int | None = None, y_col: int | None = None):
    head = fm.probe(spark, field_csv)
    names = [c.strip() for c in head["columns"]]
    find = lambda given, *known: names[given] if given is not None else next((n for k in known for n in names if n.lower() == k or n.lower().startswith((k + "_", k + " "))), None)
    raw = spark.read.option("header", True).option("sep", head["delimiter"]).csv(field_csv)
    raw = raw.toDF(*names)
    col = lambda n: fm.number(F.col(f"`{n}`"), head["decimalComma"]) if n else F.lit(None).cast("double")
    field = ne.cut_lineage(raw.select(F.monotonically_increasing_id().alias("a"), col(find(x_col, "x")).alias("x"), col(find(y_col, "y")).alias("y"), (col(find(dbh_col, "dbh", "caliper")) / 100).alias("field_dbh"), col(find(height_col, "height", "hyp")).alias("field_height")))
    t = ne.cut_lineage(trees_of(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell, merge_stems))
    m = ne.match_positions(field.select("a", "x", "y"), t.select(F.col("tree_id").alias("b"), "x", "y"), search_radius)
    pairs = m.join(field.drop("x", "y"), "a").join(t.select(F.col("tree_id").alias("b"), "dbh", "height"), "b")
    one = lambda what: stats.validation(pairs, f"field_{what}", what).withColumn("metric", F.lit(what))
    return one("dbh").unionByName(one("height"))


# ---------------------------------------------------------------- review


def _sidecar(name: str, plain: str, setter: str, field: str) -> None:
    def get(spark, octree_dir: str):
        return load(octree_dir, name) or {}

    def put_(spark, octree_dir: str, replace: bool = False, **given):
        old = {} if replace else load(octree_dir, name) or {}
        return save(octree_dir, name, {k: v for k, v in (old | {str(k): v for k, v in given[field].items()}).items() if v is not None})

    put_.__signature__ = inspect.Signature([inspect.Parameter(n, inspect.Parameter.POSITIONAL_OR_KEYWORD, default=d) for n, d in (("spark", inspect.Parameter.empty), ("octree_dir", inspect.Parameter.empty), (field, inspect.Parameter.empty), ("replace", False))])
    OPS[plain], OPS[setter] = get, put_


_sidecar("verdicts", "review.get", "review.set", "verdicts")
_sidecar("species", "review.species", "review.setSpecies", "species")


@op("review.plot")
def _(spark, octree_dir: str):
    return load(octree_dir, "plot")


@op("review.setPlot")
def _(spark, boundary: dict, octree_dir: str):
    S.boundary_area_ha(boundary)
    return save(octree_dir, "plot", boundary)


@op("review.treemap")
def _(spark, octree_dir: str):
    return load(octree_dir, "treemap") or {}


# ---------------------------------------------------------------- transfer, registration, change


def _skeleton(spark, octree_dir: str) -> DataFrame:
    kept = stored_table(spark, octree_dir, "skeletons")
    if kept is None:
        raise FileNotFoundError(f"{octree_dir} has no skeletons")
    return kept


@op("transfer.buildSkeletons")
def _(spark, baseline_dir: str, drop_far_fragments: bool = False, dtm_cell: float = 0.5, ground_threshold: float = 0.0, max_tree_points: int = 0, min_tree_points: int = 0, qsm_models: int = 1, r_cover: float = 0.08, skeleton_spacing: float = 0.02, skip_added_cylinders: bool = True):
    """Stem skeletons: cylinders between neighbouring accepted slices of each tree."""
    from pyspark.sql import Window

    h = heights_of(spark, baseline_dir, dtm_cell).filter((F.col("tree_id") > 0) & (F.col("hag") >= ground_threshold))
    size = h.groupBy("tree_id").agg(F.count("*").alias("n"))
    ok = (F.col("n") >= min_tree_points) & (F.lit(not max_tree_points) | (F.col("n") <= max_tree_points))
    h = ne.cut_lineage(h.join(size.filter(ok).select("tree_id"), "tree_id", "left_semi"))
    s = tr.slices(h, 0.25, 10).filter("accepted").join(_ground(h), "tree_id")
    w = Window.partitionBy("tree_id").orderBy("hag")
    here = F.array("cx", "cy", F.col("g") + F.col("hag"))
    store_table(baseline_dir, "skeletons", s.select("tree_id", F.lit(0).alias("branch_order"), here.alias("start"), F.lead(here).over(w).alias("end")).filter(F.col("end").isNotNull()))
    return _skeleton(spark, baseline_dir).count()


@op("transfer.skeletonInfo")
def _(spark, octree_dir: str):
    kept = stored_table(spark, octree_dir, "skeletons")
    return {"cylinders": 0 if kept is None else kept.count()}


@op("transfer.clearSkeletons")
def _(spark, octree_dir: str):
    save(octree_dir, "meta", {k: v for k, v in load(octree_dir, "meta").items() if k != "skeletons"})


@op("transfer.exportSkeletons")
def _(spark, octree_dir: str, out_path: str, format: str | None = None, only_tree_id: int | None = None, per_tree: bool = False):
    s = _skeleton(spark, octree_dir)
    fm.write_text(sg.sample_skeletons(s.filter(F.col("tree_id") == only_tree_id) if only_tree_id is not None else s, 0.02), out_path)
    return out_path


def _turn(a: dict) -> list[float]:
    import math

    c, s = math.cos(math.radians(a.get("yaw_deg", 0.0))), math.sin(math.radians(a.get("yaw_deg", 0.0)))
    return [c, -s, 0, a.get("dx", 0.0), s, c, 0, a.get("dy", 0.0), 0, 0, 1, 0, 0, 0, 0, 1]


@op("transfer.run")
def _(spark, baseline_dir: str, target_dir: str, alignment: dict | None = None, baseline_ground_threshold: float = 0.0, baseline_height: str = "stored", distance_threshold: float = 0.3, drop_far_fragments: bool = False, dtm_cell: float = 0.5, ground_threshold: float = 0.2, ignore_stored_alignment: bool = False, label_beyond_threshold: bool = True, max_tree_points: int = 0, min_tree_points: int = 0, qsm_models: int = 1, r_cover: float = 0.08, skeleton_spacing: float = 0.02, skip_added_cylinders: bool = True, target_height: str = "stored"):
    """Labels of the nearest skeleton point for the target's points above the ground threshold; the others have none."""
    a = alignment or ({} if ignore_stored_alignment else load(target_dir, "alignment")) or {}
    if stored_table(spark, baseline_dir, "skeletons") is None:
        OPS["transfer.buildSkeletons"](spark, baseline_dir, dtm_cell=dtm_cell, ground_threshold=baseline_ground_threshold, min_tree_points=min_tree_points, max_tree_points=max_tree_points)
    p = points_of(spark, target_dir)
    high = heights_of(spark, target_dir, dtm_cell).filter(F.col("hag") >= ground_threshold) if ground_threshold > 0 else p
    got = sg.transfer_labels(po.transform(high, _turn(a)), sg.sample_skeletons(_skeleton(spark, baseline_dir), skeleton_spacing), distance_threshold, label_beyond_threshold)
    out = p.drop("tree_id", "semantic").join(got, "point_id", "left").withColumns({"tree_id": F.coalesce("tree_id", F.lit(0)), "semantic": F.coalesce("semantic", F.lit(0))})
    return store_points(spark, out, target_dir)


@op("transfer.align")
def _(spark, baseline_dir: str, target_dir: str, allow_rotation: bool = True, dtm_cell: float = 0.5, search_radius: float = 30.0):
    one = lambda d: ne.cut_lineage(trees_of(spark, d, dtm_cell=dtm_cell).filter("x IS NOT NULL").select(F.col("tree_id").alias("id"), "x", "y"))
    return save(target_dir, "alignment", rg.align_stems(one(target_dir), one(baseline_dir), search_radius, allow_rotation=allow_rotation))


@op("transfer.alignment")
def _(spark, target_dir: str):
    return load(target_dir, "alignment")


@op("transfer.clearAlignment")
def _(spark, target_dir: str):
    return save(target_dir, "alignment", None)


@op("transfer.applyAlignment")
def _(spark, target_dir: str, note: str | None = None):
    a = load(target_dir, "alignment")
    if not a:
        raise ValueError("no alignment is stored")
    return store_points(spark, po.transform(points_of(spark, target_dir), _turn(a)), target_dir, note=note)


@op("transfer.shift")
def _(spark, dx: float, dy: float, octree_dir: str, note: str | None = None):
    return store_points(spark, po.transform(points_of(spark, octree_dir), [1, 0, 0, dx, 0, 1, 0, dy, 0, 0, 1, 0, 0, 0, 0, 1]), octree_dir, note=note)


@op("change.m3c2")
def _(spark, octree_dir: str, reference_dir: str, core_spacing: float = 0.5, max_depth: float = 3.0, normal_scale: float = 1.0, out_csv: str | None = None, projection_scale: float = 0.5, reg_error: float = 0.02, registration_json: str | None = None, voxel_size: float = 0.1, with_points: bool = False):
    thin = lambda d: po.decimate(points_of(spark, d), voxel_size).select(F.concat_ws(":", "vx", "vy", "vz").alias("point_id"), "x", "y", "z")
    before = thin(reference_dir)
    cores = po.decimate(before, core_spacing).select(F.concat_ws(":", "vx", "vy", "vz").alias("core"), "x", "y", "z")
    out = ne.m3c2(cores, before, thin(octree_dir), normal_scale, projection_scale, max_depth, reg_error)
    if out_csv:
        fm.write_text(out, out_csv)
    return out


@op("change.growth")
def _(spark, octree_dir: str, reference_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, crown_cell: float = 0.25, dtm_cell: float = 0.5, form_factor: float = 0.5, merge_stems: bool = True, out_csv: str | None = None, search_radius: float = 1.5, years: float = 5.0):
    now, ref = (ne.cut_lineage(trees_of(spark, d, bh_low, bh_high, crown_cell, dtm_cell, merge_stems)) for d in (octree_dir, reference_dir))
    return fo.matched_growth(ref, now, search_radius, form_factor)


@op("change.crossSensor")
def _(spark, als_dir: str, tls_dir: str, bh_high: float = 1.4, bh_low: float = 1.2, crown_cell: float = 0.25, dbh_classes: list = [0.05, 0.15, 0.25, 0.35, 0.45], dtm_cell: float = 0.5, folds: int = 5, form: str = "loglog", merge_stems: bool = True, method: str = "optimal", out_csv: str | None = None, predictors: list = ["height", "crownArea"], radius: float = 2.5):
    als, tls = (ne.cut_lineage(trees_of(spark, d, bh_low, bh_high, crown_cell, dtm_cell, merge_stems)) for d in (als_dir, tls_dir))
    m, rows = fo.found_by_place(tls, als, radius, tuple(dbh_classes), method)
    vol = fo.volumes(tls, qsm_of(spark, tls_dir)).select(F.col("tree_id").cast("long").alias("b"), "volume")
    pairs = m.join(vol, "b").join(als.withColumn("a", F.col("tree_id").cast("long")).drop("x", "y"), "a").withColumn("seq", F.col("a"))
    return {"detection": fo.detection(rows), "model": tr.volume_model(pairs, [snake(p) for p in predictors], form, folds)}


def _start(spark, init: str, a: DataFrame, b: DataFrame, moving_dir: str, reference_dir: str, given: dict, dtm_cell: float, search_radius: float, yaw_range: float, feature_voxel: float, trials: int, reach: float) -> list[float]:
    """Where a registration starts: the given place (current), stems, features, or of these the one with most overlap (auto)."""
    if init not in ("current", "stems", "features", "auto"):
        raise ValueError(f"unknown init {init!r} (current, stems, features, auto)")
    at = _turn(given)
    at[11] = given["dz"]
    found = {"current": at}
    if init in ("stems", "auto"):
        one = lambda d: ne.cut_lineage(trees_of(spark, d, dtm_cell=dtm_cell).filter("x IS NOT NULL").select(F.col("tree_id").alias("id"), "x", "y"))
        stems = rg.align_stems(one(moving_dir), one(reference_dir), search_radius, yaw_range=yaw_range)
        if stems:
            found["stems"] = _turn(stems)
            found["stems"][11] = given["dz"]
        elif init == "stems":
            found["stems"] = at
    if init in ("features", "auto"):
        got = ft.feature_start(a, b, feature_voxel, trials)
        if got:
            found["features"] = got["matrix"]
        elif init == "features":
            raise ValueError("the clouds have too few features in common")
    if init != "auto":
        return found[init]
    share = {k: ft.overlap(a, b, m, feature_voxel, max(reach, feature_voxel)) for k, m in found.items()}
    return found[max(share, key=share.get)]


@op("change.register")
def _(spark, moving_dir: str, reference_dir: str, apply: bool = False, dof: str = "full", dtm_cell: float = 0.5, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0, feature_iterations: int = 50000, feature_voxel: float = 0.3, init: str = "current", jackknife_block: float = 2.0, kernel: str = "welsch", kernel_floor: float = 0.002, levels: int = 4, max_corr_dist: float = 1.0, max_iters: int = 50, max_normal_angle_deg: float = 45.0, max_points: int = 1000000, max_variation: float = 0.15, method: str = "symmetric", name: str | None = None, normal_k: int = 16, out_dir: str | None = None, out_json: str | None = None, search_radius: float = 30.0, voxel: float = 0.05, yaw_deg: float = 0.0, yaw_range_deg: float = 5.0):
    a, b = points_of(spark, moving_dir), points_of(spark, reference_dir)
    start = _start(spark, init, a, b, moving_dir, reference_dir, {"dx": dx, "dy": dy, "dz": dz, "yaw_deg": yaw_deg}, dtm_cell, search_radius, yaw_range_deg, feature_voxel, feature_iterations, max_corr_dist)
    got = None
    for level in reversed(range(levels)):
        got = rg.icp(a, b, voxel * 2**level, max_corr_dist * 2**level, max_iters, kernel=kernel, method=method, dof=dof, normal_k=normal_k, start=start, floor=kernel_floor, jackknife_block=jackknife_block if not level else None)
        start = got["matrix"]
    if out_json:
        save(out_json.rsplit("/", 1)[0], out_json.rsplit("/", 1)[1].removesuffix(".json"), got)
    if apply:
        store_points(spark, po.transform(a, got["matrix"]), out_dir or f"{moving_dir}-registered")
    return got


# ---------------------------------------------------------------- exports


@op("export.las")
def _(spark, octree_dir: str, out_path: str, cell_size: float | None = None, decimals: int | None = None, delimiter: str | None = None, extras_to_export: Any = None, filter: dict | None = None, geoid: str | None = None, header: bool | None = None, include_laying_deadwood: bool | None = None, include_semantic: bool | None = None, include_standing_deadwood: bool | None = None, include_tree_id: bool | None = None, keep_classification: bool | None = None, keep_intensity: bool | None = None, las14: bool | None = None, normalize: bool | None = None, ply_ascii: bool | None = None, standard_fields: bool | None = None, target_crs: str | None = None):
    if target_crs:
        raise ValueError("reprojection needs a projection library that is not here")
    p = _filtered(points_of(spark, octree_dir), filter or {})
    if normalize:
        p = po.normalize_filled(p.drop("hag"), cell_size or 0.5).withColumn("z", F.coalesce("hag", "z"))
    if geoid:
        p = _above_geoid(spark, p, geoid)
    if out_path.lower().endswith((".txt", ".csv", ".xyz")):
        fm.write_text(p.select("x", "y", "z", "intensity", "cls", "tree_id"), out_path, 3 if decimals is None else decimals, delimiter or ",", header is not False)
    elif not out_path.lower().endswith((".las", "/")) and "." in out_path.rsplit("/", 1)[-1]:
        raise ValueError(f"{out_path}: only text and LAS are written")
    else:
        fm.write_las(p, out_path)
    return out_path


def _above_geoid(spark, p: DataFrame, path: str) -> DataFrame:
    """Ellipsoidal heights less the undulation, from an ESRI ASCII grid in the points' own coordinates; a point beyond the grid is an error."""
    address, n = sc.files_of(spark, path)[0]
    grid, size = fm.read_esri_ascii(sc.read_bytes(address, 0, n).decode("ascii"))
    # ESRI rasters have values at the middles of their cells, as the long grids here do.
    high = ne.cut_lineage(po.sampled(p, spark.createDataFrame(grid), size, "value", "undulation"))
    if lost := high.filter("undulation IS NULL").count():
        raise ValueError(f"{lost} points lie beyond {path}")
    return high.withColumn("z", F.col("z") - F.col("undulation")).drop("undulation")


def _filtered(p: DataFrame, f: dict) -> DataFrame:
    known = {"x", "y", "z", "intensity", "treeId", "classes", "slab", "polygon"}
    if extra := set(f) - known:
        raise TypeError(f"unknown filters {sorted(extra)}")
    return po.subset(p, {snake(k): tuple(f[k]) for k in ("x", "y", "z", "intensity", "treeId") if k in f}, f.get("classes"), f.get("slab"), f.get("polygon"))


@op("export.subset")
def _(spark, name: str, src_dir: str, filter: dict = {}, out_dir: str | None = None, scanner_type: str = "other"):
    where = out_dir or f"{src_dir.rsplit('/', 1)[0]}/{name}"
    store_points(spark, _filtered(points_of(spark, src_dir), filter), where, scannerType=scanner_type)
    return where


def tree_table(spark, octree_dir: str, bh_low: float = 1.2, bh_high: float = 1.4, crown_cell: float = 0.25, dtm_cell: float = 0.5, merge_stems: bool = True, use_qsm: bool = True, **biomass: Any) -> DataFrame:
    t = trees_of(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell, merge_stems)
    out = t.join(fo.volumes(t, qsm_of(spark, octree_dir) if use_qsm else None), "tree_id", "left")
    if use_qsm and stored_table(spark, octree_dir, "qsm") is not None:
        b = fo.biomass(qsm_of(spark, octree_dir), t.select("tree_id", "species"), **biomass)
        out = out.join(b.select("tree_id", "stem_volume", "branch_volume", "biomass", (F.col("biomass_std") * 1.96).alias("biomass_ci95"), "carbon", (F.col("carbon_std") * 1.96).alias("carbon_ci95"), "co2e"), "tree_id", "left")
    return out


@op("export.csv")
def _(spark, octree_dir: str, out_path: str, bh_high: float = 1.4, bh_low: float = 1.2, branch_unc_fraction: float = 0.25, carbon_fraction: float = 0.5, carbon_fraction_std: float = 0.02, crown_cell: float = 0.25, density: float = 400.0, density_std: float = 25.0, dtm_cell: float = 0.5, fallback_species: str = "pine", merge_stems: bool = True, use_qsm: bool = True):
    t = tree_table(spark, octree_dir, bh_low, bh_high, crown_cell, dtm_cell, merge_stems, use_qsm, density=density, density_std=density_std, carbon=carbon_fraction, carbon_std=carbon_fraction_std, branch_unc=branch_unc_fraction, fallback=fallback_species)
    fm.write_text(t.orderBy("tree_id"), out_path)
    return out_path


@op("export.report")
def _(spark, octree_dir: str, out_path: str, project_name: str | None = None, description: str | None = None, date: str | None = None, plot_area_ha: float | None = None, use_qsm: bool = True, bins: int = 12):
    """A self-contained HTML page: plot figures and histograms; numbers come from aggregates, whatever the number of trees."""
    t = ne.cut_lineage(tree_table(spark, octree_dir, use_qsm=use_qsm))
    one = fo.tree_stats(t).first().asDict()
    body = "".join(f"<tr><th>{k}</th><td>{'' if v is None else v if isinstance(v, int) else round(v, 3)}</td></tr>" for k, v in one.items())
    charts = ""
    for c in ("dbh", "height", "crown_area"):
        low, high = t.agg(F.min(c), F.max(c)).first()
        if low is None or low == high:
            continue
        n = {r["bin"]: r["n"] for r in po.histogram(t, c, low, high, bins).collect()}
        top = max(n.values())
        bars = "".join(f'<rect x="{20 * (b - 1)}" y="{100 - 100 * k / top:.1f}" width="18" height="{100 * k / top:.1f}"/>' for b, k in n.items())
        charts += f'<figure><svg viewBox="0 0 {20 * bins} 100" width="480">{bars}</svg><figcaption>{c}: {low:.2f} to {high:.2f}</figcaption></figure>'
    return put(out_path, f"<!doctype html><meta charset='utf-8'><title>{project_name or octree_dir}</title><h1>{project_name or octree_dir}</h1><p>{description or ''} {date or ''}</p><table>{body}</table>{charts}")


@op("export.qsm")
def _(spark, octree_dir: str, formats: list = ["qsm", "obj", "ply"], out_dir: str | None = None, sides: int = 12):
    rows = [r.asDict() for r in _slices(spark, octree_dir).orderBy("tree_id", "hag").toLocalIterator()]
    cyl = [((a["cx"], a["cy"], a["z"]), (b["cx"], b["cy"], b["z"]), a["r"]) for a, b in zip(rows, rows[1:]) if a["tree_id"] == b["tree_id"]]
    v, f = fm.tubes(cyl, sides)
    where = out_dir or octree_dir
    made = {"qsm": lambda: json.dumps([{"treeId": r["tree_id"], "hag": r["hag"], "z": r["z"], "centerX": r["cx"], "centerY": r["cy"], "radius": r["r"]} for r in rows]), "obj": lambda: fm.obj_mesh(v, f), "ply": lambda: fm.ply_mesh(v, f)}
    return [put(f"{where}/stems.{k}", made[k]()) for k in formats]


@op("export.qsmTubes")
def _(spark, path: str, out_ply: str | None = None, sides: int = 12):
    store, base = _fs(path)
    with store.open_input_file(base) as s:
        rows = json.loads(s.read())
    cyl = [((a["centerX"], a["centerY"], a["z"]), (b["centerX"], b["centerY"], b["z"]), a["radius"]) for a, b in zip(rows, rows[1:]) if a["treeId"] == b["treeId"]]
    v, f = fm.tubes(cyl, sides)
    return put(out_ply or path.rsplit(".", 1)[0] + ".ply", fm.ply_mesh(v, f))


# ---------------------------------------------------------------- runs


@op("run.cancel")
def _(spark, stage: str):
    spark.sparkContext.cancelJobsWithTag(stage_tag(stage))


@op("run.status")
def _(spark, stage: str):
    """Whether jobs of the operation are running, whoever asked for them."""
    tag, jobs = stage_tag(stage), spark.sparkContext._jsc.sc().statusStore().jobsList(None)
    return any(j.status().toString() == "RUNNING" and tag in str(j.jobTags().mkString(",")).split(",") for j in (jobs.apply(i) for i in range(jobs.size())))


# ---------------------------------------------------------------- targets


def _spheres(spark, project_folder: str | None, scan: str, spheres: dict | None) -> list[list[float]]:
    p = spheres or {}
    if extra := set(p) - {"minRadius", "maxRadius", "tolerance", "minPoints", "most"}:
        raise TypeError(f"unknown sphere parameters {sorted(extra)}")
    found = rg.find_spheres(_scan_points(spark, project_folder, scan), (p.get("minRadius", 0.05), p.get("maxRadius", 0.15)), p.get("tolerance", 0.01), p.get("minPoints", 40)).orderBy(F.desc("n"), "cx", "cy", "cz")
    # A scan has tens of targets; ``most`` asks for the best-supported ones only.
    return [[r.cx, r.cy, r.cz] for r in (found.limit(p["most"]) if "most" in p else found).collect()]


PLANE_PARAMETERS = {"voxelSize": "cell", "planarityMax": "planarity", "minVoxelPoints": "least_cell", "normalAngleTolDeg": "angle", "minPatchPoints": "least", "maxStdDev": "max_std", "minSize": "min_size", "maxSize": "max_size"}


def _patches(spark, project_folder: str | None, scans: list[str], planes: dict | None) -> DataFrame:
    """Plane patches of scans, found in the scanners' frames, in world coordinates."""
    given = dict(planes or {})
    given.pop("centroidDistTol", None)
    if extra := set(given) - set(PLANE_PARAMETERS):
        raise TypeError(f"unknown plane parameters {sorted(extra)}")
    entries = {s["id"]: s for s in _scans(project_folder)[1]}
    if lack := [s for s in scans if s not in entries]:
        raise KeyError(f"no scans {lack}")
    clouds = [_own_points(spark, entries[s]).select(F.lit(s).alias("scan"), "x", "y", "z") for s in scans]
    own = pl.plane_patches(po.merge_clouds(*clouds), by=("scan",), **{PLANE_PARAMETERS[k]: v for k, v in given.items()})
    return pl.posed(own, {s: entries[s]["poses"].get("pose", IDENTITY) for s in scans})


@op("preprocess.targets")
def _(spark, scan: str, planes: dict | None = None, project_folder: str | None = None, spheres: dict | None = None, with_planes: bool = True):
    """``{spheres: [[x, y, z]], planes: table}``, in world coordinates."""
    out = {"spheres": _spheres(spark, project_folder, scan, spheres)}
    return out | {"planes": _patches(spark, project_folder, [scan], planes)} if with_planes else out


@op("preprocess.matchSpheres")
def _(spark, source: str, target: str, apply: bool = False, project_folder: str | None = None, spheres: dict | None = None):
    pairs, m = rg.match_targets(_spheres(spark, project_folder, source, spheres), _spheres(spark, project_folder, target, spheres))
    if apply and m:
        OPS["preprocess.apply"](spark, m, source, True, project_folder)
    return {"pairs": pairs, "matrix": m}


@op("preprocess.msa")
def _(spark, apply: bool = False, lambda_init: float = 0.0001, max_iters: int = 1000, planes: dict | None = None, preserve_roll_pitch: bool = True, project_folder: str | None = None, rmse_eps: float = 1e-6, scans: list | None = None, spheres: dict | None = None, with_planes: bool = True):
    """Corrections of all scans' poses, from spheres and planes; a scan starts where its spheres say, else where it stands, else where its planes fit the first scan's."""
    names = scans or [s["id"] for s in _scans(project_folder)[1]]
    found = {s: _spheres(spark, project_folder, s, spheres) for s in names}
    # Targets are named by the first scan that sees them; each later scan is matched to what is known so far.
    places, observed, start = {f"t{i}": p for i, p in enumerate(found[names[0]])}, {names[0]: {f"t{i}": p for i, p in enumerate(found[names[0]])}}, {s: IDENTITY for s in names}
    unmatched = []
    for s in names[1:]:
        known = list(places)
        pairs, m = rg.match_targets(found[s], [places[k] for k in known])
        if not m:
            unmatched.append(s)
            continue
        start[s], observed[s] = m, {known[j]: found[s][i] for i, j in pairs}
        for i in set(range(len(found[s]))) - {i for i, _ in pairs}:
            places[f"t{len(places)}"] = [sum(m[4 * r + c] * found[s][i][c] for c in range(3)) + m[4 * r + 3] for r in range(3)]
            observed[s][f"t{len(places) - 1}"] = found[s][i]
    rows = [(s, t, *map(float, observed[s][k]), *map(float, observed[t][k]), *[None] * 7) for i, s in enumerate(names) for t in names[i + 1:] for k in observed.get(s, {}) if k in observed.get(t, {})]
    matches = spark.createDataFrame(rows, pl.CORRESPONDENCE)
    if with_planes:
        patches, reach = ne.cut_lineage(_patches(spark, project_folder, names, planes)), (planes or {}).get("centroidDistTol", 5.0)
        pairs = ne.cut_lineage(pl.paired(pl.posed(patches, start), reach=reach))
        met = {r.s for r in pairs.select(F.explode(F.array("a_scan", "b_scan")).alias("s")).distinct().collect()}
        if lost := [s for s in unmatched if s not in met]:
            for s in lost:
                got = pl.plane_pose(patches.filter(F.col("scan") == s), patches.filter(F.col("scan") == names[0]), reach=reach, levelled=preserve_roll_pitch)
                if got:
                    start[s] = got["matrix"]
                    unmatched.remove(s)
            pairs = pl.paired(pl.posed(patches, start), reach=reach)
        unmatched = [s for s in unmatched if s not in met]
        matches = matches.unionByName(pl.correspondences(pairs, patches))
    if unmatched:
        raise ValueError(f"{unmatched} cannot be matched to the scans before them")
    got = pl.adjust_poses(matches, start, max_iters, rmse_eps, lambda_init, preserve_roll_pitch)
    if apply:
        for s, m in got["poses"].items():
            OPS["preprocess.apply"](spark, m, s, True, project_folder)
    return got


@op("segment.treeiso")
def _(spark, octree_dir: str, decimate2: float = 0.1, k1: int = 5, k2: int = 20, k3: int = 20, lambda1: float = 1.0, lambda2: float = 20.0, max_gap: float = 2.0, min_tree_pts: int = 20, rho: float = 0.5, vertical_weight: float = 0.5, voxel_size: float = 0.1):
    return _label(spark, octree_dir, sg.segment_treeiso(heights_of(spark, octree_dir), k1, lambda1, k2, lambda2, decimate2, max_gap, k3, rho, vertical_weight, voxel_size, min_tree_pts))
