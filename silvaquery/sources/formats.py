"""Readers and writers: delimited text, XYZ/PTS, PLY, LAS, GeoJSON, DXF, OBJ, ESRI ASCII grids, GeoTIFF, per-tree CSV.

Text goes through Spark's CSV source, point files through ``scans``, which reads them in pieces. E57 and
LAZ need decoders that are not here, and are refused by name.
"""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scans
from .scans import POINT_SCHEMA

# Names that text columns go by.
NAMES = {"x": ("x", "easting", "east"), "y": ("y", "northing", "north"), "z": ("z", "elevation", "height"), "intensity": ("intensity", "reflectance"), "cls": ("classification", "class", "cls"), "return_no": ("return_number", "return"), "tree_id": ("tree_id", "treeid", "tree")}


# ---------------------------------------------------------------- delimited text


def sniff(sample: str) -> tuple[str, bool]:
    """(delimiter, decimal comma): the delimiter with most fields per line and least variance over five lines."""
    lines = [x for x in sample.lstrip("﻿").splitlines() if x.strip()][:5]

    def score(d: str) -> float:
        bare = [re.sub(r'"(?:[^"]|"")*"', "q", x) for x in lines]
        n = [len(re.split(r" +", x.strip())) if d == " " else x.count(d) + 1 for x in bare]
        return float(np.mean(n) - np.var(n)) if n and max(n) > 1 else -1.0

    best = max([";", "\t", ",", " "], key=score)
    comma = best != "," and any(re.search(r"\d,\d", x) for x in lines) and not any(re.search(r"\d\.\d", x) for x in lines)
    return best, comma


def guess_mapping(header: list[str]) -> dict[str, str]:
    """Standard name -> column: exact names first, then those that begin with the name and a blank or underscore."""
    low, out = {h.strip().lower(): h for h in header}, {}
    for name, known in NAMES.items():
        hit = next((low[k] for k in known if k in low), None) or next((h for k in known for l, h in low.items() if l.startswith((k + "_", k + " "))), None)
        if hit is not None:
            out[name] = hit
    return out


def number(c, comma: bool):
    """Strict: what is not wholly a number is null; a guard apostrophe in front is taken off."""
    s = F.trim(F.regexp_replace(c.cast("string"), r"^'(?=[=@+\-])", ""))
    s = F.regexp_replace(s, ",", ".") if comma else s
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def read_text(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Points of a text file; the delimiter and decimal comma come from its first lines, columns from the header or by position."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(6).collect())
    sep, comma = sniff(head)
    first = re.split(r" +", head.splitlines()[0].strip()) if sep == " " else head.lstrip("﻿").splitlines()[0].split(sep)
    has_header = any(re.search(r"[A-Za-z]", x) for x in first)
    raw = spark.read.option("sep", sep).option("header", has_header).option("ignoreLeadingWhiteSpace", True).csv(path)
    names = [c.lstrip("﻿/ ") for c in raw.columns]
    raw = raw.toDF(*names)
    use = mapping or (guess_mapping(names) if has_header else dict(zip(("x", "y", "z", "intensity"), names)))
    if not {"x", "y", "z"} <= set(use):
        raise ValueError(f"x, y and z are needed; found {sorted(use)}")
    out = raw.select(*(number(F.col(f"`{c}`"), comma).alias(n) for n, c in use.items()))
    return out.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def probe(spark: SparkSession, path: str, rows: int = 5) -> dict:
    """Columns, first rows and the guessed mapping."""
    lines = [r[0] for r in spark.read.text(path).limit(rows + 1).collect()]
    sep, comma = sniff("\n".join(lines))
    split = [re.split(r" +", x.strip()) if sep == " " else x.lstrip("﻿").split(sep) for x in lines]
    return {"delimiter": sep, "decimalComma": comma, "columns": split[0] if split else [], "rows": split[1:], "mapping": guess_mapping(split[0]) if split else {}}


def write_text(df: DataFrame, path: str, decimals: int = 3, sep: str = ",", header: bool = True) -> None:
    """Fixed decimals, halves away from zero, blanks for nulls, a guard before = @ + - in texts."""
    cols = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            cols.append(F.round(F.col(c), decimals).cast(f"decimal(30,{decimals})").cast("string").alias(c))
        elif t == "string":
            cols.append(F.when(F.col(c).rlike(r"^[=@+\-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    df.select(*cols).write.mode("overwrite").option("header", header).option("sep", sep).option("emptyValue", "").csv(path)


# ---------------------------------------------------------------- PLY as text


def ply_points(data: bytes) -> pd.DataFrame:
    """Vertices of an ASCII PLY file."""
    end = data.index(b"end_header") + len(b"end_header")
    end = data.index(b"\n", end - 1) + 1
    n, props, inside = 0, [], False
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            props.append(w[2])
    a = np.loadtxt(io.BytesIO(data[end:]), max_rows=n, ndmin=2) if n else np.zeros((0, len(props)))
    rec = {k: a[:, i] for i, k in enumerate(props)}
    pick = lambda *names: next((np.asarray(rec[k]) for k in names if k in rec), np.zeros(n))
    return pd.DataFrame({k: pick(k).astype(float) for k in "xyz"} | {"intensity": pick("intensity").astype("int32"), "cls": pick("classification", "class").astype("int32"), "return_no": pick("return_number").astype("int32"), "tree_id": pick("tree_id", "treeID").astype("int32")})


def read_points(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Points of LAS, PLY, PTX or text files by suffix; all but ASCII PLY are read in pieces, many tasks a file."""
    low = path.lower()
    if low.endswith((".laz", ".e57")):
        raise ValueError(f"{path}: no decoder for this format here")
    if low.endswith(".ptx"):
        return scans.read_ptx(spark, path)
    if low.endswith((".las", ".ply")):
        got = scans.read_records(spark, path)
        if got is not None:
            return got

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for content in p["content"]:
                    yield ply_points(bytes(content))

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, POINT_SCHEMA)
    return read_text(spark, path, mapping)


write_las = scans.write_las


# ---------------------------------------------------------------- drawings, grids, meshes (results of bounded size)


def geojson(lines: list[tuple[list[tuple[float, float]], dict]], closed: bool = False) -> str:
    kind = "Polygon" if closed else "LineString"
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": [[*map(list, v), list(v[0])]] if closed else [list(x) for x in v]}} for v, p in lines]})


def dxf_points(rows: Iterator[tuple[str, float, float, float]]) -> str:
    body = "".join(f"0\nPOINT\n8\n{layer}\n10\n{x:.3f}\n20\n{y:.3f}\n30\n{z:.3f}\n" for layer, x, y, z in rows)
    return f"0\nSECTION\n2\nENTITIES\n{body}0\nENDSEC\n0\nEOF\n"


def esri_ascii(grid: pd.DataFrame, size: float, value: str, nodata: float = -9999.0) -> str:
    """A long grid ``(col, row, value)`` as an ESRI ASCII raster, north up."""
    c0, r0 = int(grid["col"].min()), int(grid["row"].min())
    a = np.full((int(grid["row"].max()) - r0 + 1, int(grid["col"].max()) - c0 + 1), nodata)
    v = grid[value].to_numpy(float)
    a[grid["row"] - r0, grid["col"] - c0] = np.where(np.isfinite(v), v, nodata)
    head = f"ncols {a.shape[1]}\nnrows {a.shape[0]}\nxllcorner {c0 * size}\nyllcorner {r0 * size}\ncellsize {size}\nNODATA_value {nodata:g}\n"
    return head + "\n".join(" ".join(f"{x:g}" for x in row) for row in a[::-1]) + "\n"


def read_esri_ascii(text: str) -> tuple[pd.DataFrame, float]:
    head, rows = {}, []
    for line in text.splitlines():
        w = line.split()
        if len(w) == 2 and w[0][0].isalpha():
            head[w[0].lower()] = float(w[1])
        elif w:
            rows.append([float(x) for x in w])
    a, size = np.array(rows)[::-1], head["cellsize"]
    r, c = np.nonzero(a != head.get("nodata_value", -9999.0))
    return pd.DataFrame({"col": c + round(head["xllcorner"] / size), "row": r + round(head["yllcorner"] / size), "value": a[r, c]}), size


def geotiff(grid: pd.DataFrame, size: float, value: str, epsg: int | None = None) -> bytes:
    """A long grid as an uncompressed 32-bit float GeoTIFF, NaN for no data."""
    c0, r0, r1 = int(grid["col"].min()), int(grid["row"].min()), int(grid["row"].max())
    a = np.full((r1 - r0 + 1, int(grid["col"].max()) - c0 + 1), np.nan, "<f4")
    a[r1 - grid["row"], grid["col"] - c0] = grid[value]
    h, w = a.shape
    keys = [1, 1, 0, 2 if epsg else 1, 1025, 0, 1, 1] + ([3072, 0, 1, epsg] if epsg else [])
    extra = [(33550, 12, struct.pack("<3d", size, size, 0)), (33922, 12, struct.pack("<6d", 0, 0, 0, c0 * size, (r1 + 1) * size, 0)), (34735, 3, struct.pack(f"<{len(keys)}H", *keys))]
    tags = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, None), (277, 3, 1), (278, 4, h), (279, 4, a.nbytes), (339, 3, 3)]
    ifd = 8 + 2 + 12 * (len(tags) + len(extra)) + 4
    places, at = [], ifd
    for _, _, data in extra:
        places.append(at)
        at += len(data)
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags) + len(extra))
    for tag, kind, v in tags:
        out += struct.pack("<HHII", tag, kind, 1, at if v is None else v)
    for (tag, kind, data), where in zip(extra, places):
        out += struct.pack("<HHII", tag, kind, len(data) // {12: 8, 3: 2}[kind], where)
    return out + struct.pack("<I", 0) + b"".join(d for _, _, d in extra) + a.tobytes()


def height_mesh(grid: pd.DataFrame, size: float, value: str) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles) of a long grid: two triangles for each square of four known cells."""
    at = {(c, r): i for i, (c, r) in enumerate(zip(grid["col"], grid["row"]))}
    v = np.column_stack([(grid["col"] + 0.5) * size, (grid["row"] + 0.5) * size, grid[value]])
    faces = []
    for (c, r), i in at.items():
        q = [i, at.get((c + 1, r)), at.get((c + 1, r + 1)), at.get((c, r + 1))]
        if None not in q:
            faces += [(q[0], q[1], q[2]), (q[0], q[2], q[3])]
    return v, np.array(faces, int).reshape(-1, 3)


def obj_mesh(v: np.ndarray, faces: np.ndarray) -> str:
    return "".join(f"v {x:.4f} {y:.4f} {z:.4f}\n" for x, y, z in v) + "".join(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in faces)


def ply_mesh(v: np.ndarray, faces: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(v)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    rec = np.zeros(len(faces), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
    rec["n"], rec["v"] = 3, faces
    return head.encode() + np.asarray(v, "<f8").tobytes() + rec.tobytes()


def stl_mesh(v: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary STL file: 50 bytes a triangle."""
    rec = np.zeros(len(faces), np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    rec["v"] = v[faces] if len(faces) else np.zeros((0, 3, 3))
    n = np.cross(rec["v"][:, 1] - rec["v"][:, 0], rec["v"][:, 2] - rec["v"][:, 0])
    rec["n"] = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
    return b"silvaquery".ljust(80) + struct.pack("<I", len(faces)) + rec.tobytes()


def dxf_mesh(v: np.ndarray, faces: np.ndarray) -> str:
    """3DFACE entities; the fourth corner repeats the third."""
    rows = []
    for t in faces.tolist():
        rows.append("0\n3DFACE\n8\nMESH\n" + "".join(f"{10 + k}\n{v[i, 0]:.4f}\n{20 + k}\n{v[i, 1]:.4f}\n{30 + k}\n{v[i, 2]:.4f}\n" for k, i in enumerate([*t, t[2]])))
    return "0\nSECTION\n2\nENTITIES\n" + "".join(rows) + "0\nENDSEC\n0\nEOF\n"


def tubes(cylinders: list[tuple], sides: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles) of cylinders given as (start, end, radius)."""
    vs, fs = [], []
    for start, end, radius in cylinders:
        a, b = np.array(start, float), np.array(end, float)
        d = (b - a) / max(np.linalg.norm(b - a), 1e-12)
        u = np.cross(d, [0, 0, 1.0] if abs(d[2]) < 0.9 else [1.0, 0, 0])
        u /= np.linalg.norm(u)
        w, t = np.cross(d, u), 2 * np.pi * np.arange(sides) / sides
        ring = radius * (np.cos(t)[:, None] * u + np.sin(t)[:, None] * w)
        n = len(vs) * 2 * sides
        vs.append(np.vstack([a + ring, b + ring]))
        for i in range(sides):
            j = (i + 1) % sides
            fs += [(n + i, n + j, n + sides + j), (n + i, n + sides + j, n + sides + i)]
    return (np.vstack(vs) if vs else np.zeros((0, 3))), np.array(fs, int).reshape(-1, 3)
