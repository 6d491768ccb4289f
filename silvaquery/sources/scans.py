"""Point files that are read in pieces: LAS and binary PLY by ranges of records, PTX by ranges of bytes.

A file of any size is many tasks; each opens the file where its range begins and gives its points in batches. Only headers are read on the driver.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINT_SCHEMA = "x double, y double, z double, intensity int, cls int, return_no int, tree_id int"
#: Bytes of a range, and records of a batch.
RANGE_BYTES, BATCH = 32 << 20, 50_000


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files a path or pattern names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(where) or []
    out = []
    for f in found:
        for g in (store.listStatus(f.getPath()) if f.isDirectory() else [f]):
            # Hadoop writes local addresses with one slash.
            out.append((re.sub("^file:/(?!/)", "file:///", g.getPath().toString()), g.getLen()))
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def read_bytes(address: str, at: int, n: int) -> bytes:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(address)
    with store.open_input_file(base) as f:
        f.seek(at)
        return f.read(n)


# ---------------------------------------------------------------- records


def las_layout(head: bytes) -> dict:
    """Where a LAS file's records are and what is in them (formats 0 to 8), as far as the standard columns."""
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, = struct.unpack_from("<I", head, 96)
    kind, size, n = struct.unpack_from("<BHI", head, 104)
    if kind & 0x80:
        raise ValueError("LAZ is compressed; decompress it to LAS first")
    if head[25] >= 4 and not n:
        n, = struct.unpack_from("<Q", head, 247)
    late = kind >= 6
    own = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}.get(kind, size)
    fields = [["x", "<i4", 0], ["y", "<i4", 4], ["z", "<i4", 8], ["intensity", "<u2", 12], ["return_no", "u1", 14], ["cls", "u1", 16 if late else 15]] + ([["tree_id", "<i4", own]] if size >= own + 4 else [])
    return {"start": start, "size": size, "n": n, "fields": fields, "scale": struct.unpack_from("<3d", head, 131), "offset": struct.unpack_from("<3d", head, 155), "masks": {} if late else {"cls": 31}, "return_mask": 15 if late else 7}


# The type names of PLY files.
PLY_KINDS = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


def ply_layout(head: bytes) -> dict | None:
    """The same of a PLY file whose vertices come first; None where it is ASCII."""
    end = head.index(b"end_header") + len(b"end_header")
    end = head.index(b"\n", end - 1) + 1
    n, props, form, inside, first = 0, [], "ascii", False, True
    for line in head[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            if inside and not first:
                raise ValueError("vertices must be the first element of a PLY file")
            first = False
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            props.append((w[2], PLY_KINDS[w[1]]))
    if form == "ascii":
        return None
    named = {"classification": "cls", "class": "cls", "return_number": "return_no", "treeID": "tree_id"}
    at, fields = 0, []
    for name, kind in props:
        kind = kind.replace("<", ">") if form == "binary_big_endian" else kind
        if (own := named.get(name, name)) in ("x", "y", "z", "intensity", "cls", "return_no", "tree_id") and own not in [f[0] for f in fields]:
            fields.append([own, kind, at])
        at += np.dtype(kind).itemsize
    return {"start": end, "size": at, "n": n, "fields": fields, "scale": None, "offset": None, "masks": {}, "return_mask": None}


def records(data: bytes, layout: dict) -> pa.RecordBatch:
    names, kinds, places = zip(*layout["fields"])
    rec = np.frombuffer(data, np.dtype({"names": list(names), "formats": list(kinds), "offsets": list(places), "itemsize": layout["size"]}))
    out = {}
    for k, c in enumerate("xyz"):
        out[c] = rec[c] * layout["scale"][k] + layout["offset"][k] if layout["scale"] else rec[c].astype(float)
    for c in ("intensity", "cls", "return_no", "tree_id"):
        v = rec[c].astype(np.int32) if c in names else np.zeros(len(rec), np.int32)
        mask = layout["return_mask"] if c == "return_no" else layout["masks"].get(c)
        out[c] = v & mask if mask else v
    return pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))


class RecordRange(InputPartition):
    def __init__(self, address: str, layout: dict, first: int, n: int):
        self.address, self.layout, self.first, self.n = address, layout, first, n


class RecordReader(DataSourceReader):
    def __init__(self, files: list, range_bytes: int):
        self.files, self.range_bytes = files, range_bytes

    def partitions(self) -> list[RecordRange]:
        out = []
        for address, layout in self.files:
            step = max(1, self.range_bytes // max(layout["size"], 1))
            out += [RecordRange(address, layout, at, min(step, layout["n"] - at)) for at in range(0, layout["n"], step)]
        return out or [RecordRange("", {}, 0, 0)]

    def read(self, part: RecordRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not part.n:
            return
        store, base = fs.FileSystem.from_uri(part.address)
        size = part.layout["size"]
        with store.open_input_file(base) as f:
            f.seek(part.layout["start"] + part.first * size)
            left = part.n
            while left:
                n = min(left, BATCH)
                data = f.read(n * size)
                if len(data) < n * size:
                    raise ValueError(f"{part.address} ends before its last record")
                yield records(data, part.layout)
                left -= n


class RecordSource(DataSource):
    """``spark.read.format("scan_records").option("files", ...)``: files with their layouts as JSON."""

    @classmethod
    def name(cls) -> str:
        return "scan_records"

    def schema(self) -> str:
        return POINT_SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(json.loads(self.options["files"]), int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """Points of LAS or binary PLY files, a task for each range of records; None where a PLY file is ASCII."""
    found = []
    for address, _ in files_of(spark, path):
        head = read_bytes(address, 0, 65_536)
        layout = las_layout(head) if address.lower().endswith(".las") else ply_layout(head)
        if layout is None:
            return None
        found.append((address, layout))
    spark.dataSource.register(RecordSource)
    return spark.read.format("scan_records").option("files", json.dumps(found)).option("rangeBytes", range_bytes).load()


# ---------------------------------------------------------------- PTX

#: Lines of a scan's header: columns, rows, the scanner's place and axes, the pose.
PTX_HEAD = 10


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    rows = [(a, n, at, min(range_bytes, n - at)) for a, n in files_of(spark, path) for at in range(0, max(n, 1), range_bytes)]
    return spark.createDataFrame(rows, "address string, bytes long, at long, n long").repartition(len(rows), "address", "at")


def ptx_scans(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[list[dict], dict[tuple[str, int], int]]:
    """(scans with file, number, first line of points, points and pose; the number of lines before each range).

    Tasks count the lines of their ranges; the driver then reads headers alone, each where it must be.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [read_bytes(a, at, k).count(b"\n") for a, at, k in zip(*(b.column(c).to_pylist() for c in ("address", "at", "n")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "lines"])

    counted = _ranges(spark, path, range_bytes).mapInArrow(count, "address string, bytes long, at long, n long, lines long").orderBy("address", "at").collect()
    scans, before = [], {}
    for address in dict.fromkeys(r["address"] for r in counted):
        own, total = [r for r in counted if r["address"] == address], 0
        for r in own:
            before[address, r["at"]] = total
            total += r["lines"]
        line, number = 0, 0
        while line < total:
            # The last range that the header's line begins in or behind: a range may begin inside a line.
            r = max((r for r in own if before[address, r["at"]] < line or not r["at"]), key=lambda r: r["at"])
            skip, seen, chunks, at = line - before[address, r["at"]], 0, [], r["at"]
            while seen < skip + PTX_HEAD and at < r["bytes"]:
                chunks.append(read_bytes(address, at, 1 << 20))
                seen, at = seen + chunks[-1].count(b"\n"), at + (1 << 20)
            head = b"".join(chunks).split(b"\n", skip + PTX_HEAD)[skip:skip + PTX_HEAD]
            if len(head) < PTX_HEAD or not head[0].strip():
                break
            cols, rows = int(head[0]), int(head[1])
            # The file has the pose's columns as lines.
            pose = np.array([[float(v) for v in x.split()] for x in head[6:10]]).T
            scans.append({"address": address, "number": number, "first": line + PTX_HEAD, "n": cols * rows, "pose": pose.ravel().tolist()})
            line, number = line + PTX_HEAD + cols * rows, number + 1
    return scans, before


def read_ptx(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, posed: bool = True) -> DataFrame:
    """Points of PTX files with ``scan``, the number of their scan in the file; rays without a return (0 0 0) are left out.

    ``posed``: in world coordinates by each scan's pose, else in the scanner's own. Columns by their number: x y z, and intensity (0 to 1 becomes 16 bits) where there are 4 or 7.
    """
    scans, before = ptx_scans(spark, path, range_bytes)
    names = ["x", "y", "z", "intensity", "cls", "return_no", "tree_id", "scan"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address, size, at, n in zip(*(b.column(c).to_pylist() for c in ("address", "bytes", "at", "n"))):
                # A line belongs to the range that it begins in; one that begins at the border belongs to the later one.
                data = read_bytes(address, at, n)
                end = at + n
                while end < size and not data.endswith(b"\n"):
                    more = read_bytes(address, end, 1 << 12)
                    cut = more.find(b"\n")
                    data, end = data + (more if cut < 0 else more[:cut + 1]), end + len(more)
                lines = data.split(b"\n")
                number = before[address, at]
                if at and read_bytes(address, at - 1, 1) != b"\n":
                    lines, number = lines[1:], number + 1
                for s in scans:
                    own = lines[max(0, s["first"] - number):max(0, s["first"] + s["n"] - number)] if s["address"] == address else []
                    for k in range(0, len(own), BATCH):
                        text = b"\n".join(x for x in own[k:k + BATCH] if x.strip())
                        if not text:
                            continue
                        width = len(text.split(b"\n", 1)[0].split())
                        v = np.array(text.split(), float).reshape(-1, width)
                        v = v[(v[:, :3] != 0).any(1)]
                        pose = np.array(s["pose"]).reshape(4, 4)
                        xyz = v[:, :3] @ pose[:3, :3].T + pose[:3, 3] if posed else v[:, :3]
                        shine = np.round(np.clip(v[:, 3], 0, 1) * 65535).astype(np.int32) if width in (4, 7) else np.zeros(len(v), np.int32)
                        none = np.zeros(len(v), np.int32)
                        yield pa.RecordBatch.from_arrays([*(pa.array(xyz[:, c]) for c in range(3)), pa.array(shine), pa.array(none), pa.array(none), pa.array(none), pa.array(np.full(len(v), s["number"], np.int32))], names=names)

    return _ranges(spark, path, range_bytes).mapInArrow(run, POINT_SCHEMA + ", scan int")


# ---------------------------------------------------------------- writing


LAS_RECORD = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("return_no", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("point_source_id", "<u2"), ("tree_id", "<i4")])


def las_header(n: int, low: np.ndarray, high: np.ndarray, offset: np.ndarray, scale: float, size: int) -> bytes:
    """The header of a LAS 1.2 file, point format 0 with more bytes a record."""
    head = struct.pack("<4sHHIHH8sBB32s32sHHHII", b"LASF", 0, 0, 0, 0, 0, b"\0" * 8, 1, 2, b"silvaquery", b"silvaquery", 1, 2026, 227, 227, 0)
    head += struct.pack("<BHI5I", 0, size, n, n, 0, 0, 0, 0)
    return head + struct.pack("<12d", scale, scale, scale, *offset, high[0], low[0], high[1], low[1], high[2], low[2])


def write_las(points: DataFrame, path: str, scale: float = 0.001) -> None:
    """One LAS file per partition below ``path``, tree ids in 4 extra bytes; a file is renamed when whole, so a lost task leaves none cut short.

    Batches become records as they come; a task holds 24 bytes a point.
    """
    from pyspark import TaskContext

    where = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held, n, offset, low, high = [], 0, None, np.full(3, np.inf), np.full(3, -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            xyz = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
            offset = np.floor(xyz.min(0)) if offset is None else offset
            rec = np.zeros(b.num_rows, LAS_RECORD)
            for k, c in enumerate("xyz"):
                rec[c] = np.round((xyz[:, k] - offset[k]) / scale)
            for c in LAS_RECORD.names:
                if c in b.schema.names and c not in "xyz":
                    rec[c] = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
            low, high, n = np.minimum(low, xyz.min(0)), np.maximum(high, xyz.max(0)), n + b.num_rows
            held.append(rec.tobytes())
        if n:
            store, base = fs.FileSystem.from_uri(where)
            store.create_dir(base, recursive=True)
            name = f"{base}/part-{TaskContext.get().partitionId():05d}.las"
            own = f"{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as f:
                f.write(las_header(n, low, high, offset, scale, LAS_RECORD.itemsize))
                for x in held:
                    f.write(x)
            store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    cols = [c for c in LAS_RECORD.names if c in points.columns]
    points.select(*cols).mapInArrow(run, "n long").agg(F.sum("n")).collect()
