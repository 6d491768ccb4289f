"""Neighbour search inside tasks: points are dealt to blocks a few radii wide, with a halo of one radius, and searched there by sorted cells.

One shuffle moves each point once and those near a border a few times; pairs exist in a task only, some millions at a time, and
what leaves it are counts, sums, links or the k nearest. Blocks are as wide as the points' density allows.

Points in one place have the same neighbourhood: it is searched once, for the place, and a place counts as often as it has points. So pairs
grow with the square of the places in a neighbourhood, not of the points.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

#: Points that a block should hold, on average of the blocks there are; pairs that are looked at together.
BLOCK_POINTS, PAIRS = 30_000, 2_000_000
#: Widths of blocks, in radii.
WIDTHS = (32, 16, 8, 4, 2)
#: Rows of a table that may go whole to every task.
FEW_ROWS = 100_000


def shared_folder(df: DataFrame) -> str:
    """The session's folder for checkpoints; where it names none, a local one gets its own, and others are refused."""
    sc = df.sparkSession.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="silvaquery-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: a small part of a checkpoint's disk, since columns are packed."""
    path = f"{shared_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` that nothing will read again."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        where.getFileSystem(conf).delete(where, True)


def by_size(df: DataFrame) -> DataFrame:
    """``df`` with the hint for a join: few rows go to every task, more are merged."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df.hint("merge")


def spots(points: DataFrame, *at: str, **more: Column) -> DataFrame:
    """The distinct values of columns ``at`` with ``m``, how many points have them, and aggregates ``more``; points without a value are in none."""
    known = points
    for c in at:
        known = known.filter(F.col(c).isNotNull())
    return cut_lineage(known.groupBy(*at).agg(F.count(F.lit(1)).alias("m"), *(v.alias(k) for k, v in more.items())))


def block_width(points: DataFrame, radius: float, dims: str, by: tuple[str, ...] = ()) -> float:
    """The widest of the widths whose occupied blocks hold ``BLOCK_POINTS`` on average, in one pass with small sketches."""
    cells = points.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(F.hash(*by, *(S.cell(F.col(c), radius * w) for c in dims))).alias(f"w{w}") for w in WIDTHS)).first()
    return radius * next((w for w in WIDTHS if cells["n"] / max(1, cells[f"w{w}"]) <= BLOCK_POINTS), WIDTHS[-1])


def close_pairs(own: np.ndarray, other: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, squared distance)`` of rows of ``own`` and ``other`` at most ``radius`` apart, ascending by i and j; all of one i come together."""
    if not len(own) or not len(other):
        return
    d = own.shape[1]
    low = np.minimum(own.min(0), other.min(0)) - radius
    a, b = (np.floor((v - low) / radius).astype(np.int64) for v in (own, other))
    size = np.maximum(a.max(0), b.max(0)) + 2
    step = np.cumprod(np.append(1, size[:0:-1]))[::-1].astype(np.int64)
    key = b @ step
    order = np.argsort(key, kind="stable")
    key = key[order]
    # Cells that follow one another in the last dimension are one run of the sorted rows.
    shifts = np.array(list(itertools.product((-1, 0, 1), repeat=d - 1)), np.int64).reshape(3 ** (d - 1), d - 1)
    centre = a @ step
    runs = centre[:, None] + (shifts @ step[:-1])[None]
    begin, end = np.searchsorted(key, runs - 1), np.searchsorted(key, runs + 1, "right")
    many = (end - begin).sum(1)
    upto, at = np.cumsum(many), 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = (end[at:to] - begin[at:to]).ravel()
        total = int(n.sum())
        j = order[np.repeat(begin[at:to].ravel() - np.cumsum(n) + n, n) + np.arange(total)]
        i = np.repeat(np.arange(at, to), many[at:to])
        d2 = ((own[i] - other[j]) ** 2).sum(1)
        near = np.flatnonzero(np.sqrt(d2) <= radius)
        near = near[np.lexsort((j[near], i[near]))]
        yield i[near], j[near], d2[near]
        at = to


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as one table a block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        cut = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for at, to in zip(cut, cut[1:]):
            now = tuple(c[at].as_py() for c in columns)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def searched(left: DataFrame, right: DataFrame, radius: float, dims: str, work: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: str | T.StructType, by: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """``work(left rows, right rows)`` for each block: each row of ``left`` is in one, rows of ``right`` in all they are within ``radius`` of.

    ``by``: columns that must be equal; ``order``: a column that a block's right rows are sorted by.
    """
    if not radius > 0:
        raise ValueError("a radius is above zero")
    width = block_width(right.select(*by, *dims), radius, dims, by)
    keys = [*by, *(f"block_{c}" for c in dims)]
    for c in dims:
        left = left.withColumn(f"block_{c}", S.cell(F.col(c), width))
        # A little more than the radius, so that rounding loses no pair.
        right = right.withColumn(f"block_{c}", F.explode(F.sequence(S.cell(F.col(c) - 1.0001 * radius, width), S.cell(F.col(c) + 1.0001 * radius, width))))
    names = lambda df: [c for c in df.columns if not c.startswith("block_")]
    one, two = names(left), names(right)
    none = lambda df, cols: F.lit(None).cast(T.StructType([df.schema[c] for c in cols]))
    rows = left.select(*keys, F.lit(False).alias("is_right"), F.struct(*one).alias("l"), none(right, two).alias("r")).unionByName(right.select(*keys, F.lit(True).alias("is_right"), none(left, one).alias("l"), F.struct(*two).alias("r")))
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, keys):
            n = pc.sum(pc.invert(table.column("is_right"))).as_py()
            if not n:
                continue
            part = lambda c, at, m: pa.Table.from_batches(map(pa.RecordBatch.from_struct_array, table.column(c).slice(at, m).chunks), pa.schema(table.schema.field(c).type))
            for got in work(part("l", 0, n), part("r", n, table.num_rows - n)):
                yield from got.combine_chunks().to_batches(max_chunksize=50_000)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "is_right", *([f"r.{order}"] if order else [])).mapInArrow(run, out)


def places(table: pa.Table, dims: str) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in dims], axis=1) if table.num_rows else np.zeros((0, len(dims)))


def each_left(left: pa.Table, right: pa.Table, radius: float, dims: str, measure: Callable[[np.ndarray, np.ndarray, np.ndarray, int], dict[str, np.ndarray]], keep: list[str]) -> Iterator[pa.Table]:
    """One row for each left row: its columns ``keep`` and what ``measure(i, j, d2, n)`` makes of the pairs, whose i count from 0 in each part."""
    own, other, at = places(left, dims), places(right, dims), 0
    for i, j, d2 in close_pairs(own, other, radius) if len(other) else ():
        # Left rows without a pair belong to the part that follows them.
        to = int(i[-1]) + 1 if len(i) else at
        if to > at:
            got = measure(i - at, j, d2, to - at)
            yield _with(left.slice(at, to - at).select(keep), got)
            at = to
    if at < left.num_rows:
        none = np.zeros(0, np.int64)
        yield _with(left.slice(at).select(keep), measure(none, none, np.zeros(0), left.num_rows - at))


def _with(table: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
    for name, values in columns.items():
        table = table.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return table


def first_k(i: np.ndarray, j: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the pairs that are the k nearest of their i, ties by j; their ranks from 1)."""
    order = np.lexsort((j, d2, i))
    own = i[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    kept = rank < k
    return order[kept], rank[kept] + 1


# ---------------------------------------------------------------- what neighbourhoods are asked for


def counts_within(left: DataFrame, right: DataFrame, radius: float, dims: str = "xyz", by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with ``n``: rows of ``right`` at most ``radius`` away."""
    at = [*by, *dims]
    n = spot_counts(left.select(*at).distinct(), spots(right, *at), radius, dims, by)
    return left.join(n, at, "left").select(*left.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def spot_counts(left: DataFrame, right: DataFrame, radius: float, dims: str = "xyz", by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with ``n``: points at most ``radius`` away, of which each row of ``right`` has ``m`` in its place."""
    keep = left.columns
    schema = T.StructType([*left.schema.fields, T.StructField("n", T.LongType())])

    def work(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        m = r.column("m").to_numpy()
        yield from each_left(l, r, radius, dims, lambda i, j, d2, n: {"n": np.bincount(i, m[j], n).astype(np.int64)}, keep)

    return searched(left, right.select(*by, *dims, "m"), radius, dims, work, schema, by)


def moments_within(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with ``n``, the mean ``mx, my, mz`` and the covariance ``cxx .. czz`` of the rows of ``right`` at most ``radius`` away; without any, null."""
    at = [*by, *"xyz"]
    got = spot_moments(left.select(*at).distinct(), spots(right, *at), radius, by)
    out = left.join(got, at, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select(*left.columns, *(c for c in got.columns if c not in at))


def spot_moments(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``moments_within`` of points of which each row of ``right`` has ``m`` in its place."""
    names = ["n", "mx", "my", "mz", "cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
    schema = T.StructType([*left.schema.fields, T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names[1:])])
    keep = left.columns

    def work(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        own, other, m = places(l, "xyz"), places(r, "xyz"), r.column("m").to_numpy()
        done = 0

        def measure(i: np.ndarray, j: np.ndarray, d2: np.ndarray, n: int) -> dict[str, np.ndarray]:
            nonlocal done
            here = own[done:done + n]
            done += n
            # About the left point itself, so that coordinates far from the origin cost no digits.
            off, w = other[j] - here[i], m[j]
            many = np.bincount(i, w, n).astype(np.int64)
            some = np.maximum(many, 1)
            mean = np.stack([np.bincount(i, w * off[:, c], n) / some for c in range(3)], axis=1)
            out = {"n": many} | {f"m{c}": here[:, k] + mean[:, k] for k, c in enumerate("xyz")}
            for p in range(3):
                for q in range(p, 3):
                    out[f"c{'xyz'[p]}{'xyz'[q]}"] = np.bincount(i, w * off[:, p] * off[:, q], n) / some - mean[:, p] * mean[:, q]
            return {k: v if k == "n" else pa.array(v, mask=many == 0) for k, v in out.items()}

        yield from each_left(l, r, radius, "xyz", measure, keep)

    return searched(left, right.select(*by, "x", "y", "z", "m"), radius, "xyz", work, schema, by)


def nearest_within(left: DataFrame, right: DataFrame, radius: float, k: int, dims: str, other: bool) -> DataFrame:
    """The k nearest of ``right(b, ...)`` at most ``radius`` from each row of ``left(a, ...)``, ties by b: left's columns, right's, its place as ``rx`` .., ``distance`` and ``rank``."""
    keep, rest = left.columns, [c for c in right.columns if c not in dims]
    schema = T.StructType([*left.schema.fields, *(right.schema[c] for c in rest), *(T.StructField(f"r{c}", T.DoubleType()) for c in dims), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def work(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        own, there = places(l, dims), places(r, dims)
        for i, j, d2 in close_pairs(own, there, radius):
            at, rank = first_k(i, j, d2, k + other)
            if other:
                at = at[~_same(l, r, i[at], j[at])]
                rank = np.arange(len(at)) - np.searchsorted(i[at], i[at]) + 1
                at, rank = at[rank <= k], rank[rank <= k]
            out = l.take(pa.array(i[at])).select(keep)
            for c in rest:
                out = out.append_column(c, r.column(c).take(pa.array(j[at])))
            yield _with(out, {f"r{c}": there[j[at], n] for n, c in enumerate(dims)} | {"distance": np.sqrt(d2[at]), "rank": rank.astype(np.int32)})

    return searched(left, right, radius, dims, work, schema, order="b")


def _same(l: pa.Table, r: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j are one: a equals b."""
    return pc.fill_null(pc.equal(l.column("a").take(pa.array(i)), r.column("b").take(pa.array(j))), False).to_numpy(zero_copy_only=False) if len(i) else np.zeros(0, bool)


def mean_distances(left: DataFrame, right: DataFrame, radius: float, k: int) -> DataFrame:
    """``left(x, y, z, m)`` with ``n``, how many of the k nearest others a point of the place has within ``radius``, and ``d``, the mean of their distances.

    Each row of ``right`` has ``m`` points in its place; those of ``left`` are among them.
    """
    schema = T.StructType([*left.schema.fields, T.StructField("n", T.LongType()), T.StructField("d", T.DoubleType())])
    keep = left.columns

    def work(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        m = r.column("m").to_numpy()

        def measure(i: np.ndarray, j: np.ndarray, d2: np.ndarray, n: int) -> dict:
            # k + 1 places hold the k nearest others and the point itself, which is in the first.
            at, rank = first_k(i, j, d2, k + 1)
            i, w = i[at], m[j[at]] - (rank == 1)
            before = np.cumsum(w) - w
            before -= before[np.searchsorted(i, i)]
            w = np.clip(k - before, 0, w)
            many = np.bincount(i, w, n).astype(np.int64)
            return {"n": many, "d": pa.array(np.bincount(i, w * np.sqrt(d2[at]), n) / np.maximum(many, 1), mask=many == 0)}

        yield from each_left(l, r, radius, "xyz", measure, keep)

    return searched(left, right.select("x", "y", "z", "m"), radius, "xyz", work, schema)


def measured_pairs(left: DataFrame, right: DataFrame, radius: float, fields: str, measure: Callable, by: tuple[str, ...] = (), dims: str = "xyz", order: str | None = None) -> DataFrame:
    """``left`` with what ``measure(left rows, right rows, i, j, d2)`` makes of a part's pairs: one value for each left row and field; i count left rows of the part."""
    schema = T.StructType([*left.schema.fields, *T._parse_datatype_string(fields).fields])
    keep = left.columns

    def work(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        done = 0

        def part(i: np.ndarray, j: np.ndarray, d2: np.ndarray, n: int) -> dict:
            nonlocal done
            rows = l.slice(done, n)
            done += n
            return measure(rows, r, i, j, d2)

        yield from each_left(l, r, radius, dims, part, keep)

    return searched(left, right, radius, dims, work, schema, by, order)
