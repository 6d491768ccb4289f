"""Helpers shared by the operators: shared folder, written tables, folds, Arrow passes."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from ``spark.checkpoint.dir``; where it is unset, one is made for local sessions, and others are refused."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = worker_cache().setdefault("shared_dir", "file://" + tempfile.mkdtemp(prefix="silvaquery-"))
    spark.sparkContext.setCheckpointDir(own)
    return own


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop's API."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    store, where = hadoop_path(spark, path)
    store.deleteOnExit(where)
    return path


#: Of files whose rows are large: bytes of a row group, which is held while it is written; each row is a page of its own,
#: as Parquet looks at sizes every 100 rows otherwise and compresses, and reads, a page as a whole.
LARGE_ROWS = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
#: Where rows are large: bytes after which no row is added to an Arrow batch, rows that are read from files at a time.
BATCH_BYTES, READ_ROWS = 4 << 20, 2


def written(df: DataFrame, tag: str, batch_rows: int | None = None, large: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and lost executors lose nothing.

    ``batch_rows``: so many rows go to Python at a time while it is made, where what it reads has large rows; ``large``: its own rows are large.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with small_batches(spark, batch_rows) if batch_rows else nullcontext():
        df.write.options(**(LARGE_ROWS if large else {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once nothing will read it again (any other table is left alone); shuffles that made it are let go as well."""
    folder = getattr(df, "written_to", None)
    if folder is None:
        return
    store, where = hadoop_path(df.sparkSession, folder)
    store.delete(where, True)
    # Spark deletes a shuffle's files when the driver's collector finds nothing that refers to it.
    df.sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows or fewer, in Arrow and as files are read, for tables whose rows are large, in what is run inside."""
    now = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}
    before = {name: spark.conf.get(name) for name in now}
    for name, value in now.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def drawn_at_most(rows: DataFrame, most: int, tag: str) -> DataFrame:
    """Distinct ``rows``; where they are more than ``most``, a draw by their hash that ``most`` are expected in."""
    rows = written(rows.distinct(), tag)
    n = rows.count()
    return rows if n <= most else rows.filter(hash_share(*rows.columns) < most / n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)).cast("int")


def hash_share(*cols: str | Column) -> Column:
    """A number in [0, 1) drawn from the columns' hash; a row always gets the same one."""
    return F.pmod(F.xxhash64(*cols, F.lit("share")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def worker_cache() -> dict:
    """What one Python process keeps between its tasks (a loaded tokenizer, say)."""
    return sys.__dict__.setdefault("_silvaquery_cache", {})


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def add_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, str]], make: Callable[[], Callable]) -> DataFrame:
    """Append columns computed from ``inputs`` by an Arrow pass; all columns of ``df`` go through untouched.

    ``make()`` runs once in each task and gives a function from lists of values (one list per
    input) to one list or array per new field. Names that ``df`` has already get underscores in front.
    """
    taken, names = list(df.columns), []
    for name, _ in fields:
        names.append(free_name(taken + names, name))
    places = [df.columns.index(c) for c in inputs]
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T._parse_datatype_string(t)) for n, (_, t) in zip(names, fields)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(schema.fields[len(df.columns):]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in bounded(batch, places[-1]):
                got = compute(*(part.column(i).to_pylist() for i in places))
                new = [pa.array(v, type=f.type) for v, f in zip(got, arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, column: int, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows and about 8 MB of ``column``; a single longer row stays whole."""
    start, size = 0, batch.nbytes
    step = max(1, min(rows, batch.num_rows if size < 8 << 20 else batch.num_rows * (8 << 20) // size))
    while start < batch.num_rows:
        yield batch.slice(start, step)
        start += step


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as tables of about ``rows`` rows that cut no group of equal keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        changed = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            changed[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(changed)
        if len(cut):
            yield t.slice(0, int(cut[-1]))
            t = t.slice(int(cut[-1]))
        held, size = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def words_of(text: str | None) -> list[bytes]:
    """The contract's words, with A-Z lower-cased: bytes.lower and bytes.split know ASCII letters and blanks only."""
    return text.encode().lower().split() if text else []
