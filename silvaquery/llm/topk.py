"""Exact top-k inner products over norm-sorted vectors.

Candidates are taken by descending length. Both sides are rotated by the right singular vectors of a bounded
sample, which gathers most of each product in the first coordinates and changes none; then, for a block of
candidates and a query with k-th best score s so far:

  * |q| * (longest length left) < s: nothing further in this run can enter, the query is done;
  * partial product over the leading coordinates + |q rest| * |c rest| < s (Cauchy-Schwarz): c is pruned;
  * what is left is scored exactly, in integers: of 64 bits where the lengths' product says that they suffice, else
    of any size.

Bounds carry a margin for rounding, so pruning never decides a tie. A first pass scores every query against
the ``head`` longest candidates (a set of that fixed size) for its starting s. The second goes through the candidates'
partitions; each reads the queries in blocks from the shared folder, one block in memory at a time,
and returns only candidates that reach s. The best k of those are the answer.

Defined cases: vectors that are null, empty, or hold null or non-finite components (or such that overflow when scaled) take no part, nor do rows
with a null id; zero vectors do; vectors of other lengths than one another are compared as if padded with zeros;
repeated rows are candidates, and queries, of their own (their number stands beside the distinct row), and an id with several vectors is a candidate with
each, but never of a query with that id; results of queries with one id are ranked together; fewer than k candidates give fewer rows; an empty table gives an empty result; other columns are not read. Scores are ranked as they are;
those beyond 64 bits are shown as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, new_path, written
from .pstable import to_matrix

#: Fixed sizes: rows the rotation is fitted on, longest candidates that every query meets first, queries in a block.
SAMPLE, HEAD, BLOCK = 4096, 2048, 1024


#: Products of lengths below this leave 64-bit sums exact.
NARROW = float(1 << 62)
#: Bytes of a score that 64 bits do not hold: a product of doubles, times a count.
WIDE_BYTES = 280


def quantised(vector: Column, scale: int = 1024) -> Column:
    """Integers as doubles; from 2**52 on, doubles are integers already."""
    y = lambda x: x.cast("double") * F.lit(float(scale))
    return F.transform(vector, lambda x: F.when(F.abs(y(x)) < float(1 << 52), F.floor(y(x)).cast("double")).otherwise(y(x)))


def below(score: np.ndarray) -> np.ndarray:
    """Doubles that are not above the scores."""
    top = np.finfo(float).max
    f = np.array([float(min(max(v, -int(top)), int(top))) for v in score.tolist()]) if score.dtype == object else score.astype(float)
    return np.where(np.abs(f) < float(1 << 53), f, f - np.abs(f) * 2.0**-52)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integer-valued doubles as Python integers."""
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())] + [None], object)[:-1]


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample, strongest first."""
    return np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) else np.eye(sample.shape[1])


def _padded(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x


class Run:
    """Candidates of one run, by descending length, with their rotated partial sums."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: np.ndarray, lead: int, copies: np.ndarray | None = None):
        with np.errstate(all="ignore"):
            length = np.sqrt((vectors * vectors).sum(1))
            order = np.lexsort((ids, -length))
            self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
            self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
            # Where a component is beyond 64 bits its pairs are never counted so.
            self.whole = self.vectors.astype(np.int64)
            turned = self.vectors @ basis
            self.front, self.lead = turned[:, :lead], lead
            self.rest = np.sqrt((turned[:, lead:] ** 2).sum(1))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, basis: np.ndarray, floor: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate id, score, copies of the candidate) of at most k distinct candidates per query that reach ``floor``; ties by smaller id."""
        with np.errstate(all="ignore"):
            size = np.sqrt((queries * queries).sum(1))
            turned = queries @ basis
            front, rest = turned[:, :self.lead], np.sqrt((turned[:, self.lead:] ** 2).sum(1))
            bar, whole = floor.copy(), queries.astype(np.int64)
            kept_q, kept_id, kept_s, kept_n = (np.zeros(0, np.int64) for _ in range(4))
            for at in range(0, len(self.ids), block):
                slack = 1e-6 * (1 + size * self.length[at])
                ceiling = size * self.length[at] + slack
                # What overflows is no bound: it counts as unlimited.
                live = np.flatnonzero((ceiling >= bar) | np.isnan(ceiling))
                if not len(live):
                    break
                c = slice(at, at + block)
                bound = front[live] @ self.front[c].T + np.outer(rest[live], self.rest[c]) + slack[live, None]
                qi, ci = np.nonzero((bound >= bar[live, None]) | ~np.isfinite(bound))
                qi, ci = live[qi], ci + at
                other = query_ids[qi] != self.ids[ci]
                qi, ci = qi[other], ci[other]
                score = np.concatenate([np.einsum("ij,ij->i", whole[qi[p:p + 65536]], self.whole[ci[p:p + 65536]]) for p in range(0, len(qi), 65536)] or [np.zeros(0, np.int64)])
                wide = np.flatnonzero(~(size[qi] * self.length[ci] < NARROW))
                if len(wide):
                    score = score.astype(object)
                    score[wide] = exact_products(queries[qi[wide]], self.vectors[ci[wide]])
                reach = below(score) >= bar[qi]
                q, i, s, n = np.concatenate((kept_q, qi[reach])), np.concatenate((kept_id, self.ids[ci[reach]])), np.concatenate((kept_s, score[reach])), np.concatenate((kept_n, self.copies[ci[reach]]))
                order = np.array(sorted(range(len(q)), key=lambda t: (q[t], -s[t], i[t])), np.int64) if s.dtype == object else np.lexsort((i, -s, q))
                q, i, s, n = q[order], i[order], s[order], n[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                kept_q, kept_id, kept_s, kept_n = (v[place < k] for v in (q, i, s, n))
                full = place == k - 1
                bar[q[full]] = np.maximum(bar[q[full]], below(s[full]))
        return kept_q, kept_id, kept_s, kept_n


def shown(score: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(scores as 64-bit numbers, order among those that are beyond them as bytes)."""
    low, high = -(1 << 63), (1 << 63) - 1
    if score.dtype != object:
        return pa.array(score), pa.nulls(len(score), pa.binary())
    v = score.tolist()
    return pa.array([min(max(x, low), high) for x in v], pa.int64()), pa.array([None if low <= x <= high else (x + (1 << (8 * WIDE_BYTES - 1))).to_bytes(WIDE_BYTES, "big") for x in v], pa.binary())


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, lead: int = 16) -> DataFrame:
    """``queries`` and ``vectors`` have the same columns -> ``(query_id, rank, vec_id, score)``."""
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        ok = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) != float("inf"))), F.lit(False))
        return df.filter(ok).select(F.col(vec_id).cast("long").alias("id"), quantised(v, scale).alias("v"))

    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    counted = lambda df: sound(df).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    all_rows = written(counted(vectors).withColumn("len2", square), "topk-candidates")
    query_path = new_path(spark, "topk-queries")
    asked = written(counted(queries), "topk-asked")
    n = all_rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The longest vectors are named by length and id alone, so that tasks send the driver no vectors that don't stay.
    last = all_rows.select("len2", "id").orderBy(F.desc("len2"), "id").limit(HEAD).agg(F.min(F.struct("len2", (-F.col("id")).alias("i")))).first()[0]
    head = all_rows.filter((F.col("len2") > last["len2"]) | ((F.col("len2") == last["len2"]) & (F.col("id") <= -last["i"]))).select("id", "v").limit(2 * HEAD).toPandas()
    sample = all_rows.filter(hash_share("id", "v") <= min(1.0, SAMPLE / n)).select("v").limit(2 * SAMPLE).toPandas()
    dims = max(all_rows.agg(F.max(F.size("v"))).first()[0], asked.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0])

    def dense(column) -> np.ndarray:
        return _padded(to_matrix(pa.array(column, pa.list_(pa.float64()))), dims)

    basis = rotation(dense(sample["v"].tolist()))
    head_ids, head_vectors = head["id"].to_numpy(), dense(head["v"].tolist())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Run(head_ids, head_vectors, basis, lead)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _padded(to_matrix(part.column("v")), dims)
                q, _, s, _ = run.best(part.column("id").to_numpy(), x, basis, np.full(len(x), -np.inf), k)
                low = np.full(len(x), -np.inf)
                count = np.bincount(q, minlength=len(x))
                least = np.full(len(x), np.inf)
                np.minimum.at(least, q, below(s))
                low[count >= k] = least[count >= k]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(low)], names=["id", "v", "copies", "low"])

    asked.mapInArrow(first, "id long, v array<double>, copies long, low double").write.parquet(query_path)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        run = Run(t.column("id").to_numpy(), _padded(to_matrix(t.column("v").chunk(0)), dims), basis, lead, t.column("copies").to_numpy())
        store, base = fs.FileSystem.from_uri(query_path)
        for part in dataset.dataset(base, filesystem=store, format="parquet").to_batches(batch_size=BLOCK):
            if part.num_rows:
                ids = part.column("id").to_numpy()
                q, i, s, n = run.best(ids, _padded(to_matrix(part.column("v")), dims), basis, part.column("low").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), *shown(s), pa.array(np.minimum(n * part.column("copies").to_numpy()[q], k))], names=["query_id", "vec_id", "score", "wide", "copies"])

    found = all_rows.select("id", "v", "copies").mapInArrow(rest, "query_id long, vec_id long, score long, wide binary, copies long")
    # More than k copies never show.
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
