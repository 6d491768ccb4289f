"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its input partition as they come. A document's ids (with the end id) are cut
into full windows, which need no partner, and a rest. The rest goes on top of an open window of
level h, or into a new one (h = 0), so that the sum of squared counts of partially filled
windows by level is least after it: moving one window from level h to h + s changes that sum by
2 (N[h + s] - N[h]) + 2, a window filled up exactly by 1 - 2 N[h], a new one by 2 N[s] + 1. The
counts N are one array indexed by level. Ties go to the fullest window. What is still open when the
partition ends is poured together: the emptiest windows are cut to fill the fullest, so that a task
pads one window at most. Windows are independent of other tasks, so no row is shuffled and a lost
task is simply run again with the same result.

Defined cases: a null or empty text is its end id alone; repeated rows and null doc_ids are packed like
any others; an empty table gives an empty result; only the two named columns are read, so that other
columns of any name do not interfere. Very long texts become full windows one after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .encoding import Encoder, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Open windows by level. ``pieces`` go out as (document, start, ids, document's length, window, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(capacity)]
        self.windows = 0

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, doc: object, ids: np.ndarray) -> list[tuple]:
        """Pack one document; returns the pieces of windows that are full now."""
        size, cap, out = len(ids), self.capacity, []
        cut = size // cap * cap
        for at in range(0, cut, cap):
            out.append((doc, at, ids[at:at + cap], size, self._new(), 0))
        rest = size - cut
        if not rest:
            return out
        n = self.counts
        # Change of the sum of squares, halved, for h = 0 .. cap - rest; level 0 and a full window count for nothing.
        after = n[rest:cap + 1].astype(float)
        after[-1] = -0.5
        before = n[:cap - rest + 1] - 1.0
        before[0] = -0.5
        change = np.where(n[:cap - rest + 1] > 0, after - before, np.inf)
        change[0] = after[0] - before[0]
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        window, held = self.open[h].pop() if h else (self._new(), [])
        n[h] -= h > 0
        held.append((doc, cut, ids[cut:], size, window, h))
        if h + rest == cap:
            return out + held
        n[h + rest] += 1
        self.open[h + rest].append((window, held))
        return out

    def finish(self) -> list[tuple]:
        """Pour the open windows together, the emptiest cut to fill the fullest."""
        left = [(h, w, p) for h in range(self.capacity - 1, 0, -1) for w, p in self.open[h]]
        out, lo, hi = [], 0, len(left) - 1
        fill = [h for h, _, _ in left]
        while lo < hi:
            gap = self.capacity - fill[lo]
            if not gap:
                lo += 1
                continue
            doc, start, ids, size, _, _ = left[hi][2].pop()
            take = min(gap, len(ids))
            left[lo][2].append((doc, start + len(ids) - take, ids[len(ids) - take:], size, left[lo][1], fill[lo]))
            fill[lo] += take
            fill[hi] -= take
            if take < len(ids):
                left[hi][2].append((doc, start, ids[:len(ids) - take], size, left[hi][1], fill[hi] - len(ids) + take))
            if not fill[hi]:
                hi -= 1
        for _, _, pieces in left:
            out.extend(pieces)
        return out


def pack_documents(docs: DataFrame, capacity: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(vocabulary_path(vocabulary)), SumOfSquares(capacity)
        high = TaskContext.get().partitionId() << 36

        def made(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, size, window, offset = zip(*pieces)
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array((zlib.crc32(x) for x in ids), pa.int64()), pa.array(size, pa.int64()), pa.array((high + w for w in window), pa.int64()), pa.array(offset, pa.int64())]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for part in bounded(batch, 1, 2500):
                got = [p for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1), end)) for p in packer.place(doc, ids)]
                if got:
                    yield made(got)
        if got := packer.finish():
            yield made(got)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
