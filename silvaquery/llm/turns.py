"""Turns of conversations, numbered over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ORDER = ["conv_id", "turn", "role", "text"]


def numbered(rows: DataFrame, tag: str = "turns") -> DataFrame:
    """``rows(conv_id long, turn long, role, text)`` -> its distinct rows with ``copies``, ``place`` and ``number``.

    ``place`` counts distinct rows, ``number`` rows in a conversation's order from 0 (null turns first, ties by role and text, copies side by side). Copies
    are added up first, so rows differ in what they are sorted by, and ranges of the sort order split a conversation of any
    size; each range is numbered by itself, and a conversation that begins before its range is shifted by what it has there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, m = TaskContext.get().partitionId(), (), 0, 0
        for batch in batches:
            places, numbers = [], []
            for c, copies in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if (c,) != last:
                    last, n, m = (c,), 0, 0
                places.append(n)
                numbers.append(m)
                n, m = n + 1, m + copies
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(numbers, pa.int64())], names=[*ORDER, "copies", "part", "nth", "row"])

    dealt = rows.groupBy(*ORDER).agg(F.count(F.lit(1)).alias("copies")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    parts = written(dealt.mapInArrow(count, "conv_id long, turn long, role string, text string, copies long, part int, nth long, row long"), tag)
    sizes = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("m"))
    upto = Window.partitionBy("conv_id").orderBy("part")
    before = sizes.select("conv_id", "part", (F.sum("n").over(upto) - F.col("n")).alias("n"), (F.sum("m").over(upto) - F.col("m")).alias("m")).filter("n > 0")
    # At most one conversation of a range begins before it, so this has no more rows than there are ranges.
    shift = F.broadcast(before.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "n", "m"))
    return parts.join(shift, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").select(
        *ORDER, "copies", (F.col("nth") + F.coalesce("n", F.lit(0))).alias("place"), (F.col("row") + F.coalesce("m", F.lit(0))).alias("number"))
