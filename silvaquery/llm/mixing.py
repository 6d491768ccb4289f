"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in order of code point (null last) weigh 5, 2, 1, repeating; together they get ``share`` of
all words, none more than ``most`` times its own, and what a source can't take is shared
out again by weight. That water level has a closed form over the sources sorted by
most * size / weight, so no loop runs.

Sampling: within a source every document expects target / size copies. Ordered by (size, md5 of doc_id, or of the text where there is none, doc_id),
expectations are prefix-summed, one offset in [0, 1) drawn from the source's name is added, and a
document is emitted once for each integer boundary its interval crosses. As sizes ascend in that
order, the words taken differ from the target by little more than the longest document.

A prefix sum of equal expectations is a rank, and the rank of a row is put together from counts:
rows of smaller size in the source, rows of the same size in earlier hash buckets (256 of them at least, and so many that a bucket
has some 50,000 rows even if all rows are of one source and size), and the row's number in its bucket. So a source or size that holds a third of all rows is counted with
partial aggregation and numbered in many tasks.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows with a null doc_id are ordered by their text;
repeated rows are separate documents; a source without words has target 0 and
takes nothing; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, table, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("n"), F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source_key, source_size)``, one row per source -> with ``target``, ``rate`` and ``shift``; windows here run over sources, not documents."""
    nth = F.row_number().over(Window.orderBy("source_key"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(nth - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", w).withColumn("ceiling", F.col("source_size") * F.lit(most))
    s = s.withColumn("ratio", F.col("ceiling") / F.col("weight"))
    rising, everything = Window.orderBy("ratio", "source_key"), Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source in this order that its share fits sets the level for it and all that follow.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_key", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.least(F.col("ceiling"), F.coalesce(level * F.col("weight"), F.col("ceiling"))))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("source_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return s.select("source_key", "source_size", "target", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("rate"), shift.alias("shift"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``rows(doc_id, source, size, row, h, tie)`` -> ``(doc_id, size, source_size, target, copies, row)``; ``row`` goes through, ``h`` and ``tie`` settle order."""
    digits = max(2, math.ceil(math.log(max(rows.count(), 1) / 50_000, 16)))
    keyed = rows.select("*", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("source_key"), F.substring("h", 1, digits).alias("cell"))
    cells = written(keyed.groupBy("source_key", "size", "cell").agg(F.count("*").alias("n")), "mix-cells")
    sizes = cells.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    below = sizes.select("source_key", "size", (F.sum("n").over(Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("smaller"))
    targets = source_targets(sizes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    inside = Window.partitionBy("source_key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    start = cells.withColumn("earlier", F.sum("n").over(inside) - F.col("n")).join(below, ["source_key", "size"]).join(targets, "source_key")
    start = start.select("source_key", "size", "cell", (F.col("smaller") + F.col("earlier")).alias("start"), "source_size", "target", "rate", "shift")
    numbered = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("source_key", "size", "cell").orderBy("h", F.col("doc_id"), "tie")))
    out = numbered.join(start, ["source_key", "size", "cell"])
    rank = (F.col("start") + F.col("nth")).cast("double")
    copies = F.floor(rank * F.col("rate") + F.col("shift")) - F.floor((rank - 1) * F.col("rate") + F.col("shift"))
    return out.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), "row")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: ``(doc_id, size, source_size, target, taken, copies)``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.lit(None).cast("int").alias("row"), order_hash(F.col(doc_id), F.col(text)).alias("h"), F.lit(0).alias("tie"))
    # Sizes are counted once and written: the counting pass and the numbering pass both read them.
    m = mix(written(rows, "mix-sizes"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it has copies."""
    size = free_name(docs.columns, "size")
    sized = written(docs.withColumn(size, word_count(F.col(text))), "mix-docs")
    rows = sized.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).alias("size"), F.struct(*docs.columns).alias("row"), order_hash(F.col(doc_id), F.col(text)).alias("h"), F.xxhash64(F.col(text)).alias("tie"))
    taken = mix(rows).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), 'n' || coalesce(text, ''))) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT k, source_size, source_size * 2.0::DOUBLE AS ceiling,
             CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, ceiling / weight AS ratio,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER r, 0.0::DOUBLE))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0.0::DOUBLE)) AS level
      FROM w WINDOW r AS (ORDER BY ceiling / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, struct_pack(a := ratio, b := k)) AS level FROM l WHERE ratio >= level),
t AS (SELECT k, source_size, least(ceiling, coalesce(f.level * weight, ceiling)) AS target,
             CAST(CAST('0x' || substr(md5('mix:' || k), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS shift
      FROM l CROSS JOIN f),
n AS (SELECT d.*, t.source_size, t.target, t.shift, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS rate,
             CAST(row_number() OVER (PARTITION BY k ORDER BY size, h, doc_id NULLS FIRST) AS DOUBLE) AS rank
      FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       CAST((floor(rank * rate + shift) - floor((rank - 1) * rate + shift)) * size AS BIGINT) AS taken
FROM n
"""
