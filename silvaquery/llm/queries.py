"""The contract's queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, brown_lm, chat, crf, langid, mixing, packing, pstable, repair, simhash_bk, sstable, topk, transducer
from .common import fold, table


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(spark, table(spark, sf_dir, "documents"))


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = brown_lm.score_texts(docs, fold("doc_id", 5) != 1)
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model, prior = crf.fit_sample(docs, labels.filter(~held_out), ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return crf.score_toxicity(rows, model, prior).drop("text")


def op6_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit_sample(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op4_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.formatted_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op8_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op13_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.documents_counted(table(spark, sf_dir, "documents"))


TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown": op1_brown,
        "op2_crf": op2_crf,
        "op3_mixing": mixing.op3_mixing,
        "op4_pstable": op4_pstable,
        "op5_sstable": op5_sstable,
        "op6_subword": op6_subword,
        "op7_chat": op7_chat,
        "op8_norm_sorted": op8_norm_sorted,
        "op9_simhash_bk": op9_simhash_bk,
        "op10_sum_of_squares": op10_sum_of_squares,
        "op11_repair": op11_repair,
        "op12_alignment": op12_alignment,
        "op13_transducer": op13_transducer,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op8_norm_sorted": TOPK, "op11_repair": repair.ORACLE}
