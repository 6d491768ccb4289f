"""Corpus pipeline: toxicity, language ID, near-duplicates, source mix, packing.

Each stage takes the documents that the stage before kept and returns rows with the same columns, but for the last, which
returns packed pieces. Nulls, empty texts, repeated rows and empty tables are handled as the operators' modules say:
null and empty texts are not toxic but have no language and go in the second stage; of repeated rows one
stays after the third; the fourth gives a row as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaquery.llm import crf, langid, mixing, packing, simhash_bk
from silvaquery.llm.common import fold, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says not toxic; learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    learn = F.coalesce(fold("doc_id", 5) != 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(learn)
    model, prior = crf.fit_sample(docs, labels, learn)
    scored = crf.score_toxicity(docs, model, prior)
    return scored.filter(F.col(scored.columns[len(docs.columns) + 1]) == 0).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, named with calibrated confidence; learned from rows whose crc32(doc_id) mod 4 is not 2."""
    model = langid.fit_sample(docs, fold("doc_id", 4) != 2)
    named = langid.predict(docs, model)
    return named.filter(~F.col(named.columns[-1])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: words in shingles of five, a similarity of 0.8 or more."""
    return simhash_bk.keep_one(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Fitted models and fingerprints have no SQL; all stages are tested against a brute-force version of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
