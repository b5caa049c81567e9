"""The corpus pipeline: documents in, packed training batches out.

Every stage reads all rows that its predecessor kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketframe.llm import exact_dedup, language, minmax, mixing, packing
from docketframe.llm.shared import stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: without a letter, or less likely in the learned ones than clean documents are.

    NULL and empty texts go; repeated rows go or stay alike; no rows give none. Documents that the model has not seen set the bound.
    """
    unseen = language.held_out(F.col("doc_id"))
    model = language.train_language_model(docs.where(~unseen))
    least = language.least_gain(docs.where(unseen), model)
    found = language.detect_languages(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("gain") >= least)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (NULL counts as empty) the row with the smallest doc_id stays; of repeated rows the first. No rows give none."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id: shingles of five words, similarity 0.8 or more.

    Texts without a word and rows without a doc_id stay; rows that share a doc_id are judged by their texts. No rows give none.
    """
    return minmax.drop_near_duplicates(docs, shingle_words=5, threshold=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that sources meet their weights; rows of a NULL source are a source, and no rows give none."""
    return mixing.mix_sources(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, repeated and empty ones too, with its bucket and batch; no rows give none."""
    return packing.pack(docs, mixing.word_count(F.col("text")))


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# The language and near-duplicate stages have no SQL form; tests/llm/test_table_operators.py tests the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
