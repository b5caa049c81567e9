"""Queries of this package, one per operator, over the whole of the tables they are meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketframe.llm import exact_dedup, hard_negatives, language, licences, minmax, mixing, ngram_join, packing, pii, prefix_trie, repetition, token_counts, url_filter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", mixing.word_count(F.col("text")).alias("n_words"))
    return packing.pack(docs, F.col("n_words")).drop("n_words")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.repetitions(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(documents(spark, sf_dir), licences.train_licence_model(spark))
    return found.withColumn("families", F.array_join("families", ","))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train_language_model(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.detect_languages(docs.select("doc_id", "text"), model).withColumn("held_out", language.held_out(F.col("doc_id")))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.train_url_model(url_filter.label_pages(pages)))


def op8_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(documents(spark, sf_dir), shingle_words=4, threshold=80)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    number = {kind: F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS LONG)") for kind in pii.KINDS}
    base = F.expr("array_join(transform(base, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    rank = "array_position(array('email', 'ip', 'card', 'phone', 'secret'), x.kind)"
    ordered = f"array_sort(transform(concat(base, added), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', x.kind)))"
    spans = F.expr(f"array_join(transform({ordered}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    return found.select("doc_id", *(number[kind].alias(f"n_{kind}") for kind in pii.KINDS), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.expr("CAST(size(base) + size(added) AS LONG)").alias("n_spans"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"
    )


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), ngram_words=3, threshold=90)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_exact_dedup, op3_mixing, op4_licences, op5_language, op6_token_counts, op7_url_filter, op8_minmax, op9_personal_data, op10_repetition, op11_ngram_join, op12_prefix_trie, op13_hard_negatives,
    )
}
