"""Mixtures of more than three languages."""

import pytest
from pyspark.sql import functions as F

from docketframe.llm import language


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language.train_language_model(docs.where(~language.held_out(F.col("doc_id"))))


def test_four_languages_in_one_text(spark, sf_dir, model):
    words = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(language.held_out(F.col("doc_id"))).sort("doc_id").collect():
        words.setdefault(r.lang, []).extend((r.text or "").split())
    assert len(words) == 4
    shares = dict(zip(sorted(words), (400, 250, 200, 150)))
    text = " ".join(" ".join(words[name][:n]) for name, n in shares.items())
    got = language.detect_languages(spark.createDataFrame([(1, text), (2, " ".join(words["fr"][:300]))], "doc_id long, text string"), model).sort("doc_id").collect()
    assert sorted(got[0].languages) == sorted(shares) and got[0].lang_pred == sorted(words)[0]
    assert all(abs(p - shares[name] / 1000) < 0.08 for name, p in zip(got[0].languages, got[0].proportions))
    assert got[1].languages == ["fr"]
