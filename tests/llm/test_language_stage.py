"""The language stage drops what is in no learned language."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from docketframe.llm import language
from pyspark.sql import functions as F


def test_noise_and_other_languages_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(200))
    planted = [(-1, noise, None), (-2, "Привет, это обычный текст на русском языке, которого никто не учил. " * 9, None), (-3, "12 !", None)]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, rows, sf_dir).collect()}
    assert not kept & {-1, -2, -3}
    clean = {r.doc_id for r in docs.where(F.length("text") > 0).collect()}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(3, " ".join(words), "de"), (7, near, "de"), (7, "a text of its own that no other document has in any form", "de"), (9, None, "de"), (None, near, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _file string")
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)
    assert corpus_pipeline.near_stage(spark, docs.where("false"), "").count() == 0


def test_the_model_and_the_bound_come_from_all_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèçñå") for _ in range(5))
    rows = [(i, f"{word()} {word()}", "aa" if i % 2 else "bb") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language.train_language_model(docs)
    table = language.word_table(pa.array([text for _, text, _ in rows]), model.letters)
    owner = np.repeat(table.row, np.diff(np.append(table.first, len(table.hashes))))
    own = model.scores[table.hashes, np.array([lang == "bb" for _, _, lang in rows])[owner].astype(int)]
    assert (own > model.scores.min()).all()
    gains = sorted(r.gain for r in language.detect_languages(docs, model).collect())
    assert language.least_gain(docs, model) == min(0.0, gains[11])
