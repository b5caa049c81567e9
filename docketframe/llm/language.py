"""Languages of each document as a mixture, by expectation-maximisation over its words.

Every word is taken as drawn from one of the document's languages; its likelihood in a language is that of its letter
trigrams. Expectation-maximisation estimates the proportions of all languages in a document. Then sets of the leading
languages, one more each time, are fitted again, as long as their likelihood less a penalty for each further language can
still be the best; the set where it is the best is the document's. The trigram model is learned from labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketframe.llm.words import text_slices

TABLE_BITS = 16
UNSEEN_SHARE = 0.02
UNKNOWN = "und"
# The rank of the least gain is off by at most one in this many documents.
GAIN_ACCURACY = 100_000


@dataclass(frozen=True)
class LanguageModel:
    """``scores[h, l]`` is the log-probability of the trigrams with hash ``h`` in language ``l``."""

    languages: list[str]
    scores: np.ndarray
    letters: np.ndarray


@dataclass
class WordTable:
    """The trigram hashes of all letters, the first letter of each word, and the text each word is in."""

    hashes: np.ndarray
    first: np.ndarray
    row: np.ndarray


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def word_table(texts: pa.Array, letters: np.ndarray) -> WordTable:
    """Words are runs of letters in lower case; a trigram is a letter with its neighbours, which may be the word's edge."""
    plain = ["\n" + (text or "").lower() for text in texts.to_pylist()]
    codes = np.frombuffer(("".join(plain) + "\n").encode("utf-32-le"), dtype=np.uint32)
    codes = np.where(letters[codes], codes, np.uint32(0))
    at = np.flatnonzero(codes)
    h = codes[at - 1] * np.uint32(0x9E3779B1) + codes[at] * np.uint32(0x85EBCA6B) + codes[at + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    first = np.flatnonzero(codes[at - 1] == 0)
    begins = np.cumsum([0, *(len(text) for text in plain)])
    return WordTable(h >> np.uint32(32 - TABLE_BITS), first, np.searchsorted(begins, at[first], side="right") - 1)


def trigram_counts(docs: DataFrame, letters: np.ndarray) -> DataFrame:
    """``lang, hash, n``: each task adds up a table of fixed size per language before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                names = np.array(batch.column(0).slice(first, len(texts)).to_pylist(), dtype=object)
                table = word_table(texts, letters)
                sizes = np.diff(np.append(table.first, len(table.hashes)))
                owner = np.repeat(table.row, sizes)
                for name in set(names.tolist()):
                    chosen = table.hashes[(names == name)[owner]] if len(owner) else table.hashes
                    totals[name] = totals.get(name, 0) + np.bincount(chosen, minlength=1 << TABLE_BITS)
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "hash", "n"]
            )

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))


def train_language_model(labelled: DataFrame) -> LanguageModel:
    """A trigram model of every non-NULL ``lang`` in ``labelled`` (``doc_id, text, lang``), from all of its documents.

    The fixed size of the hash table and the number of languages bound what each task adds up and what comes to the driver,
    however many documents there are. A language whose documents have no letters is not learned.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    letters = letter_table()
    rows = trigram_counts(labelled, letters).toArrow()
    names = np.array(rows.column("lang").to_pylist(), dtype=object)
    hashes, numbers = rows.column("hash").to_numpy(), rows.column("n").to_numpy()
    languages = sorted(set(names.tolist()))
    scores = np.zeros((1 << TABLE_BITS, len(languages)), dtype=np.float32)
    for i, name in enumerate(languages):
        counts = np.bincount(hashes[names == name], weights=numbers[names == name], minlength=1 << TABLE_BITS)
        share = counts / counts.sum()
        # A trigram that no document of a language has is as likely in each language.
        scores[:, i] = np.log((share + UNSEEN_SHARE / (1 << TABLE_BITS)) / (1 + UNSEEN_SHARE))
    return LanguageModel(languages, scores, letters)


def fit_proportions(likelihood: np.ndarray, offset: np.ndarray, first: np.ndarray, row: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from ``share`` (texts x languages); zero shares stay zero. Returns shares and log-likelihoods."""
    n = np.diff(np.append(first, len(row))).astype(np.float32)[:, None]
    for _ in range(steps):
        part = likelihood * share[row]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / n
    whole = np.log((likelihood * share[row]).sum(axis=1)) + offset
    return share, np.add.reduceat(whole.astype(np.float64), first)


def detect(texts: pa.Array, model: LanguageModel, penalty: float, steps: int) -> tuple[list[str], np.ndarray, list[list[str]], list[list[float]], np.ndarray]:
    """Per text: leading language, its proportion, all languages of the chosen set, their proportions, and the gain.

    The gain, per letter, is the log-likelihood of the best mixture less that of an unknown language, to which all trigrams
    are alike; ten more letters without gain keep a text of a few letters near 0.
    """
    table, n_languages = word_table(texts, model.letters), len(model.languages)
    best = [UNKNOWN] * len(texts)
    score, gain = np.zeros(len(texts)), np.zeros(len(texts))
    sets: list[list[str]] = [[] for _ in texts]
    proportions: list[list[float]] = [[] for _ in texts]
    if not len(table.first) or not n_languages:
        return best, score, sets, proportions, gain
    words = np.add.reduceat(model.scores[table.hashes], table.first, axis=0)
    offset = words.max(axis=1)
    likelihood = np.exp(np.maximum(words - offset[:, None], -60))
    present, first = np.unique(table.row, return_index=True)
    row = np.searchsorted(present, table.row)
    number = np.diff(np.append(first, len(row)))

    start = np.full((len(present), n_languages), 1 / n_languages, dtype=np.float32)
    share, _ = fit_proportions(likelihood, offset, first, row, start, steps)
    order = np.argsort(-share, axis=1, kind="stable")
    chosen = np.zeros_like(share)
    chosen_value, reached = np.full(len(present), -np.inf), np.zeros(len(present))
    # No set explains a word better than the word's best language.
    most = np.add.reduceat(offset.astype(np.float64), first)
    for size in range(1, n_languages + 1):
        cost = penalty * (size - 1) * np.log(number + 1)
        open_ = most - cost > chosen_value
        if not open_.any():
            break
        own = open_[row]
        at = np.flatnonzero(open_)
        begins = np.concatenate(([0], np.cumsum(number[at])[:-1]))
        allowed = np.zeros_like(share[at])
        np.put_along_axis(allowed, order[at, :size], 1, axis=1)
        fitted = (share[at] + 1e-3) * allowed
        fitted /= fitted.sum(axis=1, keepdims=True)
        fitted, value = fit_proportions(likelihood[own], offset[own], begins, np.repeat(np.arange(len(at)), number[at]), fitted, steps // 2 if size > 1 else 0)
        better = value - cost[at] > chosen_value[at]
        chosen[at[better]], chosen_value[at[better]], reached[at[better]] = fitted[better], (value - cost[at])[better], value[better]
    letters = np.add.reduceat(np.diff(np.append(table.first, len(table.hashes))), first)
    gain[present] = (reached + letters * np.log(1 << TABLE_BITS)) / (letters + 10)
    for i, at in enumerate(present):
        ranked = [k for k in np.argsort(-chosen[i], kind="stable") if chosen[i, k] > 0]
        best[at], score[at] = model.languages[ranked[0]], min(1.0, float(chosen[i, ranked[0]]))
        sets[at] = [model.languages[k] for k in ranked]
        proportions[at] = [float(chosen[i, k]) for k in ranked]
    return best, score, sets, proportions, gain


def detect_languages(docs: DataFrame, model: LanguageModel, penalty: float = 2.0, steps: int = 10) -> DataFrame:
    """``row, doc_id, lang_pred, score, languages, proportions, gain`` for every row of ``docs`` (``doc_id, text``).

    ``row`` holds all columns of ``docs``, whatever their names. ``languages`` is the chosen set with its ``proportions``,
    leading first; ``lang_pred`` and ``score`` are the first of them. A NULL text, one without a letter and any text under
    a model without languages gives ``und``, 0, empty lists and no gain. Repeated rows give equal results; an empty table gives
    an empty one. ``penalty`` is what each further language must add to the log-likelihood, times the logarithm of the
    number of words.
    """

    found = "lang_pred string, score double, languages array<string>, proportions array<double>, gain double"
    names = ["lang_pred", "score", "languages", "proportions", "gain"]
    kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [
                pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(detect(texts, model, penalty, steps), kinds, strict=True)], names)
                for _, texts in text_slices(batch)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, kinds, strict=True))))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Rows stay in the JVM, only texts go to Python; as a nondeterministic step it is not repeated in filters on its result.
    detected = F.arrow_udf(run, T.StructType.fromDDL(found)).asNondeterministic()
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row")
    source = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.select("row", "doc_id", detected("text").alias("found")).select("row", "doc_id", *(f"found.{name}" for name in names))


def least_gain(labelled: DataFrame, model: LanguageModel) -> float:
    """The gain under which a text is in no learned language: that of an unknown language, 0, or less.

    One in a thousand of the documents with a ``lang`` may stay under it; take some that the model has not seen. All of
    them are judged, and their gains meet in a quantile summary of bounded size.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    found = detect_languages(known.select("doc_id", "text"), model).where(F.col("lang_pred") != UNKNOWN)
    return min(0.0, found.agg(F.percentile_approx("gain", 0.001, GAIN_ACCURACY)).first()[0] or 0.0)


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4; not a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
