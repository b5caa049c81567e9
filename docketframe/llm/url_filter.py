"""URL filter: rules first, then the ratio of two character language models.

A rule decides the URLs whose host and path it fits, the longest rule first. Every other URL gets the verdict of two
smoothed variable-order Markov models, one of accepted and one of rejected URLs: the log-likelihood difference divided by
the URL's length, against a threshold calibrated on labelled URLs that neither model has seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketframe.llm.shared import stored
from docketframe.llm.words import BYTE_CODES, MULTIPLIER, mix, raw, text_slices

# Rules as (host and path, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
# Words in a host that mark a labelled URL as rejected.
UNWANTED = ("adult", "casino", "pills", "spam", "bets", "ads-track")
MAX_ORDER = 5
ALPHABET = 256
# Counts of each order are added up in tables of this many places, whatever the number of URLs.
TABLE_BITS = 18
# Scores are dealt into bins of this width, so that no sort takes them all; a score is at most log 256 (5.5) and a little.
BINS_PER_UNIT = 256


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The pages with ``host, path``, the longest fitting ``rule`` and its verdict ``ruling``, NULL without one."""
    frame = pages.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, verdict in sorted(rules, key=lambda x: len(x[0])):
        at = name.find("/")
        host, path = name[:at], name[at:]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, name).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return frame.withColumn("rule", rule).withColumn("ruling", ruling)


def context_codes(texts: pa.Array, orders: int = MAX_ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character (bytes, and an end mark): its text, and the hashes of its contexts and grams of each order.

    ``contexts[k]`` names the k bytes before it, ``grams[k]`` these and the byte itself; places before the text's start
    count as one more symbol.
    """
    data, offsets = raw(texts)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(texts)), sizes + 1)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    symbols = np.zeros(len(row), dtype=np.int64)
    inside = np.ones(len(row), dtype=bool)
    inside[starts[1:] - 1] = False
    symbols[inside] = data
    symbols[~inside] = 10
    local = np.arange(len(row)) - starts[row]
    codes = BYTE_CODES[symbols]
    contexts, grams = [np.zeros(len(row), dtype=np.uint64)], []
    total = np.zeros(len(row), dtype=np.uint64)
    weight = np.uint64(1)
    for k in range(1, orders + 1):
        grams.append(mix(contexts[-1] * MULTIPLIER + codes + np.uint64(k)))
        before = np.full(len(row), np.uint64(3), dtype=np.uint64)
        able = np.flatnonzero(local >= k)
        before[able] = codes[able - k]
        total = total + before * weight
        weight = np.uint64((int(weight) * int(MULTIPLIER)) % 2**64)
        contexts.append(mix(total + np.uint64(k)))
    grams.append(mix(contexts[-1] * MULTIPLIER + codes + np.uint64(orders + 1)))
    return row, np.stack(contexts), np.stack(grams)


@dataclass(frozen=True)
class MarkovModel:
    """Per order, by the last bits of their hashes: how often each gram and each context occurs, and the context's distinct followers."""

    grams: np.ndarray
    contexts: np.ndarray
    followers: np.ndarray

    def log_probabilities(self, contexts: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Witten-Bell smoothing: each order that knows the context is mixed with the next lower one."""
        p = np.full(contexts.shape[1], 1 / ALPHABET)
        for k in range(len(self.grams)):
            at = place(contexts[k])
            totals, followers = self.contexts[k][at].astype(np.float64), self.followers[k][at].astype(np.float64)
            # Grams that share a place may be more than their context.
            seen = np.minimum(self.grams[k][place(grams[k])], totals)
            p = np.where(totals > 0, (seen + followers * p) / np.where(totals > 0, totals + followers, 1), p)
        return np.log(p)


def place(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood as an accepted URL less that as a rejected one, per character."""
        row, contexts, grams = context_codes(texts)
        gain = self.accepted.log_probabilities(contexts, grams) - self.rejected.log_probabilities(contexts, grams)
        return np.bincount(row, weights=gain, minlength=len(texts)) / np.bincount(row, minlength=len(texts))


def gram_counts(urls: DataFrame) -> DataFrame:
    """``label, k, context, gram, n`` of the labelled urls, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            for label in ("allow", "block"):
                texts = batch.column(1).filter(pa.array(labels == label))
                if not len(texts):
                    continue
                _, contexts, grams = context_codes(texts)
                for k in range(len(grams)):
                    names, first, n = np.unique(grams[k], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(names)), pa.array(np.full(len(names), k)), pa.array(contexts[k][first].view(np.int64)), pa.array(names.view(np.int64)), pa.array(n)],
                        names=["label", "k", "context", "gram", "n"],
                    )

    rows = urls.select("label", "url").mapInArrow(run, "label string, k long, context long, gram long, n long")
    return rows.groupBy("label", "k", "context", "gram").agg(F.sum("n").alias("n"))


def markov_models(counts: DataFrame) -> dict[str, MarkovModel]:
    """A model of each label from all its ``gram_counts``; the tables' size bounds what comes to the driver."""
    at = lambda name: F.col(name).bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int").alias("at")
    grams = counts.groupBy("label", "k", at("gram")).agg(F.sum("n").alias("n"))
    contexts = counts.groupBy("label", "k", at("context")).agg(F.sum("n").alias("n"), F.count("*").alias("followers"))
    found = {}
    for label in ("allow", "block"):
        filled = []
        for rows, name in ((grams, "n"), (contexts, "n"), (contexts, "followers")):
            table = np.zeros((MAX_ORDER + 1, 1 << TABLE_BITS), dtype=np.float32)
            own = rows.where(F.col("label") == label).select("k", "at", name).toArrow()
            table[own.column("k").to_numpy(), own.column("at").to_numpy()] = own.column(name).to_numpy()
            filled.append(table)
        found[label] = MarkovModel(*filled)
    return found


def best_threshold(scores: DataFrame) -> float:
    """The cut of ``label, score`` that leaves the fewest errors, each label counting the same; 0 if one is missing.

    Rejected URLs from the cut on and accepted ones below it are errors. Equal scores are added up and dealt into bins of a
    fixed width; sums of the bins, at most some thousands, lead on to running sums inside each.
    """
    block = F.count_if(F.col("label") == "block").alias("block")
    counted = stored(scores.groupBy("score").agg(block, (F.count("*") - block).alias("allow")).withColumn("bin", F.floor(F.col("score") * BINS_PER_UNIT)), "scores")
    before, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = counted.groupBy("bin").agg(F.sum("block").alias("b"), F.sum("allow").alias("a")).select(
        "bin", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_below") for x in "ba"), *(F.sum(x).over(whole).alias(f"{x}_all") for x in "ba")
    )
    inside = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = {x: F.col(f"{x[0]}_below") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in ("block", "allow")}
    wrong = (F.col("b_all") - below["block"]) / F.col("b_all") + below["allow"] / F.col("a_all")
    cuts = counted.join(F.broadcast(bins), "bin").where("b_all > 0 AND a_all > 0").select("score", wrong.alias("wrong"))
    best = cuts.agg(F.min(F.struct("wrong", "score")).alias("best")).first()["best"]
    if best is None:
        return 0.0
    lower = counted.where(F.col("score") < F.lit(best["score"])).agg(F.max("score")).first()[0]
    return (best["score"] + (best["score"] - 1 if lower is None else lower)) / 2


def train_url_model(labelled: DataFrame, max_urls: int | None = None) -> UrlModel:
    """Models of ``label`` (allow or block) from all rows of ``url, label``, with a calibrated threshold.

    Repeated rows count once. A fifth of the URLs, by a hash, is kept from training, never the only one of a label; among these the
    threshold leaves the fewest errors, each label counting the same. It is 0 if the fifth lacks a label. Only a table without
    URLs of both labels lets everything pass. The models are tables of a fixed size, to which tasks add; ``max_urls`` makes do with
    about as many distinct URLs of each label, chosen by a hash of the URL, and at least one.
    """
    known = labelled.where("url IS NOT NULL AND label IN ('allow', 'block')").select("label", "url", F.pmod(F.xxhash64("url"), F.lit(1 << 30)).alias("_h"))
    known = stored(known.distinct(), "labelled")
    sizes = known.groupBy("label").agg(F.count("*").alias("n"), F.min("_h").alias("least")).collect()
    below, least = F.lit(0), F.lit(-1)
    for row in sizes:
        own, share = F.col("label") == row["label"], 1.0 if max_urls is None else min(1.0, max_urls / row["n"])
        below = F.when(own, max(row["least"] + 1, int(share * (1 << 30)))).otherwise(below)
        least = F.when(own, row["least"]).otherwise(least)
    held_out = (F.pmod(F.xxhash64("url", F.lit(5)), F.lit(5)) == 0) & (F.col("_h") != least)
    chosen = known.where(F.col("_h") < below).withColumn("_held", held_out)
    models = markov_models(stored(gram_counts(chosen.where("NOT _held")), "grams"))
    if len(sizes) < 2:
        return UrlModel(models["allow"], models["block"], float("-inf"))
    model = UrlModel(models["allow"], models["block"], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(texts) for _, texts in text_slices(batch.column(1), 1 << 18)]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["label", "score"])

    held = chosen.where("_held").select("label", "url").mapInArrow(run, "label string, score double")
    return UrlModel(model.accepted, model.rejected, best_threshold(held))


def label_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """``url, label`` for training: a host with an unwanted word is rejected, other hosts are accepted.

    URLs on which a rule disagrees are left out: what a rule blocks for its language or place says nothing about the rest.
    """
    frame = ruled(pages.select("url"), rules).where("host <> ''")
    bad = F.lit(False)
    for word in unwanted:
        bad = bad | F.contains(F.col("host"), F.lit(word))
    label = F.when(bad, "block").otherwise("allow")
    return frame.select("url", label.alias("label"), "ruling").where("ruling IS NULL OR ruling = label").drop("ruling")


def filter_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Every row of ``pages`` (``page_id, url``) as ``page_id, host, path, rule, verdict, score``.

    The verdict (allow or block) is the rule's, or that of the models where no rule fits. NULL, empty and other urls
    without ``://`` have an empty host and path and no rule; the models judge their text. Other columns are ignored;
    repeated rows are judged each; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(texts) for _, texts in text_slices(batch.column(1), 1 << 18)]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array(values)], names=["page_id", "host", "path", "rule", "ruling", "score"])

    source = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    judged = source.select("page_id", "url", "host", "path", "rule", "ruling").mapInArrow(
        run, "page_id long, host string, path string, rule string, ruling string, score double"
    )
    verdict = F.coalesce("ruling", F.when(F.col("score") >= model.threshold, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
