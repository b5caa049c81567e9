"""Mixing sources to target weights by repeating documents.

Tokens are added up per source; the target of a source over its tokens is its repetition rate. Each document is emitted
floor(rate) times, and once more if a number drawn from a hash of its id and the seed lies below the rest of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketframe.llm.shared import stored

MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for NULL."""
    # A word takes the white space behind it, so that no run of white space is read once per starting place.
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(F.btrim(marks, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")


def ordinal(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with their place ``nth`` (from 0) in the order, by a range-partitioned sort and the partitions' sizes."""
    numbered = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {row["part"]: row["n"] for row in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for name in sorted(sizes):
        offsets += [F.lit(name), F.lit(before)]
        before += sizes[name]
    shift = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return numbered.withColumn("nth", (shift + place).cast("long")).drop("_at")


def source_targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, NULL last, weigh ``weights`` in turn. The targets share all tokens by weight; one above
    three times its source stops there, and the excess is shared again by weight. Each round is an aggregation of which
    only the level reaches the driver: tokens a unit of weight still gets.
    """
    weigh = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    table = stored(ordinal(sizes, F.col("source").asc_nulls_last()).withColumn("weight", weigh.cast("long")), "sources")
    full = F.col("source_size") * MAX_REPEATS
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, reached = 0.0, None
    while True:
        stopped = full <= F.lit(level) * F.col("weight") if reached is not None else F.lit(False)
        row = table.agg(F.coalesce(F.sum(F.when(stopped, full)), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)).alias("open")).first()
        if not row["open"] or (row["taken"], row["open"]) == reached:
            break
        reached = (row["taken"], row["open"])
        level = (total - row["taken"]) / row["open"]
    target = F.least(full.cast("double"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def repetitions(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    ``docs`` has ``doc_id, text, source``; all its columns stay, but columns with these five names are replaced. ``copies``
    is at most 3. A NULL text has size 0, a NULL source is a source of its own, and a source without words has target and
    rate 0. Rows are drawn by their doc_id, or by their text where that is NULL, so that reruns agree and repeated rows
    fare alike. An empty table gives an empty one.
    """
    added = ["size", "source_size", "target", "rate", "copies"]
    docs = docs.drop(*added)
    sized = docs.withColumn("size", word_count(F.col("text")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = "_source"
    while named in docs.columns:
        named = "_" + named
    table = stored(source_targets(totals, weights), "targets").withColumnRenamed("source", named)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_REPEATS)))).otherwise(F.lit(0.0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    whole = F.floor("rate")
    copies = whole + F.when(drawn < F.col("rate") - whole, 1).otherwise(0)
    joined = sized.join(table, F.col("source").eqNullSafe(F.col(named))).drop(named)
    return joined.withColumn("rate", rate).withColumn("copies", copies.cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as ``repetitions`` says, with the columns of ``docs``."""
    whole = F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row")
    rows = repetitions(docs.select("doc_id", "text", "source", whole), weights, seed)
    return rows.select("row", F.explode(F.expr("array_repeat(1, CAST(copies AS INT))"))).select("row.*")
