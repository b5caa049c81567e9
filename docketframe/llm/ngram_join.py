"""Join of documents by the Jaccard similarity of their word n-grams, by the pigeonhole principle over a partitioned universe.

Sizes fall into bands; a set's partners lie in its own band or a neighbouring one. The band of the smaller set bounds the
number h of n-grams in which two similar sets can differ, and a hash deals the universe of n-grams into h + 1 segments.
Two similar sets then have the same subset in at least one segment, so a digest of each segment's subset is indexed, under
the set's own band and the one below.

Segments are worth what they cost. A segment may also be matched up to one difference, by a digest of its subset and of
each subset with one n-gram left out; that counts twice in the pigeonhole, so another segment can go unmatched. Where the
comparisons that a segment's crowded subsets ask for outnumber the further digests that a quiet segment of the band would need, the
crowded segment is left out and the quiet one gets its one-deletion neighbourhoods: the most crowded with the quietest, the next
with the next. Crowds are counted over all documents.

What shares a digest is a candidate, and is verified on the full sets. Equal sets are one class beforehand. A digest's
classes are compared with one leader, the smallest of them, which joins near copies into components. Digests of the same leader, which
near copies share by the dozen, are from then on one group, in which a class stands once; it is compared only across components, in
blocks of leaders from the smaller components, until no group has two components left that were not compared; so no link between
different sets is lost for the components, and no group is expanded into all its pairs.

Every class carries the parities of its set (see ``minmax``). Two classes meet with their full sets only if their parities allow a link, which rules
out strangers that share a passage and the strongly changed members of a group of near copies; it never rules out a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketframe.llm.components import connected_components
from docketframe.llm.minmax import (
    FIRST_LEADERS, MOST_LEADERS, confirmed, mixed_buckets, next_leaders, pairs_of_round, parity, possible, set_name, sets_of, sets_of_pairs, shingle_sets,
)
from docketframe.llm.shared import stored
from docketframe.llm.words import mix

SALT = 0x1F83D9ABFB41BD6B
LARGEST_SET = 2**31
# A digest's place is its band times this, plus its segment.
BAND_STEP = 1 << 32


def band_starts(largest: int, threshold: int) -> list[int]:
    """Smallest size of each band; a set as large as 100 / threshold times one of a band is at most one band above."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(100 * starts[-1] // threshold + 1)
    return starts


def segments_of_bands(starts: list[int], threshold: int) -> list[int]:
    """Segments of each band: one more than two similar sets, the smaller one in the band, can differ by."""
    return [(following - 1) * (100 - threshold) // threshold + 1 for following in starts[1:]]


def subset_sums(members: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest (a sum) of every segment's subset, and the segment and summand of each member."""
    value = mix(members ^ np.uint64(SALT))
    segment = (mix(members + np.uint64((2 * band + 1) * SALT % 2**64)) % np.uint64(segments)).astype(np.int64)
    # Halves of 32 bits add up exactly as floating-point numbers.
    low = np.bincount(segment, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), segments).astype(np.uint64)
    high = np.bincount(segment, (value >> np.uint64(32)).astype(np.float64), segments).astype(np.uint64)
    return low + (high << np.uint64(32)), segment, value


def named(sums: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    return mix(sums + mix(segment.astype(np.uint64) + (np.uint64(band) << np.uint64(40)))).view(np.int64)


def bands_of(n: int, starts: list[int]) -> list[int]:
    """The bands under which a set of n n-grams is indexed."""
    own = int(np.searchsorted(starts, n, side="right")) - 1
    return [band for band in (own, own - 1) if band >= 0]


def sketches(docs: DataFrame, size: int, starts: list[int], segments: list[int]) -> DataFrame:
    """``doc_id, n_shingles, set_name, band, digests, parity`` of every row: the digests of its own ``band``, by segment, then of the one below.

    A band of one segment has none: in it only equal sets match, and these are one class anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, own, keys, odd = [], [], [], [], []
            for members in shingle_sets(batch.column(1), size):
                bands = bands_of(len(members), starts)
                found = [named(subset_sums(members, band, segments[band])[0], band, np.arange(segments[band])) for band in bands if segments[band] > 1]
                sizes.append(len(members))
                names.append(set_name(members))
                own.append(bands[0] if bands else -1)
                keys.append(np.concatenate(found) if found else np.zeros(0, np.int64))
                odd.append(parity(members))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(own, pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_name", "band", "digests", "parity"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_name binary, band int, digests array<long>, parity array<long>")


def indexed(classes: DataFrame, segments: list[int]) -> DataFrame:
    """``key, node, place`` of every digest of the classes."""
    here = F.get(F.array(*(F.lit(x) for x in segments)), F.col("band"))
    rows = classes.where("size(digests) > 0").withColumn("own", here).select("node", "band", "own", F.posexplode("digests").alias("at", "key"))
    place = F.when(F.col("at") < F.col("own"), F.col("band") * F.lit(BAND_STEP) + F.col("at")).otherwise((F.col("band") - 1) * F.lit(BAND_STEP) + F.col("at") - F.col("own"))
    return rows.select("key", "node", place.alias("place"))


def neighbours(sets: DataFrame, starts: list[int], segments: list[int], raised: dict[int, np.ndarray]) -> DataFrame:
    """``key, node`` of the subsets of the sets ``node, members`` with one n-gram left out, in the raised segments (by band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, blob in zip(batch.column(0).to_numpy().tolist(), batch.column(1), strict=True):
                members = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                for band in bands_of(len(members), starts):
                    if band not in raised:
                        continue
                    sums, segment, value = subset_sums(members, band, segments[band])
                    chosen = np.isin(segment, raised[band])
                    at = segment[chosen]
                    key = named(sums[at] - value[chosen], band, at)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(at), node, dtype=np.int64))], names=["key", "node"])

    return sets.select("node", "members").mapInArrow(merged(run), "key long, node long")


def merged(run):
    """The same rows in batches of some size: a batch for each small set would cost more than its rows."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for part in run(batches):
            waiting.append(part)
            rows += part.num_rows
            if rows >= 50_000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return wrapped


def allocation(crowds: DataFrame, classes: DataFrame, segments: list[int]) -> DataFrame:
    """``left_out, raised``: places of segments where leaving out the first costs less with the second matched up to one difference.

    ``crowds`` has the ``place`` and number of classes ``f`` of each digest that several classes have; ``classes`` the size ``n``
    and ``band`` of each.
    """
    counted = crowds.groupBy("place").agg(F.sum(F.expr("f * (f - 1) / 2")).alias("pairs"))
    of_band = classes.select("n", F.explode(F.array("band", F.col("band") - 1)).alias("band")).groupBy("band").agg(F.count("*").alias("sets"), F.sum("n").alias("ngrams"))
    number = F.get(F.array(*(F.lit(x) for x in segments)), F.col("band"))
    bands = counted.select(F.expr(f"CAST(place div {BAND_STEP} AS INT)").alias("band")).distinct().join(of_band, "band").withColumn("segments", number)
    first = F.col("band") * F.lit(BAND_STEP)
    listed = bands.select("*", F.explode(F.sequence(first, first + F.col("segments") - 1)).alias("place"))
    costs = listed.join(counted, "place", "left").fillna(0, ["pairs"]).withColumn("deletions", F.col("ngrams") / F.col("segments"))
    crowded, quiet = Window.partitionBy("band").orderBy(F.desc("pairs"), "place"), Window.partitionBy("band").orderBy("pairs", F.desc("place"))
    worst = costs.select("band", "segments", "sets", F.col("place").alias("left_out"), F.col("pairs").alias("saved"), F.row_number().over(crowded).alias("turn"))
    best = costs.select("band", F.col("place").alias("raised"), (F.col("deletions") + F.col("pairs")).alias("cost"), F.row_number().over(quiet).alias("turn"))
    return worst.join(best, ["band", "turn"]).where("turn <= segments div 2 AND saved + sets > cost").select("left_out", "raised")


def shared_digests(docs: DataFrame, classes: DataFrame, size: int, starts: list[int], segments: list[int]) -> DataFrame:
    """``key, node, leader`` of every digest that several classes have, after the allocation; the smallest class leads."""
    rows = indexed(classes, segments)
    met = F.count("*").alias("f"), F.min("node").alias("leader"), F.min("place").alias("place")
    crowds = stored(rows.groupBy("key").agg(*met).where("f > 1"), "crowds")
    allocated = stored(allocation(crowds, classes, segments), "allocation")
    # At most half of the segments, whose number goes with the longest text and not with the number of documents.
    raised: dict[int, list[int]] = {}
    for row in allocated.select("raised").collect():
        raised.setdefault(row["raised"] // BAND_STEP, []).append(row["raised"] % BAND_STEP)
    left_out, up = (allocated.select(F.col(name).alias("place")) for name in ("left_out", "raised"))
    kept = crowds.join(left_out, "place", "left_anti")
    if not raised:
        return rows.select("key", "node").join(kept.select("key", "leader"), "key")
    near = classes.where(F.col("band").isin([*raised, *(band + 1 for band in raised)]))
    sets = sets_of(docs, near, size)
    deleted = neighbours(sets, starts, segments, {band: np.array(x) for band, x in raised.items()})
    near = stored(rows.join(up, "place", "left_semi").select("key", "node").unionByName(deleted).distinct(), "neighbours")
    led = near.groupBy("key").agg(F.count("*").alias("f"), F.min("node").alias("leader")).where("f > 1")
    exact = kept.join(up, "place", "left_anti").select("key", "leader")
    return near.join(led.select("key", "leader"), "key").unionByName(rows.select("key", "node").join(exact, "key"))


def across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs ``leader, node`` of two components."""
    named = pairs.select("leader", "node").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    named = named.join(parts.withColumnRenamed("node", "leader"), "leader", "left")
    return named.where(F.col("part") != F.coalesce("component", "leader")).select("leader", "node")


def jaccard_components(docs: DataFrame, ngram_words: int = 5, threshold: int = 80) -> DataFrame:
    """Every document with the component of similar documents it belongs to.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Words are runs of non-white-space with A-Z in lower case, a
    document's set is its distinct runs of ``ngram_words`` words, or the whole sequence as one where it has fewer. Two documents
    are linked if ``100 * intersection >= threshold * union``. Returns ``doc_id, n_shingles`` (the set's size) and
    ``component_id`` (the smallest doc_id reachable over links, itself included).

    NULL, empty and blank texts have no n-grams and stay alone. Rows that share a doc_id are linked each by its own text.
    Rows without a doc_id are linked with nothing and have a NULL component. An empty table gives an empty one.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    starts = band_starts(LARGEST_SET, threshold)
    segments = segments_of_bands(starts, threshold)
    rows = stored(sketches(source, ngram_words, starts, segments), "sketches")
    filled = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("band").alias("band"), F.min_by("digests", "doc_id").alias("digests"), F.min_by("parity", "doc_id").alias("parity")
    classes = stored(filled.groupBy("set_name").agg(*first).withColumn("node", F.monotonically_increasing_id()), "classes")
    parts = links_of_classes(source, classes, ngram_words, threshold, starts, segments)
    grouped = classes.select("set_name", "node", "doc_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = filled.select("doc_id", "n_shingles", "set_name").join(grouped.select("set_name", "component").join(smallest, "component"), "set_name")
    bare = rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").unionByName(bare)


def links_of_classes(docs: DataFrame, classes: DataFrame, size: int, threshold: int, starts: list[int], segments: list[int]) -> DataFrame:
    """``node, component`` of the classes that have a link."""
    members = stored(shared_digests(docs, classes, size, starts, segments), "shared")
    traits = classes.select("node", "n", "parity")
    pairs = stored(possible(members.where("leader <> node").select("leader", "node").distinct(), traits, threshold), "pairs")
    sets = stored(sets_of_pairs(docs, classes, pairs, size), "sets")
    # First each class with one leader only: near copies, which have many leaders in common, then are one component.
    links = stored(confirmed(pairs.groupBy("node").agg(F.min("leader").alias("leader")), sets, threshold), "links")
    parts = stored(connected_components(links), "components")
    more = stored(confirmed(across(pairs, parts), sets, threshold), "links")
    if not more.isEmpty():
        links = links.union(more)
        parts = stored(connected_components(links), "components")

    grouped = members.where("leader <> node").select(F.col("leader").alias("key"), "node").distinct()
    left = stored(mixed_buckets(grouped, parts).join(traits, "node"), "left")
    number = FIRST_LEADERS
    while not left.isEmpty():
        leaders = stored(next_leaders(left, number), "leaders")
        number = MOST_LEADERS
        pairs = stored(pairs_of_round(left, leaders, threshold), "pairs")
        if not pairs.isEmpty():
            new = stored(confirmed(pairs, sets_of_pairs(docs, classes, pairs, size), threshold), "links")
            if not new.isEmpty():
                links = links.union(new)
                parts = stored(connected_components(links), "components")
        left = stored(mixed_buckets(left.join(leaders.select("key", "node"), ["key", "node"], "left_anti"), parts), "left")
    return parts
