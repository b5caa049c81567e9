"""Near-duplicate documents by min-max hashing.

Every document is a set of word shingles. Under each of 189 permutations both the smallest and the largest value of
the set are kept, so a signature of 378 values costs 189 hash evaluations per shingle. Two sets agree in either value
with a probability that equals their similarity, and the two values of one permutation are negatively correlated, so
their mean varies less than that of two independent minima. Bands of seven values place documents in buckets; a pair at
similarity 0.8 shares none of the 54 buckets with probability 3e-6, one at 0.3 shares any with probability 0.01. Links
found through a bucket are confirmed on the full sets.

How a bucket is compared: documents with the same set are one class, and only its smallest document takes part. A
bucket's members are compared with one leader, the smallest class in it, the links become components, and only members of
*other* components are left to compare. Buckets with the same leader, which near copies share by the dozen, are from then on one
group, in which a class stands once. Each further round sets a block of leaders against what remains, and a group is done when that
has one component. No group is expanded into all its pairs, and no pair of a bucket that could join two components is left out.

Every class carries the parities of its set: as many bits as shingles or up to twice as many, each of which tells whether an
odd number of the set's shingles hash to its place. A shingle that only one of two sets has changes one bit, so sets differ in
at least as many shingles as their parities in bits. Two classes meet with their full sets only if their parities allow a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docketframe.llm.components import connected_components
from docketframe.llm.exact_dedup import has_places
from docketframe.llm.shared import may_match, stored
from docketframe.llm.words import mix, split_words, text_slices, window_codes

PERMUTATIONS = 189
ROWS_PER_BAND = 7
# Leaders of each bucket in the first round, and in all others.
FIRST_LEADERS = 16
MOST_LEADERS = 1024
MEMBERS_PER_CHUNK = 1024
# Members compared with all leaders at once.
MEMBERS_PER_BLOCK = 256
BLOCK = 1 << 11
PARITY_SALT = 0x5BE0CD19137E2179

_DRAWN = np.random.default_rng(8)
FACTORS = _DRAWN.integers(1, 2**63, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAWN.integers(0, 2**63, size=PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    for _, part in text_slices(texts):
        words = split_words(part, lower=True)
        codes, at = window_codes(words, size)
        owner = words.row[at]
        cut = np.searchsorted(owner, np.arange(words.n_rows + 1))
        first = words.bounds()
        for i in range(words.n_rows):
            n = first[i + 1] - first[i]
            if n >= size:
                yield np.unique(codes[cut[i]: cut[i + 1]])
            elif n:
                short = np.uint64(n)
                for code in words.code[first[i]: first[i + 1]]:
                    short = mix(np.array([short], dtype=np.uint64) + code)[0]
                yield np.array([short], dtype=np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(members: np.ndarray) -> np.ndarray:
    """Minima under all permutations ``factor * x + shift`` of the 64-bit numbers, then the maxima."""
    low = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(members), BLOCK):
        values = FACTORS[:, None] * members[None, at: at + BLOCK]
        values += SHIFTS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket key per band; the band's number is part of it."""
    rows = values.reshape(-1, ROWS_PER_BAND)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS_PER_BAND):
        key = mix(key + rows[:, k])
    return key.view(np.int64)


def set_name(members: np.ndarray) -> bytes:
    """A 128-bit name of the whole set."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def parity(members: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of members hash to their place; their number is a power of two, that of the members or more."""
    bits = max(64, 1 << max(0, len(members) - 1).bit_length())
    place = (mix(members ^ np.uint64(PARITY_SALT)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def folded(parities: np.ndarray, width: int) -> np.ndarray:
    """The parities, one in a row, that the sets have with ``width`` numbers of 64 bits."""
    while parities.shape[1] > width:
        half = parities.shape[1] // 2
        parities = parities[:, :half] ^ parities[:, half:]
    return parities


def stacked(parities: pa.ListArray, width: int) -> np.ndarray:
    """The parities of a column as rows of ``width`` numbers, which is at most the least that one of them has."""
    flat, lengths = parities.flatten().to_numpy().view(np.uint64), parities.value_lengths().to_numpy()
    first = np.cumsum(lengths) - lengths
    out = np.empty((len(lengths), width), dtype=np.uint64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out[at] = folded(flat[first[at][:, None] + np.arange(length)], width)
    return out


def may_link(bits: np.ndarray, n: np.ndarray, other: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of these sizes, whose parities differ in ``bits`` bits, can be similar enough."""
    return (100 * np.minimum(n, other) >= threshold * np.maximum(n, other)) & (bits * (100 + threshold) <= (n + other) * (100 - threshold))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Per document: its set's size and name, the bucket keys and the parities; after them the other columns of ``docs``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, keys, odd = [], [], [], []
            for members in shingle_sets(batch.column(1), size):
                sizes.append(len(members))
                names.append(set_name(members))
                keys.append(band_keys(signature(members)) if len(members) else None)
                odd.append(parity(members))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), *batch.columns[2:]],
                names=["doc_id", "n_shingles", "set_name", "bands", "parity", *others],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    kinds = T.StructType.fromDDL("doc_id long, n_shingles long, set_name binary, bands array<long>, parity array<long>")
    return source.mapInArrow(run, T.StructType([*kinds, *(source.schema[c] for c in others)]))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, set_name, members`` with the whole shingle set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                sets = list(shingle_sets(part.column(1), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([set_name(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["doc_id", "set_name", "members"],
                )

    return docs.mapInArrow(run, "doc_id long, set_name binary, members binary")


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets share at least ``threshold`` hundredths of their union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
    return 100 * shared >= threshold * (len(a) + len(b) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``leader, node`` whose full sets are similar enough.

    The members of a leader are dealt into groups of about 1024, each of which gets one copy of the leader's set, so
    that a leader with any number of members is spread over many tasks and each member's set is sent once.
    """
    per_leader = pairs.groupBy("leader").agg(F.count("*").alias("n_members"))
    dealt = pairs.join(per_leader, "leader").select(
        "leader", "node", F.expr(f"pmod(xxhash64(node), n_members div {MEMBERS_PER_CHUNK} + 1)").alias("chunk"), F.lit(1).alias("role")
    )
    heads = dealt.select("leader", "chunk").distinct().select("leader", F.col("leader").alias("node"), "chunk", F.lit(0).alias("role"))
    rows = dealt.unionByName(heads).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for batch in batches:
            out = []
            numbers = (batch.column(i).to_numpy().tolist() for i in range(4))
            for i, (leader, chunk, role, node) in enumerate(zip(*numbers, strict=True)):
                if (leader, chunk) != group:
                    group, heads = (leader, chunk), []
                own = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.uint64)
                if role == 0:
                    heads.append(own.copy())
                    continue
                if any(similar(head, own, threshold) for head in heads):
                    out.append((leader, node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"]
            )

    placed = rows.select("leader", "chunk", "role", "node", "members").repartition("leader", "chunk")
    return placed.sortWithinPartitions("leader", "chunk", "role").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: int = 80) -> DataFrame:
    """Every document with the component of near duplicates it belongs to.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Words are runs of non-white-space with A-Z in
    lower case. Two documents are linked if ``100 * intersection >= threshold * union`` of their shingle sets. Returns
    ``doc_id, n_shingles, component_id`` (the smallest doc_id reachable over links, itself included) and ``kept`` (that
    is its own).

    NULL, empty and blank texts have no shingles and stay alone. Rows that share a doc_id are judged by the text that each
    has. Rows without a doc_id are linked with nothing, have a NULL component and are kept. An empty table gives an empty one.
    """
    return components_of(docs.select("doc_id", "text"), shingle_words, threshold)


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, whatever their names.

    Rows are told apart by file and row number, so that rows which share a doc_id are kept or dropped each by its text.
    """
    if not has_places(docs):
        docs = stored(docs, "documents")
    places = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")]
    found = components_of(docs.select("doc_id", "text", *places), shingle_words, threshold)
    gone = stored(found.where(~F.col("kept")).select("_file", "_place"), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row"), *places)
    return rows.join(gone, ["_file", "_place"], "left_anti").select("row.*")


def components_of(docs: DataFrame, shingle_words: int, threshold: int) -> DataFrame:
    """What ``near_duplicates`` returns, and the columns of ``docs`` other than ``doc_id`` and ``text``.

    Documents with the same set are one class, the node of the graph.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    sketch = stored(sketches(docs, shingle_words), "sketches")
    named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(
        named.groupBy("set_name").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("parity", "doc_id").alias("parity"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    in_bucket = classes.select("node", F.explode("bands").alias("key"))
    crowded = in_bucket.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = stored(in_bucket.join(crowded, "key").select("key", "node", "leader"), "buckets").where("leader <> node")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    traits = classes.select("node", "n", "parity")
    pairs = stored(possible(members.select("leader", "node").distinct(), traits, threshold), "pairs")
    links = stored(confirmed(pairs, sets_of_pairs(texts, classes, pairs, shingle_words), threshold), "links")
    parts = stored(connected_components(links), "components")

    left = stored(mixed_buckets(members.select(F.col("leader").alias("key"), "node").distinct(), parts).join(traits, "node"), "left")
    number = FIRST_LEADERS
    while not left.isEmpty():
        leaders = stored(next_leaders(left, number), "leaders")
        number = MOST_LEADERS
        pairs = stored(pairs_of_round(left, leaders, threshold), "pairs")
        if not pairs.isEmpty():
            new = stored(confirmed(pairs, sets_of_pairs(texts, classes, pairs, shingle_words), threshold), "links")
            if not new.isEmpty():
                links = links.union(new)
                parts = stored(connected_components(links), "components")
        left = stored(mixed_buckets(left.join(leaders.select("key", "node"), ["key", "node"], "left_anti"), parts), "left")

    grouped = classes.select("set_name", "node", "doc_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_parts = grouped.select("set_name", "component").join(smallest, "component").select("set_name", "component_id")
    bare = sketch.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *others)
    found = named.select("doc_id", "n_shingles", "set_name", *others).join(named_parts, "set_name").select("doc_id", "n_shingles", "component_id", *others)
    return found.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def mixed_buckets(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows with their present component, without the buckets that hold a single one."""
    found = rows.drop("component").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = found.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return found.join(mixed.select("key"), "key")


def sets_of(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``node, members`` of the classes; the row that stands for a class is found by its document and set.

    Only texts that may be wanted are shuffled.
    """
    wanted = classes.select("doc_id").distinct()
    texts = may_match(docs, wanted, "doc_id").join(wanted, "doc_id")
    return full_sets(texts, size).join(classes.select("doc_id", "set_name", "node"), ["doc_id", "set_name"]).select("node", "members")


def sets_of_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``node, members`` of the classes in the pairs ``leader, node``."""
    nodes = pairs.select(F.explode(F.array("leader", "node")).alias("node")).distinct()
    return sets_of(docs, classes.join(nodes, "node"), size)


def possible(pairs: DataFrame, traits: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``leader, node`` whose sizes and parities allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, leader_n = (batch.column(name).to_numpy() for name in ("n", "leader_n"))
            own, leaders = batch.column("parity"), batch.column("leader_parity")
            widths = np.minimum(own.value_lengths().to_numpy(), leaders.value_lengths().to_numpy())
            bits = np.zeros(batch.num_rows, dtype=np.int64)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                bits[at] = np.bitwise_count(stacked(own.take(pa.array(at)), width) ^ stacked(leaders.take(pa.array(at)), width)).sum(axis=1)
            yield batch.select(["leader", "node"]).filter(pa.array(may_link(bits, n, leader_n, threshold)))

    heads = traits.select(F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("parity").alias("leader_parity"))
    return pairs.join(traits, "node").join(heads, "leader").mapInArrow(run, "leader long, node long")


def next_leaders(left: DataFrame, number: int) -> DataFrame:
    """Up to ``number`` rows of each digest, from its smallest components, and the digest's number of ``chunks``; one of any size is ranked in parts."""
    sizes = left.groupBy("key", "component").agg(F.count("*").alias("rows"))
    chunks = sizes.groupBy("key").agg((F.expr(f"sum(rows) div {MEMBERS_PER_CHUNK}") + 1).alias("chunks"))
    rows = left.join(sizes, ["key", "component"]).join(chunks, "key").withColumn("part", F.expr("pmod(xxhash64(node), chunks)"))
    order = [F.col("rows"), F.col("component"), F.col("node")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "part").orderBy(*order))).where(F.col("rank") <= number)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= number)
    return best.select("key", "node", "n", "parity", "component", "chunks")


def pairs_of_round(left: DataFrame, leaders: DataFrame, threshold: int) -> DataFrame:
    """``leader, node`` of each digest's leaders and its rows of other components, as far as sizes and parities allow a link.

    The rows of a digest are dealt into chunks of about 1024, each of which gets the leaders.
    """
    columns = ["node", "n", "component", "parity"]
    chunks = leaders.groupBy("key").agg(F.max("chunks").alias("chunks"))
    members = left.join(chunks, "key").select("key", F.expr("pmod(xxhash64(node), chunks)").alias("chunk"), F.lit(1).alias("role"), *columns)
    heads = leaders.select("key", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), F.lit(0).alias("role"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leading = None, []
        for batch in batches:
            key, chunk, role = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (key[first], chunk[first]) != group:
                    group, leading = (key[first], chunk[first]), []
                middle = first + int(np.searchsorted(role[first:last], 1))
                if middle > first:
                    leading.append(batch.slice(first, middle - first))
                if middle == last:
                    continue
                those = pa.Table.from_batches(leading).combine_chunks().to_batches()[0]
                leading = [those]
                for at in range(middle, last, MEMBERS_PER_BLOCK):
                    x, y = linked_places(batch.slice(at, min(last - at, MEMBERS_PER_BLOCK)), those, threshold)
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["leader", "node"])

    placed = members.unionByName(heads).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "role")
    return placed.mapInArrow(run, "leader long, node long").distinct()


def linked_places(members: pa.RecordBatch, leaders: pa.RecordBatch, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of members and leaders of other components that may have a link."""
    width = min(x.column("parity").value_lengths().to_numpy().min() for x in (members, leaders))
    own, theirs = (stacked(x.column("parity"), width) for x in (members, leaders))
    bits = np.zeros((len(own), len(theirs)), dtype=np.int64)
    for k in range(width):
        bits += np.bitwise_count(own[:, k, None] ^ theirs[None, :, k])
    (node, n, part), (leader, leader_n, leader_part) = ([x.column(name).to_numpy() for name in ("node", "n", "component")] for x in (members, leaders))
    fit = may_link(bits, n[:, None], leader_n[None, :], threshold) & (part[:, None] != leader_part[None, :])
    x, y = np.nonzero(fit)
    return node[x], leader[y]
