"""Hard negatives of anchors by segment summary filtering.

Every vector is cut into segments, and the mean and deviation of each are stored beside it. For a segment of n values of
two vectors the products sum to n times the product of the means, plus or minus at most n times the product of the
deviations; summed over the segments this bounds the score from both sides. The bounds are taken over one segment first,
then over two, four and eight, each time only for the rows that are left, and only what no level rules out is scored
exactly. A row must be able to reach what an anchor still needs: for positives the lowest of the best scores met so far,
which lower bounds raise before anything is scored, for negatives a score inside one of the ranges around the positives
and no lower than the last of the best in it.

How it is dealt: rows lie in groups of about 16,384 and anchors in blocks of about 4,096; each block meets each group in
one place, so a task holds one block and streams its rows whatever the table's size. Positives meet rows of their own
label only, and a label of any size has as many groups as it needs. A place returns the best of each anchor, which the
ranking of all places then merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketframe.llm.shared import stored

SEGMENTS = (1, 2, 4, 8)
ROWS_PER_GROUP = 16_384
ANCHORS_PER_BLOCK = 4096
TILE_ROWS = 1024
TILE_ANCHORS = 512
# Larger components would not let every score fit a long; they count as this much.
LARGEST = 1 << 27
UNNAMED = 2**63 - 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def finest(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each of the smallest segments; segments without values have 0 of both."""
    cuts = segment_cuts(vectors.shape[1])
    sizes = np.maximum(np.diff(cuts), 1)
    values = vectors.astype(np.float64)
    means = np.diff(prefix_sums(values)[:, cuts], axis=1) / sizes
    from_mean = values - np.repeat(means, np.diff(cuts), axis=1)
    return means, np.sqrt(np.diff(prefix_sums(from_mean * from_mean)[:, cuts], axis=1) / sizes)


def segment_cuts(width: int) -> np.ndarray:
    return np.arange(SEGMENTS[-1] + 1) * width // SEGMENTS[-1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((len(values), 1)), np.cumsum(values, axis=1)), axis=1)


def levels(means: np.ndarray, deviations: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of every level, from one segment on, each times the root of its segment's size."""
    sizes = np.diff(segment_cuts(width)).astype(np.float64)
    out = []
    while True:
        out.append((means * np.sqrt(sizes), deviations * np.sqrt(sizes)))
        if len(sizes) == 1:
            return out[::-1]
        both = sizes.reshape(-1, 2)
        total = both.sum(axis=1)
        safe = np.maximum(total, 1)
        first, second = means.reshape(len(means), -1, 2), deviations.reshape(len(means), -1, 2)
        joined = (first * both).sum(axis=2) / safe
        squares = ((second**2 + (first - joined[:, :, None]) ** 2) * both).sum(axis=2) / safe
        means, deviations, sizes = joined, np.sqrt(squares), total


@dataclass
class Block:
    """Vectors with their summaries, row numbers, identifiers and label numbers."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    norms: np.ndarray
    largest: float

    def part(self, chosen: slice) -> Block:
        return Block(
            self.row[chosen], self.vec_id[chosen], self.label[chosen], self.vectors[chosen], [(m[chosen], d[chosen]) for m, d in self.levels],
            self.norms[chosen], self.largest,
        )


def block_of(batch: pa.RecordBatch, width: int, labels: dict[str, int]) -> Block:
    coded = batch.column("label").dictionary_encode()
    numbers = np.array([labels.setdefault(x, len(labels)) for x in coded.dictionary.to_pylist()], dtype=np.int64)
    vectors = matrix(batch.column("vector"), width)
    summary = levels(matrix(batch.column("means"), SEGMENTS[-1]), matrix(batch.column("deviations"), SEGMENTS[-1]), width)
    return Block(
        batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), numbers[coded.indices.to_numpy()], vectors, summary,
        np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)), float(np.abs(vectors).max(initial=0)),
    )


def exact_scores(a: Block, b: Block, ai: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, exact."""
    width = a.vectors.shape[1]
    out = np.zeros(len(ai), dtype=np.int64)
    if not width or not len(ai):
        return out
    if a.largest * b.largest * width < 2**53:
        if 8 * len(ai) > len(a.row) * len(b.row):
            return (a.vectors.astype(np.float64) @ b.vectors.T.astype(np.float64))[ai, bi].astype(np.int64)
    for at in range(0, len(ai), 8192):
        out[at: at + 8192] = np.einsum("ij,ij->i", a.vectors[ai[at: at + 8192]], b.vectors[bi[at: at + 8192]])
    return out


def survivors(a: Block, b: Block, possible: np.ndarray, least: np.ndarray, most: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``a``, place in ``b``) among the ``possible`` ones whose score may lie between an anchor's ``least`` and ``most``.

    With ``best`` an anchor's least is raised to the so-manieth largest lower bound.
    """
    mask, rows = possible, np.arange(len(b.row))
    # More than what rounding can move a bound by.
    slack = 1e-9 * np.outer(a.norms, b.norms) + 1e-6
    for (a_means, a_devs), (b_means, b_devs) in zip(a.levels, b.levels, strict=True):
        middle = a_means @ b_means[rows].T
        spread = a_devs @ b_devs[rows].T + slack[:, rows]
        if 0 < best <= len(rows):
            lower = np.where(mask, middle - spread, -np.inf)
            least = np.maximum(least, np.partition(lower, -best, axis=1)[:, -best])
        mask = mask & (middle + spread >= least[:, None]) & (middle - spread <= most[:, None])
        alive = mask.any(axis=0)
        rows, mask = rows[alive], mask[:, alive]
        if not len(rows):
            break
    ai, bi = np.nonzero(mask)
    return ai, rows[bi]


def place_in_run(key: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... inside each run of equal keys."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))


class Found:
    """Rows met so far: place of the anchor, score, identifier, row; best first for each anchor."""

    def __init__(self) -> None:
        self.parts = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, *parts: np.ndarray) -> None:
        both = [np.concatenate(pair) for pair in zip(self.parts, parts, strict=True)]
        order = np.lexsort((both[3], both[2], -both[1], both[0]))
        self.parts = [x[order] for x in both]

    def keep(self, chosen: np.ndarray) -> None:
        self.parts = [x[chosen] for x in self.parts]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """The batches cut where the group or the role changes, with both; groups come one after the other, anchors (role 0) first."""
    for batch in batches:
        columns = [batch.column(k) for k in [*keys, "role"]]
        change = np.zeros(batch.num_rows, dtype=bool)
        if batch.num_rows:
            change[0] = True
        for column in columns:
            if batch.num_rows > 1:
                change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change).tolist()
        for first, last in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(c[first].as_py() for c in columns[:-1]), columns[-1][first].as_py(), batch.slice(first, last - first)


def meet(placed: DataFrame, keys: list[str], start, step, end, kind: str, out: list[str]) -> DataFrame:
    """Run ``step`` on every group's tiles of anchors and rows, and return what ``end`` makes of each tile of anchors.

    ``start`` makes the state of a group from its anchors, as a list of (tile, state).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, tiles, labels = None, [], None, {}

        def finished() -> Iterator[pa.RecordBatch]:
            for tile, state in tiles or []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in end(tile, state)], names=out)

        for key, role, batch in runs(batches, keys):
            if key != group:
                yield from finished()
                group, waiting, tiles, labels = key, [], None, {}
            width = key[0]
            if role == 0:
                waiting.append(batch)
                continue
            if tiles is None:
                if not waiting:
                    continue
                anchors = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                whole, tiles, waiting = block_of(anchors, width, labels), [], []
                for at in range(0, len(whole.row), TILE_ANCHORS):
                    tile = whole.part(slice(at, at + TILE_ANCHORS))
                    tiles.append((tile, start(tile, anchors.slice(at, TILE_ANCHORS))))
            for at in range(0, batch.num_rows, TILE_ROWS):
                rows = block_of(batch.slice(at, TILE_ROWS), width, labels)
                for tile, state in tiles:
                    step(tile, rows, state)
        yield from finished()

    order = [*keys, "role"]
    return placed.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*order).mapInArrow(run, kind)


def place(rows: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Rows and anchors in groups: each row once per block of anchors, each anchor once per group of rows.

    With ``by`` only rows and anchors of equal values meet, and each value has as many groups and blocks as its rows need.
    """
    def number_of(most: int) -> Column:
        return F.expr(f"CAST((count(*) - 1) div {most} AS INT)")

    if by:
        both = rows.groupBy(*by).agg(number_of(ROWS_PER_GROUP).alias("groups")).join(anchors.groupBy(*by).agg(number_of(ANCHORS_PER_BLOCK).alias("blocks")), by)
        rows, anchors = rows.join(both, by), anchors.join(both, by)
    else:
        groups, blocks = (rows.count() - 1) // ROWS_PER_GROUP, (anchors.count() - 1) // ANCHORS_PER_BLOCK
        rows, anchors = (x.withColumns({"groups": F.lit(max(0, groups)), "blocks": F.lit(max(0, blocks))}) for x in (rows, anchors))
    number = F.xxhash64("row")
    rows = rows.select("*", F.lit(1).alias("role"), F.pmod(number, F.col("groups") + 1).cast("int").alias("group"), F.explode(F.expr("sequence(0, blocks)")).alias("block"))
    anchors = anchors.select("*", F.lit(0).alias("role"), F.pmod(number, F.col("blocks") + 1).cast("int").alias("block"), F.explode(F.expr("sequence(0, groups)")).alias("group"))
    return rows.unionByName(anchors, allowMissingColumns=True).drop("groups", "blocks")


def with_summaries(vectors: DataFrame, scale: int) -> DataFrame:
    """``row, vec_id, label, vector, is_anchor, width, means, deviations`` of the rows that take part; ``row`` tells all rows apart."""
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), "is_anchor"
    ).where("label IS NOT NULL AND embedding IS NOT NULL")
    source = source.where("NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))").select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(UNNAMED)).alias("vec_id"), "label",
        F.expr(f"transform(embedding, x -> CAST(greatest(-{LARGEST}D, least({LARGEST}D, floor({scale} * x))) AS LONG))").alias("vector"), "is_anchor",
    ).withColumn("width", F.size("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                means, deviations = finest(matrix(part.column("vector"), width))
                lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (means, deviations)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "means", "deviations"])

    return source.mapInArrow(run, "row long, vec_id long, label string, vector array<long>, is_anchor boolean, width int, means array<double>, deviations array<double>")


def nearest_of_label(rows: DataFrame, anchors: DataFrame, number: int) -> DataFrame:
    """The best ``number`` other rows of each anchor's label: ``anchor_row, positive_row, positive_id, positive_score, place``."""

    def start(tile: Block, anchors: pa.RecordBatch) -> dict:
        return {"found": Found(), "least": np.full(len(tile.row), -np.inf)}

    def step(tile: Block, rows: Block, state: dict) -> None:
        possible = tile.row[:, None] != rows.row[None, :]
        ai, bi = survivors(tile, rows, possible, state["least"], np.full(len(tile.row), np.inf), number)
        found = state["found"]
        found.add(ai, exact_scores(tile, rows, ai, bi), rows.vec_id[bi], rows.row[bi])
        found.keep(place_in_run(found.parts[0]) < number)
        last = place_in_run(found.parts[0]) == number - 1
        state["least"][found.parts[0][last]] = found.parts[1][last]

    def end(tile: Block, state: dict) -> list[np.ndarray]:
        at, score, vec_id, row = state["found"].parts
        return [tile.row[at], row, vec_id, score]

    names = ["anchor_row", "positive_row", "positive_id", "positive_score"]
    placed = place(rows, anchors, ["width", "label"]).select("width", "label", "block", "group", "role", "row", "vec_id", "vector", "means", "deviations")
    best = meet(placed, ["width", "label", "block", "group"], start, step, end, ", ".join(f"{n} long" for n in names), names)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= number)


def ranges_around(scores: pa.Array, low: int, high: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole score between ``low`` and ``high`` hundredths of each positive's; an impossible range where there is none."""
    least = np.full((len(scores), number), np.iinfo(np.int64).max)
    most = np.full((len(scores), number), np.iinfo(np.int64).min)
    for i, given in enumerate(scores.to_pylist()):
        for k, score in enumerate(given):
            first, last = -(-low * score // 100), high * score // 100
            if first <= last:
                least[i, k], most[i, k] = first, last
    return least, most


def best_outside_label(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """For each anchor and positive the best rows of other labels in range: ``anchor_row, place, negative_id, negative_score``."""

    def start(tile: Block, anchors: pa.RecordBatch) -> dict:
        least, most = ranges_around(anchors.column("scores"), low, high, positives)
        return {"found": Found(), "first": least, "last": most, "least": least.copy()}

    def in_range(state: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the found rows among the best of the anchor's range ``k``, and their ranks."""
        at, score, _, _ = state["found"].parts
        inside = np.flatnonzero((score >= state["first"][at, k]) & (score <= state["last"][at, k]))
        rank = place_in_run(at[inside])
        return inside[rank < negatives], rank[rank < negatives]

    def step(tile: Block, rows: Block, state: dict) -> None:
        possible = tile.label[:, None] != rows.label[None, :]
        ai, bi = survivors(tile, rows, possible, state["least"].min(axis=1).astype(np.float64), state["last"].max(axis=1).astype(np.float64))
        found = state["found"]
        found.add(ai, exact_scores(tile, rows, ai, bi), rows.vec_id[bi], rows.row[bi])
        kept = np.zeros(len(found.parts[0]), dtype=bool)
        for k in range(positives):
            inside, rank = in_range(state, k)
            kept[inside] = True
            full = inside[rank == negatives - 1]
            state["least"][found.parts[0][full], k] = found.parts[1][full]
        found.keep(kept)

    def end(tile: Block, state: dict) -> list[np.ndarray]:
        chosen = [in_range(state, k)[0] for k in range(positives)]
        inside = np.concatenate(chosen)
        at, score, vec_id, _ = (x[inside] for x in state["found"].parts)
        return [tile.row[at], np.repeat(np.arange(1, positives + 1), [len(x) for x in chosen]), vec_id, score]

    names = ["anchor_row", "place", "negative_id", "negative_score"]
    columns = ["width", "block", "group", "role", "row", "vec_id", "label", "vector", "means", "deviations", "scores"]
    best = meet(
        place(rows, anchors, []).select(*columns), ["width", "block", "group"], start, step, end, ", ".join(f"{n} long" for n in names), names
    )
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """The hard negatives of every anchor and each of its positives.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; other columns are ignored, but ``anchor`` may use them. Components
    ``x`` become ``floor(scale * x)``, and a score is the whole inner product; higher ones come first, ties by smaller
    vec_id. The positives of an anchor are its first ``positives`` other rows of the same label (all, if fewer). For each of
    them the first ``negatives`` rows of another label come back whose score lies between ``low`` and ``high`` hundredths of the
    positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a NULL label, a NULL vector or any NULL or non-finite component take no part. Vectors of different lengths
    have no score and never meet; empty vectors score 0. Rows without a vec_id are no anchors unless ``anchor`` says so and come last
    among ties. Repeated rows are rows of their own. Scaled components beyond 2^27 count as 2^27. An anchor without positives
    or without negatives in range has no rows, and an empty table gives an empty one.
    """
    table = vectors.select("vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = stored(with_summaries(table, scale), "vectors")
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    found = stored(nearest_of_label(rows, anchors, positives), "positives")
    scores = found.groupBy("anchor_row").agg(F.expr("transform(array_sort(collect_list(struct(place, positive_score))), x -> x.positive_score)").alias("scores"))
    searched = stored(anchors.join(scores.withColumnRenamed("anchor_row", "row"), "row"), "anchors")
    best = best_outside_label(rows, searched, positives, negatives, low, high)
    pairs = found.select("anchor_row", F.col("place").cast("long").alias("place"), "positive_id", "positive_score")
    pairs = pairs.join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    named = {n: F.nullif(F.col(n), F.lit(UNNAMED)).alias(n) for n in ("anchor_id", "positive_id", "negative_id")}
    return best.join(pairs, ["anchor_row", "place"]).select(
        named["anchor_id"], named["positive_id"], "rank", named["negative_id"], "positive_score", "negative_score"
    )
