"""Totals of a trie of conversation prefixes, by time-forward processing.

A node is a distinct sequence of first turns. A conversation's path gets one key per depth: the running sums of the parts
of a digest of each turn and its depth, so that equal prefixes have equal keys and a window can work them out. Nodes are
the groups of equal keys.

Totals of subtrees are passed up in order of time. Inside a shard the nodes are sorted by reverse level order, the deepest
first; a node takes what its children have sent from a priority queue ordered by receiver, adds its own, and sends the
sum to its parent, which comes later. The queue holds a bounded number of messages in memory and spills sorted runs.

A shard is a largest subtree of at most 1,024 conversations; so a depth of it has at most that many nodes, and its queue
about as many messages. What its root sends leaves the shard. The nodes above are sharded in the same way, by a bound 1,024 times
as large: such a shard has at most 1,024 nodes at a depth too, as each of them has more conversations than the bound below. So
a few passes, one per power of 1,024 in the number of conversations, go from the leaves to the root, each of them parallel
over shards, and messages from the roots of lower shards are summed by receiver before they are read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketframe.llm.mixing import word_count
from docketframe.llm.shared import stored

BRANCH = 1024
SALTS = 32
MESSAGES_IN_MEMORY = 100_000
LIMBS = 4
NO_ENDS = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """A priority queue of tuples: a heap of bounded size, and sorted runs on disk that are merged with it.

    Runs lie where Spark's own spills lie, and go with the task.
    """

    def __init__(self, in_memory: int = MESSAGES_IN_MEMORY) -> None:
        self.in_memory = in_memory
        self.heap: list[tuple] = []
        self.heads: list[tuple[tuple, int, Iterator[tuple]]] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.in_memory:
            run = self.spilled(sorted(self.heap))
            self.heap = []
            heapq.heappush(self.heads, (next(run), len(self.heads) + id(run), run))

    @staticmethod
    def spilled(items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None)
        for at in range(0, len(items), 1000):
            pickle.dump(items[at: at + 1000], file)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(0, len(items), 1000):
                    yield from pickle.load(file)

        return read()

    def first(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not self.heads or self.heap and self.heap[0] <= self.heads[0][0]:
            return heapq.heappop(self.heap)
        item, number, run = self.heads[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (following, number, run))
        return item


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, digest, words`` of every turn of a conversation, place from 1 by turn; ties by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    narrow = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), word_count(text).cast("long").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return narrow.select("conv_id", F.row_number().over(order).alias("place"), "digest", "words")


def with_shared_starts(turns: DataFrame, group: int, starts: int) -> DataFrame:
    """Turns of ``numbered_turns`` with other first turns: ``conv_id, part, place, digest, words``, in the order of part and place.

    Conversation c gets the first h turns of conversation c - c % ``group`` in place of its own first h, where h is
    crc32 of the decimal c modulo ``starts``. Every conversation also has a row of part 0, its start without a turn.
    """
    number = F.crc32(F.col("conv_id").cast("string").cast("binary")) % starts
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < starts))
    heads = first.select(F.col("conv_id").alias("base"), "place", "digest", "words")
    convs = turns.select("conv_id").distinct().withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "number": number})
    taken = convs.join(heads, "base").where("place <= number").select("conv_id", F.lit(1).alias("part"), "place", "digest", "words")
    own = turns.where(F.col("place") > number).select("conv_id", F.lit(2).alias("part"), "place", "digest", "words")
    return starts_of(convs).unionByName(taken).unionByName(own)


def starts_of(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, key, words, ends``: the node that each conversation reaches at each depth, and whether it ends there."""
    in_order = Window.partitionBy("conv_id").orderBy("part", "place")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv_id", "part", "place", "digest", "words", (F.row_number().over(in_order) - 1).alias("depth"))
    own = F.when(F.col("depth") > 0, F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256))
    limbs = [F.coalesce(F.conv(F.substring("own", 1 + 8 * i, 8), 16, 10).cast("long"), F.lit(0)).alias(f"l{i}") for i in range(LIMBS)]
    placed = placed.withColumn("own", own).select("*", *limbs)
    # Sums of 32-bit numbers stay inside a long for any number of turns that a table can hold.
    sums = [F.sum(f"l{i}").over(so_far).cast("string") for i in range(LIMBS)]
    key = F.unhex(F.md5(F.concat_ws(":", F.col("depth").cast("string"), *sums)))
    return placed.select("conv_id", F.col("depth").cast("long").alias("depth"), key.alias("key"), "words", F.lead("depth").over(in_order).isNull().alias("ends"))


def nodes_of(path: DataFrame) -> DataFrame:
    """``key, depth, conv_id, parent, parent_conv_id, n_convs, words, level, shard`` of every node.

    ``shard`` is the topmost node above it of the same level. A node on very many paths is reduced, and met again by these
    paths, in ``SALTS`` parts.
    """
    salted = path.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    parts = salted.groupBy("key", "salt").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    whole = parts.groupBy("key").agg(F.min("first").alias("node_conv_id"), F.sum("n").alias("n_convs"))
    known = stored(parts.select("key", "salt").join(whole, "key"), "nodes")
    bounds = ", ".join(f"{BRANCH ** k}L" for k in range(1, 62 // (BRANCH.bit_length() - 1) + 1))
    on_path = salted.join(known, ["key", "salt"]).withColumn("level", F.expr(f"size(filter(array({bounds}), x -> x < n_convs))"))
    along = Window.partitionBy("conv_id").orderBy("depth")
    shard = F.first("key").over(Window.partitionBy("conv_id", "level").orderBy("depth"))
    seen = on_path.select(
        "key", "depth", "conv_id", "node_conv_id", F.lag("key").over(along).alias("parent"), F.lag("node_conv_id").over(along).alias("parent_conv_id"),
        "n_convs", "words", "level", shard.alias("shard"),
    )
    return seen.where("conv_id = node_conv_id").drop("node_conv_id")


TOTALS = "key binary, parent binary, is_root boolean, n_children long, n_leaves long, saved_tokens long"


def totals_within(nodes: DataFrame, in_memory: int = MESSAGES_IN_MEMORY) -> DataFrame:
    """Subtree totals of the nodes of shards (``key, parent, depth, shard, own, children, leaves, saved``), from below to the top.

    ``children``, ``leaves`` and ``saved`` are the sums of what lies outside the shard, below the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queue = None, SpillingQueue(in_memory)
        for batch in batches:
            out = []
            for shard, depth, key, parent, own, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != group:
                    group, queue = shard, SpillingQueue(in_memory)
                place = (-depth, key)
                while (message := queue.first()) is not None and message[:2] == place:
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + message[2], saved + message[3]
                leaves, saved = leaves if children else 1, saved + own
                if key != shard:
                    queue.push((1 - depth, parent, leaves, saved))
                out.append((key, parent, key == shard, children, leaves, saved))
            kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), kind) for x, kind in zip(columns, kinds, strict=True)],
                names=["key", "parent", "is_root", "n_children", "n_leaves", "saved_tokens"],
            )

    rows = nodes.select("shard", "depth", "key", "parent", "own", "children", "leaves", "saved")
    return rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key").mapInArrow(run, TOTALS)


def subtree_totals(nodes: DataFrame, top: int) -> DataFrame:
    """``key, n_children, n_leaves, saved_tokens`` of all nodes: shards of level 0 first, the level of the root (``top``) last."""
    done = None
    for level in range(top + 1):
        here = nodes.where(F.col("level") == level).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
        if done is None:
            here = here.withColumns({name: F.lit(0).cast("long") for name in ("children", "leaves", "saved")})
        else:
            sent = done.where("is_root").groupBy(F.col("parent").alias("key")).agg(
                F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
            )
            here = here.join(sent, "key", "left").fillna(0, ["children", "leaves", "saved"])
        found = stored(totals_within(here), "totals")
        done = found if done is None else done.unionByName(found)
    return done.select("key", "n_children", "n_leaves", "saved_tokens")


def end_digests(path: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of nodes at which conversations end: the digest of their numbers in order, without holding them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest = None, None
        for batch in batches:
            out = []
            for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == group:
                    digest.update(b",")
                else:
                    if group is not None:
                        out.append((group, digest.hexdigest()))
                    group, digest = key, hashlib.sha256()
                digest.update(str(conv_id).encode())
            yield ends(out)
        if group is not None:
            yield ends([(group, digest.hexdigest())])

    def ends(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.binary(), pa.string()))], names=["key", "ends_sha256"])

    rows = path.where("ends").select("key", "conv_id")
    return rows.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of the conversations in ``turns`` (``conv_id, part, place, digest, words``, as ``with_shared_starts`` makes them).

    Returns for each node ``conv_id`` (the smallest member: a conversation that starts with it), ``depth``, ``parent_conv_id``,
    ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree, words
    of each node's last turn times its members less one) and ``ends_sha256`` (of the numbers of the conversations that end
    there, ascending, joined by commas). A table without conversations has no nodes.
    """
    path = stored(paths(turns), "paths")
    nodes = stored(nodes_of(path), "nodes")
    top = nodes.where("depth = 0").agg(F.max("level")).first()[0] or 0
    found = nodes.join(subtree_totals(nodes, top), "key").join(end_digests(path), "key", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, group: int = 20, starts: int = 4) -> DataFrame:
    """The nodes of the trie of ``conversations`` (``conv_id, turn, role, text``) after ``with_shared_starts``.

    Turns are taken by turn, NULL first; turns of the same number, repeated ones too, by a digest of role and text. A NULL role
    or text is empty. Rows without a conv_id belong to no conversation and are left out; other columns are ignored. A
    conversation that is left without turns is a member of the root alone.
    """
    return prefix_trie(with_shared_starts(stored(numbered_turns(conversations), "turns"), group, starts))
