"""The similarity join, the conversation trie and the hard negatives against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_table_operators import plain_components

from docketframe.llm import hard_negatives, minmax, ngram_join, prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# n-gram join ---------------------------------------------------------------

def changed_texts():
    rng = random.Random(11)
    rows, passage = [], [f"p{i}" for i in range(70)]
    for group, length in enumerate([12, 40, 90, 200]):
        base = [f"g{group}w{rng.randint(0, 500)}" for _ in range(length)]
        for i in range(30):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at: at + rng.randint(0, 1)] = [f"e{rng.randint(0, 9)}"] * rng.randint(0, 2)
            rows.append((1000 * (group + 1) - i, " ".join(words)))
    rows += [(i, " ".join([f"s{i}x{k}" for k in range(rng.randint(1, 12))] + passage)) for i in range(80)]
    return rows + [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (5004, "one two three"), (5005, "  ")]


def test_join_of_changed_texts(spark):
    rows = changed_texts()
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)


def test_near_copies_stand_once_in_their_groups_of_digests(spark, monkeypatch):
    left = []

    def counted(rows, leaders, threshold, plain=ngram_join.pairs_of_round):
        left.append((rows.count(), rows.select("key", "node").distinct().count(), rows.select("node").distinct().count()))
        return plain(rows, leaders, threshold)

    monkeypatch.setattr(ngram_join, "pairs_of_round", counted)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:3 * i], *(f"c{i}x{k}" for k in range(20)), *base[3 * i:]])) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)
    assert left and all(n == once and n <= 8 * nodes for n, once, nodes in left)


def test_join_with_deletion_neighbourhoods(spark, monkeypatch):
    def every_second(crowds, classes, segments):
        pairs = [(band * ngram_join.BAND_STEP + 2 * k, band * ngram_join.BAND_STEP + 2 * k + 1) for band, n in enumerate(segments[:60]) for k in range(n // 2)]
        return spark.createDataFrame(pairs, "left_out long, raised long")

    monkeypatch.setattr(ngram_join, "allocation", every_second)
    rows = changed_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)


def test_allocation_pays_for_itself(spark):
    starts = ngram_join.band_starts(20, 90)
    segments = ngram_join.segments_of_bands(starts, 90)
    band = ngram_join.bands_of(20, starts)[0]
    at = band * ngram_join.BAND_STEP
    classes = spark.createDataFrame([(20, band)] * 50, "n long, band int")
    (row,) = ngram_join.allocation(spark.createDataFrame([(at, 40), (at + 1, 2)], "place long, f long"), classes, segments).collect()
    assert row.left_out == at and at < row.raised < at + segments[band]
    few = spark.createDataFrame([(at, 3)], "place long, f long")
    assert ngram_join.allocation(few, classes, segments).count() == 0


@pytest.mark.parametrize("threshold", [50, 80, 90, 97])
def test_similar_sets_share_a_segment(threshold):
    rng = np.random.default_rng(threshold)
    starts = ngram_join.band_starts(3000, threshold)
    segments = ngram_join.segments_of_bands(starts, threshold)
    for _ in range(150):
        n = int(rng.integers(1, 2000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.concatenate((a[int(rng.integers(0, len(a) // 5 + 1)):], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        if 100 * shared < threshold * (len(a) + len(b) - shared):
            continue
        small, large = sorted((a, b), key=len)
        band = int(np.searchsorted(starts, len(small), side="right")) - 1
        assert int(np.searchsorted(starts, len(large), side="right")) - 1 in (band, band + 1)
        x, y = (ngram_join.subset_sums(s, band, segments[band])[0] for s in (a, b))
        assert (x == y).any()


@pytest.mark.parametrize("threshold", [30, 80, 90])
def test_parities_rule_out_no_link(threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(200):
        n = int(rng.integers(1, 1500))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.concatenate((a[int(rng.integers(0, len(a) // 2 + 1)):], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 2))).astype(np.uint64)))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        sets = pa.array([minmax.parity(a), minmax.parity(b)], pa.list_(pa.int64()))
        x, y = minmax.stacked(sets, sets.value_lengths().to_numpy().min())
        bits = np.bitwise_count(x ^ y).sum(dtype=np.int64)
        assert bits <= len(a) + len(b) - 2 * shared
        if 100 * shared >= threshold * (len(a) + len(b) - shared):
            assert minmax.may_link(bits, np.int64(len(a)), np.int64(len(b)), threshold)


def test_strangers_with_a_passage_are_not_verified(spark, monkeypatch):
    verified = []

    def counted(pairs, sets, threshold, plain=ngram_join.confirmed):
        verified.append(pairs.count())
        return plain(pairs, sets, threshold)

    monkeypatch.setattr(ngram_join, "confirmed", counted)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([*passage, *(f"s{i}x{k}" for k in range(8))])) for i in range(60)]
    rows.append((60, rows[0][1] + " more"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)
    assert sum(verified) <= len(rows)


def test_join_of_odd_rows(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (7, "x y z"), (3, "A b  c d"), (None, "a b c d"), (None, None), (9, "w " * 30_000), (8, "w " * 20_000), (4, None)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, members string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, 3, 90).collect())
    assert got == Counter({(7, 2, 3): 2, (7, 1, 7): 1, (3, 2, 3): 1, (None, 2, None): 1, (None, 0, None): 1, (9, 1, 8): 1, (8, 1, 8): 1, (4, 0, 4): 1})
    assert ngram_join.jaccard_components(frame.where("false"), 3, 90).count() == 0


# conversation trie -----------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        rest = c - int(np.fmod(c, 20))
        rebuilt = turns.get(rest, [])[:h] + turns[c][h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        ends[tuple(rebuilt)].append(c)
    out = Counter()
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = {n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below}
        saved = sum((len(members[n]) - 1) * len(WORDS.findall(n[-1][1])) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out[(who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node], sum(not n for n in children.values()), saved, digest)] += 1
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), -3, -20, 10**12]:
        if c % 10 == 7:
            continue
        for turn in range(rng.randint(1, 6)):
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", "bot", None]), rng.choice(["hi", "hi there", "", None, "a  b\tc"])))
    hot = [(c, t, "user", f"common text {t}") for c in range(200, 240) for t in range(9)]
    rows += hot + [(5, 1, "user", "again"), (5, 1, "user", "again"), (None, 1, "user", "no one's"), (400, None, None, None), (460, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("branch", [2, 4, 1024])
def test_trie(spark, monkeypatch, branch):
    monkeypatch.setattr(prefix_trie, "BRANCH", branch)
    rows = conversations(branch)
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, place int")
    got = prefix_trie.conversation_trie(frame)
    assert got.columns == COLUMNS and Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_of_nothing_and_of_a_long_conversation(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], kind)).count() == 0
    rows = spark.range(5000).select((F.col("id") % 2).alias("conv_id"), F.expr("id div 2").alias("turn"), F.lit("user").alias("role"), F.expr("concat('w ', id div 2)").alias("text"))
    nodes = prefix_trie.conversation_trie(rows).orderBy("depth").collect()
    assert [n.depth for n in nodes] == list(range(2501)) and nodes[0].saved_tokens == 5000 and nodes[1].n_leaves == 1


def test_queue_spills_and_keeps_the_order():
    rng = random.Random(3)
    queue, held = prefix_trie.SpillingQueue(5), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            assert queue.first() == min(held)
            held.remove(queue.pop())
        else:
            item = (rng.randint(0, 50), rng.randint(0, 5), rng.random())
            held.append(item)
            queue.push(item)
    while held:
        held.remove(queue.pop())
        assert queue.first() == (min(held) if held else None)


# hard negatives ----------------------------------------------------------------

def plain_negatives(rows, positives, negatives):
    kept = [
        (v, label, [int(np.floor(256 * x)) for x in vector]) for v, label, vector in rows
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector)
    ]
    out = Counter()
    for at, (a, label, vector) in enumerate(kept):
        if a is None or a % 5:
            continue
        scores = [
            (-sum(x * y for x, y in zip(vector, other)), 2**63 if v is None else v, of, v) for i, (v, of, other) in enumerate(kept) if i != at and len(other) == len(vector)
        ]
        scores.sort(key=lambda x: x[:2])
        for minus, _, _, p in [s for s in scores if s[2] == label][:positives]:
            fit = [s for s in scores if s[2] != label and -30 * minus <= -100 * s[0] <= -90 * minus]
            for rank, s in enumerate(fit[:negatives], 1):
                out[(a, p, rank, s[3], -minus, -s[0])] += 1
    return out


def random_vectors(seed, width=13, n=150):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = [(i, int(rng.integers(0, 4)), None) for i in range(n)]
    return [(i, label, [float(x) for x in 0.3 * centres[label] + rng.normal(size=width) * 0.4]) for i, label, _ in rows]


@pytest.mark.parametrize("group, block", [(16, 4), (16_384, 4096)])
def test_hard_negatives(spark, monkeypatch, group, block):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_GROUP", group)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", block)
    rows = random_vectors(group) + [
        (500, 1, None), (505, None, [1.0] * 13), (510, 1, [1.0, float("nan")]), (515, 1, [None] * 13), (520, 2, [0.5, 0.25, -1.0]), (525, 2, [0.5, 0.25, -0.5]),
        (530, 1, [0.125, 0.25, -0.5]), (535, 3, []), (540, 3, []), (545, 2, []), (None, 2, [0.25] * 13), (550, 9, [float("inf")] * 13), (555, 3, [3e8, 1.0, 1.0]),
    ]
    same = [(600 + i, i % 2, [0.5] * 13) for i in range(30)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + same], "vec_id long, label int, embedding array<float>, row string")
    got = hard_negatives.mine_hard_negatives(frame, F.col("vec_id") % 5 == 0)
    want = [(v, label, [float(np.float32(x)) if x is not None else None for x in vector] if vector is not None else None) for v, label, vector in rows + same]
    want = [(v, label, [min(x, 2**27 / 256) if x is not None and np.isfinite(x) else x for x in vector] if vector is not None else None) for v, label, vector in want]
    assert Counter(map(tuple, got.collect())) == plain_negatives(want, 5, 10)
    assert hard_negatives.mine_hard_negatives(frame.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(5)
    for width in (1, 5, 8, 64):
        a, b = (rng.integers(-300, 300, (40, width)) for _ in range(2))
        exact = (a @ b.T).astype(float)
        last = np.inf
        for (am, ad), (bm, bd) in zip(*(hard_negatives.levels(*hard_negatives.finest(x), width) for x in (a, b))):
            middle, spread = am @ bm.T, ad @ bd.T
            assert (middle - spread <= exact + 1e-6).all() and (exact <= middle + spread + 1e-6).all()
            assert spread.mean() <= last + 1e-6
            last = spread.mean()
