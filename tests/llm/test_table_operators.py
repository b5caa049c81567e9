"""Operators that compare documents with each other, and the pipeline, against plain restatements."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import connect, multiset
from docketframe.llm import components, exact_dedup, language, minmax, mixing, oracle, packing, queries, shared

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    relation = connect(sf_dir).sql(oracle.ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert multiset(frame.columns, frame.collect()) == multiset(relation.columns, relation.fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (5, "a  b", "s", 1), (3, "a\tb", None, 2), (9, None, "s", 3), (8, "", "t", 4), (2, " a b", "t", 5), (7, "x", "s", 6), (7, "x", "s", 6), (7, "y", "s", 7),
        (None, "x", None, 8), (None, "lonely", "u", 9), (11, "long " * 20_000, "u", 10), (12, "long " * 20_000, "u", 11),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_exact_duplicates_of_odd_rows(odd):
    got = exact_dedup.exact_duplicates(odd).collect()
    seen = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert seen == Counter({
        (5, 3, 2, False): 1, (3, 3, 2, True): 1, (9, 8, 2, False): 1, (8, 8, 2, True): 1, (2, 2, 1, True): 1, (7, 7, 3, True): 1, (7, 7, 3, False): 1,
        (None, 7, 3, False): 1, (7, 7, 1, True): 1, (None, None, 1, True): 1, (11, 11, 2, True): 1, (12, 11, 2, False): 1,
    })
    assert exact_dedup.exact_duplicates(odd.where("false")).count() == 0
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns and left.count() == 7


def test_broken_digests_are_resolved_by_the_texts(odd):
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(odd).collect()}
    weak = exact_dedup.exact_duplicates(odd, digest=lambda text: F.substring(exact_dedup.sha256(text), 1, 0))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak.collect()} == want


def test_state_outlives_the_stream(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame([(4, "a"), (6, "b")], "doc_id long, text string").write.parquet(one)
    spark.createDataFrame([(5, "a"), (1, "b"), (8, "c")], "doc_id long, text string").write.parquet(two)
    checkpoint = str(tmp_path / "state")
    exact_dedup.exact_duplicates(spark.read.parquet(one), checkpoint=checkpoint).collect()
    assert {r.keep_id: r.group_size for r in exact_dedup.read_state(spark, f"{checkpoint}/stream").collect()} == {4: 1, 6: 1}
    later = exact_dedup.exact_duplicates(spark.read.parquet(two), checkpoint=checkpoint).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in later} == {(5, 4, 2, False), (1, 1, 2, True), (8, 8, 1, True)}


def test_dedup_runs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op2_exact_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_components(rows, size, threshold):
    sets = {}
    for i, text in rows:
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k: k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, b in enumerate(ids):
        for a in ids[:n]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_of_changed_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 50)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, " ".join([f"s{i}x{k}" for k in range(rng.randint(20, 60))] + passage)) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE two"), (2004, "one two three")]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(frame, 4, 80).collect()}
    assert got == plain_components(rows, 4, 80)


def test_near_duplicates_verify_few_strangers(spark, monkeypatch):
    verified = []

    def counted(pairs, sets, threshold, plain=minmax.confirmed):
        verified.append(pairs.count())
        return plain(pairs, sets, threshold)

    monkeypatch.setattr(minmax, "confirmed", counted)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([*passage, *(f"s{i}x{k}" for k in range(20))])) for i in range(60)]
    rows.append((60, rows[0][1] + " more"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == plain_components(rows, 5, 80)
    assert sum(verified) <= 20


def test_near_copies_stand_once_in_their_groups(spark, monkeypatch):
    left = []

    def counted(rows, leaders, threshold, plain=minmax.pairs_of_round):
        left.append((rows.count(), rows.select("key", "node").distinct().count(), rows.select("node").distinct().count()))
        return plain(rows, leaders, threshold)

    monkeypatch.setattr(minmax, "pairs_of_round", counted)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:10 * (i % 20)] + [f"c{i}x{k}" for k in range(8)] + base[10 * (i % 20):])) for i in range(60)]
    rows += [(100 + i, " ".join(base[:90] + [f"d{i}x{k}" for k in range(70)] + base[90:])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == plain_components(rows, 5, 80)
    assert left and all(n == once and n <= 8 * nodes for n, once, nodes in left)


def test_only_texts_that_may_be_wanted_are_shuffled(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "x"), (7, "other")], "doc_id long, text string"))
    wanted = spark.createDataFrame([(7,), (4000,), (9999,)], "doc_id long")
    kept = shared.may_match(docs, wanted, "doc_id")
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.join(wanted, "doc_id").collect()) == Counter([(7, "some text"), (7, "other"), (4000, "some text")])
    assert kept.count() <= 10
    assert shared.may_match(docs, wanted.where("false"), "doc_id").count() == 0


def test_near_duplicates_of_odd_rows(odd):
    got = minmax.near_duplicates(odd, 5, 80)
    assert got.count() == odd.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in got.where("doc_id IS NULL OR doc_id > 10").collect()} == {(None, None, True), (11, 11, True), (12, 11, False)}
    assert minmax.near_duplicates(odd.where("false"), 5, 80).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(7, 3), (8, 8)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in [3, 7, *range(200, 300)]}}


def test_components_end_with_the_round_that_leaves_stars(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "stored", lambda frame, name, plain=components.stored: rounds.append(name) or plain(frame, name))
    edges = spark.createDataFrame([(1, i) for i in range(2, 50)] + [(3, 1), (60, 61), (61, 60)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 50)}, 60: 60, 61: 60}
    assert len(rounds) == 1
    assert components.connected_components(edges.where("false")).count() == 0


def plain_targets(sizes, weights):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / sum(weight[t] for t in names if t not in stopped) for s in names}
        above = {s for s in names if share[s] > 3 * sizes[s] and s not in stopped}
        if not above:
            return share
        stopped |= above


def test_targets(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 40, 1000, 9000]) for s in ["a", "B", "é", "z", "zz", None][: rng.randint(1, 6)]}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows, (5, 2, 1)).collect()}
        if sum(sizes.values()):
            assert got == pytest.approx(plain_targets(sizes, (5, 2, 1)))
        else:
            assert set(got.values()) == {0.0}


def test_mixing_of_odd_rows(odd):
    rows = mixing.repetitions(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.copies <= 3 for r in rows)
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert Counter(mixed.collect()) == Counter(mixing.mix_sources(odd).collect())
    assert mixing.mix_sources(odd.where("false")).count() == 0


def test_mix_comes_near_its_targets(spark, sf_dir):
    rows = queries.QUERIES["op3_mixing"](spark, f"{sf_dir}/../sf0.01").join(
        spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "source"), "doc_id"
    )
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.4 * r.target


def test_pipeline(spark, sf_dir):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*", F.lit(1).alias("score"))
    docs = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        docs[name] = after.collect()
        if name != "packing":
            assert after.columns == before.columns
        before = spark.createDataFrame(docs[name], after.schema) if docs[name] else after
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    letters = [r for r in start if any(c.isalpha() for c in r.text or "")]
    assert 0.98 * len(letters) <= len(docs["language"]) <= len(letters)
    first = {}
    for r in docs["language"]:
        text = WHITE.sub(" ", r.text)
        first[text] = min(first.get(text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in docs["exact_dedup"]} == set(first.values())
    parts = plain_components([(r.doc_id, r.text) for r in docs["exact_dedup"]], 5, 80)
    assert {r.doc_id for r in docs["near_dedup"]} == {i for i, (_, part) in parts.items() if i == part}
    sizes, copies = defaultdict(int), Counter(r.doc_id for r in docs["mixing"])
    for r in docs["near_dedup"]:
        sizes[r.source] += len(WORDS.findall(r.text))
    targets = plain_targets(sizes, (5, 2, 1))
    for r in docs["near_dedup"]:
        rate = targets[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= copies[r.doc_id] <= min(3, int(rate) + 1)
    assert Counter(r.doc_id for r in docs["packing"]) == copies
    assert all(r.n_tokens == len(WORDS.findall(r.text)) and r.padding >= 0 for r in docs["packing"])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(docs["packing"])
    assert language.UNKNOWN == "und"


def test_names_of_the_caller_stay(spark):
    names = ["_source", "_key", "_shard", "_nth", "_batch", "_length", "key", "row", "shard", "nth", "batch"]
    rows = [(i, "w " * (i % 7), "s" if i % 2 else None, *range(i, i + len(names))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    packed = packing.pack(docs, mixing.word_count(F.col("text")), n_buckets=3)
    assert packed.columns[: len(docs.columns)] == docs.columns
    assert sorted(tuple(r)[: len(docs.columns)] for r in packed.collect()) == sorted(rows)
    found = mixing.repetitions(docs)
    assert sorted(map(tuple, found.select(*docs.columns).collect())) == sorted(rows)
