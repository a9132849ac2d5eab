import random
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartpulse.llm import common, signature_tree, vector_forest


def families(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 30, 60, 120, 300]))]
        for _ in range(20):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words))
                words[at] = f"z{rng.randrange(99999)}" if rng.random() < 0.5 else words[at - 1]
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "hello there you all"), (None, "hello there you all"), (3, "another text for a key that repeats")]
    rows += [(1003, "one two"), (1004, "ONE two"), (1005, "x " * 30000), (1006, "x " * 20000), (1007, "É a b"), (1008, "é a b")]
    return rows


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 9, 10, 2_000_000), (5, 8, 10, 2_000_000), (3, 9, 10, 1500)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(signature_tree, "GROUP_TOKENS", block)  # small blocks: pairs of blocks are compared too
    rows = families(n + block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS class", "1 AS size").repartition(3)
    got = signature_tree.jaccard_components(docs, n=n, num=num, den=den).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.jaccard(rows, n, num, den)


def test_jaccard_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert signature_tree.jaccard_components(docs).count() == 0


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10)):
        for size in (1, 2, 5, 11, 24, 25, 60, 155, 700):
            for _ in range(30):
                base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                other = base[: max(1, size - int(rng.integers(0, size // 9 + 1)))]
                other = np.unique(np.concatenate([other, rng.integers(0, 1 << 63, int(rng.integers(0, size // 9 + 1)), dtype=np.uint64)]))
                base = np.unique(base)
                if signature_tree.linked(base, other, num, den) and not np.array_equal(base, other):
                    ranges = signature_tree.Ranges(num, den)
                    keys = [set(signature_tree.part_keys(s, ranges).tolist()) for s in (base, other)]
                    assert keys[0] & keys[1]


def test_jaccard_components_in_many_buckets_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(signature_tree, "BUCKET_CHARS", 500)
    monkeypatch.setattr(common.at_most, "__defaults__", (0,))
    rows = families(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = signature_tree.jaccard_components(docs, n=5, num=8, den=10).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.jaccard(rows, 5, 8, 10)


def test_sets_that_share_a_few_tokens_rarely_share_a_part():
    rng = np.random.default_rng(5)
    ranges = signature_tree.Ranges(8, 10)
    met = 0
    for _ in range(400):
        few = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([few, rng.integers(0, 1 << 63, 400, dtype=np.uint64)])) for _ in range(2))
        met += bool(np.intersect1d(signature_tree.part_keys(a, ranges), signature_tree.part_keys(b, ranges)).size)
    assert met <= 8


def test_packed_pairs_come_back():
    rng = np.random.default_rng(6)
    keys, owners = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    packed = signature_tree._packed(keys, owners)
    assert len(packed) == 12 * len(keys)
    got = signature_tree._unpacked([packed[:1200], packed[1200:]])
    assert all(np.array_equal(x, y.astype(np.int64) & ((1 << 48) - 1)) for x, y in zip(got, (keys, owners), strict=True))


def shuffle_files(spark) -> dict[str, int]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(p): p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*")}


def test_written_tables_leave_no_shuffle_files(spark):
    old = shuffle_files(spark)
    table = common.written(spark.range(5000).groupBy((F.col("id") % 997).alias("k")).count(), "t")
    assert table.count() == 997
    assert spark.conf.get(common.SHUFFLES_GO, None) is None
    assert sum(v for k, v in shuffle_files(spark).items() if k not in old) < 2000  # the count's own


def test_near_duplicates_of_large_tables_shuffle_few_texts(spark, monkeypatch):
    for f in (common.at_most, common.checked_broadcast):
        monkeypatch.setattr(f, "__defaults__", (0,))
    monkeypatch.setattr(common, "SHUFFLES_GO", "spark.cartpulse.none")  # what is shuffled stays, to be counted
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(60)) for _ in range(400)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i]) for i in range(4)] + [(2000 + i, texts[i] + " end") for i in range(2, 6)] + [(0, texts[0])]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "t")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in names]
    try:
        for k in names:
            spark.conf.set(k, "-1")
        old = shuffle_files(spark)
        kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        moved = sum(v for k, v in shuffle_files(spark).items() if k not in old)
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(tuple(r) for r in kept) == sorted(enumerate(texts))
    assert moved < 0.6 * sum(len(t) for t in texts)


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(149, 200), (300, 300), (500, 400), (400, 500)]
    got = {r.node: r.root for r in common.component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 100, 400: 400, 500: 400}


def vectors() -> list[tuple]:
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    rows = [(i, (base[rng.integers(20)] + rng.standard_normal(16) * rng.choice([0.1, 0.2])).tolist()) for i in range(600)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [1.0, None] + [0.0] * 14)]
    rows += [(2005, [1.0] * 3), (2006, [2.0] * 3), (2007, rows[0][1]), (2008, [1e200] * 16), (2009, [2e200] * 16), (2010, [float("inf")] * 16)]
    return rows


@pytest.mark.parametrize("block", [1024, 60])
def test_vectors_reach_the_recall_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_forest, "LEAF_ROWS", block)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS leaf", "'x' AS class")
    got = sorted((tuple(r) for r in vector_forest.near_vectors(table).collect()))
    want = brute.cosine(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))  # no link below the threshold, none counted twice
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_vectors_of_the_test_table_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(tuple(r)[:3] for r in vector_forest.near_vectors(table).collect()) == brute.cosine(rows)


def test_forest_keeps_the_links_of_a_hot_group():
    rng = np.random.default_rng(4)
    total, hot = 100_000, 33_333
    centre = vector_forest.unit([rng.standard_normal(64)])
    x = rng.standard_normal((total, 64))
    x[:hot] = centre * 3.27 + rng.standard_normal((hot, 64)) / 8  # mean cosine about 0.914
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sample = x[rng.permutation(total)[: vector_forest.SAMPLE]]
    forest = vector_forest.fit_forest(list(sample), total)[64]
    a, b = rng.integers(0, hot, 20_000), rng.integers(0, hot, 20_000)
    near = (x[a] * x[b]).sum(axis=1) >= 0.9
    missed = np.ones(int(near.sum()), dtype=bool)
    other = rng.standard_normal((2000, 64)) / 8
    other = x[hot : hot + 2000] + other * 0.46
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    close = (other * x[hot : hot + 2000]).sum(axis=1) >= 0.9
    far = np.ones(int(close.sum()), dtype=bool)
    for tree in forest:
        missed &= vector_forest._apart(tree, x[a][near], x[b][near])
        far &= vector_forest._apart(tree, x[hot : hot + 2000][close], other[close])
    assert len(missed) > 5000 and len(far) > 500
    assert missed.mean() <= 0.002 and far.mean() <= 0.005


def test_vectors_empty_table(spark):
    assert vector_forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("width", [4, 64, 768])
def test_copies_of_vectors_do_not_grow_with_the_dimension(width):
    rng = np.random.default_rng(1)
    x = vector_forest.unit(list(rng.standard_normal((2048, width))))
    forest = vector_forest._grown(x, 64, 4, 0.9, [5, width])
    assert None not in forest and len(forest) < vector_forest.MOST_TREES
    assert all(sum(len(rows) for _, rows in tree.put(x)) < 5 * len(x) for tree in forest)


def test_vectors_that_no_forest_separates_are_all_compared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_forest, "MOST_TREES", 1)
    monkeypatch.setattr(vector_forest, "LEAF_TARGET", 8)
    monkeypatch.setattr(vector_forest, "LEAF_ROWS", 100)
    assert vector_forest.fit_forest([v for _, v in rows], len(rows), trees=1)[3] == [None]
    assert sorted(tuple(r)[:3] for r in vector_forest.near_vectors(table, trees=1).collect()) == brute.cosine(rows)
