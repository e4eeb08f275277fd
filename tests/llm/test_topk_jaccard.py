"""Exact top-k and the Jaccard join against brute force, with edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import graph, jaccard, topk
from tessera.llm.graph import components

VECTORS = "vec_id bigint, embedding array<float>"


def brute_topk(rows, k, every):
    def fits(x, e):
        return x is not None and math.isfinite(x) and abs(1024 * float(np.float32(x))) < math.sqrt(2**62 / len(e))

    v = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in e)) for i, e in rows if i is not None and e and all(fits(x, e) for x in e)]
    out = set()
    for q, a in dict.fromkeys((i, e) for i, e in v if i % every == 0):
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(b) == len(a))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(hits, 1)}
    return out


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(700)]
    rows += [(i + 700, rows[i][1]) for i in range(60)]  # ties
    rows += [(i + 1000, [3.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(250)]  # many candidates with one vector
    rows += [(950, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0]), (951, [0.0, -3e38, 0.0, 0.0, 0.0, 0.0]), (952, [9e5, 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(800, None), (801, []), (802, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (803, [math.nan] * 6), (804, [math.inf] * 6), (900, [1.0, 2.0]), (901, [0.5, -3.0]), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("shard", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, per_shard=100, query_block=7)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_topk(rows, 5, 50)


def test_topk_empty_and_few(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 2 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [2.0])], VECTORS)
    assert sorted(tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0, k=10).collect()) == [(0, 1, 2, 2 * 1024 * 1024), (0, 2, 1, 1024 * 1024)]


def brute_components(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            index[x].append(i)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return sorted((d, len(sets[i]), min(ids[root(i)])) for i, (d, _) in enumerate(rows))


def near_copies(seed, n=160):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[words[i] for i in rng.integers(0, 400, m)] for m in (60, 60, 90, 8, 300)]
    passage = [words[i] for i in rng.integers(0, 400, 40)]
    rows = []
    for i in range(n):
        w = list(base[int(rng.integers(0, 5))])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = f"x{int(rng.integers(0, 30))}"
        if i % 5 == 0:
            w = [f"u{i}_{j}" for j in range(50)] + passage
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One"), (n + 4, "one"), (n + 5, "É a b"), (n + 6, "é a b")]


@pytest.mark.parametrize("k,percent,options", [(3, 90, {}), (5, 80, {}), (3, 90, {"block": 6, "deals": 1}), (3, 90, {"block": 4, "deals": 0}), (1, 50, {}), (3, 90, {"hot_at": 8}), (5, 80, {"id_bits": 3})])
def test_jaccard_matches_brute_force(spark, k, percent, options):
    rows = near_copies(k * 100 + percent)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("cid", F.lit(3)).withColumn("n", F.lit("x"))
    got = sorted(tuple(r) for r in jaccard.classify(df, k, percent, **options).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows, k, percent)


def test_jaccard_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.classify(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (7, "A B C D"), (None, "a b c d"), (9, None)], "doc_id bigint, text string")
    got = sorted((tuple(r) for r in jaccard.classify(rows, 3, 90).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 2, 5), (9, 0, 9)], key=str)
    kept = jaccard.keep_one(rows.withColumn("lang", F.lit("en")), 3, 90)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r["doc_id"] for r in kept.collect()) == [5, 9]


def test_block_search_uses_long_lists():
    rng = np.random.default_rng(2)
    sets = []
    for i in range(120):
        core = set(range(100 * (i % 3), 100 * (i % 3) + 100))
        sets.append(sorted((core - set(rng.integers(0, 300, 3).tolist())) | {1000 + i % 7}))
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    block = jaccard.components_of_sets([np.array(sets[i]) for i in order], 90)
    assert block.searches > 110  # every set but the first of each kind meets lists enough
    got = {}
    for place, i in enumerate(order):
        got.setdefault(block.comp[place], set()).add(i)
    parent = list(range(120))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(120):
        for j in range(i):
            n = len(set(sets[i]) & set(sets[j]))
            if 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    want = {}
    for i in range(120):
        want.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["v"]: r["comp"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_read_few_edges_after_the_first_round(spark, monkeypatch):
    order = np.random.default_rng(4).permutation(600).tolist()
    kept, counts = graph.materialise, []

    def counted(df, name):
        out = kept(df, name)
        if name == "edges":
            counts.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialise", counted)
    got = components(spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")).collect()
    assert sorted(r["v"] for r in got) == list(range(600)) and {r["comp"] for r in got} == {0}
    assert counts[0] == 599 and counts[-1] == 0 and sum(counts) < 2 * 599


def test_block_edges_of_near_copies_are_few(spark):
    """Each of 200 classes shares a shingle with each of 10 lesser ones: 2000 pairs, one block."""
    rows = [(c, t) for c in range(10, 210) for t in range(10)] + [(t, t) for t in range(10)]
    edges = jaccard.block_edges(spark.createDataFrame(rows, "cid bigint, token bigint"))
    assert edges.count() == 209 and {r["comp"] for r in components(edges).collect()} == {0}
