"""Block searches against comparing every question with every text, and how little they shuffle."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search as Z


def words_of(text):
    import regex

    return set(regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower()))


def made(n, seed):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.expovariate(0.05)), 400)}" for _ in range(4000)]
    return [(f"t{i:04}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_overlap_equals_all_pairs_and_shuffles_little(spark, monkeypatch):
    texts = made(900, 1) + [("null", None), ("case", "W1 w2, w3; ß É")]
    questions = [(i, t[:120]) for i, (_, t) in enumerate(made(60, 2))] + [(100, None), (101, "?!"), (102, "W1 ß é w1"), (103, "nowhere to be seen")]
    t, q = spark.createDataFrame(texts, "id string, text string").repartition(3), spark.createDataFrame(questions, "query_id bigint, query string")
    want = []
    own = {i: words_of(x) for i, x in texts}
    for n, x in questions:
        ask = words_of(x)
        scored = sorted((-len(ask & w) / len(ask), i) for i, w in own.items() if ask & w)[:5]
        want += [(n, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    for block, most in ((512, 2000), (40, 9)):
        monkeypatch.setattr(Z, "BLOCK", block)
        assert sorted(tuple(r) for r in Z.overlap(q, t, 5, most).collect()) == sorted(want)
    posts = t.select("id", F.explode(F.array_distinct(T.tokens("text"))).alias("w")).join(q.select("query_id", F.explode(F.array_distinct(T.tokens("query"))).alias("w")), "w").count()
    handed_on = 3 * 60 * 5  # tasks, questions, hits
    assert handed_on * 10 < posts * 10 and handed_on < posts
    assert Z.overlap(q.limit(0), t, 5).count() == 0 and Z.overlap(q, t.limit(0), 5).count() == 0


def test_blocks_without_a_chance_are_passed_over():
    import numpy as np
    import pyarrow as pa

    index = Z.Postings(pa.array([["a", "b"], ["c"], None, []], pa.list_(pa.string())), pa.array(["a", "b", "c", "d"]))
    assert index.counts(np.array([0, 1, 3]), 1).tolist() == [2, 0, 0, 0]
    assert index.counts(np.array([0, 1, 3]), 3) is None and index.counts(np.array([3]), 1) is None


def test_needles_equal_contains(spark):
    rng = random.Random(6)
    letters = "abß日😀 "
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "")]
    needles = [(f"n{i}", "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))) for i in range(120)] + [("none", None)]
    got = Z.holders(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(needles, "query_id string, needle string"), most=50)
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, i) for n, s in needles for i, t in texts if s and t and s in t)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_page_search_ranks_fields_and_counts_all(spark):
    pages = [(1, "Refund Policy", "all about it", "x" * 60 + "REFUND" + "y" * 60), (2, "Other", "the refund", "none"), (3, "", None, "a refund here"), (4, None, None, None), (5, "Straße", "s", "b")]
    df = spark.createDataFrame(pages, "page_id bigint, title string, summary string, body string")
    q = spark.createDataFrame([("a", " refund "), ("b", ""), ("c", None), ("d", "STRASSE"), ("e", "zzz")], "query_id string, needle string")
    got = {(r["query_id"], r["rank"]): (r["page_id"], r["score"], r["total"], r["snippets"]) for r in Z.page_search(df, q).collect()}
    assert got[("a", 1)] == (1, 3, 3, ["Refund Policy", "…" + "x" * 40 + "REFUND" + "y" * 40 + "…"])
    assert got[("a", 2)][:3] == (2, 2, 3) and got[("a", 3)] == (3, 1, 3, ["a refund here"]) and got[("d", 1)][:3] == (5, 3, 1) and len(got) == 4
    assert {r["rank"] for r in Z.page_search(df, q, limit=0).where("query_id = 'a'").collect()} == {1}


def test_longest_terms(spark):
    texts = spark.createDataFrame([("a", "Die STRASSE am Refund-Schalter"), ("b", "nothing"), ("c", None)], "id string, text string")
    terms = spark.createDataFrame([("refund",), ("straße",), ("am",), ("",), (None,)], "term string")
    assert [tuple(r) for r in Z.longest_terms(texts, terms).collect()] == [("a", "strasse")]


def test_chunk_scores_of_a_block_equal_plain_loops(monkeypatch):
    import hashlib
    import math
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from tessera.operators import retrieve as R

    def vector(tokens):
        c = Counter(int(hashlib.md5(t.encode()).hexdigest(), 16) % 8 for t in tokens)
        n = math.sqrt(sum(v * v for v in c.values())) or 1
        return {k: v / n for k, v in c.items()}

    split = lambda t: t.lower().split()
    texts = [t for _, t in made(90, 3)] + ["", "w1 w2 w3 held whole w4", "?"]
    asked = [(i, t[:90], split(t[:90])) for i, (_, t) in enumerate(made(30, 4))] + [(90, "w3 held whole", split("w3 held whole")), (91, "", []), (92, "w1 w1 w9", split("w1 w1 w9"))]
    hashed = []
    md5 = hashlib.md5
    monkeypatch.setattr(R.hashlib, "md5", lambda b: hashed.append(b) or md5(b))
    q = R.ChunkQueries(asked, 8)
    blocks = [q.scores(pa.array(part, pa.string()), pa.array([split(t) for t in part], pa.list_(pa.string()))) for part in (texts[:40], texts[40:])]
    assert len(hashed) == len(set(hashed))  # a token is hashed once, not once for each chunk
    got = np.hstack(blocks)
    for i, (_, query, own) in enumerate(asked):
        for j, text in enumerate(texts):
            share = 1 if query and query in text else len(set(own) & set(split(text))) / max(1, len(set(own)))
            a, b = vector(own), vector(split(text))
            assert abs(got[i, j] - (0.6 * share + 0.4 * sum(v * b.get(k, 0) for k, v in a.items()))) < 1e-8


def test_contexts_of_answers_are_made_once(spark):
    """What is checked against answers reads the stored context; the search over all texts isn't in its plan, let alone twice."""
    from tessera.plans.answers import QUERIES

    plan = QUERIES["v4_grounded_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "documents" not in plan
