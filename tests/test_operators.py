"""Hand cases for operators whose order of steps matters, and plan checks."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks as K
from tessera.operators import claims as C
from tessera.operators import pages as P
from tessera.operators import retrieve as R
from tessera.operators import synthesis as S
from tessera.operators import tables as M
from tessera.operators import topics as G


def test_join_objects(spark):
    cases = [(["a；b", "b"], "a、b"), (["ab", "a"], "ab"), (["a", "ab"], "ab"), (["x;y", ""], "x、y"), (["longer than eight", "b"], "longer than eight；b"), ([], "")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a array<string>")
    got = {r["i"]: r["o"] for r in df.select("i", C.join_objects(F.col("a")).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def spans(spark, text, how):
    df = spark.createDataFrame([("s", text)], "id string, text string")
    return [(r["start"], r["end"], r["title"]) for r in K.exploded(df, how(F.col("text"))).orderBy("start").collect()]


def test_general_spans_blank_lines(spark):
    text = "# A\nx\n\n\n\n## B\ny"
    got = spans(spark, text, K.general_spans)
    assert [text[a:b] for a, b, _ in got] == ["# A\nx\n\n", "\n\n", "## B\ny"]
    assert [t for *_, t in got] == ["A", None, "B"]


def test_heading_spans_preamble_and_none(spark):
    text = "intro\n# A\n### deep\nx\n## B\ny"
    assert [(text[a:b], t) for a, b, t in spans(spark, text, K.heading_spans)] == [("intro\n", None), ("# A\n### deep\nx\n", "A"), ("## B\ny", "B")]
    assert spans(spark, "no heading", K.heading_spans) == [(0, 10, None)]
    assert spans(spark, "", K.heading_spans) == []


def test_coverage_of_every_mode(spark):
    texts = ["# A\nx\n\ny", "\n\n\n", "a\r\nb\x0bc d", "## one\n\n## two\n" + "z" * 50, "no end"]
    s = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "id string, text string")
    assert K.coverage_violations(s, K.chunk(s, max_chars=7, max_chunks=3)).count() == 0
    merged = K.exploded(s, K.merge_small(K.general_spans(F.col("text")), F.col("text"), 2))
    assert K.coverage_violations(s, merged).count() == 0


def test_normalise_scores_ties(spark):
    h = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.5), (2, "a", 1.0), (2, "b", 3.0)], "query_id int, key string, score double")
    got = {(r["query_id"], r["key"]): r["score"] for r in R.normalise(h, ["key"]).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.666667, (1, "c"): 0.333333, (2, "a"): 0.0, (2, "b"): 1.0}


def test_two_version_scenario(spark):
    rows = [("f", 1, "buyer", "2023-01-01", "2024-01-01", "superseded"), ("f", 2, "platform", "2024-01-01", None, "active")]
    c = spark.createDataFrame(rows, "family_id string, version int, object string, valid_from string, valid_to string, status string").withColumn("valid_from", F.to_timestamp("valid_from")).withColumn("valid_to", F.to_timestamp("valid_to")).withColumn("id", F.concat("family_id", "version"))
    probe = spark.createDataFrame([("f", "2023-06-30"), ("f", "2024-06-30"), ("f", "2024-01-01")], "family_id string, at string").withColumn("at", F.to_timestamp("at"))
    assert {str(r["at"])[:10]: r["object"] for r in C.as_of(c, probe).collect()} == {"2023-06-30": "buyer", "2024-06-30": "platform", "2024-01-01": "platform"}


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    delta = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 2)], "k int, v string, seq int")
    once = M.upsert(base, delta, ["k"], "seq")
    assert sorted((r["k"], r["v"]) for r in once.collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(M.upsert(once, delta, ["k"], "seq").collect()) == sorted(once.collect())
    claims = spark.createDataFrame([("x", ["s1", "s2"]), ("y", ["s1"])], "id string, source_ids array<string>")
    left = M.delete_sources(claims, spark.createDataFrame([("s1",)], "source_id string")).collect()
    assert [(r["id"], r["source_ids"]) for r in left] == [("x", ["s2"])]


def test_substring_join_has_no_nested_loop(spark):
    q = spark.createDataFrame([(1, "What of Alpha and beta?")], "query_id int, query string")
    p = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "part string")
    df = R.substring_hits(q, p, (4, 5))
    assert sorted(r["part"] for r in df.collect()) == ["alpha", "beta"]
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_topics_by_name(spark):
    chunks = spark.createDataFrame([("k", "c1", "s1", ["Size Guide", "size-guide"]), ("k", "c2", "s2", ["size guide"]), ("k", "c3", "s2", ["Other"])], "kb_id string, id string, source_id string, topics array<string>")
    none = spark.createDataFrame([], "kb_id string, id string, subject string, source_id string")
    got = {r["canon"]: (r["chunks"], r["sources"]) for r in G.clusters(chunks, none).collect()}
    assert got == {"sizeguide": (2, 2), "other": (1, 1)}


def test_casefold_and_tokens(spark):
    r = spark.createDataFrame([("Straße 12",)], "t string").select(T.contains_folded("t", F.lit("STRASSE")).alias("a"), T.tokens("t").alias("b")).first()
    assert r["a"] and r["b"] == ["straße", "12"]


def test_text_file_scan(spark, tmp_path):
    from tessera.sources import files

    root = tmp_path / "kb"
    (root / "a").mkdir(parents=True)
    (root / "a" / "b.md").write_bytes(b"one  \r\n\r\n\r\n\r\ntwo\n")
    (root / "c.txt").write_bytes(b"x")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "blank.md").write_bytes(b" \n\n")
    (root / "d.pdf").write_bytes(b"y")
    sources, rejects = files.scan(spark, str(root))
    assert sorted(tuple(r) for r in sources.collect()) == [("a__b", "/a", "one\n\ntwo"), ("c", "/", "x")]
    assert sorted(tuple(r) for r in rejects.collect()) == [("bad.txt", "encoding"), ("blank.md", "empty"), ("d.pdf", "suffix")]


def test_seeded_walk(spark):
    edges = [("A", "p", "C"), ("B", "p", "C"), ("C", "q", "D"), ("C", "q", "E"), ("D", "r", "F"), ("H", "p", "X1"), ("H", "p", "X2"), ("H", "p", "X3"), ("H", "p", "X4"), ("H", "p", "X5")]
    r = spark.createDataFrame(edges, "src string, predicate string, dst string")
    seeds = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "H", 1), (3, "none", 1)], "query_id int, seed string, seed_rank int")
    got = {}
    for x in G.seeded_walk(r, seeds).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["src"], x["dst"], x["score"]))
    # A takes C's edges first, so B brings only its own edge; F is three hops away.
    assert got[1] == [("A", "C", 1.0), ("B", "C", 1.0), ("C", "D", 0.5), ("C", "E", 0.5)]
    assert [x[1] for x in got[2]] == ["X1", "X2", "X3", "X4"] and 3 not in got


def test_chunking_takes_time_in_proportion_to_text(spark):
    import time

    def took(n):
        text = "\n".join(("## " if i % 5 == 0 else "") + f"line {i} of some words" for i in range(n))
        df = spark.createDataFrame([(f"s{k}", text) for k in range(4)], "id string, text string")
        start = time.time()
        out = K.exploded(df, K.heading_spans(F.col("text"))).select("start", "end").collect()
        assert len(out) == 4 * (n // 5)
        return time.time() - start

    took(400)
    short, long = min(took(800) for _ in range(2)), took(12800)
    assert long < 16 * short + 8, (short, long)


def test_prefix_sums_over_many_runs(spark):
    rows = spark.createDataFrame([([],), ([3],), (list(range(2000)),)], "n array<int>")
    got = [r[0] for r in rows.select(K.prefix_sums(F.col("n"))).collect()]
    assert got == [[], [0], [sum(range(i)) for i in range(2000)]]


def test_merge_small_equals_a_plain_loop(spark):
    import random

    random.seed(2)
    for _ in range(12):
        text = "\n".join(" ".join("w" for _ in range(random.randint(0, 9))) for _ in range(random.randint(1, 12)))
        cuts = sorted({0, len(text), *[i + 1 for i, c in enumerate(text) if c == "\n" and random.random() < 0.6]})
        spans = [(a, b, f"t{a}" if random.random() < 0.5 else None) for a, b in zip(cuts, cuts[1:])]
        count = lambda a, b: len(text[a:b].split())
        want = []
        for a, b, t in spans:
            if want and count(want[-1][0], want[-1][1]) < 7:
                x = want.pop()
                want.append((x[0], b, x[2] if x[2] is not None else t))
            else:
                want.append((a, b, t))
        if len(want) > 1 and count(*want[-1][:2]) < 7:
            y, x = want.pop(), want.pop()
            want.append((x[0], y[1], x[2] if x[2] is not None else y[2]))
        df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,end:int,title:string>>")
        got = df.select(K.merge_small(F.col("spans"), F.col("text"), 7)).first()[0]
        assert [tuple(r) for r in got] == want


def test_stream_ingest_equals_the_batch_job(spark):
    from tessera.plans import knowledge
    from tessera.sources import bindings as B

    sf = "/root/testdata/sf0.001"
    batch = K.chunk(B.kb_sources(spark, sf).select("id", "text")).select("source_id", "chunk_index", "start", "end", "id")
    got = knowledge.QUERIES["st1_stream_ingest"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_graph_walks_against_plain_loops(spark):

    edges = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("b", "q", "d"), ("x", "p", "y")]
    rel = spark.createDataFrame([(s, p, d, i) for i, (s, p, d) in enumerate(edges)], "src string, predicate string, dst string, ord bigint")
    seeds = spark.createDataFrame([("q1", "a", 1), ("q2", "x", 1)], "query_id string, seed string, seed_rank int")
    got = {(r["query_id"], r["src"], r["dst"]) for r in G.two_hops(rel, seeds).select("query_id", "src", "dst").collect()}
    assert got == {("q1", "a", "b"), ("q1", "b", "c"), ("q1", "b", "d"), ("q2", "x", "y")}


def test_compiled_claims_equal_a_plain_loop(spark):
    from tessera.plans import base

    sf = "/root/testdata/sf0.001"
    facts, kinds = base._facts(spark, sf)
    extra = [("f1", i, "s", "terms", o, "Customer", "Concept", 0.5 + i / 100, f"s{i}", f"q{i}") for i, o in enumerate(["red", "blue", "red; green", "a long object with many words", "green", "blue and green"])]
    extra += [("f2", i, "s", "order_status", o, "Customer", "Concept", 0.5, f"s{i}", "q") for i, o in enumerate(["open", "shut", "open", "op"])] + [("f3", 0, "s", "other", "x", "Customer", "Concept", 0.5, "s", "q")]
    kinds = kinds.unionByName(spark.createDataFrame([("Customer", "terms", "Concept")], kinds.schema))
    facts = facts.unionByName(spark.createDataFrame(extra, facts.schema))

    def join(parts):
        kept = []
        for part in parts:
            for p in (x.strip() for x in part.split("；" if "；" in part else ";")):
                if p and not any(p in k for k in kept):
                    kept = [k for k in kept if k not in p] + [p]
        return ("；" if any(len(k) > 8 or any(m in k for m in "，。、") for k in kept) else "、").join(kept)

    ok = {(r["subject_type"], r["predicate"], r["object_type"]) for r in kinds.collect()}
    want, bad, history = [], 0, {}
    for r in sorted(facts.collect(), key=lambda r: (r["family_id"], r["ord"], r["object"])):
        if (r["subject_type"], r["predicate"], r["object_type"]) not in ok:
            bad += 1
            continue
        own = history.setdefault(r["family_id"], [])
        live = [v for v in own if v[1] != "superseded"]
        if any(v[0] == r["object"] for v in own) or any(join([v[0], r["object"]]) == v[0] for v in live):
            continue
        if live and r["predicate"] != "order_status":
            live[0][1] = "superseded"
            own.append([join([live[0][0], r["object"]]), "active", max(live[0][2], r["confidence"]), live[0][3] | {r["source_id"]}, r["quote"]])
        else:
            own.append([r["object"], "staging" if live else "active", r["confidence"], {r["source_id"]}, r["quote"]])
    for f, own in history.items():
        want += [(f, i, v[0], v[1], round(v[2], 6), tuple(sorted(v[3])), v[4]) for i, v in enumerate(own, 1)]
    versions, out = C.compile_claims(facts, kinds, ["order_status"])
    got = [(r["family_id"], r["version"], r["object"], r["status"], round(r["confidence"], 6), tuple(sorted(r["source_ids"])), r["quote"]) for r in versions.collect()]
    assert sorted(got) == sorted(want)
    assert out.count() == bad > 0


def test_page_parts_by_hand(spark):
    from tessera.operators import pages as P
    from tessera.operators import questions as Q

    text = "intro\n## 1. A\nbody a\n## 概述\n## 2、目录\nskipped\n## 3. B\nbody b\n## Plain\nrest"
    df = spark.createDataFrame([("d", text), ("e", "## 1. only\nx"), ("n", None), ("z", "")], "id string, text string")
    assert [(r["title"], r["body"]) for r in P.catalog_items(df).orderBy("item").collect()] == [("A", "body a\n## 概述"), ("B", "body b")]
    md = spark.createDataFrame([("# T\n\n## 相关主题\n- old\n\n## Next\nx", ["[[n]]"]), ("# T\n## 关键词\nk", ["[[n]]"]), ("# T", []), ("# T \n", ["a", "b"])], "md string, links array<string>")
    got = [r[0] for r in md.select(P.related_section(F.col("md"), F.col("links"))).collect()]
    assert got == ["# T\n\n## 相关主题\n- [[n]]\n\n## Next\nx", "# T\n## 相关主题\n- [[n]]\n\n## 关键词\nk", "# T", "# T\n\n## 相关主题\n- a\n- b\n"]
    asked = spark.createDataFrame([("a", "能退吗"), ("b", "退货能退吗"), ("c", "能退吗"), ("d", None)], "session_id string, question string")
    eps = spark.createDataFrame([("a", 1, "七天无理由退货", ""), ("a", 2, "好", "无关"), ("b", 1, "退货", ""), ("d", 1, "退货", None)], "session_id string, seq int, q string, a string")
    got = {r["session_id"]: (r["question"], r["anchor"]) for r in Q.rewrite(asked, eps, ["退货", "七天无理由退货"]).collect()}
    assert got == {"a": ("七天无理由退货能退吗", "七天无理由退货"), "b": ("退货能退吗", None), "c": ("能退吗", None), "d": (None, None)}
    chunks = spark.createDataFrame([("s", 0, "T", "- first line here\n# heading line\n- second line here", None), ("s", 1, None, "One sentence。short；Another sentence。", None), ("s", 2, None, "", "a summary text"), ("s", 3, "T", "first line here\nthird line here", None), ("n", 0, None, None, None)], "source_id string, chunk_index int, title string, text string, summary string")
    got = [r["point"] for r in P.points(chunks).orderBy("source_id", "place").collect()]
    assert got == ["T：first line here", "T：second line here", "One sentence。", "Another sentence。", "a summary text", "T：third line here"]


def test_claim_hits_equal_brute_force(spark):
    claims = [(f"c{i:02}", f"S{i % 3}", ("likes", "has", None)[i % 3 if i % 5 else 2], f"o{i % 4}" if i % 7 else "") for i in range(40)]
    queries = [(1, "what S1 likes of o2"), (2, "s0 has o0, s2 o1"), (3, ""), (4, None), (5, "nothing")]
    got = R.claim_hits(spark.createDataFrame(queries, "query_id bigint, query string"), spark.createDataFrame(claims, "id string, subject string, predicate string, object string"), 4)
    want = []
    for n, q in queries:
        scored = [(-sum(bool(x) and x.lower() in (q or "").lower() for x in parts), i) for i, *parts in claims]
        want += [(n, r, i, -s) for r, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:4], 1)]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()) == want
    empty = spark.createDataFrame([], "id string, subject string, predicate string, object string")
    assert R.claim_hits(spark.createDataFrame(queries, "query_id bigint, query string"), empty, 4).count() == 0


def test_chunk_lane_counts_a_held_query_as_whole(spark):
    q = spark.createDataFrame([(1, "eat the app"), (2, ""), (3, None)], "query_id bigint, query string")
    c = spark.createDataFrame([("a", "we eat the apple"), ("b", "the app"), ("n", None), ("e", "")], "id string, text string")
    got = {r["id"]: r["score"] for r in R.chunk_lane(q, c, 5).collect()}
    assert set(got) == {"a", "b"} and 0.6 < got["a"] < 1 and 0.7 < got["b"] < 0.9
    assert R.chunk_lane(q, c.where("false"), 5).count() == 0


def test_contexts_keep_order_and_answers_need_ground(spark):
    hits = spark.createDataFrame([(1, 2, "chunk", "d1"), (1, 1, "chunk", "gone"), (1, 3, "claim", "k2"), (1, 4, "claim", "no"), (1, 5, "chunk", "d1")], "query_id bigint, rank int, kind string, id string")
    allowed = spark.createDataFrame([(1, "k1"), (1, "k2"), (2, None)], "query_id bigint, claim_id string")
    claims = spark.createDataFrame([("k1", "a", "is", "b"), ("k2", "c", "is", "d"), ("no", "x", "is", "y")], "id string, subject string, predicate string, object string")
    texts = spark.createDataFrame([("chunk", "d1", "d1", "word " * 400)], "kind string, id string, source_id string, text string")
    got = S.pack_context(hits, allowed, claims, texts)
    assert [(r["kind"], r["pos"], r["id"], len(r["text"])) for r in got.orderBy("kind", "pos").collect()] == [("chunk", 1, "d1", 800), ("claim", 1, "k2", 6), ("claim", 2, "k1", 6)]
    answers = spark.createDataFrame([(1, "said " + "word " * 20 + "[1]", []), (1, " [2] ", [("d1", "word")]), (2, "free", [("d1", "word")])], "query_id bigint, answer string, citations array<struct<source_id:string,quote:string>>")
    quotes = spark.createDataFrame([], "query_id bigint, source_id string, quote string")
    kept = S.sanitised(answers, got, quotes).collect()
    assert [(r["query_id"], r["n_citations"], r["grounded"]) for r in kept] == [(1, 0, True)]


def test_page_rejects_name_the_first_fault(spark):
    pages = [("a", "[[a]]", "[[a]] ## P"), ("a", "[[a]]", "[[a]] ## P"), ("b", "[[b]]", "## P"), ("b", "[[b]]", "[[b]] ## P"), ("c", "[[c]]", None), ("d", "[[d]]", "[[d]] ## P"), ("e", "[[e]]", "[[e]]"), ("e", "[[e]]", "[[e]] ## P")]
    got = P.page_rejects(spark.createDataFrame(pages, "source_id string, link string, markdown string"), ["## P"])
    assert {r["source_id"]: r["reason"] for r in got.collect()} == {"b": "link_missing", "c": "link_missing", "d": "too_few_pages", "e": "section_missing"}


def test_points_pass_over_chunks_that_cannot_be_among_the_first(spark, monkeypatch):
    import random

    from tessera.operators import pages as P

    rng = random.Random(8)
    rows = []
    for n in range(6):
        for i in range(40):
            lines = [f"point number {rng.randint(0, 30)} of it" if rng.random() < 0.8 else rng.choice(["", "# head", " -\t", "short", "one。two and more；  "]) for _ in range(rng.randint(0, 9))]
            rows.append((f"s{n}", i, rng.choice([None, " T ", ""]), "\r\n".join(lines) if rng.random() < 0.9 else None, rng.choice([None, "a  summary\tof it"])))
    want = {}
    for source, i, title, text, summary in rows:
        for pos, point in P.said(title, text, summary):
            own = want.setdefault(source, {})
            own[point[:80]] = min(own.get(point[:80], (i, pos, point)), (i, pos, point))
    want = sorted((s, place, p) for s, own in want.items() for place, (_, _, p) in enumerate(sorted(own.values())[:12], 1))
    schema = "source_id string, chunk_index int, title string, text string, summary string"
    mixed = rng.sample(rows, len(rows))
    for order in (rows, mixed):
        assert sorted((r["source_id"], r["place"], r["point"]) for r in P.points(spark.createDataFrame(order, schema).coalesce(2)).collect()) == want
    seen = spark.createDataFrame(rows, schema).coalesce(1).select("source_id", "chunk_index", "title", "text", "summary")
    stages = P.points(seen)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in stages and "regexp" not in stages
    assert P.points(seen.where("false")).count() == 0
    assert P.said(None, None, None) == [] and P.said(" ", "a line of text\u2028another line", None) == [(0, "a line of text"), (1, "another line")]
