"""Registered queries on joins between hits, claims, topics and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks as H
from tessera.operators import claims as C
from tessera.operators import extract as X
from tessera.operators import retrieve as R
from tessera.operators import topics as P
from tessera.plans.base import ENT, EV, KB, OC, PAGES, REL
from tessera.plans.knowledge import FUSED, HS, WORDS, _fused, hops_sql
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()



@query(f"WITH {OC} SELECT vec_id, id AS claim_id, subject, label FROM embeddings JOIN oc ON vec_id = ord WHERE status = 'active'")
def j2_embedded_claims(spark: SparkSession, d: str) -> DataFrame:
    e = B.read(spark, d, "embeddings").select("vec_id", "label", F.col("vec_id").alias("ord"))
    return e.join(B.order_claims(spark, d).where("status = 'active'"), "ord").select("vec_id", F.col("id").alias("claim_id"), "subject", "label")


@query(f"WITH {OC}, h AS (SELECT DISTINCT family_id, ord % 50 AS query_id FROM oc) SELECT query_id, oc.id AS claim_id FROM h JOIN oc USING (family_id) WHERE valid_from <= TIMESTAMP '1998-06-30' AND (valid_to IS NULL OR TIMESTAMP '1998-06-30' < valid_to)")
def j17_hits_at_time(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    hits = c.select("family_id", (F.col("ord") % 50).alias("query_id")).distinct()
    return hits.join(c.where(T.valid_at(F.expr("timestamp'1998-06-30'"))), "family_id").select("query_id", F.col("id").alias("claim_id"))


@query(f"WITH {OC} SELECT subject AS topic, string_agg(predicate || '=' || object, '; ' ORDER BY predicate, version) AS facts, count(*) AS n FROM oc WHERE status = 'active' GROUP BY 1")
def j20_topic_pages(spark: SparkSession, d: str) -> DataFrame:
    g = B.order_claims(spark, d).where("status = 'active'").groupBy(F.col("subject").alias("topic")).agg(F.array_sort(F.collect_list(F.struct("predicate", "version", "object"))).alias("f"), F.count("*").alias("n"))
    return g.select("topic", F.array_join(F.transform("f", lambda x: F.concat_ws("=", x["predicate"], x["object"])), "; ").alias("facts"), "n")


@query("WITH m(key, value) AS (VALUES ('the', 'article'), ('her', 'pronoun'), ('zzzz', 'none')) SELECT item_id AS query_id, key, value FROM benchmark, m WHERE contains(text, key) OR contains(key, text)")
def j24_semantic_memory(spark: SparkSession, d: str) -> DataFrame:
    m = F.broadcast(spark.createDataFrame([("the", "article"), ("her", "pronoun"), ("zzzz", "none")], "key string, value string"))  # a table of memories
    q = B.read(spark, d, "benchmark")
    return q.join(m, F.contains("text", F.col("key")) | F.contains("key", F.col("text"))).select(F.col("item_id").alias("query_id"), "key", "value")


@query(f"WITH {HS}, r AS (SELECT DISTINCT id AS source_id, regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS canon FROM hs WHERE title IS NOT NULL) SELECT source_id, count(*) AS topics, min(canon) AS first_topic FROM r WHERE canon <> '' GROUP BY 1")
def j28_topics_of_sources(spark: SparkSession, d: str) -> DataFrame:
    c = H.exploded(B.md_sources(spark, d), H.heading_spans(F.col("text"))).select("source_id", T.topic_name("title").alias("canon")).where("canon <> ''").distinct()
    return c.groupBy("source_id").agg(F.count("*").alias("topics"), F.min("canon").alias("first_topic"))


@query(f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS w FROM benchmark), h AS (SELECT item_id, md5(w) AS m FROM t), b AS (SELECT item_id, ('0x' || substr(m, 25, 8))::BIGINT % 64 AS b0, m FROM h),
p AS (SELECT item_id, [('0x' || substr(m, 1, 8))::BIGINT, ('0x' || substr(m, 9, 8))::BIGINT, ('0x' || substr(m, 17, 8))::BIGINT, ('0x' || substr(m, 25, 8))::BIGINT] AS x FROM h),
v AS (SELECT item_id, ((((((x[1] % 64) * 4294967296 + x[2]) % 64) * 4294967296 + x[3]) % 64) * 4294967296 + x[4]) % 64 AS k, count(*) AS w FROM p GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM v GROUP BY 1),
s AS (SELECT a.item_id AS query_id, c.item_id AS id, sum(a.w * c.w) / any_value(na.n * nc.n) AS score FROM v a JOIN v c USING (k) JOIN n na ON na.item_id = a.item_id JOIN n nc ON nc.item_id = c.item_id WHERE a.item_id <> c.item_id GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM s) WHERE r <= 5""")
def k2_hash_vector_lane(spark: SparkSession, d: str) -> DataFrame:
    """Sparse hash vectors meet on their buckets: an equi-join instead of dense products."""
    v = B.read(spark, d, "benchmark").select("item_id", F.explode(T.tokens("text")).alias("w")).groupBy("item_id", T.token_bucket(F.col("w"), 64).alias("k")).agg(F.count("*").alias("w"))
    v = v.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item_id"))))
    q = v.select(F.col("item_id").alias("query_id"), "k", F.col("w").alias("qw"))
    s = v.join(q, "k").where("query_id <> item_id").groupBy("query_id", F.col("item_id").alias("id")).agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return R.ranked(s, F.desc(F.round("score", 9)), "id", k=5).select("query_id", "id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, count(*) AS hits, min(id) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 40 AND score >= 0.2 GROUP BY 1""")
def p9_min_score(spark: SparkSession, d: str) -> DataFrame:
    e = B.read(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = R.cosine_lane(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 40).where("score >= 0.2")
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("id").alias("lowest"))


@query(f"WITH {OC} SELECT id, object FROM oc WHERE status = 'active' AND predicate IN ('order_priority')")
def p13_high_risk(spark: SparkSession, d: str) -> DataFrame:
    risky = F.broadcast(spark.createDataFrame([("order_priority",)], "predicate string"))
    return B.order_claims(spark, d).where("status = 'active'").join(risky, "predicate", "left_semi").select("id", "object")


@query(f"WITH {EV}, m AS (SELECT source_id, 'license' AS subject, 'granted' AS predicate, quote AS object, 1 AS rule FROM ev UNION ALL SELECT 'doc-' || doc_id, 'license', 'granted', 'unknown terms', 0 FROM documents) SELECT source_id, subject, predicate, object, max(rule)::INT AS by_rule FROM m GROUP BY 1, 2, 3, 4")
def c3_candidates(spark: SparkSession, d: str) -> DataFrame:
    kind = [F.lit("license").alias("subject"), F.lit("granted").alias("predicate")]
    rules = B.evidence(spark, d).select("source_id", *kind, F.col("quote").alias("object"), F.lit(1).alias("rule"))
    model = B.read(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source_id"), *kind, F.lit("unknown terms").alias("object"), F.lit(0).alias("rule"))
    return rules.unionByName(model).groupBy("source_id", "subject", "predicate", "object").agg(F.max("rule").alias("by_rule"))


@query(f"WITH {EV} SELECT claim_id, CASE WHEN contains(d.text, quote) THEN 'active' ELSE 'quarantined' END AS status FROM ev JOIN documents d ON 'doc-' || d.doc_id = source_id")
def c4_sampled_verification(spark: SparkSession, d: str) -> DataFrame:
    e = B.evidence(spark, d)
    v = C.verify(e, B.kb_sources(spark, d), e.select(F.col("claim_id").alias("id")).distinct())
    return v.select("claim_id", F.when(F.col("verified"), "active").otherwise("quarantined").alias("status"))


@query(f"WITH {PAGES}, l AS (SELECT page_id, unnest(list_distinct(links)) AS link FROM wp), g AS (SELECT link, list(page_id ORDER BY page_id) AS pages FROM l GROUP BY 1) SELECT link, len(list_filter(pages, lambda p: p % 10 <> 0))::INT AS left_pages, len(pages) <> len(list_filter(pages, lambda p: p % 10 <> 0)) AS recompile FROM g WHERE len(list_filter(pages, lambda p: p % 10 <> 0)) > 0")
def d1_deletion_effects(spark: SparkSession, d: str) -> DataFrame:
    """Linked pages after every tenth page goes: what only they support is dropped, shared ones are to be compiled anew."""
    l = B.wiki_pages(spark, d).select("page_id", F.explode(F.array_distinct("links")).alias("link"))
    g = l.groupBy("link").agg(F.count_if(F.col("page_id") % 10 != 0).cast("int").alias("left_pages"), F.count("*").alias("n"))
    return g.where("left_pages > 0").select("link", "left_pages", (F.col("left_pages") < F.col("n")).alias("recompile"))


@query(f"""WITH {PAGES}, {FUSED}, b AS (SELECT query_id, max(score) AS best, count(*) FILTER (starts_with(key, 'chunk:')) AS chunks, count(*) FILTER (starts_with(key, 'wiki:')) AS pages FROM fn GROUP BY 1)
SELECT query_id, CASE WHEN chunks > 0 AND pages > 0 THEN 'mixed' WHEN chunks > 0 THEN 'chunks' WHEN pages > 0 THEN 'pages' ELSE 'none' END AS kind, CASE WHEN chunks > 0 THEN 0.7 WHEN pages > 0 THEN 0.65 ELSE 0.1 END::DOUBLE AS confidence FROM b""")
def f34_answer_kinds(spark: SparkSession, d: str) -> DataFrame:
    g = _fused(spark, d).groupBy("query_id").agg(F.count_if(F.startswith("key", F.lit("chunk:"))).alias("c"), F.count_if(F.startswith("key", F.lit("wiki:"))).alias("p"))
    kind = F.when((F.col("c") > 0) & (F.col("p") > 0), "mixed").when(F.col("c") > 0, "chunks").when(F.col("p") > 0, "pages").otherwise("none")
    return g.select("query_id", kind.alias("kind"), F.when(F.col("c") > 0, 0.7).when(F.col("p") > 0, 0.65).otherwise(0.1).alias("confidence"))


@query(f"WITH {PAGES} SELECT page_id, len(list_filter(['the', 'of', 'und', 'les'], lambda k: contains(title, k)))::INT * 2 + len(list_filter(['the', 'of', 'und', 'les'], lambda k: contains(body, k)))::INT AS raw FROM wp")
def f20_keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ["the", "of", "und", "les"]))
    count = lambda c: F.size(F.filter(words, lambda k: F.contains(F.col(c), k)))
    return B.wiki_pages(spark, d).select("page_id", (count("title") * 2 + count("body")).alias("raw"))


@query(f"WITH {HS}, n AS (SELECT id, start, \"end\", row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS i FROM hs) SELECT id AS source_id, (i // 3)::INT AS section, min(start)::INT AS start, max(\"end\")::INT AS \"end\" FROM n GROUP BY 1, 2")
def t7_applied_plans(spark: SparkSession, d: str) -> DataFrame:
    """A recorded plan that joins every three spans: each section runs from its first span's start to its last one's end."""
    c = H.exploded(B.md_sources(spark, d), H.heading_spans(F.col("text"))).select("source_id", F.floor(F.col("chunk_index") / 3).cast("int").alias("section"), "start", "end")
    return c.groupBy("source_id", "section").agg(F.min("start").alias("start"), F.max("end").alias("end"))


@query(f"WITH {KB}, f AS (SELECT kb_id, type, count(*) AS pages, min(title) AS first_page FROM kb GROUP BY 1, 2) SELECT kb_id, type AS folder, pages, first_page, sum(pages) OVER (PARTITION BY kb_id)::BIGINT AS total FROM f")
def b4_page_tree(spark: SparkSession, d: str) -> DataFrame:
    f = B.kb_sources(spark, d).groupBy("kb_id", F.col("type").alias("folder")).agg(F.count("*").alias("pages"), F.min("title").alias("first_page"))
    return f.withColumn("total", F.sum("pages").over(Window.partitionBy("kb_id")))


@query(f"WITH {REL}, {ENT}, {hops_sql('Customer')}, ends AS (SELECT query_id, src AS id FROM hops WHERE rank <= 20 UNION SELECT query_id, dst FROM hops WHERE rank <= 20) SELECT query_id, ends.id, name FROM ends JOIN ent USING (id)")
def g5_subgraph(spark: SparkSession, d: str) -> DataFrame:
    seeds = B.entities(spark, d).where("type = 'Customer'").select(F.concat(F.lit("q-"), "id").alias("query_id"), F.col("id").alias("seed"), F.lit(1).alias("seed_rank"))
    hits = P.two_hops(B.relations(spark, d), seeds)
    e = B.entities(spark, d)
    ends = hits.select("query_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(e, "id").select("query_id", "id", "name")
