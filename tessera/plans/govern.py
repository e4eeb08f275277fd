"""Registered queries on governance, question handling, memory, pages and enrichment, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import claims as C
from tessera.operators import govern as G
from tessera.operators import tables as K
from tessera.operators import topics as P
from tessera.operators import chunks as H
from tessera.operators import search as Z
from tessera.plans.base import ENT, EP, EV, KB, OC, PAGES, REL
from tessera.plans.knowledge import FUSED, HS, WORDS, _fused
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()



def stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


Q = "q AS (SELECT item_id AS query_id, CASE item_id % 6 WHEN 0 THEN 'Why ' || text WHEN 1 THEN 'What is related to ' || text WHEN 2 THEN 'How to read ' || text || ' in 2021?' WHEN 3 THEN 'Who wrote back then ' || text ELSE text END AS question FROM benchmark)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 6
    t = F.col("text")
    q = F.when(k == 0, F.concat(F.lit("Why "), t)).when(k == 1, F.concat(F.lit("What is related to "), t)).when(k == 2, F.concat(F.lit("How to read "), t, F.lit(" in 2021?"))).when(k == 3, F.concat(F.lit("Who wrote back then "), t)).otherwise(t)
    return B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), q.alias("question"))


# Questions


@query(f"WITH {Q} SELECT query_id, CASE WHEN contains(lower(question), 'why ') THEN 'claim' WHEN contains(lower(question), 'related to') OR contains(lower(question), 'between ') THEN 'graph' ELSE 'hybrid' END AS mode, CASE WHEN contains(lower(question), 'how ') THEN 0.3 WHEN contains(lower(question), 'what ') OR contains(lower(question), 'who ') THEN 0.7 ELSE 0.5 END::DOUBLE AS weight, contains(lower(question), 'how to ') AS procedure FROM q")
def f9_routes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return questions(spark, d).select("query_id", G.route(q).alias("mode"), G.claim_weight(q).alias("weight"), G.has_any(q, G.PROCEDURE_WORDS).alias("procedure"))


@query(f"WITH {Q} SELECT query_id, CASE WHEN regexp_matches(question, '20[0-9][0-9]') THEN regexp_extract(question, '(20[0-9][0-9])', 1) || '-06-30 00:00:00' WHEN contains(lower(question), 'back then') THEN '2023-06-30 00:00:00' END AS as_of FROM q")
def f10_question_times(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).withColumn("t", G.question_time(F.col("question"), F.lit(None).cast("timestamp"), 2024)).select("query_id", stamp("t").alias("as_of"))


@query(f"WITH {Q} SELECT query_id, replace(replace(question, 'the', 'that'), 'that', 'this') AS question, replace(replace(question, 'the', 'that'), 'that', 'this') <> question AS changed FROM q")
def f11_alias_substitution(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).withColumn("new", G.substitute(F.col("question"), [("the", "that"), ("that", "this")]))
    return q.select("query_id", F.col("new").alias("question"), (F.col("new") != F.col("question")).alias("changed"))


@query(f"SELECT item_id, array_to_string(list_distinct(w), ',') AS keywords FROM (SELECT item_id, list_sort(list_filter(regexp_extract_all(text, {WORDS}), lambda x: length(x) > 1 AND lower(x) NOT IN ('the', 'of', 'and'))) AS w FROM benchmark) WHERE false UNION ALL SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, {WORDS}), lambda x: length(x) > 1 AND lower(x) NOT IN ('the', 'of', 'and')))), ',') FROM benchmark")
def f19_keywords(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.keywords("text", ["the", "of", "and"])), ",").alias("keywords"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\\[\\^?[0-9]+\\]', '', 'g'), '[ \\t]+', ' ', 'g'), ' ([.,;:!?])', '\\1', 'g')) AS clean FROM (SELECT doc_id, text || ' [1] end [^2] .' AS t FROM documents)")
def f32_stripped_citations(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "documents").select("doc_id", T.strip_citations(F.concat("text", F.lit(" [1] end [^2] ."))).alias("clean"))


@query("SELECT page_id, CASE WHEN n = '' THEN 'unnamed' ELSE n END AS filename FROM (SELECT page_id, trim(regexp_replace(url, '[/\\\\:*?\"<>|]', '_', 'g')) AS n FROM pages)")
def f23_filenames(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "pages").select("page_id", T.sanitise_filename("url").alias("filename"))


@query("SELECT doc_id, CASE WHEN p > 0 AND n <> '' THEN (CASE WHEN greatest(p - 40, 1) > 1 THEN '…' ELSE '' END) || substr(text, greatest(p - 40, 1), least(p + length(n) + 40, length(text) + 1) - greatest(p - 40, 1)) || (CASE WHEN least(p + length(n) + 40, length(text) + 1) <= length(text) THEN '…' ELSE '' END) END AS snippet FROM (SELECT doc_id, text, 'licensed' AS n, instr(lower(text), 'licensed') AS p FROM documents)")
def f22_snippets(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "documents").select("doc_id", T.snippet("text", F.lit("licensed")).alias("snippet"))


# Claims and governance


@query(f"WITH {OC} SELECT count(*) FILTER (regexp_matches(subject, '^[\\d\\-~、，,cm\\s]+$')) AS numeric, count(*) FILTER (length(trim(subject)) > 2) AS kept FROM oc")
def p11_topic_subjects(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    return c.agg(F.count_if(F.col("subject").rlike(r"^[\d\-~、，,cm\s]+$")).alias("numeric"), F.count_if(F.length(F.trim("subject")) > 2).alias("kept"))


@query("SELECT page_id, rel = '' OR starts_with(rel, 'source-') OR starts_with(rel, 'chunk-') OR regexp_matches(rel, '(^|/)(index|log)$') OR regexp_matches(rel, '(^|/)\\.\\.(/|$)') AS blocked FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://[^/]*([^?#]*)', 1), '\\.md$', ''), '^/+', '') AS rel FROM pages)")
def p12_blocked_paths(spark: SparkSession, d: str) -> DataFrame:
    rel = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "://[^/]*([^?#]*)", 1), r"\.md$", ""), "^/+", "")
    bad = (rel == "") | F.startswith(rel, F.lit("source-")) | F.startswith(rel, F.lit("chunk-")) | rel.rlike(r"(^|/)(index|log)$") | rel.rlike(r"(^|/)\.\.(/|$)")
    return B.read(spark, d, "pages").select("page_id", bad.alias("blocked"))


@query(f"WITH {ENT}, {REL}, {OC}, act AS (SELECT DISTINCT 'customer-' || substr(subject, 10) AS src FROM oc WHERE status = 'active' AND object = 'F') SELECT rel.src, predicate, dst FROM rel WHERE src IN (SELECT src FROM act)")
def p14_active_edges(spark: SparkSession, d: str) -> DataFrame:
    act = B.order_claims(spark, d).where("status = 'active' AND object = 'F'").select(F.concat(F.lit("customer-"), F.substring("subject", 10, 20)).alias("src"))
    return B.relations(spark, d).join(act, "src", "left_semi").select("src", "predicate", "dst")


@query(f"WITH {OC}, st AS (SELECT id, family_id, version, subject, predicate, object, CASE WHEN status = 'active' AND ord % 2 = 0 THEN 'staging' ELSE status END AS status, valid_to, ord FROM oc), ap AS (SELECT family_id, arg_max(object, version) AS object, max(version) AS v FROM st WHERE status = 'staging' AND ord % 4 = 0 GROUP BY 1), t AS (SELECT family_id, max(version) AS top FROM st GROUP BY 1) SELECT family_id, (top + 1)::INT AS version, object FROM ap JOIN t USING (family_id)")
def e2_approved_versions(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    staged = c.withColumn("status", F.when((F.col("status") == "active") & (F.col("ord") % 2 == 0), "staging").otherwise(F.col("status")))
    decisions = staged.where("status = 'staging'").select("id", F.when(F.col("ord") % 4 == 0, "approve").otherwise("reject").alias("verdict"))
    out = G.approve(staged.select("id", "family_id", "version", "subject", "predicate", "object", "status", "valid_from", "valid_to"), decisions, F.expr("timestamp'2024-01-01'"))
    return out.where("status = 'active' AND valid_from = timestamp'2024-01-01'").select("family_id", "version", "object")


@query(f"""WITH {OC}, o AS (SELECT family_id, arg_max(id, version) AS old_id, arg_max(object, version) AS oo FROM oc WHERE valid_from < TIMESTAMP '1998-01-01' GROUP BY 1),
n AS (SELECT family_id, arg_max(id, version) AS new_id, arg_max(object, version) AS no FROM oc WHERE valid_from >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT family_id, CASE WHEN old_id IS NULL THEN 'claim_added' ELSE 'policy_changed' END AS event, old_id, new_id, '2024-01-01 00:00:00' AS at_time FROM n LEFT JOIN o USING (family_id) WHERE old_id IS NULL OR oo <> no""")
def e1_evolution_events(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    diff = C.diff(c.where("valid_from < timestamp'1998-01-01'"), c.where("valid_from >= timestamp'1998-01-01'"))
    return G.apply_diff(c, diff, F.expr("timestamp'2024-01-01'")).withColumn("at_time", stamp("at")).drop("at")


@query(f"WITH {EV}, r AS (SELECT source_id, claim_id, contains(d.text, quote) AS ok FROM ev JOIN documents d ON 'doc-' || d.doc_id = source_id) SELECT source_id, count(*) AS checked, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS quarantined, coalesce(string_agg(claim_id, ',' ORDER BY claim_id) FILTER (NOT ok), '') AS failed FROM r GROUP BY 1")
def a13_sample_report(spark: SparkSession, d: str) -> DataFrame:
    e = B.evidence(spark, d)
    v = C.verify(e, B.kb_sources(spark, d), e.select(F.col("claim_id").alias("id")).distinct()).join(e.select("claim_id", "source_id"), "claim_id")
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("verified"), F.col("claim_id")))), ",")
    return v.groupBy("source_id").agg(F.count("*").alias("checked"), F.count_if("verified").alias("passed"), F.count_if(~F.col("verified")).alias("quarantined"), failed.alias("failed"))


@query(f"WITH {OC}, m AS (SELECT *, version >= max(version) OVER (PARTITION BY family_id) - 1 AS act FROM oc), f AS (SELECT family_id FROM m WHERE act GROUP BY 1 HAVING count(*) > 1) SELECT subject, count(*) AS competing FROM m JOIN f USING (family_id) WHERE act GROUP BY 1")
def a4_competing_claims(spark: SparkSession, d: str) -> DataFrame:
    top = Window.partitionBy("family_id")
    c = B.order_claims(spark, d).withColumn("act", F.col("version") >= F.max("version").over(top) - 1).where("act").withColumn("n", F.count("*").over(top)).where("n > 1")
    return c.groupBy("subject").agg(F.count("*").alias("competing"))


@query(f"WITH {OC}, a AS (SELECT subject, list_sort(list(id)) AS ids FROM oc WHERE status = 'active' GROUP BY 1) SELECT subject, sha256(array_to_string(ids, ',') || '|' || len(ids)) AS fingerprint FROM a")
def a12_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    g = B.order_claims(spark, d).where("status = 'active'").groupBy("subject").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return g.select("subject", F.sha2(F.concat_ws("|", F.array_join("ids", ","), F.size("ids")), 256).alias("fingerprint"))


@query(f"WITH {OC}, b AS (SELECT DISTINCT subject FROM oc WHERE valid_from < TIMESTAMP '1996-01-01'), a AS (SELECT DISTINCT subject FROM oc WHERE valid_from >= TIMESTAMP '1996-01-01') SELECT CASE WHEN b.subject IS NULL THEN 'created' WHEN a.subject IS NULL THEN 'stale' ELSE 'updated' END AS kind, count(*) AS topics FROM a FULL JOIN b USING (subject) GROUP BY 1")
def u3_topic_changes(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    cut = F.expr("timestamp'1996-01-01'")
    s = c.groupBy("subject").agg(F.bool_or(F.col("valid_from") < cut).alias("b"), F.bool_or(F.col("valid_from") >= cut).alias("a"))
    return s.groupBy(F.when(~F.col("b"), "created").when(~F.col("a"), "stale").otherwise("updated").alias("kind")).agg(F.count("*").alias("topics"))


@query(f"""WITH {OC}, h AS (SELECT substr(subject, 10)::BIGINT % 100 AS page_id, id, subject, predicate, confidence, contains(predicate, 'priority')::INT + contains(predicate, 'order')::INT AS hits FROM oc WHERE status = 'active'),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, subject, predicate ORDER BY hits DESC, confidence DESC, id) AS n FROM h) WHERE n = 1)
SELECT page_id, place::INT AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, confidence DESC, predicate DESC, id) AS place FROM o) WHERE place <= 8""")
def k8_faq_claims(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).where("status = 'active'").withColumn("page_id", F.substring("subject", 10, 20).cast("bigint") % 100)
    return C.faq(c, ["priority", "order"])


@query(f"WITH {REL} SELECT src, predicate, dst, total, total > 500 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY src, predicate, dst) AS n, count(*) OVER () AS total FROM rel) WHERE n <= 500")
def k9_snapshot(spark: SparkSession, d: str) -> DataFrame:
    r = B.relations(spark, d)
    total = F.broadcast(r.agg(F.count("*").alias("total")))  # one row
    return r.orderBy("src", "predicate", "dst").limit(500).crossJoin(total).select("src", "predicate", "dst", "total", (F.col("total") > 500).alias("truncated"))


@query(f"WITH {REL} SELECT DISTINCT src, predicate, dst FROM rel")
def g2_merged_relations(spark: SparkSession, d: str) -> DataFrame:
    r, key = B.relations(spark, d), ["src", "predicate", "dst"]
    return B.dealt(r.unionByName(r), 2 * B.relation_rows(spark, d), *key).groupBy(*key).agg(F.count("*").alias("n")).drop("n")


@query(f"""WITH {OC}, e AS (SELECT DISTINCT subject, predicate, object FROM oc), v AS (SELECT * FROM oc WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR TIMESTAMP '1996-06-30' < valid_to))
SELECT subject, predicate, object, arg_min(v.id, v.ord) AS claim_id FROM e JOIN v USING (subject, predicate, object) GROUP BY ALL""")
def j5_edge_claims(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the graph of all claims, each with the first claim that bears it at a time."""
    claims = B.order_claims(spark, d)
    return C.edge_claims(claims.select("subject", "predicate", "object").distinct(), claims, F.expr("timestamp'1996-06-30'"))


# Chunk maintenance


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d).where("length(text) > 0")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("title")))
    return H.exploded(s, H.size_split(whole, 1000)).select("id", "source_id", "chunk_index", "start", "end", F.lit("active").alias("status"))


CHUNKS = "ck AS (SELECT 'doc-' || doc_id AS source_id, doc_id, s::INT AS start, least(s + 1000, length(text))::INT AS e FROM documents, (SELECT unnest(range(0, 200000, 1000)) AS s) WHERE s < length(text))"


@query(f"WITH {CHUNKS}, f AS (SELECT DISTINCT source_id FROM ck WHERE doc_id % 4 = 0) SELECT status, count(*) AS chunks, count(DISTINCT source_id) AS sources FROM (SELECT source_id, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'active' END AS status FROM ck UNION ALL SELECT source_id, 'fresh' FROM f) GROUP BY 1")
def s6_replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    fresh = c.where("cast(substring(source_id, 5, 20) as bigint) % 4 = 0 AND chunk_index = 0").withColumn("status", F.lit("fresh"))
    return K.replace_chunks(c, fresh).groupBy("status").agg(F.count("*").alias("chunks"), F.countDistinct("source_id").alias("sources"))


@query(f"WITH {CHUNKS} SELECT source_id, count(*) AS purged FROM ck WHERE doc_id % 3 = 0 GROUP BY 1")
def s7_purged_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).withColumn("status", F.when(F.expr("cast(substring(source_id, 5, 20) as bigint) % 3 = 0"), "stale").otherwise("active"))
    left, vectors, purged = K.purge_stale(c, c.select(F.col("id").alias("ref_id")))
    return purged


@query(f"WITH {HS} SELECT id AS source_id, count(*) FILTER (title IS NOT NULL) AS sections, max(\"end\") >= 5000 OR count(*) FILTER (title IS NOT NULL) >= 4 AS split FROM hs GROUP BY 1")
def f25_split_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = B.md_sources(spark, d).where("length(text) > 0")
    n = F.regexp_count("text", F.lit(r"(?m)^[ \t]*#{1,2}[ \t]+\S"))
    return s.select(F.col("id").alias("source_id"), n.cast("bigint").alias("sections"), ((F.length("text") >= 5000) | (n >= 4)).alias("split"))


# Memory


@query(f"""WITH {EP}, t AS (SELECT session_id, seq, replace(lower(q || ' ' || a), 'ß', 'ss') AS text FROM ep), w AS (SELECT DISTINCT replace(lower(unnest(regexp_extract_all(text, {WORDS}))), 'ß', 'ss') AS term FROM benchmark),
h AS (SELECT session_id, seq, arg_min(term, (-length(term), term)) AS term FROM t JOIN w ON contains(text, term) GROUP BY 1, 2)
SELECT session_id, arg_max(term, seq) AS anchor FROM h GROUP BY 1""")
def j25_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The longest term that a session's newest episode with any holds, as a part of its text."""
    texts = B.episodes(spark, d).select(F.struct("session_id", "seq").alias("id"), F.concat_ws(" ", "q", "a").alias("text"))
    terms = B.read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("term")).distinct()
    hit = Z.longest_terms(texts.withColumn("id", F.to_json("id")), terms)
    of = F.from_json("id", "session_id string, seq bigint")
    return hit.withColumn("of", of).groupBy("of.session_id").agg(F.max_by("term", "of.seq").alias("anchor"))


@query(f"""WITH {EP}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS age FROM ep), k AS (SELECT * FROM n WHERE age <= 10),
w AS (SELECT session_id, list_filter(string_split_regex(lower(q), '[ \\t\\r\\n]+'), lambda x: x <> '') AS words FROM n WHERE age = 1),
m AS (SELECT k.session_id, seq, age, len(list_filter(words, lambda x: contains(lower(q || ' ' || a), x))) > 0 AS hit FROM k JOIN w USING (session_id) WHERE age > 1)
SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC)::INT AS rank, hit AS matched FROM (SELECT *, bool_or(hit) OVER (PARTITION BY session_id) AS found FROM m) WHERE hit OR (NOT found AND age <= 4)""")
def m1_session_memory(spark: SparkSession, d: str) -> DataFrame:
    """Each session's memory, trimmed to ten episodes, recalled for its newest question."""
    e = G.trim_memory(B.episodes(spark, d), 10)
    newest = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    e = e.withColumn("age", F.row_number().over(newest))
    return G.recall(e.where("age > 1"), e.where("age = 1").select("session_id", F.col("q").alias("query")))


# Retrieval and pages


@query(f"""WITH {PAGES}, {FUSED}, p AS (SELECT 'chunk:doc-' || doc_id AS key, text AS passage FROM documents UNION ALL SELECT 'wiki:page-' || page_id, body FROM wp),
h AS (SELECT fn.query_id, fn.key, substr(passage, 1, 400) AS passage, b.text AS query, rank FROM fn JOIN p USING (key) JOIN benchmark b ON item_id = fn.query_id WHERE rank <= 8),
s AS (SELECT query_id, key, CASE WHEN contains(lower(passage), lower(query)) THEN 1.0 ELSE len(list_intersect(list_distinct(regexp_extract_all(lower(query), {WORDS})), list_distinct(regexp_extract_all(lower(passage), {WORDS})))) / len(list_distinct(regexp_extract_all(lower(query), {WORDS}))) END AS score FROM h)
SELECT query_id, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM s""")
def r6_reranked(spark: SparkSession, d: str) -> DataFrame:
    f = _fused(spark, d).where("rank <= 8")
    texts = B.read(spark, d, "documents").select(F.concat(F.lit("chunk:doc-"), "doc_id").alias("key"), F.substring("text", 1, 400).alias("passage")).unionByName(B.wiki_pages(spark, d).select(F.concat(F.lit("wiki:page-"), "page_id").alias("key"), F.substring("body", 1, 400).alias("passage")))
    hits = f.join(texts, "key").join(B.questions(spark, d), "query_id").select("query_id", "rank", "key", "query", "passage")
    return G.rerank(hits, 8, 0.0).select("query_id", "key", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {PAGES}, {FUSED} SELECT query_id, string_agg(substr(key, 12), ',' ORDER BY rank) FILTER (starts_with(key, 'chunk:doc-')) AS chunks, count(*) FILTER (starts_with(key, 'wiki:')) AS pages FROM fn GROUP BY 1""")
def j18_hit_lists(spark: SparkSession, d: str) -> DataFrame:
    f = _fused(spark, d)
    doc = F.when(F.startswith("key", F.lit("chunk:doc-")), F.struct("rank", F.substring("key", 12, 40).alias("id")))
    g = f.groupBy("query_id").agg(F.array_sort(F.collect_list(doc)).alias("c"), F.count_if(F.startswith("key", F.lit("wiki:"))).alias("pages"))
    return g.select("query_id", F.array_join(F.col("c.id"), ",").alias("chunks"), "pages")


@query(f"WITH {PAGES}, r AS (SELECT upper(substr(title, 1, 1)) AS folder, page_id, row_number() OVER (PARTITION BY upper(substr(title, 1, 1)) ORDER BY title, page_id) AS n FROM wp) SELECT folder, count(*) AS pages, string_agg(page_id::VARCHAR, ',' ORDER BY n) FILTER (n <= 5) AS first_five FROM r GROUP BY 1")
def a17_page_bundles(spark: SparkSession, d: str) -> DataFrame:
    return G.page_bundles(B.wiki_pages(spark, d).withColumn("folder", T.initial("title")))


@query(f"""WITH {PAGES}, k AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(text, {WORDS}), lambda x: length(x) > 3))) AS kw FROM benchmark),
h AS (SELECT query_id, page_id, 2 * count(*) FILTER (contains(title, kw)) + count(*) FILTER (contains(body, kw)) AS raw FROM k, wp GROUP BY 1, 2), g AS (SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, page_id) AS rank FROM h WHERE raw > 0)
SELECT query_id, rank::INT AS rank, page_id, round(score, 6) AS score FROM g WHERE rank <= 5""")
def r4_page_lane(spark: SparkSession, d: str) -> DataFrame:
    kw = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)), lambda x: F.length(x) > 3)).alias("kw"))
    return Z.page_lane(B.wiki_pages(spark, d), kw)
