"""Registered queries on enrichment, recorded plans, quarantine, procedures and page exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks as H
from tessera.operators import claims as C
from tessera.operators import govern as G
from tessera.operators import retrieve as R
from tessera.operators import search as Z
from tessera.plans.base import EV, KB, OC, PAGES
from tessera.plans.knowledge import MD, WORDS
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()



@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), {WORDS}))::INT + len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]'))::INT AS tokens FROM documents")
def f2_tokens_cjk(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "documents").select("doc_id", F.size(T.tokens_cjk("text")).alias("tokens"))


@query(f"""WITH {OC} SELECT id, trim(subject || ' ' || predicate || ' ' || object) AS claim_text, substr(sha256(trim(subject || ' ' || predicate || ' ' || object)), 1, 16) AS digest FROM oc WHERE status = 'active'""")
def f7_claim_texts(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).where("status = 'active'").withColumn("claim_text", F.trim(F.concat_ws(" ", "subject", "predicate", "object")))
    return c.select("id", "claim_text", T.short_hash("claim_text").alias("digest"))


@query("WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice / 100000 AS score FROM orders) SELECT query_id, id, round(CASE WHEN bool_or(score < 0 OR score > 1) OVER (PARTITION BY query_id) THEN 1 / (1 + exp(-score)) ELSE score END, 6) AS score FROM s")
def f8_unit_scores(spark: SparkSession, d: str) -> DataFrame:
    s = B.read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("score"))
    out = F.bool_or((F.col("score") < 0) | (F.col("score") > 1)).over(Window.partitionBy("query_id"))
    return s.select("query_id", "id", F.round(F.when(out, 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score")), 6).alias("score"))


@query(f"""WITH p AS (SELECT item_id AS query_id, b.text AS query, doc_id, d.text AS passage FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = item_id),
s AS (SELECT query_id, doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(query), {WORDS})), list_distinct(regexp_extract_all(lower(passage), {WORDS})))) / len(list_distinct(regexp_extract_all(lower(query), {WORDS}))) AS base, contains(lower(passage), lower(query)) AS whole FROM p)
SELECT query_id, doc_id, round(CASE WHEN whole THEN greatest(base, 1.0) ELSE base END, 6) AS score FROM s""")
def f5_overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = B.read(spark, d, "documents").select("doc_id", (F.col("doc_id") % B.read(spark, d, "benchmark").count()).alias("query_id"), F.col("text").alias("passage"))
    return docs.join(B.questions(spark, d), "query_id").select("query_id", "doc_id", F.round(T.overlap_score("query", "passage"), 6).alias("score"))


@query(f"WITH {PAGES}, t AS (SELECT page_id, title, regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS canon FROM wp) SELECT canon, count(*) AS pages, min(title) AS first_title FROM t WHERE canon <> '' GROUP BY 1")
def f14_topic_names(spark: SparkSession, d: str) -> DataFrame:
    w = B.wiki_pages(spark, d).select("title", T.topic_name("title").alias("canon")).where("canon <> ''")
    return w.groupBy("canon").agg(F.count("*").alias("pages"), F.min("title").alias("first_title"))


@query(f"WITH {KB} SELECT id, CASE WHEN regexp_matches(text, '(?:Licensed|Released) under') THEN regexp_extract(text, '(?:Licensed|Released) under ([^\\n]+)', 1) ELSE regexp_replace(title, '\\.md$', '') END AS anchor FROM kb")
def f16_document_anchors(spark: SparkSession, d: str) -> DataFrame:
    named = F.regexp_extract("text", r"(?:Licensed|Released) under ([^\n]+)", 1)
    return B.kb_sources(spark, d).select("id", F.coalesce(F.nullif(named, F.lit("")), F.regexp_replace("title", r"\.md$", "")).alias("anchor"))


@query(f"WITH {OC} SELECT id, CASE WHEN starts_with(predicate, subject) THEN predicate || '?' ELSE subject || ': ' || predicate END AS question, (contains(predicate, 'priority')::INT + contains(predicate, 'order')::INT)::INT AS priority FROM oc WHERE status = 'active'")
def f28_claim_questions(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.lit("priority"), F.lit("order"))
    q = F.when(F.startswith("predicate", F.col("subject")), F.concat("predicate", F.lit("?"))).otherwise(F.concat_ws(": ", "subject", "predicate"))
    return B.order_claims(spark, d).where("status = 'active'").select("id", q.alias("question"), F.size(F.filter(words, lambda w: F.contains(F.col("predicate"), w))).alias("priority"))


@query(f"WITH {OC} SELECT id, 'Order status of ' || subject || ' is ' || object AS sentence FROM oc WHERE status = 'active' AND predicate = 'order_status' UNION ALL SELECT id, subject || ' has priority ' || object FROM oc WHERE status = 'active' AND predicate = 'order_priority'")
def f27_formatted_claims(spark: SparkSession, d: str) -> DataFrame:
    forms = F.broadcast(spark.createDataFrame([("order_status", "Order status of {s} is {o}"), ("order_priority", "{s} has priority {o}")], "predicate string, form string"))
    c = B.order_claims(spark, d).where("status = 'active'").join(forms, "predicate")
    return c.select("id", F.replace(F.replace("form", F.lit("{s}"), F.col("subject")), F.lit("{o}"), F.col("object")).alias("sentence"))


# Source statuses and what they say of the enrichment; any other says nothing.
ENRICHMENT = {"chunking": "running", "extracting_claims": "running", "enriching_chunks": "running", "compiling_wiki": "running", "running": "running", "enriching": "running", "succeeded": "done", "succeeded_partial": "done", "failed": "failed"}
STATUSES = [*ENRICHMENT, "uploaded"]


@query(
    "WITH s AS (SELECT 'doc-' || doc_id AS id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(STATUSES)) + " END AS status FROM documents) SELECT id, status, CASE status "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ENRICHMENT.items()) + " END AS enrichment FROM s"
)
def f33_enrichment_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("doc_id") % 10).cast("int"))
    known = F.create_map(*[F.lit(x) for pair in ENRICHMENT.items() for x in pair])
    return B.kb_sources(spark, d).select("id", status.alias("status")).select("id", "status", F.try_element_at(known, F.col("status")).alias("enrichment"))


# Recorded plans and responses


@query("SELECT doc_id, n::INT AS spans, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS valid FROM (SELECT doc_id, least(12, greatest(2, length(text) // 500 + 2)) AS n FROM documents)")
def u5_plan_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Recorded section plans: valid if their sections cover all spans once, in order."""
    docs = B.read(spark, d, "documents").select("doc_id", F.least(F.lit(12), F.greatest(F.lit(2), F.floor(F.length("text") / 500) + 2)).cast("int").alias("n"))
    full = F.sequence(F.lit(0), F.col("n") - 1)
    said = F.when(F.col("doc_id") % 7 == 0, F.slice(full, F.lit(1), F.col("n") - 1)).when(F.col("doc_id") % 5 == 0, F.reverse(full)).otherwise(full)
    plan = docs.withColumn("sections", F.array(F.slice(said, 1, 1), F.slice(said, F.lit(2), F.size(said))))
    return plan.select("doc_id", F.col("n").alias("spans"), (F.flatten("sections") == full).alias("valid"))


@query(f"WITH {PAGES}, l AS (SELECT page_id, unnest(string_split('- [[' || array_to_string(links, '|t]] x' || chr(10) || '- [[') || '|t]] x', chr(10))) AS line FROM wp WHERE len(links) > 0) SELECT page_id, regexp_extract(line, '\\[\\[([^\\]|]+)\\|', 1) AS path, count(*) AS n FROM l GROUP BY 1, 2")
def t11_index_entries(spark: SparkSession, d: str) -> DataFrame:
    w = B.wiki_pages(spark, d).where(F.size("links") > 0)
    index = F.array_join(F.transform("links", lambda x: F.concat(F.lit("- [["), x, F.lit("|t]] x"))), "\n")
    lines = w.select("page_id", F.explode(F.split(index, "\n")).alias("line"))
    return lines.select("page_id", F.regexp_extract("line", r"\[\[([^\]|]+)\|", 1).alias("path")).groupBy("page_id", "path").agg(F.count("*").alias("n"))


@query(f"""WITH {OC}, r AS (SELECT id, ord, CASE WHEN ord % 3 = 0 THEN 'reactivated' WHEN ord % 3 = 1 THEN 'created' ELSE 'failed' END AS outcome FROM oc WHERE status = 'superseded') SELECT outcome, count(*) AS n FROM r GROUP BY 1""")
def e3_quarantine_approvals(spark: SparkSession, d: str) -> DataFrame:
    """Quarantined JSON rows: with a claim id they reactivate it, with a whole triple they make a claim, else they fail."""
    c = B.order_claims(spark, d).where("status = 'superseded'")
    raw = F.when(F.col("ord") % 3 == 0, F.to_json(F.struct(F.col("id").alias("claim_id")))).when(F.col("ord") % 3 == 1, F.to_json(F.struct("subject", "predicate", "object"))).otherwise(F.to_json(F.struct("subject")))
    q = c.select(F.from_json(raw, "claim_id string, subject string, predicate string, object string").alias("r"))
    whole = F.length("r.subject") * F.length("r.predicate") * F.length("r.object") > 0
    out = F.when(F.col("r.claim_id").isNotNull(), "reactivated").when(F.coalesce(whole, F.lit(False)), "created").otherwise("failed")
    return q.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT CASE WHEN weight < 0.6 THEN 'low_confidence' WHEN ord % 7 = 0 THEN 'span_mismatch' END AS reason, count(*) AS backlog FROM ev WHERE weight < 0.6 OR ord % 7 = 0 GROUP BY 1")
def a16_quarantine_backlog(spark: SparkSession, d: str) -> DataFrame:
    e = B.evidence(spark, d)
    bad = C.verify(e, B.kb_sources(spark, d), e.select(F.col("claim_id").alias("id")).distinct()).join(e.select("claim_id", "weight"), "claim_id")
    reason = F.when(F.col("weight") < 0.6, "low_confidence").when(~F.col("verified"), "span_mismatch")
    return bad.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("backlog"))


# Memory, procedures, citations


@query("""WITH p(name, steps) AS (VALUES ('reading a text', 3), ('text', 1), ('orders', 2)), q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'Reading a text about ' || item_id ELSE 'orders' END AS query FROM benchmark)
SELECT query_id, arg_max(name, (length(name), name)) AS name, arg_max(steps, (length(name), name))::INT AS steps FROM q, p WHERE contains(lower(query), lower(name)) OR contains(lower(name), lower(query)) GROUP BY 1""")
def j23_procedures(spark: SparkSession, d: str) -> DataFrame:
    p = F.broadcast(spark.createDataFrame([("reading a text", 3), ("text", 1), ("orders", 2)], "name string, steps int"))  # a table of procedures
    q = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Reading a text about "), "item_id")).otherwise("orders").alias("query"))
    hit = q.join(p, F.contains(F.lower("query"), F.lower("name")) | F.contains(F.lower("name"), F.lower("query")))
    return hit.groupBy("query_id").agg(F.max_by(F.struct("name", "steps"), F.struct(F.length("name"), "name")).alias("p")).select("query_id", "p.name", "p.steps")


@query(f"WITH {EV} SELECT claim_id, bool_or(contains(d.text, quote) OR contains(quote, d.text)) AS allowed FROM ev JOIN documents d ON 'doc-' || d.doc_id = source_id GROUP BY 1")
def j26_allowed_quotes(spark: SparkSession, d: str) -> DataFrame:
    e, s = B.evidence(spark, d), B.kb_sources(spark, d).select(F.col("id").alias("source_id"), "text")
    ok = F.contains("text", F.col("quote")) | F.contains("quote", F.col("text"))
    return e.join(s, "source_id").groupBy("claim_id").agg(F.bool_or(ok).alias("allowed"))


@query(f"WITH {OC}, a(alias, canon) AS (VALUES ('P', 'pending'), ('F', 'finished'), ('O', 'open')), t(name, type) AS (VALUES ('pending', 'State'), ('finished', 'State')) SELECT id, coalesce(canon, object) AS object, coalesce(t.type, 'Concept') AS object_type FROM oc LEFT JOIN a ON object = alias LEFT JOIN t ON coalesce(canon, object) = name WHERE status = 'active'")
def j22_resolved_terms(spark: SparkSession, d: str) -> DataFrame:
    a = F.broadcast(spark.createDataFrame([("P", "pending"), ("F", "finished"), ("O", "open")], "object string, canon string"))
    t = F.broadcast(spark.createDataFrame([("pending", "State"), ("finished", "State")], "name string, type string"))
    c = B.order_claims(spark, d).where("status = 'active'").select("id", "object").join(a, "object", "left").withColumn("name", F.coalesce("canon", "object"))
    return c.join(t, "name", "left").select("id", F.col("name").alias("object"), F.coalesce("type", F.lit("Concept")).alias("object_type"))


@query(f"""WITH {EV}, v AS (SELECT ord % 40 AS query_id, claim_id, ord % 7 <> 0 AS ok FROM ev), t AS (SELECT *, CASE WHEN bool_and(ok) OVER w THEN 'verified' WHEN NOT bool_or(ok) OVER w THEN 'unverified' ELSE 'partial' END AS status FROM v WINDOW w AS (PARTITION BY query_id))
SELECT query_id, status, claim_id FROM t WHERE status = 'partial' OR ok UNION ALL SELECT DISTINCT query_id, status, NULL FROM t WHERE status = 'unverified'""")
def v2_effective_claims(spark: SparkSession, d: str) -> DataFrame:
    e = B.evidence(spark, d)
    v = C.verify(e, B.kb_sources(spark, d), e.select(F.col("claim_id").alias("id")).distinct())
    return C.effective(v.join(e.select("claim_id", (F.col("ord") % 40).alias("query_id")), "claim_id").select("query_id", "claim_id", "verified"))


@query(f"""WITH c AS (SELECT 'doc-' || doc_id || '#' || s AS id, substr(text, s::INT + 1, 1000) AS text FROM documents, (SELECT unnest(range(0, 200000, 1000)) AS s) WHERE s < length(text)),
qt AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), {WORDS}))) AS token FROM benchmark), qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1), ct AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), {WORDS}))) AS token FROM c)
SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, count(*) / any_value(n) AS score FROM ct JOIN qt USING (token) JOIN qn USING (query_id) GROUP BY 1, 2)) WHERE rank <= 8""")
def k4_chunk_lane(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d).where("length(text) > 0")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("title")))
    chunks = H.exploded(s, H.size_split(whole, 1000)).select(F.concat_ws("#", "source_id", "start").alias("id"), "text")
    return Z.overlap(B.questions(spark, d), chunks, 8).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {KB}, {OC} SELECT 'source-' || id AS page_id, 'sources/' || id || '.md' AS path, '# ' || title || chr(10) || chr(10) || 'Type: ' || type || chr(10) || 'Characters: ' || length(text) AS body FROM kb")
def s11_exported_pages(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d)
    body = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), F.concat(F.lit("Type: "), "type"), F.concat(F.lit("Characters: "), F.length("text")))
    return s.select(F.concat(F.lit("source-"), "id").alias("page_id"), F.concat(F.lit("sources/"), "id", F.lit(".md")).alias("path"), body.alias("body"))


@query(f"WITH {PAGES}, t AS (SELECT page_id, title, body, len(regexp_extract_all(body, {WORDS})) AS words FROM wp) SELECT page_id, '# ' || title || chr(10) || CASE WHEN words > 300 THEN 'long' ELSE 'short' END || chr(10) || body AS page FROM t")
def b1_compiled_pages(spark: SparkSession, d: str) -> DataFrame:
    w = B.wiki_pages(spark, d)
    kind = F.when(F.regexp_count("body", F.lit(T.WORD)) > 300, "long").otherwise("short")
    return w.select("page_id", F.concat_ws("\n", F.concat(F.lit("# "), "title"), kind, "body").alias("page"))


@query(f"WITH {OC}, g AS (SELECT DISTINCT subject FROM oc WHERE ord % 10 = 0 AND status = 'active'), l AS (SELECT subject FROM oc WHERE ord % 10 <> 0) SELECT subject FROM g WHERE subject NOT IN (SELECT subject FROM l)")
def j19_orphaned_subjects(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    gone = c.where("ord % 10 = 0 AND status = 'active'").select("subject").distinct()
    return gone.join(c.where("ord % 10 <> 0").select("subject"), "subject", "left_anti")


@query(f"""WITH {MD}, p AS (SELECT id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '(?m)^([ \\t]*#{{1,6}}[ \\t]+[^ \\t\\r\\n][^\\n]*)$', chr(30) || '\\1' || chr(30), 'g'), '\\x1e|\\n[ \\t]*\\n'),
  lambda x: regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda x: x <> '') AS s FROM md),
u AS (SELECT id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM p), h AS (SELECT id, i, unnest(range(0, length(x), 3000)) AS o, x FROM u),
n AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i, o) - 1)::INT AS chunk_index, md5(substr(x, o::INT + 1, 3000)) AS digest, count(*) OVER (PARTITION BY id) > 40 AS truncated FROM h)
SELECT id AS source_id, chunk_index, digest, truncated FROM n WHERE chunk_index < 40""")
def t14_line_outline(spark: SparkSession, d: str) -> DataFrame:
    """The plain splitter over all sources."""
    return H.plain_table(B.md_sources(spark, d)).select("source_id", "chunk_index", F.md5("text").alias("digest"), "truncated")
