"""Registered queries on claim and chunk lanes, contexts of answers, evidence of pages and rule packs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks as H
from tessera.operators import claims as C
from tessera.operators import extract as X
from tessera.operators import pages as P
from tessera.operators import render as W
from tessera.operators import retrieve as R
from tessera.operators import search as Z
from tessera.operators import synthesis as S
from tessera.plans.base import EV, KB, OC, PAGES
from tessera.plans.knowledge import FUSED, HS, OVERLAP, WORDS, _fused
from tessera.plans.registry import registry
from tessera.sources import bindings as B
from tessera.streaming.ingest import shared_path

QUERIES, SQL, query = registry()



# Lanes


@query(f"""WITH {OC}, q AS (SELECT item_id AS query_id, 'orders of customer-' || (item_id % 50) || ' with order_status f or 1-urgent?' AS query FROM benchmark),
s AS (SELECT query_id, id, contains(query, lower(subject))::INT + contains(query, lower(predicate))::INT + contains(query, lower(object))::INT AS score FROM q, oc WHERE status = 'active')
SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def j3_claim_hits(spark: SparkSession, d: str) -> DataFrame:
    q = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("orders of customer-"), F.col("item_id") % 50, F.lit(" with order_status f or 1-urgent?")).alias("query"))
    return R.claim_hits(q, B.order_claims(spark, d).where("status = 'active'"), 10)


@query(f"""WITH c AS (SELECT 'doc-' || doc_id || '#' || s AS id, substr(text, s::INT + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS s FROM documents)),
w AS (SELECT 'q' AS side, item_id::VARCHAR AS id, unnest(regexp_extract_all(lower(text), {WORDS})) AS w FROM benchmark UNION ALL SELECT 'c', id, unnest(regexp_extract_all(lower(text), {WORDS})) FROM c),
m AS (SELECT w, md5(w) AS m FROM (SELECT DISTINCT w FROM w)), x AS (SELECT w, [('0x' || substr(m, 1, 8))::BIGINT, ('0x' || substr(m, 9, 8))::BIGINT, ('0x' || substr(m, 17, 8))::BIGINT, ('0x' || substr(m, 25, 8))::BIGINT] AS x FROM m),
k AS (SELECT w, ((((((x[1] % 64) * 4294967296 + x[2]) % 64) * 4294967296 + x[3]) % 64) * 4294967296 + x[4]) % 64 AS k FROM x),
v AS (SELECT side, id, k, count(*) AS n FROM w JOIN k USING (w) GROUP BY 1, 2, 3), l AS (SELECT side, id, sqrt(sum(n * n)) AS l FROM v GROUP BY 1, 2), u AS (SELECT side, id, k, n / l AS n FROM v JOIN l USING (side, id)),
cs AS (SELECT a.id AS q, b.id AS c, sum(a.n * b.n) AS s FROM u a JOIN u b USING (k) WHERE a.side = 'q' AND b.side = 'c' GROUP BY 1, 2),
dw AS (SELECT DISTINCT * FROM w), qn AS (SELECT id, count(*) AS n FROM dw WHERE side = 'q' GROUP BY 1), ov AS (SELECT a.id AS q, b.id AS c, count(*) AS s FROM dw a JOIN dw b USING (w) WHERE a.side = 'q' AND b.side = 'c' GROUP BY 1, 2),
sc AS (SELECT item_id AS query_id, c.id, round(0.6 * CASE WHEN contains(c.text, b.text) THEN 1 ELSE coalesce(ov.s / qn.n, 0) END + 0.4 * coalesce(cs.s, 0), 9) AS score FROM cs JOIN c ON c.id = cs.c JOIN benchmark b ON b.item_id::VARCHAR = cs.q JOIN qn ON qn.id = cs.q LEFT JOIN ov ON ov.q = cs.q AND ov.c = cs.c)
SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= 8""")
def r3_mixed_chunk_lane(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d).where("length(text) > 0")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("title")))
    chunks = H.exploded(s, H.size_split(whole, 1000)).select(F.concat_ws("#", "source_id", "start").alias("id"), "text")
    return R.chunk_lane(B.questions(spark, d), chunks, 8)


@query(f"""WITH {OC}, {EV}, {PAGES}, {OVERLAP}, q AS (SELECT item_id AS query_id, ['claim', 'bm25', 'hybrid'][item_id % 3 + 1] AS mode, 'orders of customer-' || (item_id % 50) || ' with order_status f or 1-urgent?' AS query FROM benchmark),
s AS (SELECT query_id, id, contains(query, lower(subject))::INT + contains(query, lower(predicate))::INT + contains(query, lower(object))::INT AS score, lower(subject || ' ' || predicate || ' ' || object) AS key FROM q, oc WHERE status = 'active'),
c AS (SELECT query_id, id AS claim_id, key, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10),
b AS (SELECT query_id, claim_id, id AS key, score FROM dl LEFT JOIN ev ON source_id = id WHERE rank <= 10),
h AS (SELECT * FROM c UNION ALL SELECT * FROM b), l AS (SELECT query_id, key, max(score) AS score FROM h WHERE claim_id IS NULL GROUP BY 1, 2), m AS (SELECT query_id, claim_id, min(key) AS key, max(score) AS score FROM h WHERE claim_id IS NOT NULL GROUP BY 1, 2)
SELECT query_id, claim_id, key, round(score, 9) AS score FROM (SELECT * FROM c JOIN q USING (query_id) WHERE mode = 'claim' UNION ALL BY NAME SELECT * FROM b JOIN q USING (query_id) WHERE mode = 'bm25'
UNION ALL BY NAME SELECT * FROM m JOIN q USING (query_id) WHERE mode = 'hybrid' UNION ALL BY NAME SELECT *, NULL AS claim_id FROM l JOIN q USING (query_id) WHERE mode = 'hybrid')""")
def r1_hits_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """A third of the questions by claims, a third by texts, a third by both."""
    b = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(F.array(*map(F.lit, ["claim", "bm25", "hybrid"])), (F.col("item_id") % 3 + 1).cast("int")).alias("mode"), F.concat(F.lit("orders of customer-"), F.col("item_id") % 50, F.lit(" with order_status f or 1-urgent?")).alias("query"))
    c = B.order_claims(spark, d).where("status = 'active'")
    claims = R.claim_hits(b, c, 10).join(c.select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("snippet")), "id")
    texts = Z.overlap(B.questions(spark, d), B.kb_sources(spark, d).select("id", "text"), 10).join(B.evidence(spark, d).select("claim_id", F.col("source_id").alias("id")), "id", "left")
    lanes = {
        "claim": claims.select("query_id", F.lit(0).alias("lane"), F.col("id").alias("claim_id"), "snippet", F.col("score").cast("double").alias("score")),
        "bm25": texts.select("query_id", F.lit(1).alias("lane"), "claim_id", F.col("id").alias("snippet"), "score"),
    }
    return R.hits_by_mode(b, lanes, 10).select("query_id", "claim_id", "key", F.round("score", 9).alias("score"))


# Answers

CONTEXT = f"""{PAGES}, {FUSED}, {EV}, h AS (SELECT query_id, rank, split_part(key, ':', 1) AS kind, substr(key, strpos(key, ':') + 1) AS id FROM fn),
al AS (SELECT query_id, claim_id, ord, source_id, quote, rank FROM h JOIN ev ON kind = 'chunk' AND id = source_id AND ord % 7 <> 0),
cr AS (SELECT query_id, kind, id, rank, id AS source_id, substr(text, 1, 800) AS text FROM h JOIN documents ON kind = 'chunk' AND id = 'doc-' || doc_id
  UNION ALL SELECT query_id, kind, id, rank, id, substr(body, 1, 800) FROM h JOIN wp ON kind = 'wiki' AND id = 'page-' || page_id
  UNION ALL SELECT query_id, 'claim', claim_id, CASE WHEN ord % 2 = 0 THEN rank END, NULL, source_id || ' granted_under ' || quote FROM al),
cx AS (SELECT query_id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank NULLS LAST, id)::INT AS pos, id, source_id, text FROM cr)"""
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(a, '\[\^?[0-9]+\]', '', 'g'), '[ \t]+', ' ', 'g'), ' ([.,;:!?])', '\1', 'g'))"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table, made once however often it is read; its rows grow with the questions."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _context(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The context of each question, and the verified evidence in it."""
    f = _stored(_fused(spark, d).select("query_id", "rank", F.substring_index("key", ":", 1).alias("kind"), F.expr("substring(key, instr(key, ':') + 1)").alias("id")), "hits")
    # Only texts that a question hit are read for evidence and contexts.
    hit = f.where("kind = 'chunk'").select("id").distinct()
    sources = B.kb_sources(spark, d).join(hit, "id", "left_semi")
    e = _stored(B.evidence(spark, d).join(hit.withColumnRenamed("id", "source_id"), "source_id", "left_semi"), "evidence")
    good = C.verify(e, sources, e.select(F.col("claim_id").alias("id")).distinct()).where("verified").select("claim_id").join(e, "claim_id")
    allowed = f.where("kind = 'chunk'").select("query_id", "rank", F.col("id").alias("source_id")).join(good, "source_id")
    hits = f.unionByName(allowed.where("ord % 2 = 0").select("query_id", "rank", F.lit("claim").alias("kind"), F.col("claim_id").alias("id")))
    claims = e.select(F.col("claim_id").alias("id"), F.col("source_id").alias("subject"), F.lit("granted_under").alias("predicate"), F.col("quote").alias("object"))
    pages = B.wiki_pages(spark, d).select(F.concat(F.lit("page-"), "page_id").alias("id"), F.col("body").alias("text")).select(F.lit("wiki").alias("kind"), "id", F.col("id").alias("source_id"), "text")
    texts = sources.select(F.lit("chunk").alias("kind"), "id", F.col("id").alias("source_id"), "text").unionByName(pages)
    return _stored(S.pack_context(hits, allowed, claims, texts), "context"), allowed.select("query_id", "source_id", "quote")


@query(f"WITH {CONTEXT} SELECT query_id, kind, pos, id, source_id, text FROM cx")
def v4_packed_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d)[0]


@query(f"""WITH {CONTEXT}, t AS (SELECT query_id, id AS source_id, text FROM cx WHERE kind = 'chunk' AND pos = 1),
an AS (SELECT query_id, source_id, CASE query_id % 4 WHEN 0 THEN 'It says: ' || substr(text, 1, 60) || ' [1]' WHEN 2 THEN '  ' ELSE 'Not to be found.' END AS a, CASE WHEN query_id % 4 = 3 THEN substr(text, 5, 40) ELSE 'no such quote here' END AS quote FROM t),
cl AS (SELECT query_id, source_id, {CLEAN} AS answer, quote FROM an),
bs AS (SELECT query_id, source_id, text, substr(text, 1, 120) AS short, CASE WHEN length(text) >= 12 THEN substr(text, 1, 40) END AS mark FROM cx WHERE kind <> 'claim' AND text <> '' UNION ALL SELECT query_id, source_id, quote, quote, CASE WHEN length(quote) >= 6 THEN quote END FROM al),
st AS (SELECT query_id, count(DISTINCT 1) AS n FROM cl JOIN bs USING (query_id, source_id) WHERE contains(text, quote) OR contains(quote, short) GROUP BY 1),
gr AS (SELECT query_id, coalesce(bool_or(contains(answer, mark)), false) AS grounded FROM cl JOIN bs USING (query_id) GROUP BY 1)
SELECT query_id, answer, coalesce(n, 0) AS n_citations, grounded FROM cl LEFT JOIN st USING (query_id) JOIN gr USING (query_id) WHERE answer <> '' AND (n > 0 OR grounded)""")
def v4_grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers of four kinds: one that begins like its best text, one without ground, an empty one, one with a true citation."""
    context, quotes = _context(spark, d)
    best = context.where("kind = 'chunk' AND pos = 1")
    kind = F.col("query_id") % 4
    said = F.when(kind == 0, F.concat(F.lit("It says: "), F.substring("text", 1, 60), F.lit(" [1]"))).when(kind == 2, "  ").otherwise("Not to be found.")
    quote = F.when(kind == 3, F.substring("text", 5, 40)).otherwise("no such quote here")
    return S.sanitised(best.select("query_id", said.alias("answer"), F.array(F.struct("source_id", quote.alias("quote"))).alias("citations")), context, quotes)


# Pages


@query("""SELECT 'doc-' || doc_id AS source_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 > 0 THEN 'link_missing' WHEN doc_id % 7 = 0 THEN 'section_missing' ELSE 'too_few_pages' END AS reason FROM documents
WHERE (doc_id % 5 = 0 AND doc_id % 3 > 0) OR doc_id % 7 = 0 OR doc_id % 3 = 0""")
def t15_rejected_pages(spark: SparkSession, d: str) -> DataFrame:
    s = B.read(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("source_id"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("page"))
    link = F.concat(F.lit("[[source-"), "source_id", F.lit("]]"))
    body = F.concat_ws("\n", F.concat(F.lit("# Page "), "page"), F.when((F.col("doc_id") % 5 != 0) | (F.col("page") != 1), link), F.when((F.col("doc_id") % 7 != 0) | (F.col("page") != 0), F.lit("## 要点")))
    return P.page_rejects(s.select("source_id", link.alias("link"), body.alias("markdown")), ["## 要点"])


def _words(title: str, focus: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({title} || ' ' || {focus}, '\\s+|、|；|;|/|，|,'), lambda w: trim(w)), lambda w: length(w) >= 2 AND w NOT IN ('include', 'exclude', '本页', '其他'))"


@query(f"""WITH {HS}, {EV}, f AS (SELECT id AS source_id, regexp_extract(text, '[^\\s#]+') AS word FROM md WHERE length(text) > 0),
o AS (SELECT source_id, 0 AS page_index, word AS page, {_words("word", "word")} AS words FROM f UNION ALL SELECT source_id, 1, 'zzqx9', {_words("'zzqx9'", "'zzqx9'")} FROM f
  UNION ALL SELECT source_id, 2, 'zzqx9', {_words("'zzqx9'", "' ' || word || ' '")} FROM f),
c AS (SELECT hs.id AS source_id, hs.id || '#' || start AS id, title, substr(text, start + 1, "end" - start) AS text, row_number() OVER (PARTITION BY hs.id ORDER BY start) - 1 AS spot, count(*) OVER (PARTITION BY hs.id) AS n FROM hs JOIN md ON md.id = hs.id),
ce AS (SELECT *, lower(concat_ws(' ', title, text)) AS blob FROM c),
j AS (SELECT *, contains(coalesce(title, ''), page) OR len(list_filter(words, lambda w: contains(blob, lower(w)))) > 0 AS fits, greatest(2, least(4, n // (page_index + 1))) AS width FROM o JOIN ce USING (source_id)),
a AS (SELECT *, bool_or(fits) OVER (PARTITION BY source_id, page_index) AS any_fits FROM j),
t AS (SELECT source_id, page_index, 'chunk' AS kind, row_number() OVER (PARTITION BY source_id, page_index ORDER BY spot)::INT AS pos, id FROM a WHERE CASE WHEN any_fits THEN fits ELSE spot >= least(page_index * width, greatest(0, n - width)) AND spot < least(page_index * width, greatest(0, n - width)) + width END)
SELECT source_id, page_index, kind, pos, id FROM t WHERE pos <= 6 UNION ALL SELECT source_id, page_index, 'claim', 1, claim_id FROM o JOIN ev USING (source_id)""")
def b5_page_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Three recorded pages a source: one by its first word, one that nothing fits, one with the word in its focus."""
    s = B.md_sources(spark, d).where("length(text) > 0")
    word = F.regexp_extract("text", r"[^\s#]+", 0)
    page = lambda i, title, focus: F.struct(F.lit(i).alias("page_index"), title.alias("title"), focus.alias("focus"))
    none = F.lit("zzqx9")
    outline = s.select(F.col("id").alias("source_id"), F.explode(F.array(page(0, word, F.lit("")), page(1, none, F.lit("")), page(2, none, F.concat(F.lit("to include: "), word, F.lit(" exclude: rest"))))).alias("p")).select("source_id", "p.*")
    chunks = H.exploded(s, H.heading_spans(F.col("text"))).select("source_id", F.col("start").alias("ord"), F.concat_ws("#", "source_id", "start").alias("id"), "title", "text")
    claims = B.evidence(spark, d).select("source_id", "ord", F.col("claim_id").alias("id"), F.col("source_id").alias("subject"), F.lit("granted_under").alias("predicate"), F.col("quote").alias("object"))
    return P.page_evidence(outline, chunks, claims)


# Extraction


@query(r"""WITH r AS (SELECT doc_id, 'granted_by' AS predicate, unnest(regexp_extract_all(text, '(?:Licensed|Released) under (?:the )?((\w+)[^\n]*)', 2)) AS subject, unnest(regexp_extract_all(text, '(?:Licensed|Released) under (?:the )?((\w+)[^\n]*)', 1)) AS object FROM documents
UNION ALL SELECT doc_id, 'has_contact', unnest(regexp_extract_all(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+[A-Za-z0-9])', 2)), unnest(regexp_extract_all(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+[A-Za-z0-9])')) FROM documents
UNION ALL SELECT doc_id, 'has_address', 'this product', unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) FROM documents) SELECT 'doc-' || doc_id AS source_id, subject, predicate, trim(object) AS object, 0.88::DOUBLE AS confidence FROM r WHERE trim(object) <> ''""")
def t9_product_claims(spark: SparkSession, d: str) -> DataFrame:
    return X.rule_claims(B.kb_sources(spark, d), X.PRODUCT_PACK, 0.88).select("source_id", "subject", "predicate", "object", "confidence")


# Page renderers

SAFE = "regexp_replace({}, '[/\\\\:*?\"<>|]', '_', 'g')"
FRONT = "'---' || chr(10) || 'tags: [{0}]' || chr(10) || 'type: {0}' || chr(10) || 'kb_id: ' || kb_id || chr(10) || '---' || chr(10) || chr(10)"
LINES = "SELECT kb_id, page, section, key, line FROM"


@query(f"""WITH {OC}, c AS (SELECT 'orders' AS kb_id, subject AS page, * FROM oc WHERE status = 'active'), l AS (
SELECT DISTINCT kb_id, page, 0 AS section, '' AS key, {FRONT.format("entity")} || '# ' || subject || chr(10) || chr(10) || '## Claims' AS line FROM c
UNION ALL SELECT kb_id, page, 1, predicate || chr(1) || object || chr(1) || id, '- [[source-' || source_id || '|Order ' || substr(source_id, 7) || ']]: ' || predicate || ' → ' || object FROM c
UNION ALL SELECT DISTINCT kb_id, page, 2, '', chr(10) || '## 相关' FROM c
UNION ALL SELECT DISTINCT kb_id, page, 3, source_id, '- [[source-' || source_id || '|Order ' || substr(source_id, 7) || ']]' FROM c) {LINES} l""")
def f30_entity_pages(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).where("status = 'active'").withColumn("kb_id", F.lit("orders"))
    return W.entity_pages(c, c.select("source_id", F.concat(F.lit("Order "), F.substring("source_id", 7, 20)).alias("title")).distinct())


@query(f"""WITH {KB}, {EV}, c AS (SELECT claim_id AS id, source_id, 'text ' || ord AS subject, 'granted_under' AS predicate, quote AS object FROM ev), k AS (SELECT 'doc-' || doc_id AS source_id, n FROM (SELECT doc_id, unnest(range(0, ceil(length(text) / 1000)::BIGINT)) AS n FROM documents)),
l AS (SELECT kb_id, 'source-' || id AS page, 0 AS section, '' AS key, {FRONT.format("source")} || '# ' || title || chr(10) || chr(10) || '## 元数据' || chr(10) || '- source_id: `' || id || '`' || chr(10) || '- type: ' || type || chr(10) || '- status: active' || chr(10) || '- chunks: ' || (SELECT count(*) FROM k WHERE k.source_id = kb.id) || chr(10) || chr(10) || '## Claims' AS line FROM kb
UNION ALL SELECT kb_id, 'source-' || source_id, 1, subject || chr(1) || predicate || chr(1) || c.id, '- [[' || subject || '|' || subject || ']]: ' || predicate || ' → ' || object || ' (`' || c.id || '`)' FROM c JOIN kb ON kb.id = source_id
UNION ALL SELECT kb_id, 'source-' || id, 1, '', '- （无 active Claim）' FROM kb WHERE id NOT IN (SELECT source_id FROM c)
UNION ALL SELECT kb_id, 'source-' || id, 2, '', chr(10) || '## 章节' FROM kb WHERE id IN (SELECT source_id FROM k)
UNION ALL SELECT kb_id, 'source-' || id, 3, lpad(n::VARCHAR, 9, '0'), '- [[chunk-' || id || '-' || n || '|chunk-' || n || ']]' FROM k JOIN kb ON kb.id = k.source_id) {LINES} l""")
def f30_source_pages(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d).withColumn("status", F.lit("active"))
    claims = B.evidence(spark, d).select(F.col("claim_id").alias("id"), "source_id", F.concat(F.lit("text "), "ord").alias("subject"), F.lit("granted_under").alias("predicate"), F.col("quote").alias("object"), F.lit("active").alias("status"))
    return W.source_pages(s, claims, _parts(s))


def _parts(sources: DataFrame) -> DataFrame:
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("title")))
    return H.exploded(sources.where("length(text) > 0"), H.size_split(whole, 1000))


@query(f"""WITH {KB}, k AS (SELECT *, unnest(range(0, ceil(length(text) / 1000)::BIGINT)) AS n FROM kb)
SELECT kb_id, 'chunk-' || id || '-' || n AS page, {FRONT.format("chunk")} || '# Chunk ' || n || chr(10) || chr(10) || '- source: [[source-' || id || '|' || title || ']]' || chr(10) || '- chunk_index: ' || n || chr(10) || chr(10) || substr(text, n * 1000 + 1, 1000) || chr(10) AS body FROM k""")
def b2_chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d)
    return W.chunk_pages(s, _parts(s))


@query(f"""WITH {KB}, b AS (SELECT DISTINCT kb_id FROM kb), e AS (SELECT DISTINCT kb_id, type AS subject FROM kb), l AS (
SELECT kb_id, 0 AS section, '' AS key, {FRONT.format("index")} || '# Wiki Index — ' || kb_id || chr(10) || chr(10) || '## Sources' AS line FROM b
UNION ALL SELECT kb_id, 1, title || chr(1) || id, '- [[source-' || id || '|' || title || ']]' FROM kb UNION ALL SELECT kb_id, 2, '', chr(10) || '## Entities' FROM b
UNION ALL SELECT kb_id, 3, subject, '- [[' || {SAFE.format("subject")} || '|' || subject || ']]' FROM e UNION ALL SELECT kb_id, 3, '', '- （无实体）' FROM b WHERE kb_id NOT IN (SELECT kb_id FROM e)) SELECT kb_id, '_index' AS page, section, key, line FROM l""")
def b2_index_lines(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d)
    return W.index_lines(s, s.select("kb_id", F.col("type").alias("subject")))


@query(f"""WITH u AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages), n AS (SELECT *, coalesce(nullif(trim({SAFE.format("url")}), ''), 'unnamed') AS slug, coalesce(nullif(trim({SAFE.format("title")}), ''), 'unnamed') AS t, array_to_string(list_filter(string_split(url, '/'), lambda x: trim(x) <> ''), chr(1)) AS lv FROM u)
SELECT page_id, '[[' || slug || '|' || url || ']]' AS entity, CASE WHEN lv = '' THEN '未分类' ELSE replace(regexp_replace(lv, '[:*?\"<>|]', '_', 'g'), chr(1), '/') END || '/' || t AS path, '[[' || slug || '/' || t || '|' || title || ']]' AS topic, '[[' || slug || '/_index|' || url || ']]' AS hub, 'chunk-' || slug || '-' || page_id AS chunk FROM n""")
def f23_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    p = B.read(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", T.entity_link("url").alias("entity"), T.page_path("url", "title").alias("path"), T.topic_link("url", "title").alias("topic"), T.topic_link("url").alias("hub"), T.chunk_page("url", "page_id").alias("chunk"))
