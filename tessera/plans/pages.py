"""Registered queries on question rewriting, subject binding and the parts of compiled pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks as H
from tessera.operators import pages as P
from tessera.operators import questions as Q
from tessera.plans.base import ENT, EP, OC, PAGES
from tessera.plans.knowledge import FUSED, HS, _fused
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()



def st(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def pick(key: Column, values: list[str], other: Column) -> Column:
    """The value at key, or other beyond the list."""
    return F.coalesce(F.get(F.array(*map(F.lit, values)), key.cast("int")), other)


def picked(key: str, values: list[str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE {other} END"


# Questions and subjects

TERMS = ["退货", "of the", "tion", "ing", "ea"]
SHORT = ["那个怎么退", " 多久 ", "运费谁承担呢", "有没有 tion"]


@query(
    f"WITH {EP}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS age FROM ep), t(term, r) AS (VALUES "
    + ", ".join(f"('{t}', {i})" for i, t in enumerate(sorted(TERMS, key=lambda t: (-len(t), t))))
    + f"""), x AS (SELECT session_id, seq, arg_min(term, r) AS term FROM n JOIN t ON contains(q || ' ' || a, term) WHERE age > 1 GROUP BY 1, 2), an AS (SELECT session_id, arg_max(term, seq) AS anchor FROM x GROUP BY 1),
qu AS (SELECT session_id, {picked("substr(session_id, 6)::BIGINT % 5", SHORT, "q")} AS question FROM n WHERE age = 1),
u AS (SELECT *, {st("question")} AS s, coalesce(anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE contains(question, term)) AND NOT starts_with({st("question")}, anchor) AND ({" OR ".join(f"regexp_matches({st('question')}, '{p}')" for p in Q.INCOMPLETE)}), false) AS use FROM qu LEFT JOIN an USING (session_id))
SELECT session_id, CASE WHEN use THEN anchor || s ELSE question END AS question, CASE WHEN use THEN anchor END AS anchor FROM u"""
)
def f12_rewritten_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each session's newest question, completed from its earlier episodes."""
    e = B.episodes(spark, d).withColumn("age", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq"))))
    asked = e.where("age = 1").select("session_id", pick(F.substring("session_id", 6, 20).cast("bigint") % 5, SHORT, F.col("q")).alias("question"))
    return Q.rewrite(asked, e.where("age > 1"), TERMS)


SUBJECTS = ["本产品", " 投资者", "本理财产品托管人", "该产品的利率", "本季理财", "本公司产品", "该产品的 ", "利率", ""]
BOUND = ["{a}", "{a}的投资者", "{a}的托管人", "{a}的利率", "{a}", "本公司产品", "{a}", "利率", ""]


@query(
    "WITH s AS (SELECT doc_id, 'doc-' || doc_id AS a FROM documents) SELECT 'doc-' || doc_id AS source_id, CASE doc_id % 11 "
    + " ".join(f"WHEN {i} THEN " + " || ".join(["a" if x == "{a}" else f"'{x}'" for x in b.replace("{a}", "\0{a}\0").split("\0") if x] or ["''"]) for i, b in enumerate(BOUND))
    + " WHEN 9 THEN a || '的利率' ELSE a END AS subject FROM s"
)
def f15_bound_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of each document bound to it."""
    s = B.kb_sources(spark, d).select("id", "doc_id")
    own = F.when(F.col("doc_id") % 11 == 9, F.concat("id", F.lit("的利率"))).otherwise(F.col("id"))
    return s.select(F.col("id").alias("source_id"), Q.bind_subject(pick(F.col("doc_id") % 11, SUBJECTS, own), F.col("id")).alias("subject"))


@query(f"WITH {OC}, s AS (SELECT id, ord, CASE ord % 4 WHEN 0 THEN '尺码XL' WHEN 1 THEN '12-14 cm' WHEN 2 THEN repeat(subject || '、', 6) ELSE subject END AS name FROM oc WHERE status = 'active') SELECT id, name, ord % 4 = 3 OR (ord % 4 = 2 AND length(name) <= 48) AS worthy FROM s")
def p11_topic_worthy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("ord") % 4
    name = F.when(k == 0, "尺码XL").when(k == 1, "12-14 cm").when(k == 2, F.repeat(F.concat("subject", F.lit("、")), 6)).otherwise(F.col("subject"))
    return B.order_claims(spark, d).where("status = 'active'").select("id", name.alias("name"), Q.topic_worthy(name).alias("worthy"))


# Parts of pages

NUMBERED = "nt AS (SELECT 'doc-' || doc_id AS id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 AND (i - 1) % 4 = 3 THEN '## ' || x WHEN (i - 1) % 5 = 0 THEN '## ' || i || '. ' || x WHEN (i - 1) % 7 = 3 AND doc_id % 2 = 0 THEN '二、' || x ELSE x END), chr(10)) AS text FROM documents)"


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """Texts with numbered and plain headings, and with chapters in every other one."""
    s = B.kb_sources(spark, d)
    line = lambda x, i: F.when((i % 5 == 0) & (i % 4 == 3), F.concat(F.lit("## "), x)).when(i % 5 == 0, F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), x)).when((i % 7 == 3) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("二、"), x)).otherwise(x)
    return s.select("id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


CUT = "list_transform(string_split(m, chr(30))[2:], lambda p: {'title': " + st("split_part(p, chr(31), 1)") + ", 'body': " + st("substr(p, instr(p, chr(31)) + 1)") + "})"
SKIPPED = ", ".join(f"'{x}'" for x in P.SKIPPED_TITLES)
# RE2 knows no look-ahead: a heading without a number begins with another character, or its digits are not followed by a mark.
PLAIN = "(?m)^##\\s+([^\\d\\s].*?|\\d+[^\\d、.．\\n].*?|\\d+)\\s*$"


@query(f"""WITH {NUMBERED}, mk AS (SELECT id, regexp_replace(text, '(?m)^##\\s+\\d+[、.．]\\s*(.+?)\\s*$', chr(30) || '\\1' || chr(31), 'g') AS m FROM nt), pc AS (SELECT id, {CUT} AS p FROM mk),
u AS (SELECT id, len(p) AS n, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS item FROM pc WHERE len(p) >= 2)
SELECT id AS source_id, item::INT AS item, x.title AS title, md5(CASE WHEN item = n - 1 THEN {st("regexp_replace(x.body, '(?m)^##\\s+(?:[^\\d\\s]|\\d+[^\\d、.．]|\\d+$)[\\s\\S]*', '')")} ELSE x.body END) AS body_md5 FROM u WHERE x.title <> '' AND x.title NOT IN ({SKIPPED})""")
def t12_catalog_items(spark: SparkSession, d: str) -> DataFrame:
    return P.catalog_items(numbered(spark, d)).select("source_id", "item", "title", F.md5("body").alias("body_md5"))


@query(f"""WITH {NUMBERED}, c AS (SELECT id, regexp_replace(text, '(?m)^[ \\t]*[一二三四五六七八九十百]+[、．.]\\s*(\\S.+?)\\s*$', chr(30) || '\\1' || chr(31), 'g') AS m FROM nt), h AS (SELECT id, regexp_replace(text, '{PLAIN}', chr(30) || '\\1' || chr(31), 'g') AS m FROM nt),
g AS (SELECT c.id, list_filter(c.p, lambda x: length(x.body) >= 40 AND x.title <> '' AND x.title NOT IN ({SKIPPED})) AS a, list_filter(h.p, lambda x: length(x.body) >= 40 AND x.title <> '' AND x.title NOT IN ({SKIPPED})) AS b FROM (SELECT id, {CUT} AS p FROM c) c JOIN (SELECT id, {CUT} AS p FROM h) h USING (id)),
k AS (SELECT id, CASE WHEN len(a) >= 2 THEN a WHEN len(b) >= 2 THEN b END AS p FROM g), u AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS item FROM k)
SELECT id AS source_id, item::INT AS item, x.title AS title, md5(x.body) AS body_md5 FROM u""")
def t12_chapter_items(spark: SparkSession, d: str) -> DataFrame:
    return P.chapter_items(numbered(spark, d)).select("source_id", "item", "title", F.md5("body").alias("body_md5"))


MARKDOWN = "mk AS (SELECT page_id, links, '# ' || title || chr(10) || body || CASE page_id % 4 WHEN 0 THEN chr(10) || '## 相关主题' || chr(10) || '- old' || chr(10) || '## Chunks' || chr(10) || 'x' WHEN 1 THEN chr(10) || '## 关键词' || chr(10) || 'x' WHEN 2 THEN chr(10) || '## 相关主题' || chr(10) || '- old' ELSE ' ' END AS md FROM wp)"


@query(f"""WITH {PAGES}, {MARKDOWN}, s AS (SELECT *, '## 相关主题' || chr(10) || '- ' || array_to_string(links, chr(10) || '- ') || chr(10) AS new FROM mk)
SELECT page_id, md5(CASE WHEN len(links) = 0 THEN md WHEN page_id % 4 = 0 THEN regexp_replace(split_part(md, '## 相关主题', 1), '\\s+$', '') || chr(10) || chr(10) || new || chr(10) || '## Chunks' || chr(10) || 'x'
  WHEN page_id % 4 = 1 THEN replace(md, '## 关键词', new || chr(10) || '## 关键词') WHEN page_id % 4 = 2 THEN regexp_replace(split_part(md, '## 相关主题', 1), '\\s+$', '') || chr(10) || chr(10) || new
  ELSE regexp_replace(md, '\\s+$', '') || chr(10) || chr(10) || new END) AS page_md5 FROM s""")
def f31_related_sections(spark: SparkSession, d: str) -> DataFrame:
    ends = ["\n## 相关主题\n- old\n## Chunks\nx", "\n## 关键词\nx", "\n## 相关主题\n- old"]
    w = B.wiki_pages(spark, d).withColumn("md", F.concat(F.lit("# "), "title", F.lit("\n"), "body", pick(F.col("page_id") % 4, ends, F.lit(" "))))
    return w.select("page_id", F.md5(P.related_section(F.col("md"), F.col("links"))).alias("page_md5"))


PLANNED = ["", " 未分类 ", "guides", "other/x", "guides/x "]


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'guides/' || source WHEN doc_id % 2 = 0 AND doc_id % 5 IN (2, 3) THEN 'guides/' || source ELSE {st(picked('doc_id % 5', PLANNED, chr(39) * 2))} END AS folder FROM documents")
def f35_plan_folders(spark: SparkSession, d: str) -> DataFrame:
    docs = B.read(spark, d, "documents").select("doc_id", F.concat(F.lit("guides/"), "source").alias("own"))
    return docs.select("doc_id", P.plan_folder(pick(F.col("doc_id") % 5, PLANNED, F.lit("")), F.col("own"), F.lit("guides"), F.col("doc_id") % 2 == 0).alias("folder"))


@query(f"""WITH {HS}, c AS (SELECT hs.id, start, {st("coalesce(title, '')")} AS label, {st('substr(text, start + 1, "end" - start)')} AS body FROM hs JOIN md USING (id)),
l AS (SELECT *, list_filter(list_transform(list_filter(string_split_regex(body, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {st("x")} <> ''), lambda x: regexp_replace(x, '^[ \\-\\t]+|[ \\-\\t]+$', '', 'g')), lambda x: length(x) >= 8 AND NOT starts_with(x, '#')) AS us FROM c),
s AS (SELECT id, start, label, CASE WHEN len(us) >= 2 THEN us[1:6] ELSE regexp_extract_all(replace(body, chr(10), ' '), '[^。；;]*[。；;]|[^。；;]+$') END AS said FROM l),
e AS (SELECT id, start, unnest(said) AS x, generate_subscripts(said, 1) AS pos, label FROM s),
p AS (SELECT id, start, pos, {st("regexp_replace(CASE WHEN label <> '' THEN label || '：' || x ELSE x END, '\\s+', ' ', 'g')")} AS point FROM e WHERE {st("x")} <> ''),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, substr(point, 1, 80) ORDER BY start, pos) AS n FROM p WHERE length(point) >= 8) WHERE n = 1)
SELECT id AS source_id, place::INT AS place, substr(point, 1, 220) AS point FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, pos) AS place FROM o) WHERE place <= 12""")
def f29_point_bullets(spark: SparkSession, d: str) -> DataFrame:
    c = H.exploded(B.md_sources(spark, d), H.heading_spans(F.col("text")))
    return P.points(c.withColumn("summary", F.lit("")))


# Topics, chunks and passages


@query(f"""WITH {HS}, c AS (SELECT hs.id, start, coalesce({st("title")}, '') AS t, substr(text, start + 1, "end" - start) AS blob FROM hs JOIN md USING (id)), k AS (SELECT 'doc-' || doc_id AS id, unnest(list_distinct(list_filter(string_split(text, ' ')[1:3], lambda x: x <> ''))) AS s FROM documents),
m AS (SELECT id, start, s, contains(s, t) OR contains(t, s) AS a, contains(blob, s) AS b FROM c JOIN k USING (id) WHERE t <> ''), w AS (SELECT *, bool_or(a) OVER (PARTITION BY id, start) AS has_title FROM m)
SELECT id AS source_id, start::INT AS topic_id, md5(s) AS claim_id FROM w WHERE CASE WHEN has_title THEN a ELSE b END""")
def j29_topic_claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims about a document's first words that its headings' topics take."""
    topics = H.exploded(B.md_sources(spark, d), H.heading_spans(F.col("text"))).select("source_id", F.col("start").alias("topic_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("blob"))
    words = F.array_distinct(F.filter(F.slice(F.split("text", " "), 1, 3), lambda x: x != ""))
    claims = B.kb_sources(spark, d).select(F.col("id").alias("source_id"), F.explode(words).alias("subject")).withColumn("claim_id", F.md5("subject"))
    return P.topic_claims(topics, claims)


TOPIC_CLAIMS = f"tcl AS (SELECT substr(sha256('orders|' || predicate), 1, 16) AS topic_id, CASE WHEN substr(subject, 10)::BIGINT % 2 = 0 THEN 'Customer#' || lpad(substr(subject, 10), 9, '0') ELSE subject END AS subject, object, source_id FROM oc WHERE status = 'active')"


@query(f"""WITH {OC}, {ENT}, {TOPIC_CLAIMS}, nm AS (SELECT topic_id, subject AS name FROM tcl UNION SELECT topic_id, object FROM tcl), kn AS (SELECT name, min(id) AS id FROM ent GROUP BY 1)
SELECT topic_id AS src, '涵盖' AS predicate, coalesce(id, substr(sha256('Concept:' || name), 1, 16)) AS dst FROM nm LEFT JOIN kn USING (name) UNION SELECT topic_id, '包含段落', 'chunk:' || source_id FROM tcl""")
def j27_topic_edges(spark: SparkSession, d: str) -> DataFrame:
    key = F.substring("subject", 10, 20)
    c = B.order_claims(spark, d).where("status = 'active'").select(T.cluster_id(F.lit("orders"), "predicate").alias("topic_id"), F.when(key.cast("bigint") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(key, 9, "0"))).otherwise(F.col("subject")).alias("subject"), "object", F.col("source_id").alias("chunk_id"))
    return P.topic_edges(c, c.select("topic_id", "chunk_id"), B.entities(spark, d))


TOPICS = "old AS (SELECT DISTINCT subject AS name FROM oc WHERE valid_from < TIMESTAMP '1996-01-01'), new AS (SELECT DISTINCT subject AS name FROM oc WHERE valid_from >= TIMESTAMP '1996-01-01'), rb AS (SELECT coalesce(new.name, old.name) AS name, CASE WHEN new.name IS NULL THEN 'stale' ELSE 'active' END AS status, CASE WHEN old.name IS NULL THEN 'created' WHEN new.name IS NULL THEN 'stale' ELSE 'updated' END AS change FROM old FULL JOIN new ON old.name = new.name)"


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).select(T.cluster_id(F.lit("orders"), "subject").alias("id"), F.col("subject").alias("name"), "valid_from")
    cut = F.col("valid_from") < F.expr("timestamp'1996-01-01'")
    return P.rebuilt(c.where(cut).select("id", "name").distinct(), c.where(~cut).select("id", "name").distinct())


@query(f"WITH {OC}, {TOPICS} SELECT substr(sha256('orders|' || name), 1, 16) AS id, name, status, change FROM rb")
def t2_rebuilt_topics(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d)


@query(f"WITH {OC}, {TOPICS}, ed AS (SELECT subject AS name, count(DISTINCT object) AS n FROM oc WHERE status = 'active' GROUP BY 1) SELECT change, count(*) AS topics, coalesce(sum(n) FILTER (status = 'active'), 0)::BIGINT AS edges FROM rb LEFT JOIN ed USING (name) GROUP BY 1")
def a14_rebuild_report(spark: SparkSession, d: str) -> DataFrame:
    edges = B.order_claims(spark, d).where("status = 'active'").groupBy(F.col("subject").alias("name")).agg(F.countDistinct("object").alias("n"))
    live = F.sum(F.when(F.col("status") == "active", F.col("n")))
    return _rebuilt(spark, d).join(edges, "name", "left").groupBy("change").agg(F.count("*").alias("topics"), F.coalesce(live, F.lit(0)).alias("edges"))


@query("""WITH c AS (SELECT doc_id, unnest(range(0, length(text), 1000)) AS s FROM documents), k AS (SELECT doc_id, s // 1000 AS i, CASE WHEN (s // 1000) % 3 = 1 THEN 'stale' ELSE 'active' END AS status FROM c)
SELECT 'doc-' || doc_id AS source_id, i::INT AS chunk_index, status FROM k WHERE doc_id % 4 = 2 OR (doc_id % 4 = 0 AND status = 'active') OR (doc_id % 4 = 1 AND status = 'stale')""")
def p15_chunk_status(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d).where("length(text) > 0")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("title")))
    c = H.exploded(s, H.size_split(whole, 1000)).select("source_id", "chunk_index", F.when(F.col("chunk_index") % 3 == 1, "stale").otherwise("active").alias("status"))
    wanted = s.select(F.col("id").alias("source_id"), pick(F.col("doc_id") % 4, ["active", "stale", "all"], F.lit("other")).alias("wanted"))
    return P.with_status(c, wanted).select("source_id", "chunk_index", "status")


@query(f"WITH {PAGES}, l AS (SELECT page_id, unnest(links) AS path, generate_subscripts(links, 1) - 1 AS i FROM wp) SELECT page_id AS query_id, path, i::INT AS place, round(1 - 0.01 * i, 6)::DOUBLE AS score FROM l")
def w7_path_hits(spark: SparkSession, d: str) -> DataFrame:
    """Paths in the order in which they were chosen, each scored a hundredth less than the one before."""
    l = B.wiki_pages(spark, d).select(F.col("page_id").alias("query_id"), F.posexplode("links").alias("place", "path"))
    return l.select("query_id", "path", "place", F.round(F.lit(1.0) - F.lit(0.01) * F.col("place"), 6).alias("score"))


@query(f"""WITH {PAGES}, {FUSED}, {OC}, dt1 AS (SELECT 'chunk:doc-' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'doc-' || doc_id || '.md' END AS title, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE string_split(text, chr(10))[1] END AS summary, text FROM documents),
f AS (SELECT key, coalesce(nullif({st("concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))")}, ''), nullif({st("text")}, '')) AS found FROM dt1 UNION ALL SELECT 'wiki:page-' || page_id, nullif({st("title || ' ' || CASE WHEN length(body) > 160 THEN rtrim(substr(body, 1, 160)) || '…' ELSE body END")}, '') FROM wp
UNION ALL SELECT 'claim:' || id, subject || ' ' || predicate || ' ' || object FROM oc WHERE ord % 2 = 0), h AS (SELECT query_id, key FROM fn UNION ALL SELECT ord % 50, 'claim:' || id FROM oc WHERE status = 'active')
SELECT query_id, key, substr(coalesce(found, 'snippet of ' || key), 1, 400) AS passage FROM h LEFT JOIN f USING (key)""")
def j16_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages of all fused hits and of claims; claims that are no longer there fall back to the hit's snippet."""
    docs, c = B.read(spark, d, "documents"), B.order_claims(spark, d)
    chunks = docs.select(F.concat(F.lit("chunk:doc-"), "doc_id").alias("key"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("doc-"), "doc_id", F.lit(".md"))).alias("title"), F.when(F.col("doc_id") % 2 != 0, F.split_part("text", F.lit("\n"), F.lit(1))).alias("summary"), "text")
    pages = B.wiki_pages(spark, d).select(F.concat(F.lit("wiki:page-"), "page_id").alias("key"), "title", T.excerpt("body").alias("snippet"))
    key = F.concat(F.lit("claim:"), "id").alias("key")
    hits = _fused(spark, d).select("query_id", "key").unionByName(c.where("status = 'active'").select((F.col("ord") % 50).alias("query_id"), key))
    return P.passages(hits.withColumn("snippet", F.concat(F.lit("snippet of "), "key")), chunks, pages, c.where("ord % 2 = 0").select(key, "subject", "predicate", "object"))
