"""Registered queries on tables, predicates, claims and memory, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import claims as C
from tessera.operators import retrieve as R
from tessera.operators import tables as K
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()

# SQL of the derived relations, for use in WITH.
KB = "kb AS (SELECT lang AS kb_id, 'doc-' || doc_id AS id, 'doc-' || doc_id || '.md' AS title, source AS type, doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, text FROM documents)"
OC = """oc0 AS (SELECT 'customer-' || o_custkey AS subject, p AS predicate, CASE p WHEN 'order_priority' THEN o_orderpriority ELSE o_orderstatus END AS object, 'Concept' AS object_type,
  o_orderdate AS valid_from, o_orderkey AS ord, 'order-' || o_orderkey AS source_id, 0.5 + (o_orderkey % 50) / 100 AS confidence FROM orders, (VALUES ('order_priority'), ('order_status')) x(p)),
oc1 AS (SELECT *, substr(sha256(subject || '|' || predicate || '|' || object_type), 1, 16) AS family_id FROM oc0),
oc2 AS (SELECT *, row_number() OVER w AS version, lead(valid_from) OVER w AS valid_to, CASE WHEN lead(ord) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM oc1 WINDOW w AS (PARTITION BY family_id ORDER BY valid_from, ord)),
oc AS (SELECT *, substr(sha256(family_id || '|' || version), 1, 16) AS id FROM oc2)"""
EV = """ev0 AS (SELECT doc_id, regexp_extract(text, '(?:Licensed|Released) under [^\\n]+') AS q FROM documents),
ev AS (SELECT 'claim-' || doc_id AS claim_id, 'doc-' || doc_id AS source_id, CASE WHEN doc_id % 7 = 0 THEN 'no such quote' ELSE q END AS quote, 0.5 + (doc_id % 5) / 10 AS weight, doc_id AS ord FROM ev0 WHERE q <> '')"""
ENT = """ent AS (SELECT 'customer-' || c_custkey AS id, 'Customer' AS type, c_name AS name FROM customer UNION ALL SELECT 'supplier-' || s_suppkey, 'Supplier', s_name FROM supplier
UNION ALL SELECT 'nation-' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'region-' || r_regionkey, 'Region', r_name FROM region UNION ALL SELECT 'part-' || p_partkey, 'Part', p_name FROM part)"""
REL = """rel AS (SELECT 'customer-' || c_custkey AS src, 'in_nation' AS predicate, 'nation-' || c_nationkey AS dst FROM customer UNION ALL SELECT 'nation-' || n_nationkey, 'in_region', 'region-' || n_regionkey FROM nation
UNION ALL SELECT 'supplier-' || s_suppkey, 'in_nation', 'nation-' || s_nationkey FROM supplier UNION ALL SELECT DISTINCT 'part-' || l_partkey, 'supplied_by', 'supplier-' || l_suppkey FROM lineitem)"""
EP = """ep0 AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ep AS (SELECT 'conv-' || conv_id AS session_id, turn AS seq, text AS q, a FROM ep0 WHERE role = 'user' AND nr = 'assistant')"""
PAGES = """wp AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS links FROM pages)"""


def stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")



# Sources and table maintenance


@query("SELECT page_id, replace(regexp_replace(p, '\\.[^./]*$', ''), '/', '__') AS source_id, CASE WHEN regexp_extract('/' || p, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract('/' || p, '^(.*)/[^/]*$', 1) END AS directory FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]*([^?#]*)', 1), '^/+', '') AS p FROM pages)")
def s2_source_ids(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    return B.read(spark, d, "pages").select("page_id", T.source_id(path).alias("source_id"), T.directory(path).alias("directory"))


@query("SELECT doc_id, md5(t) AS text_md5, length(t)::INT AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS t FROM documents) WHERE t <> ''")
def s3_normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    t = B.read(spark, d, "documents").select("doc_id", T.normalise_text("text").alias("t")).where("t <> ''")
    return t.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("n"))


@query(f"WITH {KB} SELECT kb_id, id, CASE WHEN doc_id % 3 = 0 THEN 'Revised ' || title ELSE title END AS title, type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM kb UNION ALL SELECT kb_id, id || '-b', title, type, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM kb WHERE doc_id % 3 = 0")
def s4_upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    s = B.kb_sources(spark, d).drop("text").withColumn("seq", F.lit(0))
    third = s.where("doc_id % 3 = 0").withColumn("seq", F.lit(1))
    delta = third.withColumn("title", F.concat(F.lit("Revised "), "title")).unionByName(third.withColumn("id", F.concat("id", F.lit("-b"))))
    return K.upsert(s, delta, ["kb_id", "id"], "seq").select("kb_id", "id", "title", "type", stamp("created_at").alias("created_at"))


@query(f"WITH {OC} SELECT id, subject, object FROM oc WHERE ord % 2 = 0 UNION ALL SELECT id, subject, 'late' AS object FROM oc WHERE ord % 2 = 1 AND ord % 3 = 0")
def s5_insert_absent_claims(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    base, delta = c.where("ord % 2 = 0"), c.where("ord % 3 = 0").withColumn("object", F.lit("late"))
    return K.insert_absent(base.select("id", "subject", "object"), delta.select("id", "subject", "object"), ["id"])


@query(f"""WITH {OC}, s AS (SELECT family_id || ':' || object AS id, list_sort(list(source_id)) AS sources FROM oc GROUP BY family_id, object),
l AS (SELECT id, list_filter(sources, lambda x: substr(x, 7)::BIGINT % 10 <> 0) AS sources FROM s) SELECT id, array_to_string(sources, ',') AS source_ids FROM l WHERE len(sources) > 0""")
def s8_delete_sources(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    claims = c.groupBy("family_id", "object").agg(F.sort_array(F.collect_list("source_id")).alias("source_ids")).select(F.concat_ws(":", "family_id", "object").alias("id"), "source_ids")
    gone = B.read(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.concat(F.lit("order-"), "o_orderkey").alias("source_id"))
    return K.delete_sources(claims, gone).select("id", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"WITH {OC} SELECT id, CASE WHEN ord % 5 = 0 THEN 'superseded' ELSE status END AS status, strftime(CASE WHEN ord % 10 = 0 THEN TIMESTAMP '2020-06-30' WHEN ord % 5 = 0 THEN TIMESTAMP '2024-01-01' ELSE valid_to END, '%Y-%m-%d %H:%M:%S') AS valid_to FROM oc")
def s9_supersede(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    changes = c.where("ord % 5 = 0").select("id", F.lit("superseded").alias("status"), F.expr("if(ord % 10 = 0, timestamp'2020-06-30', null)").alias("valid_to"))
    return K.transition(c, changes, F.expr("timestamp'2024-01-01'"))[0].select("id", "status", stamp("valid_to").alias("valid_to"))


@query(f"WITH {KB} SELECT kb_id, id, row_number() OVER (PARTITION BY kb_id ORDER BY created_at, id) AS place FROM kb")
def s10_listed_sources(spark: SparkSession, d: str) -> DataFrame:
    return B.kb_sources(spark, d).select("kb_id", "id", F.row_number().over(Window.partitionBy("kb_id").orderBy("created_at", "id")).cast("bigint").alias("place"))


@query("SELECT lang AS kb_id, count(*) AS sources, count(DISTINCT source) AS types, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def s12_by_knowledge_base(spark: SparkSession, d: str) -> DataFrame:
    return B.kb_sources(spark, d).groupBy("kb_id").agg(F.count("*").alias("sources"), F.countDistinct("type").alias("types"), F.sum(F.length("text")).alias("chars"))


# Predicates


@query(f"WITH {OC} SELECT id, subject, predicate, object FROM oc WHERE status = 'active' AND predicate = 'order_status'")
def p1_active_claims(spark: SparkSession, d: str) -> DataFrame:
    return B.order_claims(spark, d).where("status = 'active' AND predicate = 'order_status'").select("id", "subject", "predicate", "object")


@query(f"WITH {OC} SELECT source_id, id FROM oc WHERE ord % 100 = 0")
def p2_claims_of_sources(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).select("id", F.explode(F.array("source_id")).alias("source_id"))
    wanted = B.read(spark, d, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("order-"), "o_orderkey").alias("source_id"))
    return c.join(wanted, "source_id", "left_semi").select("source_id", "id")


@query(f"WITH {OC} SELECT id, CASE status WHEN 'active' THEN 0 ELSE 3 END::INT AS place FROM oc WHERE contains(lower(subject), '-12') AND contains(lower(object), 'urgent')")
def p3_claim_browser(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).where(T.contains_folded("subject", F.lit("-12")) & T.contains_folded("object", F.lit("URGENT")))
    return c.select("id", F.when(F.col("status") == "active", 0).when(F.col("status") == "staging", 1).when(F.col("status") == "quarantined", 2).otherwise(3).alias("place"))


@query(f"WITH {OC} SELECT id FROM oc WHERE valid_from <= TIMESTAMP '1997-06-30' AND (valid_to IS NULL OR TIMESTAMP '1997-06-30' < valid_to)")
def p4_valid_at(spark: SparkSession, d: str) -> DataFrame:
    return B.order_claims(spark, d).where(T.valid_at(F.expr("timestamp'1997-06-30'"))).select("id")


@query(f"WITH {OC} SELECT id FROM oc WHERE valid_from <= TIMESTAMP '1997-06-30' AND valid_to IS NULL AND status = 'active'")
def p5_valid_at_strict(spark: SparkSession, d: str) -> DataFrame:
    return B.order_claims(spark, d).where(T.valid_at(F.expr("timestamp'1997-06-30'"), strict_active=True)).select("id")


@query(f"WITH {KB} SELECT kb_id, id FROM kb WHERE contains(lower(concat_ws(' ', id, title, type)), 'src1')")
def p6_source_search(spark: SparkSession, d: str) -> DataFrame:
    return B.kb_sources(spark, d).where(F.contains(F.lower(F.concat_ws(" ", "id", "title", "type")), F.lit("src1"))).select("kb_id", "id")


@query(f"WITH {ENT}, {REL} SELECT id, name FROM (SELECT id, name, row_number() OVER (ORDER BY name, id) AS n FROM ent WHERE contains(lower(name), '#0000000') AND id IN (SELECT src FROM rel WHERE contains(predicate, 'nation') UNION SELECT dst FROM rel WHERE contains(predicate, 'nation'))) WHERE n <= 50")
def p7_entity_search(spark: SparkSession, d: str) -> DataFrame:
    r = B.relations(spark, d).where(F.contains("predicate", F.lit("nation")))
    ends = r.select(F.col("src").alias("id")).unionByName(r.select(F.col("dst").alias("id"))).distinct()
    return B.entities(spark, d).where(F.contains(F.lower("name"), F.lit("#0000000"))).join(ends, "id", "left_semi").select("id", "name").orderBy("name", "id").limit(50)


@query(f"WITH {REL} SELECT DISTINCT predicate FROM rel WHERE contains(predicate, 'in_')")
def p8_predicates(spark: SparkSession, d: str) -> DataFrame:
    return B.relations(spark, d).where(F.contains("predicate", F.lit("in_"))).select("predicate").distinct()


@query(f"""WITH {OC} SELECT id, predicate, CASE WHEN predicate = 'order_status' OR object IN ('1-URGENT', '2-HIGH') THEN 'accepted' ELSE 'invalid_predicate' END AS verdict FROM oc""")
def p10_ontology_check(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("order_status", None), ("order_priority", "1-URGENT"), ("order_priority", "2-HIGH")], "predicate string, allowed string")
    c = B.order_claims(spark, d).select("id", "predicate", "object")
    ok = c.join(F.broadcast(allowed), (c.predicate == allowed.predicate) & (allowed.allowed.isNull() | (c.object == allowed.allowed)), "left_semi").select("id", F.lit("accepted").alias("v"))
    return c.join(ok, "id", "left").select("id", "predicate", F.coalesce("v", F.lit("invalid_predicate")).alias("verdict"))


@query(f"WITH {OC} SELECT family_id, count(*) AS n, array_to_string(list(version::INT ORDER BY version), ',') AS versions FROM oc WHERE status <> 'staging' GROUP BY 1")
def p16_history(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).where("status <> 'staging'")
    return c.groupBy("family_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("version")), ",").alias("versions"))


@query(f"WITH {ENT}, {REL} SELECT a.type AS subject_type, b.type AS object_type, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM rel JOIN ent a ON src = a.id JOIN ent b ON dst = b.id GROUP BY 1, 2")
def p17_allowed_predicates(spark: SparkSession, d: str) -> DataFrame:
    e, r = B.entities(spark, d).select("id", "type"), B.relations(spark, d)
    j = r.join(e.select(F.col("id").alias("src"), F.col("type").alias("subject_type")), "src").join(e.select(F.col("id").alias("dst"), F.col("type").alias("object_type")), "dst")
    return j.groupBy("subject_type", "object_type").agg(F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))


# Joins over claims, evidence and memory


@query(f"WITH {EV} SELECT claim_id, bool_and(contains(text, quote)) AS verified FROM ev JOIN documents d ON 'doc-' || d.doc_id = source_id GROUP BY 1")
def j1_verified_claims(spark: SparkSession, d: str) -> DataFrame:
    e = B.evidence(spark, d)
    return C.verify(e, B.kb_sources(spark, d), e.select(F.col("claim_id").alias("id")).distinct())


@query(f"WITH {OC}, q AS (SELECT item_id AS query_id, 'orders of customer-' || (item_id % 50) || ' with order_status?' AS query FROM benchmark), p AS (SELECT DISTINCT subject AS part FROM oc UNION SELECT DISTINCT predicate FROM oc) SELECT query_id, part FROM q, p WHERE contains(lower(query), lower(part))")
def j3_claim_lane(spark: SparkSession, d: str) -> DataFrame:
    q = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("orders of customer-"), F.col("item_id") % 50, F.lit(" with order_status?")).alias("query"))
    c = B.order_claims(spark, d)
    parts = c.select(F.lower("subject").alias("part")).unionByName(c.select(F.lower("predicate").alias("part"))).distinct()
    r = parts.agg(F.min(F.length("part")), F.max(F.length("part"))).first()
    return R.substring_hits(q, parts, (r[0], r[1]))


@query(f"WITH {OC} SELECT source_id, arg_min(id, ord::VARCHAR || id) AS claim_id FROM oc WHERE status = 'active' GROUP BY 1")
def j4_first_claim(spark: SparkSession, d: str) -> DataFrame:
    return C.first_per_source(B.order_claims(spark, d))


@query(f"""WITH {OC}, o AS (SELECT family_id, arg_max(id, version) AS old_id, arg_max(object, version) AS oo FROM oc WHERE valid_from < TIMESTAMP '1998-01-01' GROUP BY 1),
n AS (SELECT family_id, arg_max(id, version) AS new_id, arg_max(object, version) AS no FROM oc WHERE valid_from >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT family_id, CASE WHEN old_id IS NULL THEN 'added' WHEN oo <> no THEN 'superseded' ELSE 'same' END AS kind, old_id, new_id FROM n LEFT JOIN o USING (family_id)""")
def j6_version_diff(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    return C.diff(c.where("valid_from < timestamp'1998-01-01'"), c.where("valid_from >= timestamp'1998-01-01'"))


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = B.evidence(spark, d).select("source_id", F.lit("license").alias("subject"), F.lit("granted").alias("predicate"), F.col("quote").alias("object"), F.lit(0.9).alias("confidence"), "quote", "ord")
    return e, e.where("ord % 2 = 0").withColumn("confidence", F.lit(0.95)).withColumn("quote", F.lit("model"))


@query(f"WITH {EV} SELECT source_id, 'license' AS subject, 'granted' AS predicate, quote AS object, 0.95::DOUBLE AS confidence, quote FROM ev WHERE ord % 2 = 0")
def j7_intersected(spark: SparkSession, d: str) -> DataFrame:
    return C.intersect_extracted(*_extracted(spark, d))


@query(f"WITH {EV} SELECT source_id, 'license' AS subject, 'granted' AS predicate, quote AS object, CASE WHEN ord % 2 = 0 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence, quote FROM ev")
def j8_united(spark: SparkSession, d: str) -> DataFrame:
    return C.union_extracted(*_extracted(spark, d))


@query(f"WITH {OC}, p AS (SELECT DISTINCT family_id, t AS t0 FROM oc, (VALUES (TIMESTAMP '1996-06-30'), (TIMESTAMP '1999-06-30')) x(t)) SELECT family_id, strftime(t0, '%Y-%m-%d %H:%M:%S') AS probe, arg_max(id, version) AS id, arg_max(object, version) AS object, max(version)::INT AS version FROM oc JOIN p USING (family_id) WHERE valid_from <= t0 AND (valid_to IS NULL OR t0 < valid_to) GROUP BY 1, 2")
def j9_as_of(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    probes = c.select("family_id").distinct().withColumn("at", F.explode(F.array(F.expr("timestamp'1996-06-30'"), F.expr("timestamp'1999-06-30'"))))
    return C.as_of(c, probes).withColumn("probe", stamp("at")).drop("at")


@query(f"WITH {KB}, {EV} SELECT kb_id, id FROM kb WHERE id NOT IN (SELECT source_id FROM ev)")
def j10_orphan_sources(spark: SparkSession, d: str) -> DataFrame:
    return B.kb_sources(spark, d).select("kb_id", "id").join(B.evidence(spark, d).select(F.col("source_id").alias("id")), "id", "left_anti").select("kb_id", "id")


@query(f"WITH {ENT}, {REL} SELECT src, a.name AS src_name, predicate, dst, coalesce(b.name, dst) AS dst_name FROM rel JOIN ent a ON src = a.id LEFT JOIN ent b ON dst = b.id WHERE predicate IN ('in_nation', 'in_region')")
def j12_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = B.entities(spark, d)
    r = B.relations(spark, d).where(F.col("predicate").isin("in_nation", "in_region"))
    names = lambda k: e.select(F.col("id").alias(k), F.col("name").alias(k + "_name"))
    return r.join(names("src"), "src").join(names("dst"), "dst", "left").select("src", "src_name", "predicate", "dst", F.coalesce("dst_name", "dst").alias("dst_name"))


@query(f"WITH {ENT}, q AS (SELECT item_id AS query_id, 'Where is Customer#' || lpad((item_id % 20)::VARCHAR, 9, '0') || ' of NATION_' || (item_id % 9) || '?' AS query FROM benchmark), m AS (SELECT query_id, lower(name) AS part, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, lower(name)) AS rank FROM q JOIN (SELECT DISTINCT name FROM ent WHERE length(name) >= 3) ON contains(lower(query), lower(name))) SELECT query_id, rank::INT AS rank, part FROM m WHERE rank <= 7")
def j13_entity_seeds(spark: SparkSession, d: str) -> DataFrame:
    q = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Where is Customer#"), F.lpad((F.col("item_id") % 20).cast("string"), 9, "0"), F.lit(" of NATION_"), F.col("item_id") % 9, F.lit("?")).alias("query"))
    names = B.entities(spark, d).where("length(name) >= 3").select(F.lower("name").alias("part")).distinct()
    r = names.agg(F.min(F.length("part")), F.max(F.length("part"))).first()
    return R.ranked(R.substring_hits(q, names, (r[0], r[1])), F.desc(F.length("part")), "part", k=7).select("query_id", "rank", "part")


@query(f"WITH {PAGES}, l AS (SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM wp) SELECT page_id, link, min(pos)::INT AS pos FROM l WHERE link IN (SELECT unnest(links) FROM wp WHERE page_id % 2 = 0) GROUP BY 1, 2")
def j15_page_links(spark: SparkSession, d: str) -> DataFrame:
    w = B.wiki_pages(spark, d)
    links = w.select("page_id", F.posexplode("links").alias("pos", "link"))
    known = w.where("page_id % 2 = 0").select(F.explode("links").alias("link")).distinct()
    return links.join(known, "link", "left_semi").groupBy("page_id", "link").agg((F.min("pos") + 1).alias("pos"))


@query(f"WITH {EP}, t AS (SELECT DISTINCT session_id, seq, unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM ep), s AS (SELECT session_id, arg_max(q, seq) AS query, max(seq) AS s0 FROM ep GROUP BY 1), w AS (SELECT session_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'))) AS token, s0 FROM s) SELECT session_id, seq, count(*) AS shared FROM t JOIN w USING (session_id, token) WHERE seq < s0 GROUP BY 1, 2")
def w3_recall(spark: SparkSession, d: str) -> DataFrame:
    e = B.episodes(spark, d)
    asked = e.groupBy("session_id").agg(F.max_by("q", "seq").alias("query"), F.max("seq").alias("at"))
    own = e.select("session_id", "seq", F.explode(F.array_distinct(T.tokens("q"))).alias("token"))
    return own.join(asked.select("session_id", "at", F.explode(F.array_distinct(T.tokens("query"))).alias("token")), ["session_id", "token"]).where("seq < at").groupBy("session_id", "seq").agg(F.count("*").alias("shared"))


# Aggregates and windows


@query(f"WITH {OC}, f AS (SELECT subject, predicate, object, min(ord) AS o FROM oc GROUP BY 1, 2, 3), a AS (SELECT subject, predicate, list(object ORDER BY o, object) AS objects FROM f GROUP BY 1, 2) SELECT subject, predicate, CASE WHEN len(list_filter(objects, lambda x: length(x) > 8)) > 0 THEN array_to_string(objects, '；') ELSE array_to_string(objects, '、') END AS object, len(objects)::INT AS n FROM a")
def a1_merged_objects(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    e = c.select(F.lit("all").alias("source_id"), "ord", "subject", "predicate", "object", "confidence", F.col("object").alias("quote"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    merged = C.merge_complementary(e)
    return merged.select("subject", "predicate", "object", F.size(F.split("object", "、|；")).alias("n"))


@query(f"WITH {OC}, m AS (SELECT *, version >= max(version) OVER (PARTITION BY family_id) - 1 AS act FROM oc) SELECT family_id, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS claim_ids FROM m WHERE act GROUP BY 1 HAVING count(*) > 1")
def a3_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    two = c.withColumn("status", F.when(F.col("version") >= F.max("version").over(Window.partitionBy("family_id")) - 1, "active").otherwise("superseded"))
    return C.conflicts(two)


@query(f"WITH {EV} SELECT source_id, round(avg(weight), 6) AS confidence, string_agg(claim_id, '; ' ORDER BY ord) AS conclusion FROM ev GROUP BY 1")
def a6_evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    g = B.evidence(spark, d).groupBy("source_id").agg(F.round(F.avg("weight"), 6).alias("confidence"), F.array_sort(F.collect_list(F.struct("ord", "claim_id"))).alias("c"))
    return g.select("source_id", "confidence", F.array_join(F.col("c.claim_id"), "; ").alias("conclusion"))


@query(f"""WITH {OC}, b AS (SELECT subject, count(*) AS n FROM oc WHERE valid_from < TIMESTAMP '1998-01-01' GROUP BY 1), a AS (SELECT subject, count(*) AS n FROM oc GROUP BY 1)
SELECT subject, a.n - coalesce(b.n, 0) AS added FROM a LEFT JOIN b USING (subject) WHERE a.n > coalesce(b.n, 0)""")
def a9_ingest_delta(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    return c.groupBy("subject").agg((F.count("*") - F.count_if(F.col("valid_from") < F.expr("timestamp'1998-01-01'"))).alias("added")).where("added > 0")


@query(f"WITH {OC} SELECT substr(subject, 10)::BIGINT % 100 AS bucket, count(*) AS claims, count(DISTINCT subject) AS subjects, count(DISTINCT source_id) AS sources FROM oc GROUP BY 1")
def a10_claim_counts(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d).withColumn("bucket", F.substring("subject", 10, 20).cast("bigint") % 100)
    return c.groupBy("bucket").agg(F.count("*").alias("claims"), F.countDistinct("subject").alias("subjects"), F.countDistinct("source_id").alias("sources"))


@query(f"WITH {OC} SELECT family_id, max(version)::INT + 1 AS next_version FROM oc GROUP BY 1")
def a11_next_version(spark: SparkSession, d: str) -> DataFrame:
    return B.order_claims(spark, d).groupBy("family_id").agg((F.max("version") + 1).alias("next_version"))


@query(f"WITH {OC} SELECT id, family_id, version::INT AS version, status, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to FROM oc")
def w1_version_chain(spark: SparkSession, d: str) -> DataFrame:
    return B.order_claims(spark, d).select("id", "family_id", "version", "status", stamp("valid_from").alias("valid_from"), stamp("valid_to").alias("valid_to"))


@query(f"WITH {EP} SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM ep) WHERE n <= 10")
def w2_memory_trim(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return B.episodes(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 10").select("session_id", "seq")


@query(f"WITH {OC}, f AS (SELECT family_id, object, min(ord) AS ord FROM oc GROUP BY 1, 2), v AS (SELECT family_id, object, row_number() OVER (PARTITION BY family_id ORDER BY ord, object) AS version FROM f) SELECT family_id, object, version::INT AS version, CASE WHEN version = 1 THEN 'active' ELSE 'staging' END AS status FROM v")
def c1_compiled_claims(spark: SparkSession, d: str) -> DataFrame:
    return C.compile_versions(B.order_claims(spark, d)).select("family_id", "object", "version", "status")


@query(f"""WITH {OC}, {KB}, {EV}, f AS (SELECT family_id FROM (SELECT family_id, version >= max(version) OVER (PARTITION BY family_id) - 1 AS act FROM oc) WHERE act GROUP BY 1 HAVING count(*) > 1),
u AS (SELECT 'error' AS severity, 'conflict' AS code, count(*) AS n FROM f UNION ALL SELECT 'warning', 'missing_evidence', count(*) FROM ev WHERE ord % 7 = 0 UNION ALL SELECT 'warning', 'orphan_source', count(*) FROM kb WHERE id NOT IN (SELECT source_id FROM ev)
UNION ALL SELECT 'warning', 'quarantine_backlog', count(*) FROM ev WHERE weight < 0.6) SELECT * FROM u WHERE n > 0""")
def l1_lint(spark: SparkSession, d: str) -> DataFrame:
    """Faults by kind where the last two versions of each family are still active and weak claims wait in quarantine."""
    e, s, c = B.evidence(spark, d), B.kb_sources(spark, d), B.order_claims(spark, d)
    two = c.withColumn("status", F.when(F.col("version") >= F.max("version").over(Window.partitionBy("family_id")) - 1, "active").otherwise("superseded"))
    return C.lint(two, e, s, e.where("weight < 0.6").select("claim_id"))


@query()
def c1_folded_claims(spark: SparkSession, d: str) -> DataFrame:
    """All order facts compiled: statuses exclude one another, priorities are joined, one kind of object is unknown to the ontology. A test holds it against a plain loop."""
    return C.compile_claims(*_facts(spark, d), exclusive=["order_status"])[0].select("family_id", "version", "object", "status", F.round("confidence", 6).alias("confidence"), F.size("source_ids").alias("sources"), "quote")


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = B.order_claims(spark, d).withColumn("object_type", F.when(F.col("object") == "4-NOT SPECIFIED", "Unknown").otherwise("Concept"))
    kinds = spark.createDataFrame([("Customer", p, "Concept") for p in ("order_status", "order_priority")], "subject_type string, predicate string, object_type string")
    return c.select("family_id", "ord", "subject", "predicate", "object", F.lit("Customer").alias("subject_type"), "object_type", "confidence", "source_id", F.concat_ws(" ", "predicate", "object").alias("quote")), kinds


@query(f"WITH {OC} SELECT family_id, ord, object, 'invalid_predicate' AS reason FROM oc WHERE object = '4-NOT SPECIFIED'")
def c1_quarantined_claims(spark: SparkSession, d: str) -> DataFrame:
    return C.compile_claims(*_facts(spark, d), exclusive=["order_status"])[1].select("family_id", "ord", "object", "reason")


@query(f"""WITH {EV}, c AS (SELECT ord % 40 AS query_id, claim_id, contains(d.text, quote) AS ok, weight, ord // 3 AS family_id, ord % 5 <> 0 AS act FROM ev JOIN documents d ON 'doc-' || d.doc_id = source_id),
f AS (SELECT family_id, count(*) AS n FROM c WHERE act GROUP BY 1 HAVING count(*) > 1), r AS (SELECT query_id, sum(n) AS rivals FROM (SELECT DISTINCT query_id, family_id FROM c) JOIN f USING (family_id) GROUP BY 1),
g AS (SELECT query_id, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad, avg(weight) AS w FROM c GROUP BY 1)
SELECT query_id, CASE WHEN rivals > 0 THEN 'conflict' WHEN bad = 0 THEN 'verified' WHEN good = 0 THEN 'unverified' ELSE 'partial' END AS status, coalesce(rivals, 0)::BIGINT AS competing, round(w * CASE WHEN bad > 0 THEN 0.5 ELSE 1 END, 6) AS confidence FROM g LEFT JOIN r USING (query_id)""")
def v1_verification(spark: SparkSession, d: str) -> DataFrame:
    e = B.evidence(spark, d)
    ok = C.verify(e, B.kb_sources(spark, d), e.select(F.col("claim_id").alias("id")).distinct())
    claims = e.select(F.col("claim_id").alias("id"), F.expr("ord div 3").alias("family_id"), F.when(F.col("ord") % 5 == 0, "superseded").otherwise("active").alias("status"))
    v = C.verification(e.select((F.col("ord") % 40).alias("query_id"), "claim_id"), ok, claims, e)
    return v.withColumn("confidence", F.round("confidence", 6))
