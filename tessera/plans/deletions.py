"""Registered queries on the deletion of sources: one for each table, as it is afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import deletion as D
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()

# A knowledge base over the documents: claims of single documents, claims that up to 50 share, claims that say the same for many; topics by source; pages of one and of up to 50.
WORLD = """d AS (SELECT doc_id, 'doc-' || doc_id AS id, coalesce(source, 'none') AS src, coalesce(lang, 'none') AS lang, coalesce(length(text), 0) // 1000 AS parts, coalesce(source, 'none') || '-' || doc_id // 50 AS grp FROM documents WHERE doc_id IS NOT NULL),
gone AS (SELECT id FROM d WHERE doc_id % 7 = 0 OR src = 'src3'),
ch AS (SELECT id AS source_id, id || ':' || i AS id, src FROM (SELECT *, unnest(range(0, parts + 1)) AS i FROM d)),
cl AS (SELECT grp || '|' || lang AS id, grp AS subject, 'written_in' AS predicate, lang AS object, 'active' AS status, list(id ORDER BY doc_id) AS source_ids FROM d GROUP BY grp, lang
  UNION ALL SELECT 'kept|' || doc_id, id, 'kept_by', src, CASE WHEN doc_id % 6 = 0 THEN 'superseded' ELSE 'active' END, [id] FROM d
  UNION ALL SELECT 'seen|' || doc_id, lang, 'seen_in', src, 'active', [id] FROM d),
ed AS (SELECT *, substr(sha256('Concept:' || subject), 1, 16) AS src, substr(sha256('Concept:' || object), 1, 16) AS dst FROM cl),
en AS (SELECT src AS id, 'Concept' AS type, subject AS name FROM ed UNION SELECT dst, 'Concept', object FROM ed UNION SELECT 'topic:' || src, 'Topic', src FROM d UNION SELECT 'chunk:' || id, 'Chunk', NULL FROM ch),
re AS (SELECT src, predicate, dst FROM ed UNION SELECT 'topic:' || src, '涵盖', substr(sha256('Concept:' || grp), 1, 16) FROM d UNION SELECT 'topic:' || src, '包含段落', 'chunk:' || id FROM ch),
pg AS (SELECT 'page-' || grp AS page_id, list(id ORDER BY doc_id) AS source_ids FROM d GROUP BY grp UNION ALL SELECT 'own-' || doc_id, [id] FROM d)"""
LEFT = f"""{WORLD},
un AS (SELECT id, unnest(source_ids) AS s FROM ed), lk AS (SELECT un.id, list(s ORDER BY substr(s, 5)::BIGINT) AS kept FROM un ANTI JOIN gone ON s = gone.id GROUP BY 1), lf AS (SELECT ed.*, kept FROM ed LEFT JOIN lk USING (id)),
lch AS (SELECT ch.* FROM ch ANTI JOIN gone ON source_id = gone.id),
dd AS (SELECT * FROM lf r WHERE kept IS NULL AND NOT EXISTS (SELECT 1 FROM lf a WHERE a.kept IS NOT NULL AND a.status = 'active' AND a.subject = r.subject AND a.predicate = r.predicate AND a.object = r.object)),
r1 AS (SELECT re.* FROM re ANTI JOIN dd USING (src, predicate, dst)),
tc AS (SELECT src AS id FROM dd UNION SELECT dst FROM dd), ends AS (SELECT src AS id FROM r1 UNION SELECT dst FROM r1),
e1 AS (SELECT en.* FROM en WHERE id NOT IN (SELECT id FROM tc) OR id IN (SELECT id FROM ends)),
tp AS (SELECT src AS id, CASE WHEN src IN (SELECT src FROM lch) THEN 'active' ELSE 'stale' END AS status FROM (SELECT DISTINCT src FROM d)),
r2 AS (SELECT r1.* FROM r1 WHERE (predicate NOT IN ('涵盖', '包含段落') OR src NOT IN (SELECT 'topic:' || id FROM tp WHERE status = 'stale')) AND (NOT starts_with(dst, 'chunk:') OR dst IN (SELECT 'chunk:' || id FROM lch))),
e2 AS (SELECT e1.id, type, CASE WHEN type <> 'Topic' THEN NULL ELSE tp.status END AS status FROM e1 LEFT JOIN tp ON e1.id = 'topic:' || tp.id WHERE type <> 'Chunk' OR e1.id IN (SELECT 'chunk:' || id FROM lch)),
pu AS (SELECT page_id, unnest(source_ids) AS s FROM pg), pl AS (SELECT page_id, list(s ORDER BY substr(s, 5)::BIGINT) AS kept, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM pu) u ANTI JOIN gone ON s = gone.id GROUP BY 1)"""


def world(spark: SparkSession, d: str) -> tuple[D.Knowledge, DataFrame]:
    """The tables and the sources to delete: every seventh document and those of one source."""
    docs = B.read(spark, d, "documents").where("doc_id IS NOT NULL")
    src, lang = (F.coalesce(c, F.lit("none")) for c in ("source", "lang"))
    docs = docs.select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("id"), src.alias("src"), lang.alias("lang"), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 1000).alias("parts"), F.concat_ws("-", src, F.floor(F.col("doc_id") / 50).cast("string")).alias("grp"))
    chunks = docs.select(F.col("id").alias("source_id"), "src", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), "parts"), lambda i: F.concat_ws(":", "id", i.cast("string")))).alias("id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "id"))), lambda x: x["id"])  # of up to 50
    shape = ["id", "subject", "predicate", "object", "status", "source_ids"]
    shared = docs.groupBy("grp", "lang").agg(listed.alias("source_ids")).select(F.concat_ws("|", "grp", "lang").alias("id"), F.col("grp").alias("subject"), F.lit("written_in").alias("predicate"), F.col("lang").alias("object"), F.lit("active").alias("status"), "source_ids")
    kept = docs.select(F.concat(F.lit("kept|"), "doc_id").alias("id"), F.col("id").alias("subject"), F.lit("kept_by").alias("predicate"), F.col("src").alias("object"), F.when(F.col("doc_id") % 6 == 0, "superseded").otherwise("active").alias("status"), F.array("id").alias("source_ids"))
    seen = docs.select(F.concat(F.lit("seen|"), "doc_id").alias("id"), F.col("lang").alias("subject"), F.lit("seen_in").alias("predicate"), F.col("src").alias("object"), F.lit("active").alias("status"), F.array("id").alias("source_ids"))
    claims = shared.select(shape).unionByName(kept.select(shape)).unionByName(seen.select(shape)).withColumn("subject_type", F.lit("Concept")).withColumn("object_type", F.lit("Concept"))
    edges = D.edges_of(claims)
    none = F.lit(None).cast("string")
    concepts = edges.select(F.col("src").alias("id"), F.lit("Concept").alias("type"), none.alias("status")).unionByName(edges.select(F.col("dst").alias("id"), F.lit("Concept").alias("type"), none.alias("status")))
    topics = docs.select(F.col("src").alias("id"), F.col("src").alias("name"), F.lit("active").alias("status")).distinct()
    nodes = topics.select(F.concat(F.lit("topic:"), "id").alias("id"), F.lit("Topic").alias("type"), "status").unionByName(chunks.select(F.concat(F.lit("chunk:"), "id").alias("id"), F.lit("Chunk").alias("type"), none.alias("status")))
    topic = F.concat(F.lit("topic:"), "src")
    structural = docs.select(topic.alias("src"), F.lit(D.COVERS).alias("predicate"), T.entity_id(F.lit("Concept"), "grp").alias("dst")).unionByName(chunks.select(topic.alias("src"), F.lit(D.HOLDS).alias("predicate"), F.concat(F.lit("chunk:"), "id").alias("dst")))
    vectors = chunks.select(F.lit("chunk").alias("ref_type"), F.col("id").alias("ref_id")).unionByName(claims.select(F.lit("claim").alias("ref_type"), F.col("id").alias("ref_id")))
    pages = docs.groupBy("grp").agg(listed.alias("source_ids")).select(F.concat(F.lit("page-"), "grp").alias("page_id"), "source_ids").unionByName(docs.select(F.concat(F.lit("own-"), "doc_id").alias("page_id"), F.array("id").alias("source_ids")))
    k = D.Knowledge(
        sources=docs.select("id", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("doc-"), F.col("doc_id") - 1)).alias("replaces_source_id")),
        texts=docs.select(F.col("id").alias("source_id")),
        chunks=chunks.select("id", "source_id"),
        vectors=vectors,
        claims=claims,
        evidence=claims.select(F.col("id").alias("claim_id"), F.explode("source_ids").alias("source_id")),
        events=B.read(spark, d, "events").select("event_id", F.concat(F.lit("doc-"), "user_id").alias("source_id")),
        quarantine=docs.where("doc_id % 5 <> 2").select(F.col("doc_id").alias("id"), F.to_json(F.struct(F.col("id").alias("source_id"))).alias("raw")),
        entities=concepts.unionByName(nodes).distinct(),
        relations=edges.select("src", "predicate", "dst").unionByName(structural).distinct(),
        topics=topics,
        members=chunks.select(F.col("src").alias("topic_id"), F.lit("chunk").alias("ref_type"), F.col("id").alias("ref_id")),
        pages=pages,
    )
    return k, docs.where("doc_id % 7 = 0 OR src = 'src3'").select(F.col("id").alias("source_id"))


def after(spark: SparkSession, d: str) -> tuple[D.Knowledge, DataFrame]:
    return D.delete_sources(*world(spark, d))


@query(f"WITH {LEFT} SELECT id, CASE WHEN doc_id % 4 = 1 AND 'doc-' || (doc_id - 1) NOT IN (SELECT id FROM gone) THEN 'doc-' || (doc_id - 1) END AS replaces_source_id FROM d WHERE id NOT IN (SELECT id FROM gone)")
def s8_left_sources(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].sources


@query(f"WITH {LEFT} SELECT id, source_id FROM lch")
def s8_left_chunks(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].chunks


@query(f"WITH {LEFT} SELECT 'chunk' AS ref_type, id AS ref_id FROM lch UNION ALL SELECT 'claim', id FROM lf WHERE kept IS NOT NULL")
def s8_left_vectors(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].vectors


@query(f"WITH {LEFT} SELECT id, status, array_to_string(kept, ',') AS source_ids FROM lf WHERE kept IS NOT NULL")
def s8_left_claims(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].claims.select("id", "status", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"WITH {LEFT} SELECT id AS claim_id, s AS source_id FROM un WHERE s NOT IN (SELECT id FROM gone)")
def s8_left_evidence(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].evidence


@query(f"WITH {LEFT} SELECT event_id FROM events WHERE 'doc-' || user_id NOT IN (SELECT id FROM gone)")
def s8_left_events(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].events.select("event_id")


@query(f"WITH {LEFT} SELECT doc_id AS id FROM d WHERE doc_id % 5 <> 2 AND id NOT IN (SELECT id FROM gone)")
def s8_left_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].quarantine.select("id")


@query(f"WITH {LEFT} SELECT id, type, status FROM e2")
def j19_left_entities(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].entities


@query(f"WITH {LEFT} SELECT src, predicate, dst FROM r2")
def j19_left_relations(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].relations


@query(f"WITH {LEFT} SELECT id, status FROM tp")
def t2_topics_after_deletion(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].topics.select("id", "status")


@query(f"WITH {LEFT} SELECT page_id, array_to_string(kept, ',') AS source_ids FROM pl")
def d1_left_pages(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[0].pages.select("page_id", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"WITH {LEFT} SELECT DISTINCT unnest(kept) AS source_id FROM pl WHERE len(kept) < n")
def d1_sources_to_compile(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d)[1]


@query(f"WITH {LEFT} SELECT src, predicate, dst FROM re WHERE (src, predicate, dst) IN (SELECT (src, predicate, dst) FROM ed WHERE status = 'active') OR (predicate IN ('涵盖', '包含段落') AND src <> 'topic:src3')")
def p14_edges_of_claims_and_topics(spark: SparkSession, d: str) -> DataFrame:
    """Active edges where one topic is stale."""
    k, _ = world(spark, d)
    nodes = k.entities.withColumn("status", F.when(F.col("id") == "topic:src3", "stale").otherwise(F.col("status")))
    return D.active_edges(k.relations, k.claims, nodes)


@query(f"WITH {LEFT} SELECT e.id FROM en e WHERE type = 'Chunk' AND e.id NOT IN (SELECT 'chunk:' || id FROM lch) UNION ALL SELECT src || ' ' || predicate || ' ' || dst FROM re WHERE starts_with(dst, 'chunk:') AND dst NOT IN (SELECT 'chunk:' || id FROM lch)")
def j11_purged_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges that go when chunks of deleted sources are missed."""
    k, gone = world(spark, d)
    left = k.chunks.join(gone, "source_id", "left_anti")
    nodes, edges = D.purge_orphans(k.entities, k.relations, left)
    lost = k.relations.join(edges, ["src", "predicate", "dst"], "left_anti").select(F.concat_ws(" ", "src", "predicate", "dst").alias("id"))
    return k.entities.join(nodes, "id", "left_anti").select("id").unionByName(lost)
