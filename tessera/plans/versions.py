"""Registered queries on compiling into existing history and on applying version diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import compile as K
from tessera.operators import extract as X
from tessera.plans.base import EV, OC, stamp
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()

#: Order facts after this date meet the claims that those before it were compiled to.
SPLIT = "1996-01-01"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    c = B.order_claims(spark, d)
    return c.select(F.date_diff("valid_from", F.lit("1970-01-01")).cast("bigint").alias("day"), F.col("ord").alias("key"), "subject", "predicate", "object", "confidence", "source_id", F.concat_ws(" ", "predicate", "object").alias("quote"), F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("end"), F.col("valid_from").alias("at")).withColumn("ord", F.col("day") * 100000000 + F.col("key"))


def _ontology(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """No aliases, one kind of object that is no concept, and no predicate for it."""
    types = spark.createDataFrame([("4-NOT SPECIFIED", "Gap")], "mention string, type string")
    return spark.createDataFrame([], "alias string, canonical string"), types, spark.createDataFrame([], "subject_type string, predicate string, object_type string")


def compiled(spark: SparkSession, d: str) -> tuple[K.Compiled, K.Compiled]:
    """Earlier facts compiled into nothing, later ones into what that gave."""
    facts, ontology = _facts(spark, d), _ontology(spark)
    empty = spark.createDataFrame([], K.CLAIM)
    first = K.ingest(facts.where(F.col("at") < SPLIT), empty, *ontology, exclusive=["order_status"])
    return first, K.ingest(facts.where(F.col("at") >= SPLIT), first.claims, *ontology, exclusive=["order_status"])


# Without containment among the objects, joining is a fold of the distinct objects in order; a long or joined part asks for the semicolon.
FOLD = f"""{OC}, cd AS (SELECT family_id, predicate, object, confidence, source_id, valid_from AS began, date_diff('day', DATE '1970-01-01', valid_from::DATE) * 100000000 + ord AS o FROM oc WHERE object <> '4-NOT SPECIFIED'),
ds AS (SELECT family_id, predicate, object, min(struct_pack(o := o, conf := confidence, src := source_id, began := began)) AS x FROM cd GROUP BY 1, 2, 3),
vs AS (SELECT family_id, predicate, object, x, row_number() OVER w AS version, lead(x.began) OVER w AS next_at, list(object) OVER (PARTITION BY family_id ORDER BY x.o, object ROWS UNBOUNDED PRECEDING) AS objs, max(x.conf) OVER (PARTITION BY family_id ORDER BY x.o, object ROWS UNBOUNDED PRECEDING) AS top FROM ds WINDOW w AS (PARTITION BY family_id ORDER BY x.o, object)),
fo AS (SELECT family_id, version::INT AS version, CASE WHEN predicate = 'order_status' THEN object ELSE list_reduce(objs, lambda a, b: a || CASE WHEN length(a) > 8 OR length(b) > 8 OR contains(a, '、') THEN '；' ELSE '、' END || b) END AS object,
  CASE WHEN predicate = 'order_status' THEN CASE WHEN version = 1 THEN 'active' ELSE 'staging' END WHEN next_at IS NULL THEN 'active' ELSE 'superseded' END AS status,
  round(CASE WHEN predicate = 'order_status' THEN x.conf ELSE top END, 6) AS confidence, x.began AS valid_from, CASE WHEN predicate <> 'order_status' THEN next_at END AS valid_to, CASE WHEN predicate = 'order_status' THEN 1 ELSE version END::INT AS sources, x.src AS source FROM vs)"""


@query(f"WITH {FOLD} SELECT family_id, version, object, status, confidence, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to, sources FROM fo")
def c1_compiled_history(spark: SparkSession, d: str) -> DataFrame:
    """All versions after the later facts were compiled into the claims of the earlier ones."""
    c = compiled(spark, d)[1].claims
    return c.select("family_id", "version", "object", "status", F.round("confidence", 6).alias("confidence"), stamp("valid_from").alias("valid_from"), stamp("valid_to").alias("valid_to"), F.size("source_ids").alias("sources"))


@query(f"WITH {FOLD} SELECT family_id, version, status, source FROM fo WHERE valid_from >= TIMESTAMP '{SPLIT}' OR valid_to >= TIMESTAMP '{SPLIT}'")
def c1_changed_versions(spark: SparkSession, d: str) -> DataFrame:
    """What the second compile wrote: versions that began or ended in it, and the source that began each."""
    _, late = compiled(spark, d)
    return late.changed.select("family_id", "version", "status", F.element_at("source_ids", -1).alias("source"))


@query(f"WITH {FOLD} SELECT substr(sha256(family_id || '|' || version), 1, 16) AS claim_id, source AS source_id FROM fo WHERE valid_from >= TIMESTAMP '{SPLIT}'")
def c1_bound_evidence(spark: SparkSession, d: str) -> DataFrame:
    return compiled(spark, d)[1].evidence.select("claim_id", "source_id")


@query(f"""WITH {EV}, r AS (SELECT 'doc-' || doc_id AS source_id, doc_id, text, unnest(list_zip(regexp_extract_all(text, '(?:Licensed|Released) under (?:the )?([^\\n]+)', 0), regexp_extract_all(text, '(?:Licensed|Released) under (?:the )?([^\\n]+)', 1))) AS m FROM documents),
a AS (SELECT source_id, doc_id, (doc_id % 10) / 10 AS confidence, trim(m[2]) AS object, CASE WHEN doc_id % 7 = 0 THEN 'no such quote' ELSE m[1] END AS quote, text FROM r WHERE trim(m[2]) <> ''),
g AS (SELECT *, CASE WHEN confidence < 0.5 THEN 'low_confidence' WHEN NOT contains(text, quote) THEN 'span_missing' END AS reason FROM a),
f AS (SELECT object, min(doc_id) AS first FROM g WHERE reason IS NULL GROUP BY 1), v AS (SELECT object, row_number() OVER (ORDER BY first, object) AS n FROM f)
SELECT CASE WHEN n = 1 THEN 'active' ELSE 'staging' END AS outcome, object AS what, 1::BIGINT AS n FROM v UNION ALL SELECT reason, source_id, count(*) FROM g WHERE reason IS NOT NULL GROUP BY 1, 2""")
def c2_applied_triples(spark: SparkSession, d: str) -> DataFrame:
    """Licence triples of all documents, as a model might have given them, through the gates and into claims; one subject, one predicate that allows one object."""
    docs = B.kb_sources(spark, d)
    pack = [(0, "library", "granted_under", X.ENGLISH_PACK[0][3], 1)]
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("bigint")
    found = X.rule_claims(docs, pack).withColumn("ord", number * 100000 + F.col("ord")).withColumn("confidence", (number % 10) / 10)
    found = found.withColumn("quote", F.when(number % 7 == 0, "no such quote").otherwise(F.col("quote"))).withColumn("end", F.col("start"))
    aliases, types, allowed = _ontology(spark)
    out = K.apply_extracted(found, docs.select(F.col("id").alias("source_id"), "text"), spark.createDataFrame([], K.CLAIM), aliases, types, allowed, F.expr("timestamp'2024-01-01'"), exclusive=["granted_under"])
    made = out.claims.select(F.col("status").alias("outcome"), F.col("object").alias("what"), F.lit(1).cast("bigint").alias("n"))
    return made.unionByName(out.quarantine.groupBy(F.col("reason").alias("outcome"), F.col("source_id").alias("what")).agg(F.count("*").alias("n")))


EVOLVED = f"""{OC}, st AS (SELECT *, CASE WHEN status = 'active' AND ord % 2 = 0 THEN 'staging' ELSE status END AS now_status, lag(id) OVER (PARTITION BY family_id ORDER BY version) AS old_id, max(version) OVER (PARTITION BY family_id) AS top FROM oc),
df AS (SELECT *, row_number() OVER () AS r FROM st WHERE now_status = 'staging')"""


def evolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every second family's last version is staged; each takes the place of the one before it, but claims whose id ends in 0 are lost."""
    c = B.order_claims(spark, d)
    before = F.lag("id").over(Window.partitionBy("family_id").orderBy("version"))
    staged = c.withColumn("old_id", before).withColumn("status", F.when((F.col("status") == "active") & (F.col("ord") % 2 == 0), "staging").otherwise(F.col("status")))
    lost = F.col("id").endswith("0")
    diff = staged.where("status = 'staging'").select("ord", "old_id", F.when(lost, F.concat(F.lit("lost-"), "id")).otherwise(F.col("id")).alias("new_id"), "source_id")
    claims = staged.withColumn("source_ids", F.array("source_id")).withColumn("subject_type", F.lit("Concept")).select(*K.CLAIM_COLUMNS)
    return K.apply_versions(claims, diff, F.expr("timestamp'2024-01-01'"))


@query(f"""WITH {EVOLVED}, ok AS (SELECT * FROM df WHERE id NOT LIKE '%0'), gone AS (SELECT DISTINCT old_id AS id FROM ok WHERE old_id IS NOT NULL)
SELECT family_id, version::INT AS version, object, CASE WHEN gone.id IS NULL THEN now_status ELSE 'superseded' END AS status, strftime(CASE WHEN gone.id IS NULL THEN valid_to ELSE TIMESTAMP '2024-01-01' END, '%Y-%m-%d %H:%M:%S') AS valid_to FROM st LEFT JOIN gone USING (id)
UNION ALL SELECT family_id, (top + 1)::INT, object, 'active', NULL FROM ok""")
def e1_evolved_versions(spark: SparkSession, d: str) -> DataFrame:
    return evolved(spark, d)[0].select("family_id", "version", "object", "status", stamp("valid_to").alias("valid_to"))


@query(f"""WITH {EVOLVED} SELECT ord, CASE WHEN id LIKE '%0' THEN 'error' WHEN old_id IS NULL THEN 'claim_added' ELSE 'policy_changed' END AS type, CASE WHEN id LIKE '%0' THEN 'staging claim not found: lost-' || id ELSE substr(sha256(family_id || '|' || (top + 1)), 1, 16) END AS what FROM df""")
def e1_stored_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the versions that were written, and errors of claims that are not there."""
    _, events, errors = evolved(spark, d)
    return events.select("ord", "type", F.col("claim_id").alias("what")).unionByName(errors.select("ord", F.lit("error").alias("type"), F.col("error").alias("what")))
