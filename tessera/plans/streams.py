"""Registered queries on streams: claims by family, and session memory within bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import extract as X
from tessera.plans.registry import registry
from tessera.sources import bindings as B
from tessera.streaming import families as S
from tessera.streaming import ingest as I

QUERIES, SQL, query = registry()


def licence_candidates(docs: DataFrame) -> DataFrame:
    """Licence facts of documents (doc_id, text): one subject, and a predicate that allows one object."""
    pack = [(0, "library", "granted_under", X.ENGLISH_PACK[0][3], 1)]
    found = X.rule_claims(docs.select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text"), pack)
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("bigint")
    at = F.timestamp_seconds(F.lit(1704067200) + number * 60)
    return found.withColumn("ord", number * 100000 + F.col("ord")).withColumn("end", F.col("start") + F.length("quote")).withColumn("at", at)


@query("""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:Licensed|Released) under (?:the )?([^\\n]+)', 1)) AS o, generate_subscripts(regexp_extract_all(text, '(?:Licensed|Released) under (?:the )?([^\\n]+)', 1), 1) AS i FROM documents),
f AS (SELECT trim(o) AS object, min(doc_id * 100000 + i) AS first FROM r WHERE trim(o) <> '' GROUP BY 1)
SELECT object, row_number() OVER (ORDER BY first, object)::INT AS version, CASE WHEN row_number() OVER (ORDER BY first, object) = 1 THEN 'active' ELSE 'staging' END AS status, 'doc-' || first // 100000 AS source FROM f""")
def st1_stream_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a stream of documents in four slices; the same as one compile of all."""
    docs = B.read(spark, d, "documents").select("doc_id", "text")
    source, state, n = I.shared_path(spark, "slices"), I.shared_path(spark, "families-state"), 0
    store = S.FamilyStore(spark, I.shared_path(spark, "families"), exclusive=["granted_under"])
    none = spark.createDataFrame([], "alias string, canonical string"), spark.createDataFrame([], "mention string, type string"), spark.createDataFrame([], "subject_type string, predicate string, object_type string")
    for _ in S.arriving(docs, F.col("doc_id"), 4, source):
        stream = spark.readStream.schema(docs.schema).parquet(source)
        n = S.stream_claims(stream, licence_candidates, *none, store, state)
    return store.claims(n).select("object", "version", "status", F.col("source_ids")[0].alias("source"))


@query("SELECT session_id, seq FROM (SELECT 'conv-' || conv_id AS session_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')) WHERE n <= 10")
def st2_stream_memory(spark: SparkSession, d: str) -> DataFrame:
    """User turns in four slices of time, ten minutes a turn; a session that is idle for an hour leaves the state."""
    c = B.read(spark, d, "conversations").where("role = 'user'")
    rows = c.select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("seq"), F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 600).alias("at"))
    source, out, state = (I.shared_path(spark, name) for name in ("slices", "memory", "memory-state"))
    for _ in S.arriving(rows, F.col("seq"), 4, source):
        I.session_memory(spark.readStream.schema(rows.schema).parquet(source), out, state)
    return I.remembered(spark, out)
