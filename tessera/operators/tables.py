"""Keyed table maintenance: merges, appends, replacement, deletion cascades. Each is one join or window on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, for each key the one of the highest order; delta wins ties."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base and the rows of delta whose key it lacks (one for each key)."""
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old chunks of the re-chunked sources become stale; the fresh ones join."""
    done = fresh.select("source_id").distinct().withColumn("_done", F.lit(True))
    old = chunks.join(done, "source_id", "left").withColumn("status", F.when(F.col("_done"), "stale").otherwise(F.col("status"))).drop("_done")
    return old.unionByName(fresh)


def purge_stale(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks left, vectors left, and how many chunks went by source."""
    stale = chunks.where("status = 'stale'")
    return chunks.where("status <> 'stale'"), vectors.join(stale.select(F.col("id").alias("ref_id")), "ref_id", "left_anti"), stale.groupBy("source_id").agg(F.count("*").alias("purged"))


def delete_sources(claims: DataFrame, gone: DataFrame) -> DataFrame:
    """Claims (source_ids array) without those that only gone sources support; shared ones lose these sources."""
    ids = gone.select("source_id").distinct().withColumn("_gone", F.lit(True))
    cited = claims.select("id", F.explode("source_ids").alias("source_id")).join(ids, "source_id", "left")
    left = cited.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("_gone").isNull(), F.col("source_id")))).alias("left"))
    return claims.join(left, "id").where(F.size("left") > 0).withColumn("source_ids", F.col("left")).drop("left")


def transition(claims: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """changes(id, status, valid_to) applied; a superseded claim without an end ends now. Second: changes without a claim."""
    c = changes.select("id", F.col("status").alias("_status"), F.col("valid_to").alias("_to"))
    out = claims.join(c, "id", "left")
    end = F.when(F.col("_status") == "superseded", F.coalesce("_to", now)).otherwise(F.col("valid_to"))
    done = out.withColumn("valid_to", end).withColumn("status", F.coalesce("_status", "status")).drop("_status", "_to")
    return done, changes.join(claims.select("id"), "id", "left_anti")
