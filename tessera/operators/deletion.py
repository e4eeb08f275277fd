"""Deletion of sources with all that only they support: every table that knows them, in the order in which support is lost.

Support is counted, not walked: a claim, an edge, an entity, a topic or a page lives while something left supports it, so one pass of joins on keys
deletes any number of sources at once, as deleting them one by one would. Nothing is gathered; only rows that a deleted source touches are rewritten."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Edges of topics, to entities and to chunks.
COVERS, HOLDS = "涵盖", "包含段落"
STRUCTURAL = (COVERS, HOLDS)


class Knowledge(NamedTuple):
    """All tables of a knowledge base that a source leaves traces in. Further columns are kept."""

    sources: DataFrame  # id, replaces_source_id
    texts: DataFrame  # source_id
    chunks: DataFrame  # id, source_id
    vectors: DataFrame  # ref_type (chunk, claim), ref_id
    claims: DataFrame  # id, subject, predicate, object, subject_type, object_type, status, source_ids
    evidence: DataFrame  # claim_id, source_id
    events: DataFrame  # source_id
    quarantine: DataFrame  # raw: JSON with source_id
    entities: DataFrame  # id, type, status
    relations: DataFrame  # src, predicate, dst
    topics: DataFrame  # id, name, status
    members: DataFrame  # topic_id, ref_type (chunk, claim), ref_id
    pages: DataFrame  # page_id, source_ids


def shrunk(table: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with what is left of source_ids, rows without any left as they were, keys of rows that lost some and have some). Rows that cite no source stay."""
    hit = table.select(key, F.explode("source_ids").alias("source_id")).join(gone, "source_id", "left_semi")
    lost = hit.groupBy(key).agg(F.collect_set("source_id").alias("_lost"))  # part of the row's own array
    both = table.join(lost, key, "left").withColumn("_left", F.when(F.col("_lost").isNull(), F.col("source_ids")).otherwise(F.array_except("source_ids", "_lost")))
    bare = F.col("_lost").isNotNull() & (F.size("_left") == 0)
    kept = both.where(~bare).withColumn("source_ids", F.col("_left"))
    return kept.select(*table.columns), both.where(bare).select(*table.columns), kept.where("_lost IS NOT NULL").select(key, "source_ids")


def edges_of(claims: DataFrame) -> DataFrame:
    """subject, predicate, object, src, dst: the edge that each claim stands for."""
    return claims.select("subject", "predicate", "object", T.entity_id("subject_type", "subject").alias("src"), T.entity_id("object_type", "object").alias("dst"))


def without_claims(entities: DataFrame, relations: DataFrame, removed: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) after claims were removed: their edges go, unless an active claim that is left says the same; entities at the ends of
    edges that went go too, unless an edge is left to them."""
    spo = ["subject", "predicate", "object"]
    dead = edges_of(removed).join(left.where("status = 'active'").select(*spo).distinct(), spo, "left_anti")
    rest = relations.join(dead.select("src", "predicate", "dst").distinct(), ["src", "predicate", "dst"], "left_anti").select(*relations.columns)
    touched = dead.select(F.col("src").alias("id")).unionByName(dead.select(F.col("dst").alias("id"))).distinct()
    ends = rest.select(F.col("src").alias("id")).unionByName(rest.select(F.col("dst").alias("id"))).distinct()
    lonely = touched.join(ends, "id", "left_anti")
    return entities.join(lonely, "id", "left_anti").select(*entities.columns), rest


def stale_topics(topics: DataFrame, members: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, entities) in which a topic without members is stale, and its node too."""
    held = members.select(F.col("topic_id").alias("id")).distinct().withColumn("_held", F.lit(True))
    marked = topics.join(held, "id", "left").withColumn("status", F.when(F.col("_held"), F.col("status")).otherwise("stale")).select(*topics.columns)
    nodes = marked.where("status = 'stale'").select(F.concat(F.lit("topic:"), "id").alias("id")).distinct().withColumn("_stale", F.lit(True))
    return marked, entities.join(nodes, "id", "left").withColumn("status", F.when(F.col("_stale"), "stale").otherwise(F.col("status"))).select(*entities.columns)


def purge_orphans(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) without structural edges of stale topics, edges to chunks that are not there, and nodes of such chunks."""
    stale = entities.where("type = 'Topic' AND status = 'stale'").select(F.col("id").alias("src")).distinct()
    structural = F.col("predicate").isin(*STRUCTURAL)
    live = relations.join(stale.withColumn("_stale", F.lit(True)), "src", "left").where(~(structural & F.coalesce("_stale", F.lit(False)))).select(*relations.columns)
    there = chunks.select(F.concat(F.lit("chunk:"), "id").alias("dst")).distinct().withColumn("_there", F.lit(True))
    edges = live.join(there, "dst", "left").where(~F.startswith("dst", F.lit("chunk:")) | F.col("_there")).select(*relations.columns)
    nodes = entities.join(there.withColumnRenamed("dst", "id"), "id", "left").where(~F.coalesce(F.col("type") == "Chunk", F.lit(False)) | F.col("_there"))
    return nodes.select(*entities.columns), edges


def active_edges(relations: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that an active claim stands for, and structural edges of topics that are not stale."""
    keys = ["src", "predicate", "dst"]
    said = edges_of(claims.where("status = 'active'")).select(*keys).distinct().withColumn("_said", F.lit(True))
    topics = entities.where("type = 'Topic' AND coalesce(status, '') <> 'stale'").select(F.col("id").alias("src")).distinct().withColumn("_topic", F.lit(True))
    both = relations.join(said, keys, "left").join(topics, "src", "left")
    return both.where(F.col("_said") | (F.col("predicate").isin(*STRUCTURAL) & F.col("_topic"))).select(*relations.columns)


def delete_sources(k: Knowledge, gone: DataFrame) -> tuple[Knowledge, DataFrame]:
    """(all tables after the sources in `gone` (source_id) were deleted, source_id of those to compile again: what is left of shared pages and exists)."""
    gone = gone.select("source_id").where("source_id IS NOT NULL").distinct()
    anti = lambda df: df.join(gone, "source_id", "left_anti").select(*df.columns)
    claims, removed, _ = shrunk(k.claims, "id", gone)
    chunks = anti(k.chunks)
    dead = k.chunks.join(gone, "source_id", "left_semi").select(F.lit("chunk").alias("ref_type"), F.col("id").alias("ref_id")).unionByName(removed.select(F.lit("claim").alias("ref_type"), F.col("id").alias("ref_id"))).distinct()
    vectors = k.vectors.join(dead, ["ref_type", "ref_id"], "left_anti").select(*k.vectors.columns)
    members = k.members.join(dead, ["ref_type", "ref_id"], "left_anti").select(*k.members.columns)
    of = F.coalesce(F.get_json_object("raw", "$.source_id"), F.lit(""))
    quarantine = k.quarantine.withColumn("source_id", of).join(gone, "source_id", "left_anti").select(*k.quarantine.columns)
    sources = k.sources.join(gone.select(F.col("source_id").alias("replaces_source_id"), F.lit(True).alias("_gone")), "replaces_source_id", "left")
    sources = sources.withColumn("replaces_source_id", F.when(F.col("_gone").isNull(), F.col("replaces_source_id"))).select(*k.sources.columns)
    sources = sources.join(gone.withColumnRenamed("source_id", "id"), "id", "left_anti").select(*k.sources.columns)
    entities, relations = without_claims(k.entities, k.relations, removed, claims)
    topics, entities = stale_topics(k.topics, members, entities)
    entities, relations = purge_orphans(entities, relations, chunks)
    pages, _, shared = shrunk(k.pages, "page_id", gone)
    again = shared.select(F.explode("source_ids").alias("source_id")).distinct().join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return Knowledge(sources, anti(k.texts), chunks, vectors, claims, anti(k.evidence), anti(k.events), quarantine, entities, relations, topics, members, pages), again
