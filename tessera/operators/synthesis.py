"""Contexts for answers and checks of recorded answers against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def pack_context(hits: DataFrame, allowed: DataFrame, claims: DataFrame, texts: DataFrame, most: int = 800) -> DataFrame:
    """query_id, kind, pos, id, source_id, text: what an answer may lean on, in the order of the hits (query_id, rank, kind, id).

    Of claims (id, subject, predicate, object) only the allowed ones (query_id, claim_id) are taken; those that no hit names follow by id.
    Chunks and pages (kind, id, source_id, text) are cut to `most` characters; what is not there any more is left out."""
    first = hits.groupBy("query_id", "kind", "id").agg(F.min("rank").alias("rank"))
    may = allowed.select("query_id", F.col("claim_id").alias("id")).distinct()
    named = may.join(first.where("kind = 'claim'").select("query_id", "id", "rank"), ["query_id", "id"], "left")
    said = named.join(claims.select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("text")), "id")
    said = said.select("query_id", F.lit("claim").alias("kind"), "id", "rank", F.lit(None).cast("string").alias("source_id"), "text")
    read = first.join(texts.select("kind", "id", "source_id", F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text")), ["kind", "id"])
    w = Window.partitionBy("query_id", "kind").orderBy(F.asc_nulls_last("rank"), "id")
    return said.unionByName(read.select(*said.columns)).select("query_id", "kind", F.row_number().over(w).alias("pos"), "id", "source_id", "text")


def sanitised(answers: DataFrame, context: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, answer, n_citations, grounded of recorded answers (query_id, answer, citations of source_id and quote) that may stand.

    A citation stands if a text of its source in the query's context, or a quote of its evidence (query_id, source_id, quote), holds it or is
    held by it. An answer stands if a citation does, or if it holds a quote of 6 characters or more or the first 40 of a text of 12 or more."""
    clean = answers.withColumn("answer", T.strip_citations("answer")).where("answer <> ''")
    texts = context.where("kind <> 'claim' AND text <> ''").select("query_id", "source_id", "text", F.substring("text", 1, 120).alias("short"), F.when(F.length("text") >= 12, F.substring("text", 1, 40)).alias("mark"))
    quotes = evidence.where("quote <> ''").select("query_id", "source_id", F.col("quote").alias("text"), F.col("quote").alias("short"), F.when(F.length("quote") >= 6, F.col("quote")).alias("mark"))
    base = texts.unionByName(quotes)
    cited = clean.select("query_id", F.posexplode("citations").alias("n", "c")).select("query_id", "n", "c.source_id", "c.quote").where("quote <> ''")
    stand = cited.join(base, ["query_id", "source_id"]).where(F.contains("text", F.col("quote")) | F.contains("quote", F.col("short")))
    stand = stand.groupBy("query_id").agg(F.countDistinct("n").alias("n_citations"))
    ground = clean.join(base.select("query_id", "mark"), "query_id").groupBy("query_id").agg(F.coalesce(F.bool_or(F.contains("answer", F.col("mark"))), F.lit(False)).alias("grounded"))
    out = clean.join(stand, "query_id", "left").join(ground, "query_id", "left")
    out = out.select("query_id", "answer", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("grounded", F.lit(False)).alias("grounded"))
    return out.where("n_citations > 0 OR grounded")
