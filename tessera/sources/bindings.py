"""Knowledge tables derived from the given parquet tables, as lazy DataFrames (see FIXTURES.md).

Every function reads only the columns that it needs; ids are hashes of content keys, so they are the same on
every run and after a retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def plain_unions(spark: SparkSession) -> None:
    """Let a union be no promise of partitioning. Spark 4.1 takes a union of parts that are partitioned alike as partitioned so itself, but where
    adaptive execution has changed the number of a part's partitions by then, a join on it fails (can't zip RDDs)."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") == "true":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Rows and bytes of an Arrow batch: a Python worker holds a batch, whatever the size of the table.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Give Python tasks of this session batches of few rows and bytes, unless it has limits of its own."""
    for name, given, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, given) == given:
            spark.conf.set(key, str(value))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task's hash table of rows with their keys may hold: parts grow in number, not in size.
PART_ROWS = 250_000


def dealt(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """df, of at most so many rows, dealt by keys that few rows share into parts of bounded size, so that what groups it by them does so where it lies."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-most // PART_ROWS)), *keys)


def kb_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their text; the language is the knowledge base."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("lang").alias("kb_id"),
        F.concat(F.lit("doc-"), d.doc_id).alias("id"),
        F.concat(F.lit("doc-"), d.doc_id, F.lit(".md")).alias("title"),
        F.col("source").alias("type"),
        "doc_id",
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)").alias("created_at"),
        "text",
    )


def md_text(text: Column) -> Column:
    """The text with every fifth line a level-two heading and a blank line after each line."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return F.array_join(lines, "\n\n")


def md_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = kb_sources(spark, sf_dir)
    return s.withColumn("text", md_text(s.text))


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned facts: two families for each customer, one version for each order."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    facts = F.array(F.struct(F.lit("order_priority").alias("p"), F.col("o_orderpriority").alias("o")), F.struct(F.lit("order_status").alias("p"), F.col("o_orderstatus").alias("o")))
    c = o.withColumn("f", F.explode(facts)).select(
        F.concat(F.lit("customer-"), "o_custkey").alias("subject"), F.col("f.p").alias("predicate"), F.col("f.o").alias("object"), F.lit("Concept").alias("object_type"),
        F.col("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("order-"), "o_orderkey").alias("source_id"),
        (F.lit(0.5) + (F.col("o_orderkey") % 50) / 100).alias("confidence"),
    )
    w = Window.partitionBy("family_id").orderBy("valid_from", "ord")
    c = c.withColumn("family_id", T.family_id("subject", "predicate", "object_type"))
    c = c.withColumn("version", F.row_number().over(w)).withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("status", F.when(F.lead("ord").over(w).isNull(), "active").otherwise("superseded"))
    return c.withColumn("id", T.short_hash(F.concat_ws("|", "family_id", "version")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named vertices of the relation graph."""
    parts = [("customer", "c_custkey", "c_name", "Customer"), ("supplier", "s_suppkey", "s_name", "Supplier"), ("nation", "n_nationkey", "n_name", "Nation"), ("region", "r_regionkey", "r_name", "Region"), ("part", "p_partkey", "p_name", "Part")]
    out = None
    for table, key, name, kind in parts:
        one = read(spark, sf_dir, table).select(F.concat(F.lit(table + "-"), key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def relation_rows(spark: SparkSession, sf_dir: str) -> int:
    """The most edges that `relations` can have, by the tables' footers."""
    return sum(read(spark, sf_dir, t).count() for t in ("customer", "nation", "supplier", "lineitem"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges src -predicate-> dst of customers, nations, regions, suppliers and parts."""
    c, n, s, l = (read(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "lineitem"))
    ps = dealt(l.select("l_partkey", "l_suppkey"), l.count(), "l_partkey", "l_suppkey").distinct()

    def edge(df: DataFrame, a: str, x: str, p: str, b: str, y: str) -> DataFrame:
        return df.select(F.concat(F.lit(a + "-"), x).alias("src"), F.lit(p).alias("predicate"), F.concat(F.lit(b + "-"), y).alias("dst"))

    return edge(c, "customer", "c_custkey", "in_nation", "nation", "c_nationkey").unionByName(edge(n, "nation", "n_nationkey", "in_region", "region", "n_regionkey")).unionByName(edge(s, "supplier", "s_suppkey", "in_nation", "nation", "s_nationkey")).unionByName(edge(ps, "part", "l_partkey", "supplied_by", "supplier", "l_suppkey"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes for facts found in texts: the sentence of a licence, or a wrong quote where doc_id % 7 = 0."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    quote = F.regexp_extract("text", r"(?:Licensed|Released) under [^\n]+", 0)
    return d.where(quote != "").select(F.concat(F.lit("claim-"), "doc_id").alias("claim_id"), F.concat(F.lit("doc-"), "doc_id").alias("source_id"), F.when(F.col("doc_id") % 7 == 0, F.lit("no such quote")).otherwise(quote).alias("quote"), (F.lit(0.5) + (F.col("doc_id") % 5) / 10).alias("weight"), F.col("doc_id").alias("ord"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("a", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("q"), "a")


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with title, body without tags, and the names they link to."""
    p = read(spark, sf_dir, "pages").select("page_id", "html")
    return p.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n]+", " ")).alias("body"),
        F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)).alias("links"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
