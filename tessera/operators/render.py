"""Pages as lines: page, section, key, line. Lines of a page are in order of section, then key, so that no page, and be it the index of all
sources, is gathered in one task; a writer sorts within the pages it is dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Headings and stand-ins of exported pages.
SUMMARY, DATA, CHAPTERS, RELATED, TOPICS = "## 摘要", "## 元数据", "## 章节", "## 相关", "## 主题"
NO_CLAIM, NO_SOURCE, NO_ENTITY = "- （无 active Claim）", "- （无文档）", "- （无实体）"


def front_matter(kind: str, kb: Column) -> Column:
    return F.concat(F.lit(f"---\ntags: [{kind}]\ntype: {kind}\nkb_id: "), kb, F.lit("\n---\n"))


def lines(rows: DataFrame, page: Column, section: int, key: Column, line: Column) -> DataFrame:
    return rows.select("kb_id", page.alias("page"), F.lit(section).alias("section"), key.alias("key"), line.alias("line"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order(*parts: str) -> Column:
    """A key that sorts by its parts."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in parts])


def entity_pages(claims: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines of one page for each subject of claims (kb_id, id, subject, predicate, object, source_id); titles: source_id, title."""
    c = claims.join(titles.select("source_id", "title"), "source_id", "left")
    page = T.sanitise_filename("subject")
    one = c.select("kb_id", "subject").distinct()
    head = lines(one, page, 0, F.lit(""), F.concat(front_matter("entity", F.col("kb_id")), F.lit("\n# "), "subject", F.lit("\n\n## Claims")))
    source = F.when(F.col("source_id").isNull(), F.lit("")).otherwise(F.concat(T.source_link("source_id", "title"), F.lit(": ")))
    said = lines(c, page, 1, order("predicate", "object", "id"), F.concat(F.lit("- "), source, "predicate", F.lit(" → "), "object"))
    near = c.where("source_id IS NOT NULL").select("kb_id", "subject", "source_id", "title").distinct()
    top = lines(near.select("kb_id", "subject").distinct(), page, 2, F.lit(""), F.lit(f"\n{RELATED}"))
    return stacked([head, said, top, lines(near, page, 3, order("source_id"), F.concat(F.lit("- "), T.source_link("source_id", "title")))])


def source_pages(sources: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines of one page for each source (kb_id, id, title, type, status) with its active claims (id, subject, predicate, object, source_id,
    status) and chunks (source_id, chunk_index, title)."""
    s = sources.select("kb_id", F.col("id").alias("source_id"), F.col("title").alias("name"), "type", F.col("status").alias("state"))
    page = F.concat(F.lit("source-"), T.sanitise_filename("source_id"))
    counted = s.join(chunks.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    data = F.concat_ws("\n", F.concat(front_matter("source", F.col("kb_id")), F.lit("\n# "), "name"), F.lit(""), F.lit(DATA), F.concat(F.lit("- source_id: `"), "source_id", F.lit("`")), F.concat(F.lit("- type: "), "type"), F.concat(F.lit("- status: "), "state"), F.concat(F.lit("- chunks: "), "n"), F.lit("\n## Claims"))
    own = claims.where("status = 'active'").select("id", "subject", "predicate", "object", "source_id")
    said = s.join(own, "source_id")
    none = s.join(own.select("source_id").distinct(), "source_id", "left_anti")
    line = F.concat(F.lit("- "), T.entity_link("subject"), F.lit(": "), "predicate", F.lit(" → "), "object", F.lit(" (`"), "id", F.lit("`)"))
    part = s.join(chunks.select("source_id", "chunk_index", "title"), "source_id")
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("chunk-"), "chunk_index"))
    return stacked([
        lines(counted, page, 0, F.lit(""), data),
        lines(said, page, 1, order("subject", "predicate", "id"), line),
        lines(none, page, 1, F.lit(""), F.lit(NO_CLAIM)),
        lines(counted.where("n > 0"), page, 2, F.lit(""), F.lit(f"\n{CHAPTERS}")),
        lines(part, page, 3, F.lpad(F.col("chunk_index").cast("string"), 9, "0"), F.concat(F.lit("- "), T.link(T.chunk_page("source_id", "chunk_index"), label))),
    ])


def chunk_pages(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """kb_id, page, body: a page for each chunk (source_id, chunk_index, title, text) of sources (kb_id, id, title)."""
    s = sources.select("kb_id", F.col("id").alias("source_id"), F.col("title").alias("name"))
    c = chunks.select("source_id", "chunk_index", "title", "text").join(s, "source_id")
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chunk "), "chunk_index"))
    body = F.concat_ws("\n", F.concat(front_matter("chunk", F.col("kb_id")), F.lit("\n# "), name), F.lit(""), F.concat(F.lit("- source: "), T.source_link("source_id", "name")), F.concat(F.lit("- chunk_index: "), "chunk_index"), F.lit(""), F.coalesce("text", F.lit("")), F.lit(""))
    return c.select("kb_id", T.chunk_page("source_id", "chunk_index").alias("page"), body.alias("body"))


def index_lines(sources: DataFrame, subjects: DataFrame) -> DataFrame:
    """Lines of each knowledge base's index: sources (kb_id, id, title), then subjects (kb_id, subject)."""
    page = F.lit("_index")
    s, e = sources.select("kb_id", "id", "title"), subjects.select("kb_id", "subject").distinct()
    bases = s.select("kb_id").unionByName(e.select("kb_id")).distinct()
    head = F.concat(front_matter("index", F.col("kb_id")), F.lit("\n# Wiki Index — "), "kb_id", F.lit("\n\n## Sources"))
    return stacked([
        lines(bases, page, 0, F.lit(""), head),
        lines(s, page, 1, order("title", "id"), F.concat(F.lit("- "), T.source_link("id", "title"))),
        lines(bases.join(s.select("kb_id").distinct(), "kb_id", "left_anti"), page, 1, F.lit(""), F.lit(NO_SOURCE)),
        lines(bases, page, 2, F.lit(""), F.lit("\n## Entities")),
        lines(e, page, 3, order("subject"), F.concat(F.lit("- "), T.entity_link("subject"))),
        lines(bases.join(e.select("kb_id").distinct(), "kb_id", "left_anti"), page, 3, F.lit(""), F.lit(NO_ENTITY)),
    ])
