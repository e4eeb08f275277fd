"""Parts of compiled pages: numbered items and chapters of a text, points, related links, topic edges and reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions import text as T

# Headings of numbered items and of chapters, and titles that are neither.
CATALOG_HEAD = r"(?md)^##\s+\d+[、.．]\s*(.+?)\s*$"
PLAIN_HEAD = r"(?md)^##\s+(?!\d+[、.．])"
CHAPTER_CN = r"(?md)^[ \t]*[一二三四五六七八九十百]+[、．.]\s*(\S.+?)\s*$"
CHAPTER_MD = r"(?md)^##\s+(?!\d+[、.．])(.+?)\s*$"
SKIPPED_TITLES = ["概述", "简介", "前言", "目录", "常见问题", "联系方式", "附录", "总结"]
# The section of related links and the sections that it stands before.
RELATED = "## 相关主题"
BEFORE = ["## Chunks", "## 关键词", "## 相关实体", "## 相关原文"]
UNSORTED = "未分类"
COVERS, HOLDS = "涵盖", "包含段落"


def headed(text: Column, head: str) -> Column:
    """array<struct<title, body>> of what follows each heading, in one pass over the text (marks of record and unit are read as blanks)."""
    marked = F.regexp_replace(F.translate(text, "\x1e\x1f", "  "), head, "\x1e$1\x1f")
    cut = F.split(marked, "\x1e")
    title = lambda p: T.strip(F.substring_index(p, "\x1f", 1))
    body = lambda p: T.strip(F.substring(p, F.instr(p, "\x1f") + 1, F.length(p)))
    return F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda p: F.struct(title(p).alias("title"), body(p).alias("body")))


def catalog_items(sources: DataFrame) -> DataFrame:
    """source_id, item, title, body of numbered second-level headings (id, text), where a text has two or more. The last one ends at the next
    heading without a number; titles to skip are left out. A null or empty text has none."""
    rows = sources.select(F.col("id").alias("source_id"), headed(F.col("text"), CATALOG_HEAD).alias("p"))
    each = rows.select("source_id", F.size("p").alias("n"), F.posexplode("p").alias("item", "x")).where("n >= 2")
    last = T.strip(F.regexp_replace("x.body", PLAIN_HEAD + r"[\s\S]*", ""))
    out = each.select("source_id", "item", "x.title", F.when(F.col("item") == F.col("n") - 1, last).otherwise(F.col("x.body")).alias("body"))
    return out.where((F.col("title") != "") & ~F.col("title").isin(SKIPPED_TITLES))


def chapter_items(sources: DataFrame, least: int = 40) -> DataFrame:
    """source_id, item, title, body of chapters with a body of `least` characters: by Chinese numerals if two or more, else by plain second-level headings."""
    good = lambda p: F.filter(p, lambda x: (F.length(x["body"]) >= least) & (x["title"] != "") & ~x["title"].isin(SKIPPED_TITLES))
    rows = sources.select(F.col("id").alias("source_id"), good(headed(F.col("text"), CHAPTER_CN)).alias("cn"), good(headed(F.col("text"), CHAPTER_MD)).alias("md"))
    chosen = F.when(F.size("cn") >= 2, F.col("cn")).when(F.size("md") >= 2, F.col("md"))
    return rows.select("source_id", F.posexplode(chosen).alias("item", "x")).select("source_id", "item", "x.title", "x.body")


def related_section(markdown: Column, links: Column) -> Column:
    """The page with its section of related links put new: in its place, else before the first known section, else at the end."""
    new = F.concat(F.lit(RELATED + "\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))
    tail_of = lambda c, at: F.substring(c, at, F.length(c))
    head = lambda c, at: F.substring(c, F.lit(1), at - 1)
    end = lambda c: F.regexp_replace(c, r"\s+$", "")
    at = F.instr(markdown, RELATED)
    rest = tail_of(markdown, at + len(RELATED))
    follows = F.instr(rest, "\n## ")
    out = F.when(F.size(links) == 0, markdown).when(at > 0, F.concat(end(head(markdown, at)), F.lit("\n\n"), new, F.when(follows > 0, tail_of(rest, follows)).otherwise("")))
    for section in BEFORE:
        place = F.instr(markdown, section)
        out = out.when(place > 0, F.concat(head(markdown, place), new, F.lit("\n"), tail_of(markdown, place)))
    return out.otherwise(F.concat(end(markdown), F.lit("\n\n"), new))


def plan_folder(planned: Column, folder: Column, category: Column, bundled: Column) -> Column:
    """The folder that a plan names; the given one where it names none or, for bundles, one outside the category."""
    named = T.strip(F.coalesce(planned, F.lit("")))
    inside = F.startswith(named, F.concat(category, F.lit("/")))
    return F.when((named == "") | (named == UNSORTED), folder).when(bundled & ~inside, folder).otherwise(named)


# White space as the patterns of the JVM have it.
_WS = " \t\n\x0b\x0c\r"
_BLANKS = re.compile(f"[{_WS}]+")
_SENTENCES = re.compile(r"[^。；;]*[。；;]|[^。；;]+\Z")


def said(title: str | None, text: str | None, summary: str | None) -> list[tuple[int, str]]:
    """Place and point of what a chunk says: see `points`."""
    body, label = (text or "").strip(_WS), (title or "").strip(_WS)
    if not body:
        parts = [summary or ""]
    else:
        useful = (x.strip(" -\t") for x in body.splitlines() if x.strip(_WS))
        parts = list(islice((x for x in useful if len(x) >= 8 and x[0] != "#"), 6))
        if len(parts) < 2:
            parts = _SENTENCES.findall(body.replace("\n", " "))
    tidy = ((pos, _BLANKS.sub(" ", f"{label}：{x}" if label else x).strip(_WS)) for pos, x in enumerate(parts) if x.strip(_WS))
    return [(pos, point) for pos, point in tidy if len(point) >= 8]


def points(chunks: DataFrame, most: int = 12) -> DataFrame:
    """source_id, place, point: of each chunk (source_id, chunk_index, title, text, summary) its first six lines of eight characters and more
    that are no headings, if there are two, else its sentences, else its summary; under the chunk's title, each once by its first 80 characters,
    cut to 220. A source's first `most` stay: that is the report.

    A task hands on the first `most` of each run of chunks of one source, which hold all that can be among the source's first; chunks after them are not read."""
    rows = chunks.select("source_id", "chunk_index", "title", "text", "summary")
    schema = StructType([rows.schema["source_id"], rows.schema["chunk_index"], StructField("pos", IntegerType()), StructField("point", StringType())])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, {}  # of the source at hand: by key the first chunk, place and point
        for batch in batches:
            out = []
            sources, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for j, (source, number) in enumerate(zip(sources, numbers)):
                if source != own:
                    out += [(own, *x) for x in held.values()]
                    own, held = source, {}
                if len(held) == most and number > last:
                    continue
                for pos, point in said(*(c[j].as_py() for c in batch.columns[2:])):
                    key, new = point[:80], (number, pos, point)
                    held[key] = min(held.get(key, new), new)
                if len(held) > most:
                    held = dict(sorted(held.items(), key=lambda x: x[1])[:most])
                if len(held) == most:
                    last = max(held.values())[0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), types)], schema=types)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*[(own, *x) for x in held.values()]), types)], schema=types)

    named = rows.mapInArrow(run, schema)
    once = named.groupBy("source_id", F.substring("point", 1, 80).alias("key")).agg(F.min(F.struct("chunk_index", "pos", "point")).alias("m"))
    w = Window.partitionBy("source_id").orderBy("m.chunk_index", "m.pos")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("source_id", "place", F.substring("m.point", 1, 220).alias("point"))


def topic_claims(topics: DataFrame, claims: DataFrame) -> DataFrame:
    """source_id, topic_id, claim_id: claims (source_id, claim_id, subject) of a topic (source_id, topic_id, title, blob) of the same source: those whose
    subject holds the title or lies in it, else those whose subject stands in the topic's text. A topic without a title has none."""
    t, s = T.strip("title"), F.col("subject")
    both = topics.where(t != "").join(claims.where("subject <> ''"), "source_id")
    met = both.select("source_id", "topic_id", "claim_id", (F.contains(s, t) | F.contains(t, s)).alias("by_title"), F.contains("blob", s).alias("by_text"))
    some = F.bool_or("by_title").over(Window.partitionBy("source_id", "topic_id"))
    return met.withColumn("some", some).where(F.when(F.col("some"), F.col("by_title")).otherwise(F.col("by_text"))).select("source_id", "topic_id", "claim_id")


def topic_edges(claims: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """src, predicate, dst: a topic covers the subjects and objects of its claims (topic_id, subject, object) and holds its chunks (topic_id, chunk_id).
    A name is the first entity (id, type, name) of that name, else a new concept. Names are made distinct before they meet the entities."""
    names = claims.select("topic_id", F.explode(F.array("subject", "object")).alias("name")).where("name <> ''").distinct()
    known = entities.where("type NOT IN ('Topic', 'Chunk')").groupBy("name").agg(F.min("id").alias("id"))
    covers = names.join(known, "name", "left").select(F.col("topic_id").alias("src"), F.lit(COVERS).alias("predicate"), F.coalesce("id", T.entity_id(F.lit("Concept"), "name")).alias("dst"))
    holds = chunks.select(F.col("topic_id").alias("src"), F.lit(HOLDS).alias("predicate"), F.concat(F.lit("chunk:"), "chunk_id").alias("dst"))
    return covers.unionByName(holds).distinct()


def rebuilt(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, name, status, change: new topics (id, name) are active, old ones that are not among them stay as stale."""
    both = old.select("id", F.col("name").alias("old_name")).join(new.select("id", F.col("name").alias("new_name")), "id", "full_outer")
    change = F.when(F.col("old_name").isNull(), "created").when(F.col("new_name").isNull(), "stale").otherwise("updated")
    return both.select("id", F.coalesce("new_name", "old_name").alias("name"), F.when(F.col("new_name").isNull(), "stale").otherwise("active").alias("status"), change.alias("change"))


def with_status(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunks of the sources asked for (source_id, wanted), by status: active, stale, or all of these two; any other gives none."""
    fits = (F.col("status") == F.col("wanted")) | (F.col("wanted") == "all")
    return chunks.where("status IN ('active', 'stale')").join(wanted, "source_id").where(fits)


def passages(hits: DataFrame, chunks: DataFrame, pages: DataFrame, claims: DataFrame, most: int = 400) -> DataFrame:
    """query_id, key, passage: what stands for a hit (query_id, key, snippet) when it is scored: a chunk's (key, title, summary, text) title and
    summary, else its text; a page's (key, title, snippet) title and snippet; a claim's (key, subject, predicate, object) triple; else the hit's
    snippet. Cut to `most` characters, as such passages are by definition."""
    said = lambda *c: F.nullif(T.strip(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in c])), F.lit(""))
    texts = chunks.select("key", F.coalesce(said("title", "summary"), said("text")).alias("found")).unionByName(pages.select("key", said("title", "snippet").alias("found"))).unionByName(claims.select("key", said("subject", "predicate", "object").alias("found")))
    return hits.join(texts, "key", "left").select("query_id", "key", F.substring(F.coalesce("found", T.strip(F.coalesce("snippet", F.lit("")))), 1, most).alias("passage"))


def focus_tokens(title: Column, focus: Column) -> Column:
    """Words of two characters or more of a title and of its focus, of which only what follows `include:` counts."""
    f = F.coalesce(F.nullif(focus, F.lit("")), title)
    marked = F.regexp_like(f, F.lit("include[:：]"))
    f = F.when(marked, F.split(F.regexp_replace(f, r"(?s)^.*?include[:：]", ""), "exclude[:：]")[0]).otherwise(f)
    words = F.transform(F.split(F.concat_ws(" ", title, f), r"\s+|、|；|;|/|，|,"), lambda w: F.trim(w))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin("include", "exclude", "本页", "其他"))


def page_evidence(outline: DataFrame, chunks: DataFrame, claims: DataFrame, most_chunks: int = 6, most_claims: int = 12) -> DataFrame:
    """source_id, page_index, kind, pos, id: what each page of an outline (source_id, page_index, title, focus) is to be written from.

    Chunks (source_id, ord, id, title, text) whose title holds the page's or that hold one of its words, else a window of chunks by the page's
    place; claims (source_id, ord, id, subject, predicate, object) whose subject holds the title or the other way round, or that hold a
    word, else six claims by the page's place."""
    page = outline.select("source_id", "page_index", F.col("title").alias("page"), focus_tokens(F.col("title"), F.col("focus")).alias("words"))
    w = Window.partitionBy("source_id").orderBy("ord")

    def chosen(rows: DataFrame, kind: str, fits: Column, start: Column, width: Column, most: int) -> DataFrame:
        placed = rows.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("source_id")))
        both = page.join(placed, "source_id").withColumn("fits", fits)
        both = both.withColumn("any", F.bool_or("fits").over(Window.partitionBy("source_id", "page_index")))
        inside = (F.col("at") >= start) & (F.col("at") < start + width)
        took = both.where(F.when(F.col("any"), F.col("fits")).otherwise(inside))
        pos = F.row_number().over(Window.partitionBy("source_id", "page_index").orderBy("at"))
        return took.select("source_id", "page_index", F.lit(kind).alias("kind"), pos.alias("pos"), "id").where(F.col("pos") <= most)

    text = F.lower(F.concat_ws(" ", "title", "text"))
    in_chunk = F.contains(F.coalesce("title", F.lit("")), F.col("page")) | F.exists("words", lambda x: F.contains(text, F.lower(x)))
    width = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.col("n") / (F.col("page_index") + 1))))
    start = F.least(F.col("page_index") * width, F.greatest(F.lit(0), F.col("n") - width))
    said = F.concat("subject", "predicate", "object")
    in_claim = F.contains("subject", F.col("page")) | F.contains("page", F.col("subject")) | F.exists("words", lambda x: F.contains(said, x))
    a = chosen(chunks.select("source_id", "ord", "id", "title", "text"), "chunk", in_chunk, start, width, most_chunks)
    b = chosen(claims.select("source_id", "ord", "id", "subject", "predicate", "object"), "claim", in_claim, F.pmod(F.col("page_index") * 6, F.col("n")), F.lit(6), most_claims)
    return a.unionByName(b)


def page_rejects(pages: DataFrame, sections: list[str], least: int = 2) -> DataFrame:
    """source_id, reason of sources whose recorded pages (source_id, link, markdown) can't be taken: a page lacks the link to its source or a
    required section, or there are fewer than `least`."""
    whole = F.lit(True)
    for section in sections:
        whole = whole & F.contains("markdown", F.lit(section))
    checked = pages.withColumns({"linked": F.coalesce(F.contains("markdown", F.col("link")), F.lit(False)), "whole": F.coalesce(whole, F.lit(False))})
    by = checked.groupBy("source_id").agg(F.bool_and("linked").alias("linked"), F.bool_and("whole").alias("whole"), F.count("*").alias("n"))
    reason = F.when(~F.col("linked"), "link_missing").when(~F.col("whole"), "section_missing").when(F.col("n") < least, "too_few_pages")
    return by.select("source_id", reason.alias("reason")).where("reason IS NOT NULL")
