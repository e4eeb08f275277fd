"""Governance and question handling: evolution, approvals, memory, routing, reranking, deletion side effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Question words that choose a retrieval mode, a lane weight or a time; English words stand beside the Chinese.
WHY_WORDS = ["为什么", "为何", "why "]
RELATION_WORDS = ["关系", "关联", "之间", "相关", "影响", "涉及", "对应", "related to", "between "]
HOW_WORDS = ["为什么", "为何", "怎么", "如何", "流程", "步骤", "how "]
WHAT_WORDS = ["是什么", "多少", "谁", "何时", "什么时候", "what ", "who "]
EARLIER_WORDS = ["当时", "那时", "之前", "back then"]
PROCEDURE_WORDS = ["怎么做", "流程", "步骤", "怎么走", "how to "]


def has_any(c: Column, words: list[str]) -> Column:
    low = F.lower(c)
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def route(question: Column) -> Column:
    return F.when(has_any(question, WHY_WORDS), "claim").when(has_any(question, RELATION_WORDS), "graph").otherwise("hybrid")


def claim_weight(question: Column) -> Column:
    return F.when(has_any(question, HOW_WORDS), 0.3).when(has_any(question, WHAT_WORDS), 0.7).otherwise(0.5)


def question_time(question: Column, given: Column, this_year: int) -> Column:
    """The time a question asks about: given, or mid-year of a year it names, or mid-year before this one for words of the past."""
    year = F.regexp_extract(question, "(20[0-9]{2})", 1)
    named = F.when(year != "", F.make_timestamp(year.cast("int"), F.lit(6), F.lit(30), F.lit(0), F.lit(0), F.lit(0)))
    return F.coalesce(given, named, F.when(has_any(question, EARLIER_WORDS), F.make_timestamp(F.lit(this_year - 1), F.lit(6), F.lit(30), F.lit(0), F.lit(0), F.lit(0))))


def substitute(question: Column, aliases: list[tuple[str, str]]) -> Column:
    """Aliases replaced one after another, in list order."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in aliases])
    return F.aggregate(pairs, question, lambda q, p: F.replace(q, p["a"], p["b"]))


def approve(claims: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """claims with decisions(id, verdict) on staged ones applied: approving supersedes the active peers and the staged row and
    adds an active version; rejecting supersedes the staged row. Other statuses are left alone."""
    d = claims.join(decisions, "id").where("status = 'staging'")
    fams = d.where("verdict = 'approve'").groupBy("family_id").agg(F.max_by(F.struct("subject", "predicate", "object"), F.struct("version", "id")).alias("won"))
    top = claims.groupBy("family_id").agg(F.max("version").alias("top"))
    new = fams.join(top, "family_id").select((F.col("top") + 1).alias("version"), "family_id", "won.subject", "won.predicate", "won.object", F.lit("active").alias("status"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")).withColumn("id", T.short_hash(F.concat_ws("|", "family_id", "version")))
    mark = claims.join(fams.select("family_id", F.lit(True).alias("_fam")), "family_id", "left").join(d.select("id", F.lit(True).alias("_staged")), "id", "left")
    ends = F.coalesce("_staged", F.lit(False)) | (F.coalesce("_fam", F.lit(False)) & (F.col("status") == "active"))
    old = mark.select("id", "family_id", "version", "subject", "predicate", "object", F.when(ends, "superseded").otherwise(F.col("status")).alias("status"), "valid_from", F.when(ends, F.coalesce("valid_to", now)).otherwise(F.col("valid_to")).alias("valid_to"))
    return old.unionByName(new.select(*old.columns))


def apply_diff(claims: DataFrame, diff: DataFrame, now: Column) -> DataFrame:
    """family_id, event, old_id, new_id, at: the changes that a version diff makes (superseded and added families)."""
    event = F.when(F.col("kind") == "superseded", "policy_changed").otherwise("claim_added")
    return diff.where("kind <> 'same'").select("family_id", event.alias("event"), "old_id", "new_id", now.alias("at"))


def term_in_text(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """text_id, term for every term (single words) that a text's tokens hold: an equi-join on tokens."""
    return texts.select("text_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term")).join(terms, "term")


def trim_memory(episodes: DataFrame, most: int) -> DataFrame:
    """The newest `most` episodes (session_id, seq, ...) of each session."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return episodes.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= most).drop("_age")


def recall(episodes: DataFrame, queries: DataFrame, fallback: int = 3) -> DataFrame:
    """session_id, seq, rank, matched: for a session's query (session_id, query) the episodes whose q or a holds one of its words,
    newest first; where none does, the newest `fallback`. Sessions are trimmed, so a session's rows are few."""
    words = F.filter(F.split(F.lower("query"), r"[ \t\r\n]+"), lambda x: x != "")
    both = episodes.join(queries.select("session_id", words.alias("words")), "session_id")
    said = F.lower(F.concat_ws(" ", "q", "a"))
    own, newest = Window.partitionBy("session_id"), Window.partitionBy("session_id").orderBy(F.desc("seq"))
    hit = both.withColumn("matched", F.exists("words", lambda x: F.contains(said, x)))
    hit = hit.withColumn("some", F.bool_or("matched").over(own)).withColumn("place", F.row_number().over(newest))
    kept = hit.where(F.col("matched") | (~F.col("some") & (F.col("place") <= fallback)))
    return kept.select("session_id", "seq", F.row_number().over(newest).alias("rank"), "matched")


def rerank(hits: DataFrame, top_n: int, least: float) -> DataFrame:
    """hits (query_id, rank, key, query, passage): the first top_n rescored by overlap, those under `least` dropped; a query
    of which nothing is left keeps its hits as they were."""
    scored = hits.where(F.col("rank") <= top_n).withColumn("score", T.overlap_score("query", "passage"))
    good = scored.where(F.col("score") >= least)
    kept = good.select("query_id", "key", "score").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
    rest = hits.join(good.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "key", F.lit(0.0).alias("score"), "rank")
    return kept.unionByName(rest)


def page_bundles(pages: DataFrame) -> DataFrame:
    """folder, pages, titles: pages folded by folder, in order of title."""
    return pages.groupBy("folder").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("title", "page_id"))), 1, 5), lambda x: x["page_id"].cast("string")), ",").alias("first_five"))
