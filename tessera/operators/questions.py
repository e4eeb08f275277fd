"""Questions and subjects that lean on their context: completing short questions, binding subjects to a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Patterns of a question that leaves out what it is about.
INCOMPLETE = [
    r"^(那|这|它|该)(个|种|项|笔)?",
    r"(能退|可以退|能不能退|退货吗|支持吗|怎么退|如何退)",
    r"(多久|多少天|几时|什么时候).{0,6}$",
    r"(谁承担|运费谁|谁出运费|运费吗)",
    r"(时效|期限|有效期).{0,4}(呢|吗)?$",
    r"^(是不是|是否|有没有|能不能).{0,10}(吗|么|呢)?$",
    r"^.{1,12}(吗|呢|么)$",
]
# Words that stand for the document's product, for a party to it, and openings of such subjects.
PRODUCT_WORDS = ["本产品", "本理财产品", "本理财计划", "本计划", "该产品", "该理财产品", "该理财计划"]
ROLE_WORDS = ["投资者", "客户", "托管人", "管理人", "份额持有人"]
OPENINGS = ["本理财产品", "本理财计划", "本产品", "本计划", "该理财产品", "该理财计划", "该产品"]
KINDS = ["产品", "计划", "理财"]
# Subjects that are sizes or rows of figures and no topics.
SIZE_SUBJECT = r"(?i)^(女装|男装)?尺码[A-Z0-9XL]+$|^中国码\d+$|^欧码\d+$|^美码[\d.]+$"
NUMERIC_SUBJECT = r"^[\d\-~、，,cm\s]+$"


def incomplete(question: Column) -> Column:
    q = T.strip(question)
    return F.exists(F.array(*map(F.lit, INCOMPLETE)), lambda p: F.regexp_like(q, p)) & (q != "")


def rewrite(questions: DataFrame, episodes: DataFrame, terms: list[str]) -> DataFrame:
    """session_id, question, anchor: an incomplete question (session_id, question) that names no term gets in front of it the
    longest term of the newest episode (session_id, seq, q, a) with one. Terms are a domain's dictionary, a small fixed list."""
    known = F.array(*map(F.lit, sorted({t.strip() for t in terms} - {""}, key=lambda t: (-len(t), t))))
    first = lambda c: F.get(F.filter(known, lambda t: F.contains(c, t)), F.lit(0))
    said = episodes.select("session_id", "seq", first(F.concat_ws(" ", "q", "a")).alias("term")).where("term IS NOT NULL")
    anchors = said.groupBy("session_id").agg(F.max_by("term", "seq").alias("anchor"))
    short = T.strip("question")
    use = F.coalesce(incomplete(F.col("question")) & first(F.col("question")).isNull() & ~F.startswith(short, F.col("anchor")), F.lit(False))
    both = questions.select("session_id", "question").join(anchors, "session_id", "left").withColumn("use", use)
    return both.select("session_id", F.when(F.col("use"), F.concat("anchor", short)).otherwise(F.col("question")).alias("question"), F.when(F.col("use"), F.col("anchor")).alias("anchor"))


def bind_subject(subject: Column, anchor: Column) -> Column:
    """The subject with words that stand for the document put as the document's anchor; unchanged without an anchor."""
    s, a = T.strip(F.coalesce(subject, F.lit(""))), T.strip(F.coalesce(anchor, F.lit("")))
    of = lambda rest: F.concat(a, F.lit("的"), rest)
    out = F.when((s == "") | (a == "") | (s == a) | F.startswith(s, F.concat(a, F.lit("的"))), s)
    out = out.when(s.isin(PRODUCT_WORDS), a).when(s.isin(ROLE_WORDS), of(s))
    for opening in OPENINGS:
        rest = F.regexp_replace(F.substring(s, len(opening) + 1, 1 << 30), r"^[的 \t]+", "")
        out = out.when(F.startswith(s, F.lit(opening)), F.when(rest != "", of(rest)).otherwise(a))
    kind = F.exists(F.array(*map(F.lit, KINDS)), lambda k: F.contains(s, k))
    vague = F.startswith(s, F.lit("本")) & kind & ~F.contains(s, F.lit("公司")) & (F.length(s) <= 16)
    return out.when(vague, a).otherwise(s)


def topic_worthy(subject: Column) -> Column:
    """Whether a claim's subject makes a topic: no sizes, no rows of figures, no long lists."""
    s = T.strip(subject)
    return topic_shaped(s) & ~s.rlike(SIZE_SUBJECT) & ~s.rlike(NUMERIC_SUBJECT)


def topic_shaped(subject: Column) -> Column:
    """Whether a subject is long enough for a topic and no long list; figures and sizes may be."""
    s = T.trim_spaces(subject)
    return (F.length(s) > 2) & ~((F.length(s) > 48) & s.rlike("[、，]"))
