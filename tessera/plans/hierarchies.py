"""Registered queries on canonical topic names and the hierarchy of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import hierarchy as H
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()

# Every fifth line is a heading; headings of up to three words seed the hierarchy.
HEADS = """ln AS (SELECT lang AS kb_id, doc_id, unnest(string_split(text, chr(10))) AS name, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
hd AS (SELECT kb_id, name, doc_id * 1000000 + i AS ord FROM ln WHERE i % 5 = 0 AND name <> '' AND kb_id IS NOT NULL),
hw AS (SELECT DISTINCT kb_id, name, string_split(name, ' ') AS w FROM hd)"""
NORM = "regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}]+', '', 'g')"
TREE = f"""{HEADS}, n AS (SELECT kb_id, name, min(ord) AS ord FROM hd GROUP BY 1, 2),
seed AS (SELECT kb_id, name, w[1] AS hub, CASE len(w) WHEN 2 THEN w[2] END AS leaf, CASE len(w) WHEN 1 THEN 'hub' WHEN 2 THEN 'leaf' ELSE 'snippet' END AS role, CASE len(w) WHEN 3 THEN w[3] END AS target FROM hw WHERE len(w) <= 3),
known AS (SELECT DISTINCT kb_id, hub FROM seed WHERE hub NOT IN ('', '未分类')),
rest AS (SELECT n.* FROM n ANTI JOIN seed USING (kb_id, name)),
longer AS (SELECT *, substr(name, 1, 2) AS pair FROM rest WHERE length(name) > 4),
given AS (SELECT r.kb_id, r.name, r.pair, r.ord, arg_min(k.hub, (-length(k.hub), k.hub)) AS taken FROM longer r LEFT JOIN known k ON r.kb_id = k.kb_id AND k.hub <> r.name AND (substr(k.hub, 1, 2) = r.pair OR k.hub = substr(r.name, 1, 1)) GROUP BY 1, 2, 3, 4),
firsts AS (SELECT kb_id, pair, min(struct_pack(o := ord, n := name)) AS own FROM given WHERE taken IS NULL GROUP BY 1, 2),
both2 AS (SELECT g.kb_id, g.name, g.ord, g.taken, CASE WHEN struct_pack(o := g.ord, n := g.name) > own THEN own.n END AS later FROM given g LEFT JOIN firsts USING (kb_id, pair)),
found AS (SELECT kb_id, name, ord, CASE WHEN taken IS NULL OR length(later) > length(taken) OR (length(later) = length(taken) AND later < taken) THEN coalesce(later, taken) ELSE taken END AS hub FROM both2),
placed AS (SELECT kb_id, name, hub, leaf, role, target, 0 AS phase, ord FROM n JOIN seed USING (kb_id, name) UNION ALL
  SELECT kb_id, name, coalesce(hub, name), CASE WHEN hub IS NULL THEN NULL WHEN starts_with(name, hub) THEN coalesce(nullif(substr(name, length(hub) + 1), ''), name) ELSE name END, CASE WHEN hub IS NULL THEN 'hub' ELSE 'leaf' END, NULL, 1, ord FROM found),
run AS (SELECT kb_id, hub, phase, ord, name, row_number() OVER (PARTITION BY kb_id, hub ORDER BY phase, ord, name) AS k, min(struct_pack(p := phase, o := ord, n := name)) OVER (PARTITION BY kb_id, hub) AS f FROM placed),
brief AS (SELECT b.kb_id, b.name, b.ord, arg_min(r.hub, (-r.k, r.f.p, r.f.o, r.f.n)) AS hub FROM rest b LEFT JOIN run r ON r.kb_id = b.kb_id AND (r.phase, r.ord, r.name) < (1, b.ord, b.name) WHERE length(b.name) <= 4 GROUP BY 1, 2, 3),
tree AS (SELECT * FROM placed UNION ALL SELECT kb_id, name, coalesce(hub, '未分类'), NULL, 'snippet', NULL, 1, ord FROM brief)"""


def headings(spark: SparkSession, d: str) -> DataFrame:
    """kb_id, name, ord: every fifth line of each document, the language being the knowledge base."""
    lines = B.kb_sources(spark, d).select("kb_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "name"))
    return lines.where("i % 5 = 0 AND name <> '' AND kb_id IS NOT NULL").select("kb_id", "name", (F.col("doc_id") * 1000000 + F.col("i")).alias("ord"))


def seeds(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and snippets told by headings of one to three words: the first is the hub, the second the leaf, or the third the leaf a snippet belongs to."""
    w = heads.select("kb_id", "name", F.split("name", " ").alias("w")).distinct()
    parents = w.where(F.size("w") <= 2).select("kb_id", "name", F.col("w")[0].alias("hub"), F.get("w", F.lit(1)).alias("leaf"), F.when(F.size("w") == 1, "hub").otherwise("leaf").alias("role"))
    return parents, w.where(F.size("w") == 3).select("kb_id", "name", F.col("w")[0].alias("hub"), F.col("w")[2].alias("target"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    heads = H.cut(headings(spark, d).groupBy("kb_id", "name").agg(F.min("ord").alias("ord")))  # texts are read once
    return H.hierarchy(heads, *seeds(heads))


@query(f"WITH {TREE} SELECT kb_id, name, hub, leaf, role, target FROM tree")
def f26_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).drop("phase", "ord")


@query(f"""WITH {TREE}, l AS (SELECT kb_id, hub, phase, ord, nullif(CASE role WHEN 'leaf' THEN leaf WHEN 'snippet' THEN target END, '') AS leaf FROM tree),
b AS (SELECT kb_id, hub, leaf, min(struct_pack(p := phase, o := ord)) AS f FROM l GROUP BY 1, 2, 3)
SELECT kb_id, hub, leaf, f.p AS phase, f.o AS ord FROM b WHERE leaf IS NOT NULL UNION ALL SELECT kb_id, hub, NULL, min(phase), arg_min(ord, (phase, ord)) FROM l GROUP BY 1, 2 HAVING count(leaf) = 0""")
def f26_hub_leaves(spark: SparkSession, d: str) -> DataFrame:
    return H.hub_leaves(tree(spark, d))


@query(f"""WITH {HEADS}, w AS (SELECT name, {NORM} AS form FROM hd GROUP BY 1),
al AS (SELECT {NORM} AS alias, min(regexp_replace(lower(trim(w[1])), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS canonical FROM hw WHERE len(w) = 2 GROUP BY 1 UNION ALL SELECT '尺码表', '尺码选择' UNION ALL SELECT '尺码指南', '尺码选择'),
hs AS (SELECT DISTINCT canonical AS head FROM al WHERE canonical <> ''),
f AS (SELECT form, arg_max(head, length(head)) AS begun FROM (SELECT DISTINCT form FROM w WHERE form <> '') LEFT JOIN hs ON starts_with(form, head) GROUP BY 1)
SELECT coalesce(al.canonical, f.begun, w.form) AS canon, count(*) AS names, min(w.name) AS first_name FROM w LEFT JOIN al ON alias = form LEFT JOIN f USING (form) WHERE form <> '' GROUP BY 1""")
def f14_canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by canonical form; headings of two words are aliases of their first word."""
    names = headings(spark, d).select("name").distinct()
    two = names.withColumn("w", F.split("name", " ")).where(F.size("w") == 2).select(T.topic_name("name").alias("alias"), T.topic_name(F.col("w")[0]).alias("canonical"))
    got = H.canonical_names(names, two.unionByName(H.default_aliases(spark))).where(T.topic_name("name") != "")
    return got.groupBy("canon").agg(F.count("*").alias("names"), F.min("name").alias("first_name"))
