"""Registered queries on domain packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import packs as P
from tessera.operators import rules as R
from tessera.plans.registry import registry
from tessera.sources import bindings as B

QUERIES, SQL, query = registry()

EN = """tx AS (SELECT 'doc-' || doc_id AS id, text FROM documents WHERE lang = 'en' OR lang = 'de'),
lc AS (SELECT id, unnest(regexp_extract_all(text, '(?:Licensed|Released) under (?:the )?([^\\n]+)', 1)) AS object FROM tx),
em AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]')) AS object FROM tx),
un AS (SELECT id, unnest(list_zip(regexp_extract_all(text, 'under (?:the )?(([A-Z][A-Za-z]+)[^\\n]*)', 2), regexp_extract_all(text, 'under (?:the )?(([A-Z][A-Za-z]+)[^\\n]*)', 1))) AS m FROM tx),
al AS (SELECT id, 'license' AS subject, 'granted_under' AS predicate, trim(object) AS object FROM lc UNION ALL SELECT id, 'contact', 'has_email', object FROM em UNION ALL SELECT id, m[1], 'under', trim(m[2]) FROM un)"""


def found(spark: SparkSession, d: str) -> DataFrame:
    """All packs over all documents: English and German texts are of the English pack, French of the shop's, others of loans or none."""
    pack = F.when(F.col("kb_id").isin("en", "de"), P.ENGLISH).when(F.col("kb_id") == "fr", P.SHOP).when(F.col("kb_id") == "es", P.LOAN)
    return R.apply_packs(B.kb_sources(spark, d).select("id", "text", pack.alias("pack")), P.rules(spark))


@query(f"WITH {EN} SELECT id, subject, predicate, object FROM al WHERE object <> ''")
def t10_pack_claims(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("id", "subject", "predicate", "object")


@query(f"WITH {EN} SELECT id, CASE predicate WHEN 'granted_under' THEN 'The ' || subject || ' is granted under ' || object ELSE subject || predicate || object END AS sentence FROM al WHERE object <> ''")
def x1_claim_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the packs in the words of their pack."""
    c = found(spark, d).join(F.broadcast(P.forms(spark)), ["pack", "predicate"], "left")  # a few rows
    return c.select("id", R.sentence(F.col("form"), F.col("subject"), F.col("predicate"), F.col("object")).alias("sentence"))
