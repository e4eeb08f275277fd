"""Registered queries on text files: documents written out and scanned again, and pages as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans import answers
from tessera.plans.registry import registry
from tessera.sources import bindings as B
from tessera.sources import files as S
from tessera.sources import pages as P
from tessera.streaming.ingest import shared_path

QUERIES, SQL, query = registry()


@query("""WITH f AS (SELECT coalesce(lang, 'none') AS folder, doc_id, CASE doc_id % 10 WHEN 3 THEN '.txt' WHEN 7 THEN '.pdf' ELSE '.md' END AS suffix, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS t FROM f)
SELECT folder || '__' || doc_id AS id, '/' || folder AS directory, md5(t) AS text_md5, NULL AS reason FROM n WHERE suffix <> '.pdf' AND trim(t) <> ''
UNION ALL SELECT folder || '/' || doc_id || suffix, NULL, NULL, CASE WHEN suffix = '.pdf' THEN 'suffix' ELSE 'empty' END FROM n WHERE suffix = '.pdf' OR trim(t) = ''""")
def s1_scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of three kinds, scanned: sources with their text, and rejects."""
    docs = B.read(spark, d, "documents")
    suffix = F.when(F.col("doc_id") % 10 == 3, ".txt").when(F.col("doc_id") % 10 == 7, ".pdf").otherwise(".md")
    folder = shared_path(spark, "files")
    P.write_texts(docs.select(F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), "doc_id", suffix).alias("path"), F.coalesce("text", F.lit("")).alias("text")), folder)
    good = F.col("reason").isNull()
    return S.scanned(spark, folder).select(
        F.when(good, T.source_id("rel")).otherwise(F.col("rel")).alias("id"), F.when(good, T.directory("rel")).alias("directory"), F.when(good, F.md5("text")).alias("text_md5"), "reason"
    )


@query(f"WITH p AS ({answers.SQL['f30_source_pages']}) SELECT kb_id || '/' || page || '.md' AS path, sha256(string_agg(line, chr(10) ORDER BY section, key, line)) AS content_sha256, count(*) AS lines FROM p WHERE kb_id IS NOT NULL GROUP BY kb_id, page")
def s11_written_pages(spark: SparkSession, d: str) -> DataFrame:
    """Source pages as files, read back: path, digest of the content, and how many lines were rendered."""
    lines = answers.f30_source_pages(spark, d).where("kb_id IS NOT NULL")
    folder = shared_path(spark, "pages")
    P.write_lines(lines, folder)
    files = S.contents(S.listed(spark, folder), folder).select(F.col("rel").alias("path"), F.sha2("content", 256).alias("content_sha256"))
    counted = lines.groupBy(F.concat_ws("/", "kb_id", F.concat("page", F.lit(".md"))).alias("path")).agg(F.count("*").alias("lines"))
    return files.join(counted, "path")
