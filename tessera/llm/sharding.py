"""Sharding by extendible hashing, with DataFrame functions only.

A document's bucket is a prefix of the bits of its hash. The directory starts with the empty prefix; only a bucket
over the byte limit is split on the next bit, until every bucket fits. The documents are read once; their bytes are summed up by
cell of the coarse depth (some 32 cells a shard), and the buckets of all depths come from these sums. The
directory has an entry for each cell that occurs; several entries point to one bucket. Cells that are
still too big alone go on with all 32 bits; what is too big then (many rows with one id, or one huge
text) goes to overflow pages: by the text's md5, and equal rows counted out to as many pages as they need.

A text longer than the limit is a shard of its own, the only kind over the limit. Null text has no bytes; null ids
hash as the empty text. Repeated rows may lie in one shard or, when too big, in several. Documents meet the directory by a broadcast while
it is small, else by a join that Spark splits where a cell is hot; hot ids have no entry but overflow pages. Very long texts are only
measured and hashed. Only the id and the text are read, so extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialise, sent

BITS = 32


def directory(cells: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """cells(cell of `bits` bits, bytes) -> cell, depth of its bucket, for buckets of low bits or more that fit; none for cells too big even alone.

    A bucket is split while it is over the limit, so the buckets are those prefixes that fit and whose parent doesn't. All prefixes' sums come from
    one aggregate (combined in each task: the shallow ones are few); each cell then looks up its prefix at the depths that occur."""
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    at = F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth")
    sums = materialise(cells.select("cell", "bytes", at).groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes")), "sums")
    fits, split = sums.where(F.col("bytes") <= limit), sums.where(F.col("bytes") > limit)
    parents = split.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    halves = fits.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").select("depth", "prefix")
    buckets = materialise(halves.unionByName(fits.where(F.col("depth") == low).select("depth", "prefix")), "buckets")
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())  # at most bits + 1 numbers
    ladder = cells.select("cell", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("depth")).withColumn("prefix", prefix)
    out = materialise(ladder.join(buckets, ["depth", "prefix"]).select("cell", "depth"), "directory")
    drop(sums, buckets)
    return out


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, bytes, shard (its bits, `*` for none; overflow pages add the text's hash and a page number), depth."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("bigint").alias("bytes"), F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("text_md5"))
    rows = rows.withColumn("hash", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint"))
    rows = materialise(rows, "hashed")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    coarse = min(BITS, max(1, math.ceil(math.log2(max(total / limit, 1))) + 5))
    rows = rows.withColumn("cell", F.shiftright("hash", BITS - coarse))
    first = directory(rows.groupBy("cell").agg(F.sum("bytes").alias("bytes")), 0, coarse, limit)
    placed = materialise(rows.join(sent(first, first.count()), "cell", "left"), "placed")
    done, deep = placed.where(F.col("depth").isNotNull()), placed.where(F.col("depth").isNull()).drop("depth", "cell")
    bits = F.when(F.col("depth") == 0, "*").otherwise(F.expr("substring(lpad(bin(hash), 32, '0'), 1, depth)"))
    out = done.select("doc_id", "bytes", bits.alias("shard"), "depth")
    if coarse < BITS:
        rest = deep.groupBy(F.col("hash").alias("cell")).agg(F.sum("bytes").alias("bytes"))
        second = directory(rest, coarse + 1, BITS, limit) if deep.limit(1).count() else rest.select("cell", F.lit(0).alias("depth")).where("false")
        deep = deep.join(second.withColumnRenamed("cell", "hash"), "hash", "left")
        out = out.unionByName(deep.where(F.col("depth").isNotNull()).select("doc_id", "bytes", bits.alias("shard"), "depth"))
        deep = deep.where(F.col("depth").isNull())
    equal = deep.groupBy("doc_id", "hash", "text_md5", "bytes").agg(F.count("*").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    page = F.floor(F.col("i") / F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))), F.lit(1)))
    over = equal.select("doc_id", "bytes", F.concat_ws(".", F.lpad(F.bin("hash"), 32, "0"), "text_md5", page.cast("string")).alias("shard"), F.lit(BITS).alias("depth"))
    return out.unionByName(over)


def sql(limit: int) -> str:
    """The same over the view `documents`, for DuckDB (where no bucket needs overflow pages)."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
n AS (SELECT g.depth, h >> (32 - g.depth)::INT AS prefix, sum(bytes) AS s FROM d, (SELECT unnest(range(0, 33)) AS depth) g GROUP BY 1, 2),
f AS (SELECT * FROM n WHERE s <= {limit}),
m AS (SELECT d.h, min(f.depth) AS depth FROM (SELECT DISTINCT h FROM d) d, f WHERE d.h >> (32 - f.depth)::INT = f.prefix GROUP BY 1)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '*' ELSE substr(lpad(bin(h), 32, '0'), 1, depth::INT) END AS shard, depth::INT AS depth FROM d JOIN m USING (h)"""
