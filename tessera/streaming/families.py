"""Streams into versioned claims: each batch compiles its candidates into the families they touch, and can run again at any time.

The state is a table of claims in the shared folder. Batch n writes the complete versions of the families that it changed, so what it writes grows
with the batch, not with the state; every `full` batches one writes the whole state, and reading goes back no farther than to
that. Batch n reads only what batches before it wrote and replaces its own output, so a batch that was killed half way, or comes
again, gives the same rows; there is no other state. Claims are written last: what a batch wrote besides counts only once its claims are there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import compile as K
from tessera.operators.claims import EXCLUSIVE
from tessera.streaming.ingest import shared_path

#: Partitions of a batch's claims by family, so that a batch reads the parts of the state that it touches.
BUCKETS = 64
STORED = f"{K.CLAIM}, bucket int"
EVIDENCE = "claim_id string, source_id string, start bigint, end bigint, quote string, weight double"


def bucket_of(family_id: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(family_id), F.lit(buckets)).cast("int")


class FamilyStore:
    """Claims and evidence by batch, under one folder."""

    def __init__(self, spark: SparkSession, path: str, exclusive: list[str] = EXCLUSIVE, full: int = 16, buckets: int = BUCKETS):
        self.spark, self.path, self.exclusive, self.full, self.buckets = spark, path.rstrip("/"), exclusive, full, buckets

    def _read(self, kind: str, schema: str, first: int, below: int) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={n}" for n in range(first, below)]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def claims(self, below: int, touched: DataFrame | None = None) -> DataFrame:
        """The claims as batches before `below` left them; of the families in `touched` (family_id) alone, if it is given."""
        base = max((below - 1) // self.full * self.full, 0)
        rows = self._read("claims", STORED, base, below)
        if touched is not None:
            parts = [r[0] for r in touched.select(bucket_of("family_id", self.buckets)).distinct().collect()]  # at most so many numbers
            rows = rows.where(F.col("bucket").isin(parts)).join(touched.select("family_id").distinct(), "family_id", "left_semi")
        newest = rows.groupBy("family_id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["family_id", "batch"], "left_semi").select(*K.CLAIM_COLUMNS)

    def evidence(self, below: int) -> DataFrame:
        return self._read("evidence", EVIDENCE, 0, below).drop("batch")

    def take(self, number: int, candidates: DataFrame, aliases: DataFrame, types: DataFrame, allowed: DataFrame, **options) -> None:
        """Compile a batch of candidates (see `compile.ingest`). Any number of times: it reads what batches before it wrote, and replaces what it wrote itself."""
        named = K.typed(candidates, aliases, types)
        touched = named.select(T.family_id("subject", "predicate", "object_type").alias("family_id")).distinct()
        whole = number > 0 and number % self.full == 0
        held = self.claims(number, None if whole else touched)
        out = K.ingest(candidates, held, aliases, types, allowed, exclusive=self.exclusive, **options)
        out.evidence.write.mode("overwrite").parquet(f"{self.path}/evidence/batch={number}")
        rows = out.claims if whole else out.claims.join(out.changed.select("family_id").distinct(), "family_id", "left_semi")
        rows = rows.withColumn("bucket", bucket_of("family_id", self.buckets))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/claims/batch={number}")


def stream_claims(docs: DataFrame, candidates: Callable[[DataFrame], DataFrame], aliases: DataFrame, types: DataFrame, allowed: DataFrame, store: FamilyStore, checkpoint: str, **options) -> int:
    """Run a stream of documents until its input ends: each batch's candidates go into the store. Gives the number of batches; started again with
    the same checkpoint it goes on with the batch that failed."""

    def merge(batch: DataFrame, number: int) -> None:
        store.take(number, candidates(batch), aliases, types, allowed, **options)

    run = docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return batches_done(store.spark, checkpoint)


def batches_done(spark: SparkSession, checkpoint: str) -> int:
    """How many batches a checkpoint has committed (the highest number and one)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=-1) + 1


def _parts(df: DataFrame, key: Column, n: int) -> Iterator[DataFrame]:
    """The rows of df in n parts by rising key."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max((high or 0) - (low or 0) + 1, 1)
    for k in range(n):
        yield df.where((key - F.lit(low)) * n >= k * width).where((key - F.lit(low)) * n < (k + 1) * width)


def slices(df: DataFrame, key: Column, n: int) -> str:
    """A folder with the rows of df in n files by rising key, one written after the other, as a stream would find them. Each is written by one task; see `arriving` for more rows."""
    path = shared_path(df.sparkSession, "slices")
    for part in _parts(df, key, n):
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def arriving(df: DataFrame, key: Column, n: int, path: str) -> Iterator[int]:
    """Write the rows of df into a folder in n parts by rising key, by as many tasks as read them; between two parts the caller runs its stream."""
    for k, part in enumerate(_parts(df, key, n)):
        part.write.mode("append").parquet(path)
        yield k
