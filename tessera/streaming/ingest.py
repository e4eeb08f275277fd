"""Incremental forms: documents to chunks with idempotent merges, and the newest episodes of each session within bounded state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import chunks as C


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; a cluster has none that all could see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def as_stream(spark: SparkSession, source: str, per_batch: int) -> DataFrame:
    """The parquet files of a folder, or one file, as a stream."""
    table = spark.read.parquet(source)
    name = source.rstrip("/").rpartition("/")[2]
    alone = all(f.rstrip("/").endswith("/" + name) for f in table.inputFiles())
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_batch)
    return reader.option("pathGlobFilter", name).parquet(source.rstrip("/").rpartition("/")[0]) if alone else reader.parquet(source)


def ingest_chunks(spark: SparkSession, source: str, per_batch: int = 1, **limits) -> DataFrame:
    """Chunks of the documents in a folder or file that is read as a stream.

    A batch writes its own partition, by its number, so a batch that runs again replaces itself; chunk ids hash
    their content, so the union of all batches equals the batch job's result."""
    out, checkpoint = shared_path(spark, "stream-chunks"), shared_path(spark, "stream-state")
    docs = as_stream(spark, source, per_batch)
    rows = docs.select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")

    def merge(batch: DataFrame, number: int) -> None:
        C.chunk(batch, **limits).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def session_memory(rows: DataFrame, out: str, checkpoint: str, most: int = 10, idle_ms: int = 3_600_000, late: str = "10 minutes") -> dict:
    """Run a stream of rows (session_id, seq, at) until its input ends; `remembered(out)` gives each session's newest `most` by seq.

    The state of a session is its newest numbers and its last time. It goes when event time, less `late`, is past that time by idle_ms, so
    state is bounded by the sessions of a window, not by all that ever were; a session that comes back begins anew and
    its numbers are merged when they are read. Rows of any order within `late` count by seq. Gives the last progress of the state."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, last = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for f in frames:
            seqs += f["seq"].tolist()
            last = max(last, int(f["ms"].max()))
        seqs = sorted(set(seqs))[-most:]
        if last + idle_ms > state.getCurrentWatermarkMs():
            state.update((seqs, last))
            state.setTimeoutTimestamp(last + idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"session_id": [key[0]], "seqs": [seqs]})

    kept = rows.where("session_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("session_id").applyInPandasWithState(keep, "session_id string, seqs array<bigint>", "seqs array<bigint>, last bigint", "update", "EventTimeTimeout")
    run = kept.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run.lastProgress["stateOperators"][0] if run.lastProgress and run.lastProgress["stateOperators"] else {}


def remembered(spark: SparkSession, out: str, most: int = 10) -> DataFrame:
    """session_id, seq: the newest numbers of each session that its batches wrote. Each batch gave at most `most`, and what is among the newest at last was so when it came."""
    seen = spark.read.schema("session_id string, seqs array<bigint>").parquet(out).select("session_id", F.explode("seqs").alias("seq")).distinct()
    return seen.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).where(F.col("n") <= most).drop("n")
