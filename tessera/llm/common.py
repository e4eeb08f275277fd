"""Helpers that several corpus operators share: shared folders, table access, word and shingle hashes."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word cache may hold before it starts afresh (a memory bound, not a data bound).
CACHE_WORDS = 200_000


#: Rows of an Arrow batch; whole texts of ten thousand rows, Spark's default, take too much memory in each of many workers.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Give Python tasks of this session batches of few rows, unless it has a limit of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary folder; a cluster has none that all could see, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of tables and broadcasts that a scope (a stage of the pipeline) has made; see `scope`.
_WRITTEN: list[list[str | Broadcast]] = []


def materialise(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._table)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def leave(*shared: Broadcast) -> None:
    """Note broadcasts in the scope, if there is one, so that they can be destroyed with its tables."""
    if _WRITTEN:
        _WRITTEN[-1].extend(shared)


def clear(spark: SparkSession, left: list[str | Broadcast]) -> None:
    """Delete what a scope has noted; what reads it has to be written by then."""
    for one in dict.fromkeys(left):
        one.destroy() if isinstance(one, Broadcast) else delete(spark, one)
    left.clear()


@contextmanager
def scope(left: list[str | Broadcast]):
    """Within it, tables that `materialise` writes and broadcasts that operators leave are noted in the list; see `clear`."""
    _WRITTEN.append(left)
    try:
        yield
    finally:
        _WRITTEN.pop()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it new to df."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


#: A side of a join is broadcast up to so many bytes, at so many a row of a few longs in Spark's hash tables.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 160


def sent(table: DataFrame, rows: int) -> DataFrame:
    """A side of a join (a few longs a row), broadcast where its counted rows allow; beyond, Spark shuffles and splits skewed keys."""
    return F.broadcast(table) if rows * ROW_BYTES <= BROADCAST_BYTES else table


def by_bytes(column: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """An Arrow string column in slices of at most so many bytes of text, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield column.slice(at, to - at)
        at = to


def byte_strings(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Texts of an Arrow string column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: What each operator's worker-wide cache is emptied by; one operator's caches are kept at a time.
_EMPTY: dict[str, list[Callable[[], None]]] = {}
_FOCUS: list[str] = [""]


def cached_by(name: str, empty: Callable[[], None]) -> None:
    """Note a worker-wide cache of an operator."""
    _EMPTY.setdefault(name, []).append(empty)


def focus(name: str) -> None:
    """Called where an operator's task begins: empties what other operators left in this reused Python worker."""
    if _FOCUS[0] != name:
        for other, calls in _EMPTY.items():
            for empty in calls if other != name else []:
                empty()
        gc.collect()  # a cache may lie in a cycle, as a codec and its memory of pre-tokens do
        give_back()
        _FOCUS[0] = name


def give_back() -> None:
    """Return freed memory to the system, which a reused worker would else keep."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task's function, which returns freed memory when it ends, so that idle workers stay small beside later stages."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


class WordHashes(dict):
    """Word -> signed 64-bit hash, kept for the life of a Python worker and bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()
cached_by("words", _WORDS.clear)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; of fewer words than k, one hash of the whole sequence; of none, nothing."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out * _M1 + h[i : len(h) - k + 1 + i])
    return out


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the columns' text: the same in Spark and in SQL elsewhere."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
