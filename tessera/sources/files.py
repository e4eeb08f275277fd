"""Text files as sources: one row for each .md or .txt file, whole text; what is no valid UTF-8 goes to rejects.

Files are listed and read by tasks, through the file systems that pyarrow knows: the driver holds no list of them, and empty files count."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.bindings import BATCH_BYTES, BATCH_ROWS
from tessera.streaming.ingest import shared_path

#: Files that a task reads, one after the other.
FILES_A_TASK = 20_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path or an address) and its path there."""
    return fs.FileSystem.from_uri(folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _entries(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder, and whether each is a folder; those that begin with a dot or an underscore are hidden."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as found:  # a name at a time
            yield from ((x.name, x.is_dir()) for x in found if x.name[0] not in "._")
    else:
        yield from ((x.base_name, x.type == fs.FileType.Directory) for x in files.get_file_info(fs.FileSelector(folder)) if x.base_name[0] not in "._")


def _lister(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.bool_())], ["rel", "folder"])
        rows: list[tuple[str, bool]] = []
        for rel in (x for b in batches for x in b["rel"].to_pylist()):
            for name, folder in _entries(files, posixpath.join(base, rel) if rel else base):
                rows.append((posixpath.join(rel, name), folder))
                if len(rows) == BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    return list_


def listed(spark: SparkSession, root: str) -> DataFrame:
    """rel: the path under root of every file there. Each level of folders is listed by tasks and written to the shared folder."""
    level, found = spark.createDataFrame([("",)], "rel string"), None
    while found is None or not level.isEmpty():
        path = shared_path(spark, "listing")
        level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rel").mapInArrow(_lister(root), "rel string, folder boolean").write.parquet(path)
        got = spark.read.schema("rel string, folder boolean").parquet(path)
        files, level = got.where("NOT folder").select("rel"), got.where("folder").select("rel")
        found = files if found is None else found.unionByName(files)
    return found


def _reader(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        batch = lambda rels, texts: pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(texts, pa.binary())], ["rel", "content"])
        rels, texts, size = [], [], 0
        for rel in (x for b in batches for x in b["rel"].to_pylist()):
            with files.open_input_file(posixpath.join(base, rel)) as f:
                texts.append(f.read())
            rels.append(rel)
            size += len(texts[-1])
            if len(rels) == BATCH_ROWS or size > BATCH_BYTES:
                yield batch(rels, texts)
                rels, texts, size = [], [], 0
        yield batch(rels, texts)

    return read


def contents(rels: DataFrame, root: str) -> DataFrame:
    """rel, content: the bytes of the files (rel) under root, dealt to tasks by number; a task holds a few files at a time."""
    parts = max(int(rels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rels.count() // FILES_A_TASK))
    return rels.repartition(parts, "rel").mapInArrow(_reader(root), "rel string, content binary")


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """rel, text, reason: each file under root with its text, or with the reason why it is none."""
    rels = listed(spark, root)
    known = F.col("rel").rlike(r"\.(md|txt)$")
    text = T.normalise_text(F.col("content").cast("string"))
    reason = F.when(~F.expr("is_valid_utf8(content)"), "encoding").when(T.trim_spaces(text) == "", "empty")
    read = contents(rels.where(known), root).select("rel", text.alias("text"), reason.alias("reason"))
    return read.unionByName(rels.where(~known).select("rel", F.lit(None).cast("string").alias("text"), F.lit("suffix").alias("reason")))


def source_columns() -> list:
    """id, directory and text of a scanned file."""
    return [T.source_id("rel").alias("id"), T.directory("rel").alias("directory"), F.col("text")]


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(sources, rejects): id, directory, text of each file under root; rejects carry the path and the reason."""
    marked = scanned(spark, root)
    return marked.where("reason IS NULL").select(*source_columns()), marked.where("reason IS NOT NULL").select("rel", "reason")
