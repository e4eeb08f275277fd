"""A sink that lays lines out as files, one a page, all or none: a Spark data source with commit and abort."""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.files import opened

#: Files that are moved at a time, and that are asked for at a time; a move waits for the file system.
MOVERS, ASKED = 32, 1024
#: Files of the staging folder: where a task's files belong (a line each, in their order), and the tasks that count.
TARGETS, TASKS = "targets", "tasks"


@dataclass
class Written(WriterCommitMessage):
    """The folder under root of a task that has written files; what belongs where is listed there, so that the driver needn't hold it."""

    own: str


def publish(files: fs.FileSystem, root: str, own: str) -> None:
    """Move what a task has written to its place. What is moved already is passed over, so that a move may be done again."""
    made: set[str] = set()

    def move(source: str, target: str) -> None:
        try:
            files.move(source, target)
        except OSError:
            if files.get_file_info(source).type != fs.FileType.NotFound or files.get_file_info(target).type == fs.FileType.NotFound:
                raise

    with files.open_input_stream(posixpath.join(root, own, TARGETS)) as f, ThreadPoolExecutor(MOVERS) as pool:
        lines = enumerate(io.TextIOWrapper(f, "utf-8"))
        while some := [(posixpath.join(root, own, str(i)), posixpath.join(root, json.loads(x))) for i, x in islice(lines, ASKED)]:
            for folder in {posixpath.dirname(target) for _, target in some} - made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            for _ in pool.map(move, *zip(*some)):
                pass


class PageWriter(DataSourceWriter):
    """Tasks write rows (path, line), each path in one run, into a folder of the job's own beside the pages. The commit moves what the tasks
    that count have written to its place and drops the folder; an abort drops the folder, so that a failed job leaves no page. (A task that is
    killed while it writes may leave files in the folder of its job after that, never among the pages.) With a staging folder given, the commit
    only notes in it which tasks count, and leaves the moves to whoever gave it."""

    def __init__(self, folder: str, staging: str | None = None):
        self.folder = folder
        self.later = staging is not None
        self.staging = staging or staging_name()

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = opened(self.folder)
        own, seen, out, last = posixpath.join(self.staging, uuid.uuid4().hex), set(), None, None
        files.create_dir(posixpath.join(root, own), recursive=True)
        targets = files.open_output_stream(posixpath.join(root, own, TARGETS), buffer_size=1 << 16)
        try:
            for row in rows:
                path, line = row["path"], row["line"]
                if path != last:
                    if out:
                        out.close()
                    if path in seen or path.startswith("/") or ".." in path.split("/"):
                        raise ValueError(f"page {path} comes twice in a task, or lies outside the folder")
                    targets.write(json.dumps(path).encode() + b"\n")
                    out, last = files.open_output_stream(posixpath.join(root, own, str(len(seen)))), path
                    seen.add(path)
                else:
                    out.write(b"\n")
                out.write((line or "").encode())
        except BaseException:
            for f in (out, targets):
                if f:
                    f.close()
            files.delete_dir(posixpath.join(root, own))
            raise
        for f in (out, targets):
            if f:
                f.close()
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.folder)
        tasks = [m.own for m in messages if m]
        if self.later:
            files.create_dir(posixpath.join(root, self.staging), recursive=True)
            with files.open_output_stream(posixpath.join(root, self.staging, TASKS)) as f:
                f.write(json.dumps(tasks).encode())
            return
        for own in tasks:
            publish(files, root, own)
        drop(files, root, self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        drop(*opened(self.folder), self.staging)


def staging_name() -> str:
    return f"_staging-{uuid.uuid4().hex}"


def drop(files: fs.FileSystem, root: str, staging: str) -> None:
    path = posixpath.join(root, staging)
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_dir(path)


class PageFiles(DataSource):
    """`df.write.format("page_files").mode("append").save(folder)` for rows (path, line)."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], self.options.get("staging"))


def _publisher(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        for b in batches:
            for own in b["own"].to_pylist():
                publish(files, root, own)
            yield b

    return moved


def save(rows: DataFrame, folder: str) -> None:
    """Rows (path, line), each path in one run, as files under folder. First all are written beside their places, and a failure there leaves no page;
    then tasks move them, each what one task has written, so that the driver knows only the names of the tasks. A move that fails is done again by
    the next attempt; if the job gives up, what isn't moved is left in the staging folder."""
    spark, staging = rows.sparkSession, staging_name()
    spark.dataSource.register(PageFiles)
    rows.select("path", "line").write.format("page_files").option("staging", staging).mode("append").save(folder)
    files, root = opened(folder)
    with files.open_input_stream(posixpath.join(root, staging, TASKS)) as f:
        tasks = json.loads(f.read())
    if tasks:
        todo = spark.createDataFrame([(own,) for own in tasks], "own string").repartition(len(tasks), "own")
        todo.mapInArrow(_publisher(folder), "own string").write.format("noop").mode("overwrite").save()
    drop(files, root, staging)


def write_lines(lines: DataFrame, folder: str) -> None:
    """Lines (kb_id, page, section, key, line) as files kb_id/page.md under folder: a page's lines in order, parted by line ends. A page is sorted by
    Spark, which spills, and written line by line, so no page is held whole. Lines without a page are left out."""
    path = F.concat_ws("/", "kb_id", F.concat("page", F.lit(".md")))
    rows = lines.where("page IS NOT NULL").withColumn("path", path).repartition("path").sortWithinPartitions("path", "section", "key", "line")
    save(rows, folder)


def write_texts(texts: DataFrame, folder: str) -> None:
    """Whole texts (path, text) as files."""
    save(texts.select("path", F.col("text").alias("line")).sortWithinPartitions("path"), folder)
