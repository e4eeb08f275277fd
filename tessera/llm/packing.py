"""Token-ID output: best-fit-decreasing packing of whole documents into rows of fixed length.

Texts become token ids where they are read, and only ids (two bytes each while the vocabulary allows) are shuffled, to
as many shards as keep each near `shard_bytes` of text; one task packs a shard. Texts longer than a row are cut into
pieces of a row's length, without loss; pieces of full length are rows of their own, the rest go, longest first, to the
row with the least room that still holds them. A segment tree over room sizes finds it. So tasks are bounded by the
shard size, except for one text that alone is longer.

The result is binary: a row's ids and position resets are little-endian int32 of fixed width, so that a shard's rows laid end to
end are its id matrix; `write` lays them out as files, `numbers` reads a column back as an array.

A shard is chosen by the hash of id, text and how often the task has met this row before; so neither a hot id nor rows
that repeat a million times gather in one shard. Null and empty texts have no tokens and lie in no row. Null ids stay null.
Repeated rows are packed each: `seqs` numbers the documents of a shard, and shard and number tell apart rows of one
id. Every piece keeps its start among its document's tokens, so `unpack` gives back the ids of every row. Only the id and the text are
read, so extra columns do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes

# Fixed value: the public byte-level pre-tokeniser pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose ids a packing task should sort at most.
TASK_BYTES = 32 << 20
SCHEMA = "shard int, row int, ids binary, n_ids int, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, seqs array<int>, starts array<int>"
_ENCODERS: dict = {}


def encoder(ranks_file: str):
    """A byte-level BPE encoder from a file of ranks, made once in a worker."""
    if ranks_file not in _ENCODERS:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks_file] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[ranks_file]


class Rooms:
    """Open rows by the room left in them, under a segment tree that finds the least room of at least a size."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.tree, self.rows = [0] * (2 * self.width), [deque() for _ in range(most + 1)]

    def change(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        if room > 0:
            self.rows[room].append(row)
            self.change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and row of the tightest fit, removed; None if no open row has the room."""
        i = size + self.width
        while not self.tree[i]:  # up to the nearest right neighbour that holds a room
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.width
        self.change(room, -1)
        return room, self.rows[room].popleft()


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length): full pieces first, then best fit, longest first, ties in order."""
    rows, rest = [], []
    for d, n in enumerate(lengths):
        full = n // size
        rows += [[(d, i * size, size)] for i in range(full)]
        if n % size:
            rest.append((-(n % size), d, full * size))
    rooms = Rooms(size)
    for n, d, start in sorted(rest):
        if hit := rooms.take(-n):
            room, row = hit
        else:
            room, row = size, len(rows)
            rows.append([])
        rows[row].append((d, start, -n))
        rooms.put(room + n, row)
    return rows


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def matrix(flat: np.ndarray, width: int) -> pa.Array:
    """Rows of int32, each as bytes."""
    rows = len(flat) // width
    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * (4 * width))
    return pa.Array.from_buffers(pa.binary(), rows, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(flat, dtype="<i4"))])


def shard_rows(shard: int, doc_ids: list[int | None], ids: list[np.ndarray], size: int, pad: int) -> pa.RecordBatch:
    """A shard's documents as packed rows: pieces are laid out by one pass over the shard, not row by row."""
    plan = pack([len(x) for x in ids], size)
    rows = len(plan)
    piece = np.array([p for row in plan for p in row], dtype=np.int64).reshape(-1, 3)
    doc, start, n = piece[:, 0], piece[:, 1], piece[:, 2]
    many = np.array([len(row) for row in plan], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(many)])
    used = np.add.reduceat(n, first[:-1]) if rows else n
    # Where each piece lies in its row, and each of its tokens in the matrix and among all tokens of the shard.
    before = np.cumsum(n) - n
    place = before - np.repeat(before[first[:-1]], many) if rows else before
    inside = np.arange(int(n.sum())) - np.repeat(before, n)
    at = np.repeat(np.repeat(np.arange(rows) * size, many) + place, n) + inside
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    from_ = np.repeat((np.cumsum(lengths) - lengths)[doc] + start, n) + inside
    flat, position = np.full(rows * size, pad, dtype=np.int32), np.zeros(rows * size, dtype=np.int32)
    flat[at], position[at] = np.concatenate(ids)[from_], inside
    ends = np.insert((place + n).astype(np.int32), first[:-1], 0)
    of = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
    doc_lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), of)
    cols = [pa.array(np.full(rows, shard, np.int32)), pa.array(np.arange(rows, dtype=np.int32)), matrix(flat, size), pa.array(used.astype(np.int32)), lists(ends, many + 1), matrix(position, size), doc_lists, lists(doc.astype(np.int32), many), lists(start.astype(np.int32), many)]
    return pa.RecordBatch.from_arrays(cols, ["shard", "row", "ids", "n_ids", "cu_seqlens", "position_ids", "doc_ids", "seqs", "starts"])


def packed(docs: DataFrame, ranks_file: str, size: int = 2048, pad: int = 50256, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of all of docs: ids (padded to size), n_ids, cu_seqlens, position_ids, and the pieces' doc_ids, seqs and starts."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file)
        kind = np.uint16 if enc.n_vocab <= 1 << 16 else np.int32
        met: dict[int, int] = {}
        for batch in batches:
            of = iter(batch.column(0).to_pylist())
            for part in by_bytes(batch.column(1)):
                out = []
                for text in part.to_pylist():
                    doc = next(of)
                    key = xxhash.xxh3_64_intdigest(f"{doc}|{text}".encode())
                    met[key] = again = met.get(key, -1) + 1
                    out.append((xxhash.xxh3_64_intdigest(f"{key}|{again}".encode()) % shards, doc, key - (1 << 63), np.array(enc.encode_ordinary(text), dtype=kind).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "doc_id", "key", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if encoder(ranks_file).n_vocab <= 1 << 16 else np.int32
        shard, own, ids = None, [], []
        for batch in batches:
            for s, d, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))):
                if s != shard:
                    if own:
                        yield shard_rows(shard, own, ids, size, pad)
                    shard, own, ids = s, [], []
                own.append(d)
                ids.append(np.frombuffer(data, dtype=kind))
        if own:
            yield shard_rows(shard, own, ids, size, pad)

    dealt = rows.where(F.length("text") > 0).mapInArrow(tokenise, "shard int, doc_id bigint, key bigint, ids binary")
    parts = max(math.ceil(total / TASK_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(min(parts, shards), "shard").sortWithinPartitions("shard", "doc_id", "key").drop("key").mapInArrow(run, SCHEMA)


def numbers(column: Column | str) -> Column:
    """A column of `packed` in binary as an array of its numbers."""

    @F.arrow_udf("array<int>")
    def read(data: pa.Array) -> pa.Array:
        cut = [np.frombuffer(x, dtype="<i4") for x in data.to_pylist()]
        return lists(np.concatenate(cut) if cut else np.zeros(0, np.int32), np.array([len(x) for x in cut], dtype=np.int64))

    return read(column)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write `packed` rows as one record a shard with whole matrices: shard, n_rows, ids and position_ids (n_rows x size int32),
    cu_seqlens and its row lengths (int32), by the executors, as parquet in the shared folder; gives the table back."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, []

        def record() -> pa.RecordBatch:
            ids, where, cum = ([r[i] for r in own] for i in range(3))
            flat = [np.array([len(x) for x in cum], dtype="<i4").tobytes(), np.concatenate([np.array(x, dtype="<i4") for x in cum]).tobytes()]
            cols = [pa.array([shard], pa.int32()), pa.array([len(own)], pa.int32()), *[pa.array([x], pa.binary()) for x in (b"".join(ids), b"".join(where), *flat)]]
            return pa.RecordBatch.from_arrays(cols, ["shard", "n_rows", "ids", "position_ids", "n_cu", "cu_seqlens"])

        for batch in batches:
            for s, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard and own:
                    yield record()
                    own = []
                shard = s
                own.append(r)
        if own:
            yield record()

    dealt = rows.select("shard", "row", "ids", "position_ids", "cu_seqlens").repartition("shard").sortWithinPartitions("shard", "row").drop("row")
    dealt.mapInArrow(join, "shard int, n_rows int, ids binary, position_ids binary, n_cu binary, cu_seqlens binary").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def unpack(rows: DataFrame) -> DataFrame:
    """shard, seq, doc_id and token ids of every document, put together from its pieces; repeated rows come back each."""
    piece = F.posexplode(F.arrays_zip("doc_ids", "seqs", "starts")).alias("i", "p")
    cut = rows.select("shard", numbers("ids").alias("ids"), "cu_seqlens", "doc_ids", "seqs", "starts").select("shard", "ids", "cu_seqlens", piece)
    part = F.slice("ids", F.get("cu_seqlens", F.col("i")) + 1, F.get("cu_seqlens", F.col("i") + 1) - F.get("cu_seqlens", F.col("i")))
    parts_ = cut.select("shard", F.col("p.seqs").alias("seq"), F.col("p.doc_ids").alias("doc_id"), F.struct(F.col("p.starts").alias("start"), part.alias("ids")).alias("part"))
    return parts_.groupBy("shard", "seq", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["ids"])).alias("ids"))
