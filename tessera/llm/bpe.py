"""BPE encoding and decoding with a byte-level vocabulary.

Encoding keeps, for every pre-token, a priority queue of merge ranks over a doubly linked list of
symbols; entries whose symbols have since merged are stale and skipped. Decoding concatenates the
vocabulary's strings. The work is narrow: Spark splits the table, each task encodes its rows.

Null text counts as empty (no tokens, empty decoded text); repeated rows give repeated results;
extra columns of the input are left out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import by_bytes, cached_by, focus, trimmed

# Fixed value: the public byte-level pre-tokeniser pattern (white space by its Unicode property).
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?=\p{White_Space}|\Z)|\p{White_Space}+"
#: Pre-tokens kept by a worker before its memory starts afresh, and the longest one kept (memory bounds, not data bounds).
CACHE_PIECES, CACHE_BYTES = 600_000, 64
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def spelled(pattern: str) -> re.Pattern:
    """The pattern for texts without characters beyond the basic plane, its Unicode properties spelled out as ranges: the re module searches these faster than regex does the properties."""
    plane = [chr(i) if not 0xD800 <= i < 0xE000 else "" for i in range(0x10000)]
    for name in (r"\p{White_Space}", r"\p{L}", r"\p{N}"):
        has = [bool(c) and regex.match(name, c) is not None for c in plane] + [False]
        ends = [i for i in range(len(has)) if has[i] != (i > 0 and has[i - 1])]
        ranges = "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(ends[::2], ends[1::2]))
        pattern = re.sub(r"(\[\^[^]]*)" + re.escape(name), lambda m: m[1] + ranges, pattern).replace(name, f"[{ranges}]")
    return re.compile(pattern)


NEXT, LAST = list(range(1, 257)), list(range(-1, 255))


class Remembered(dict):
    """A bounded memory of what a function gave for short strings."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.make(piece)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """A byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in of.items()}
        self.symbols = [vocab[of[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.ranks: list[dict[int, int]] = [{} for _ in range(size)]  # by the left symbol, then the right one
        for rank, (a, b, _) in enumerate(self.pairs):
            self.ranks[a][b] = rank
        self.strings, self.decimal = [b""] * size, [str(i) for i in range(size)]
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.known = Remembered(self.piece)
        self.find, self.find_plane = regex.compile(PATTERN).findall, spelled(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        return tuple(self.merge(list(map(self.symbols.__getitem__, piece.encode()))))

    def merge(self, sym: list[int]) -> list[int]:
        """Apply the merges of lowest rank first, leftmost first among equals. A queue entry is a rank, shifted, and a position."""
        n, ranks = len(sym), self.ranks
        shift = 12 if n < 4096 else 40
        low = (1 << shift) - 1
        heap, right = [], ranks[sym[0]]
        for i in range(1, n):
            b = sym[i]
            if b in right:
                heap.append((right[b] << shift) | (i - 1))
            right = ranks[b]
        if not heap:
            return sym
        heapify(heap)
        pairs = self.pairs
        after, before = (NEXT[:n], LAST[:n]) if n < len(NEXT) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        while heap:
            entry = heappop(heap)
            i = entry & low
            a, b, new = pairs[entry >> shift]
            if sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                continue  # stale: one of the two has merged since
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (b := sym[k]) in (right := ranks[new]):
                    heappush(heap, (right[b] << shift) | i)
            if i and new in (right := ranks[sym[h := before[i]]]):
                heappush(heap, (right[new] << shift) | h)
        return [s for s in sym if s >= 0]

    def encode(self, text: str) -> list[int]:
        if self.cut and any(t in text for t in self.added):
            return [i for k, part in enumerate(self.cut(text)) for i in ([self.added[part]] if k % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        find = self.find_plane if len(text.encode("utf-16-le")) == 2 * len(text) else self.find
        return list(chain.from_iterable(map(self.known.__getitem__, find(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}
cached_by("bpe", _CODECS.clear)


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file, loaded once and kept until another operator works there."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and its ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("bpe")
        c = codec(vocabulary)
        for batch in batches:
            ids = [c.encode(t or "") for part in by_bytes(batch.column(1)) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(trimmed(run), "doc_id bigint, ids array<int>")


def round_trips(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; per row its token count and digests of the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("bpe")
        c, sha = codec(vocabulary), hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in (t for part in by_bytes(batch.column(1)) for t in part.to_pylist()):
                ids = c.encode(text or "")
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(trimmed(run), SCHEMA)
