"""Periodic runs of words: stretches that repeat a block three times or more, found as maximal pairs.

A run of period q and length L is a pair of equal stretches q words apart, each of L - q words, that can be
extended to neither side: a maximal pair. Maximal pairs are read off the LCP-interval tree of the text's word suffixes, from
its leaves up: a node stands for the suffixes that share its depth of first words, and holds their positions in lists
by the word to their left. Where two children meet, positions of different lists at a distance that the length allows
are a maximal pair, hence a run as it stands; nothing is extended.

With the distance at most half the depth, the shared words have one period, so within reach of a position all later
ones have one left word between them, and of the earlier ones only the farthest can have another left word than it has. So each position of the
smaller child costs two binary searches, and each pair reported is a run or a multiple of its period (which has the
run's two ends, and goes). Only nodes of a depth that a run needs are built, and only texts in which so many words in a row repeat within reach have suffixes sorted.

A run's `period` is its smallest period, its length is at least max(shortest, 3 * period). Whole texts of any length are read; the
work for a text is one task's, n log n for n words in a row. Null, empty and blank texts have no words and no runs, and their
`collapsed` text is null, or empty. Repeated rows and null ids give a row each; no two runs share start and period, so there are no ties.
Extra columns stay, whatever their names (`fresh`); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm.common import by_bytes, byte_strings, focus, fresh, windows, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHORTEST, TIMES = 24, 3

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number among the text's distinct words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32)


def repeats(words: list[bytes], depth: int) -> np.ndarray:
    """Starts of stretches of depth words that occur again in the text, by hash: all that a node of that depth can hold, and by chance more."""
    if len(words) <= depth:
        return np.empty(0, np.int64)
    h = windows(word_hashes(words), depth)
    order = h.argsort(kind="stable")
    same = h[order][1:] == h[order][:-1]
    # Of a pair in one run the distance is at most half of the equal stretch, so less than a third of the text.
    near = same & (np.diff(order) <= len(words) // TIMES)
    return order[np.append(near, False) | np.insert(near, 0, False)]


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, by doubling, and the number of first words that each suffix shares with the one before it."""
    n = len(ids)
    rank, levels, k = ids.astype(np.int64), [ids.astype(np.int32)], 1
    order = rank.argsort(kind="stable")
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - k, 0)] = rank[k:]
        key = rank * (n + 1) + after + 1
        order = key.argsort(kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            break
        levels.append(rank.astype(np.int32))
    # Equal ranks of level j mean 2**j equal words, so a binary descent finds how far two suffixes agree.
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        level, step = levels[j], 1 << j
        x, y = a + shared, b + shared
        fits = np.flatnonzero(np.maximum(x, y) + step <= n)
        shared[fits[level[x[fits]] == level[y[fits]]]] += step
    return order, np.append(0, shared)


class Node:
    """Positions under a node: all in order, and in order by the word to their left (-1: none)."""

    __slots__ = ("all", "lists")

    def __init__(self, position: int, left: int):
        self.all, self.lists = [position], {left: [position]}

    def add(self, other: Node) -> None:
        for left, places in other.lists.items():
            own = self.lists.get(left)
            if own is None:
                self.lists[left] = places
            else:
                for p in places:
                    insort(own, p)
        for p in other.all:
            insort(self.all, p)


def meet(one: Node, other: Node, depth: int, left: list[int], shortest: int, found: dict[tuple[int, int], int]) -> Node:
    """The two children of a node of that depth as one; maximal pairs between them go into found: (start, end) -> least distance."""
    big, small = (one, other) if len(one.all) >= len(other.all) else (other, one)
    reach = depth // (TIMES - 1)

    def pair(a: int, b: int) -> None:
        if b - a + depth >= shortest:
            span = (a, b + depth)
            if found.get(span, b - a + 1) > b - a:
                found[span] = b - a

    for p in small.all:
        after = bisect_left(big.all, p)
        if after < len(big.all) and (s := big.all[after]) - p <= reach and left[s] != left[p]:
            own = big.lists[left[s]]  # all within reach to the right are in this list
            for at in range(bisect_left(own, p), bisect_right(own, p + reach)):
                pair(p, own[at])
        far = bisect_left(big.all, p - reach, 0, after)
        if far < after and left[big.all[far]] != left[p]:
            pair(big.all[far], p)
    big.add(small)
    return big


def find(words: list[bytes], shortest: int = SHORTEST) -> list[Run]:
    """All runs of the words, by start and period."""
    least = min(max(shortest - d, (TIMES - 1) * d) for d in range(1, shortest + 1))  # no run's stretch is less
    if not len(repeats(words, least)):
        return []
    ids = numbered(words)
    order, shared = suffixes(ids)
    left = [-1, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}
    deep = shared >= least
    first = np.flatnonzero(deep[1:] & ~deep[:-1])  # subtrees of that depth: suffixes from first to last
    last = np.flatnonzero(deep & ~np.append(deep[1:], False))
    for f, t in zip(first.tolist(), last.tolist()):
        if np.diff(np.sort(order[f : t + 1])).min() * TIMES > len(words):
            continue  # no two of them are within reach of any depth
        stack: list[tuple[int, Node]] = []  # open nodes: depth, and what they hold so far
        places, depths = order[f : t + 1].tolist(), shared[f + 1 : t + 1].tolist()
        node = Node(places[0], left[places[0]])
        for p, depth in zip(places[1:], depths):
            while stack and stack[-1][0] > depth:
                d, held = stack.pop()
                node = meet(held, node, d, left, shortest, found)
            if stack and stack[-1][0] == depth:
                d, held = stack.pop()
                node = meet(held, node, d, left, shortest, found)
            stack.append((depth, node))
            node = Node(p, left[p])
        while stack:
            d, held = stack.pop()
            node = meet(held, node, d, left, shortest, found)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def keeps(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: of a run its first period alone, unless another run drops a word of it."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUN_TYPE = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def collapse(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """All columns of docs but the text, runs: array<struct<start, length, period>> in words, and collapsed: the words kept, joined by spaces."""
    rows = docs.select(docs[text_col].alias(fresh(docs.drop(text_col), "text")[0]), *[docs[c] for c in docs.columns if c.lower() != text_col.lower()])
    rest = StructType(rows.schema.fields[1:])
    names = fresh(docs.drop(text_col), "runs", "collapsed")

    def one(text: bytes | None) -> tuple[list[dict], bytes | None]:
        words = WORD.findall(text or b"")
        runs = find(words, shortest)
        if runs:
            stays = keeps(len(words), runs)
            words = [w for w, s in zip(words, stays.tolist()) if s]
        return [{"start": s, "length": n, "period": q} for s, n, q in runs], None if text is None else b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("runs")
        for batch in batches:
            at = 0
            for texts in by_bytes(batch.column(0)):
                other = batch.slice(at, len(texts))
                at += len(texts)
                got = [one(t) for t in byte_strings(texts)]
                yield pa.RecordBatch.from_arrays([*other.columns[1:], pa.array([r for r, _ in got], RUNS), pa.array([c for _, c in got], pa.binary()).cast(pa.string())], [*rest.names, *names])

    return rows.mapInArrow(run, StructType([*rest, StructField(names[0], RUN_TYPE), StructField(names[1], StringType())]))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; then least start, then least period. Null if there is none."""

    def better(best: Column, r: Column) -> Column:
        one, other = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (one > other), r).otherwise(best)  # runs come by start and period

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def repeated_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which the text of one id in ten ends in a repeated block: with h the id's crc32 and g = floor(h / 10), where h % 10 = 0 each
    word from number a = g % n on becomes word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8))."""
    words, h, g, a, p = fresh(docs, "words", "h", "g", "a", "p")
    got = docs.withColumn(h, F.crc32(docs[id_col].cast("string").cast("binary")))
    got = got.withColumn(words, F.when(F.col(h) % 10 == 0, F.filter(F.split(docs[text_col], r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n = F.size(words)
    got = got.withColumn(g, F.floor(F.col(h) / 10).cast("bigint")).withColumn(a, F.when(n > 0, (F.col(g) % n).cast("int")))
    got = got.withColumn(p, (1 + F.floor((n - F.col(a)) / (3 + F.col(g) % 8))).cast("int"))
    changed = F.concat(F.slice(words, 1, F.col(a)), F.transform(F.sequence(F.lit(0), n - F.col(a) - 1), lambda i: F.get(F.col(words), F.col(a) + i % F.col(p))))
    return got.withColumn(text_col, F.when(F.col(a).isNull(), docs[text_col]).otherwise(F.array_join(changed, " "))).select(*docs.columns)
