"""Searches of many questions over many texts without a join of the two: blocks of postings and of character grams, and best hits by task.

A task turns its texts, block by block, into an index of its own, looks up a broadcast batch of questions (of bounded size) in it, and hands on
only each question's best hits and counts. So what is shuffled grows with tasks, questions and k, not with the pairs
of a question and a text that share a word; and no question meets a text that its index rules out."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.functions import text as T

#: Questions of a batch that is sent to the tasks, and texts of a block.
QUESTIONS, BLOCK = 2000, 512


def batches_of(queries: DataFrame, most: int = QUESTIONS) -> list[DataFrame]:
    """The queries (query_id, ...) in batches of about `most`, each small enough to be sent."""
    n = max(1, -(-queries.count() // most))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def _each(queries: DataFrame, most: int, scan: Callable[[list], DataFrame], schema: StructType) -> DataFrame:
    """The union of what a scan gives for each batch of rows of queries."""
    found = None
    for batch in batches_of(queries, most):
        rows = batch.collect()
        if rows:
            part = scan(rows)
            found = part if found is None else found.unionByName(part)
    return found if found is not None else queries.sparkSession.createDataFrame([], schema)


def ranked(hits: DataFrame, *order, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


# ---- words


class Postings:
    """A block of texts as a matrix of the words that questions ask for, by those texts."""

    def __init__(self, words: pa.Array, asked: pa.Array):
        n = len(words)
        number = pc.index_in(words.flatten(), value_set=asked)
        owner = pc.list_parent_indices(words)
        some = pc.is_valid(number)
        number, owner = number.filter(some).to_numpy(), owner.filter(some).to_numpy()
        self.words, row = np.unique(number, return_inverse=True)
        self.holds = np.zeros((len(self.words), n), bool)
        self.holds[row, owner] = True
        self.row = np.full(len(asked), -1)
        self.row[self.words] = np.arange(len(self.words))

    def counts(self, question: np.ndarray, least: int) -> np.ndarray | None:
        """How many of the question's words each text has; none if no text of the block can have `least`: the block's greatest count is at most the words it has at all."""
        rows = self.row[question]
        rows = rows[rows >= 0]
        if len(rows) < max(least, 1):
            return None
        return self.holds[rows].sum(0)


def overlap(queries: DataFrame, texts: DataFrame, k: int, most: int = QUESTIONS) -> DataFrame:
    """query_id, rank, id, score: the share of a query's (query_id, query) distinct words that a text (id, text) has, best k, ties to the lesser id.

    Queries without words and texts without any of them give nothing. A block whose words cannot reach a query's k-th count so far is passed over."""
    schema = StructType([queries.schema["query_id"], StructField("id", StringType()), StructField("score", DoubleType())])
    rows_of = texts.select(F.col("id").cast("string").alias("id"), F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))).alias("words"))

    def scan(rows: list) -> DataFrame:
        words = sorted({w for r in rows for w in r["words"]})
        place = {w: i for i, w in enumerate(words)}
        asked = queries.sparkSession.sparkContext.broadcast((words, [(r["query_id"], np.array([place[w] for w in r["words"]])) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, questions = asked.value
            vocabulary = pa.array(words, pa.string())
            held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, dtype=object))] * len(questions)
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    block = batch.slice(at, BLOCK)
                    index, ids = Postings(block.column(1), vocabulary), None
                    for i, (_, question) in enumerate(questions):
                        n, names = held[i]
                        least = int(n[-1]) if len(n) == k else 1
                        counts = index.counts(question, least)
                        if counts is None:
                            continue
                        hit = np.flatnonzero(counts >= least)
                        if not len(hit):
                            continue
                        if ids is None:
                            ids = np.array(block.column(0).to_pylist(), dtype=object)
                        n, names = np.append(n, counts[hit]), np.append(names, ids[hit])
                        best = sorted(range(len(n)), key=lambda j: (-n[j], names[j]))[:k]
                        held[i] = n[best], names[best]
            out = [(questions[i][0], name, c / len(questions[i][1])) for i, (n, names) in enumerate(held) for c, name in zip(n.tolist(), names.tolist())]
            yield from _as_batches(out, schema)

        return rows_of.mapInArrow(run, schema)

    q = queries.select("query_id", F.array_distinct(T.tokens(F.coalesce("query", F.lit("")))).alias("words")).where(F.size("words") > 0)
    return ranked(_each(q, most, scan, schema), F.desc("score"), "id", k=k).select("query_id", "rank", "id", "score")


# ---- substrings


def grams(text: str, size: int) -> np.ndarray:
    """The text's runs of `size` (up to 3) characters, as numbers."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = a[: max(len(a) - size + 1, 0)].copy()
    for i in range(1, size):
        out = (out << np.uint64(21)) | a[i : i + len(out)]
    return out


class Needles:
    """Search strings by their grams: a text is compared with those alone all of whose grams it has."""

    def __init__(self, needles: list[str]):
        self.needles = needles
        self.sizes = [min(3, len(s)) for s in needles]
        own = [grams(s, size) if size else np.zeros(0, np.uint64) for s, size in zip(needles, self.sizes)]
        self.asked = {size: np.unique(np.concatenate([g for g, s in zip(own, self.sizes) if s == size])) for size in {s for s in self.sizes if s}}
        self.rows = [np.unique(np.searchsorted(self.asked[size], g)) if size else None for g, size in zip(own, self.sizes)]

    def found(self, texts: list[str | None]) -> np.ndarray:
        """needles x texts: which needle lies in which text; empty needles and texts lie in and hold nothing."""
        out = np.zeros((len(self.needles), len(texts)), bool)
        has = {size: np.zeros((len(codes), len(texts)), bool) for size, codes in self.asked.items()}
        for j, text in enumerate(texts):
            for size, codes in self.asked.items() if text else ():
                g = grams(text, size)
                at = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
                has[size][at[codes[at] == g], j] = True
        for i, (needle, size) in enumerate(zip(self.needles, self.sizes)):
            if size:
                for j in np.flatnonzero(has[size][self.rows[i]].all(0)).tolist():
                    out[i, j] = size == len(needle) or needle in texts[j]
        return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 128) -> Iterator[list[list]]:
    for batch in batches:
        for at in range(0, len(batch), size):
            yield [c.to_pylist() for c in batch.slice(at, size).columns]


def holders(texts: DataFrame, needles: DataFrame, most: int = QUESTIONS) -> DataFrame:
    """query_id, id for every needle (query_id, needle) that a text (id, text) holds, as they are written."""
    schema = StructType([needles.schema["query_id"], texts.schema["id"]])

    def scan(rows: list) -> DataFrame:
        asked = texts.sparkSession.sparkContext.broadcast([(r["query_id"], r["needle"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, strings = zip(*asked.value)
            search = Needles(list(strings))
            for ids, bodies in _blocks(batches):
                i, j = np.nonzero(search.found(bodies))
                yield from _as_batches([(names[a], ids[b]) for a, b in zip(i.tolist(), j.tolist())], schema)

        return texts.select("id", "text").mapInArrow(run, schema)

    return _each(needles.where("needle IS NOT NULL AND query_id IS NOT NULL"), most, scan, schema)


def longest_terms(texts: DataFrame, terms: DataFrame, most: int = QUESTIONS) -> DataFrame:
    """id, term: the longest of the terms (term) that each text (id, text) holds, in folded case, ties to the lesser text; texts without one have no row."""
    low = texts.select("id", T.casefold("text").alias("text"))
    asked = terms.select(T.casefold("term").alias("query_id"), T.casefold("term").alias("needle")).distinct()
    longest = holders(low, asked, most).groupBy("id").agg(F.min(F.struct((-F.length("query_id")).alias("n"), "query_id")).alias("b"))
    return longest.select("id", F.col("b.query_id").alias("term"))


FIELDS = (("title", 3), ("summary", 2), ("body", 1))


def page_search(pages: DataFrame, queries: DataFrame, limit: int = 50, most: int = QUESTIONS) -> DataFrame:
    """query_id, rank, page_id, score, total, snippets: pages (page_id, title, summary, body) that hold a query's (query_id, needle) needle in any case: 3 by
    title, 2 by summary, 1 by body; best first, then by title (the id where there is none) and id; limit is held within 1 to 100, total counts all. Snippets: what stands
    around the first find in each field, each text once. Blank needles find nothing."""
    limit = max(1, min(limit, 100))
    schema = StructType([queries.schema["query_id"], pages.schema["page_id"], StructField("name", StringType()), StructField("score", IntegerType()), StructField("n", LongType())])
    name = F.coalesce(F.nullif("title", F.lit("")), F.col("page_id").cast("string"))
    folded = pages.select("page_id", name.alias("name"), *[T.casefold(c).alias(c) for c, _ in FIELDS])

    def scan(rows: list) -> DataFrame:
        asked = pages.sparkSession.sparkContext.broadcast([(r["query_id"], r["needle"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions = asked.value
            search = Needles([n for _, n in questions])
            held: list[list] = [[] for _ in questions]
            total = np.zeros(len(questions), np.int64)
            for ids, names, *fields in _blocks(batches):
                score = np.zeros((len(questions), len(ids)), np.int64)
                for (_, worth), texts in zip(FIELDS, fields):
                    score = np.maximum(score, worth * search.found(texts))
                total += (score > 0).sum(1)
                for i in np.flatnonzero(score.any(1)).tolist():
                    new = [(-int(score[i, j]), names[j], ids[j]) for j in np.flatnonzero(score[i]).tolist()]
                    held[i] = heapq.nsmallest(limit, held[i] + new)
            out = [(questions[i][0], p, name, -s, 0) for i, best in enumerate(held) for s, name, p in best]
            out += [(questions[i][0], None, None, None, n) for i, n in enumerate(total.tolist()) if n]
            yield from _as_batches(out, schema)

        return folded.mapInArrow(run, schema)

    needles = queries.select("query_id", T.casefold(T.strip("needle")).alias("needle")).where("needle <> ''")
    found = _each(needles, most, scan, schema)
    total = found.groupBy("query_id").agg(F.sum("n").alias("total"))
    best = ranked(found.where("name IS NOT NULL"), F.desc("score"), "name", "page_id", k=limit).join(total, "query_id")
    shown = best.join(pages.select("page_id", *[c for c, _ in FIELDS]), "page_id").join(queries.select("query_id", T.strip("needle").alias("needle")), "query_id")
    pieces = F.array_distinct(F.filter(F.array(*[folded_snippet(F.col(c), F.col("needle")) for c, _ in FIELDS]), lambda s: s.isNotNull()))
    return shown.select("query_id", "rank", "page_id", "score", "total", pieces.alias("snippets"))


def folded_snippet(text, needle, radius: int = 40):
    """What stands around the first find of needle in any case, with ellipses where it is cut; null without one."""
    at = F.instr(T.casefold(text), T.casefold(needle))
    start, end = F.greatest(at - radius, F.lit(1)), F.least(at + F.length(needle) + radius, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))
    return F.when((at > 0) & (F.length(needle) > 0), cut)


def page_lane(pages: DataFrame, questions: DataFrame, k: int = 5, most: int = QUESTIONS) -> DataFrame:
    """query_id, rank, page_id, score: pages (page_id, title, body) by twice the keywords (query_id, kw) in the title plus those in the body,
    over the query's largest, best k, ties to the lesser id."""
    schema = StructType([questions.schema["query_id"], pages.schema["page_id"], StructField("raw", IntegerType())])

    def scan(rows: list) -> DataFrame:
        words = sorted({w for r in rows for w in r["kw"] if w})
        place = {w: i for i, w in enumerate(words)}
        asked = pages.sparkSession.sparkContext.broadcast((words, [(r["query_id"], np.array([place[w] for w in r["kw"] if w], dtype=np.int64)) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, wanted = asked.value
            search = Needles(words)
            held: list[list] = [[] for _ in wanted]
            for ids, titles, bodies in _blocks(batches):
                worth = 2 * search.found(titles).astype(np.int32) + search.found(bodies)
                for i, (_, kw) in enumerate(wanted):
                    raw = worth[kw].sum(0)
                    least = -held[i][-1][0] if len(held[i]) == k else 1
                    hit = np.flatnonzero(raw >= least)
                    if len(hit):
                        held[i] = heapq.nsmallest(k, held[i] + [(-int(raw[j]), ids[j]) for j in hit.tolist()])
            yield from _as_batches([(wanted[i][0], p, -r) for i, best in enumerate(held) for r, p in best], schema)

        return pages.select("page_id", "title", "body").mapInArrow(run, schema)

    top = ranked(_each(questions.where("kw IS NOT NULL"), most, scan, schema), F.desc("raw"), "page_id", k=k)
    return top.withColumn("score", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")), 6)).select("query_id", "rank", "page_id", "score")


def _as_batches(rows: list[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    types = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, types)], schema=types)
