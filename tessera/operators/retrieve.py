"""Retrieval lanes over tables of questions, fusion, and reranking. Substring search is turned into equi-joins."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def substring_hits(queries: DataFrame, parts: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """query_id, part for each part (distinct, lower case) that a query (query_id, query) holds.

    All substrings of a query whose length lies in `lengths` are exploded and hash-joined to the parts; there is no
    nested-loop join. lengths: least and most length of any part."""
    low, high = lengths
    at = queries.select("query_id", F.lower("query").alias("q")).withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1)))))
    subs = at.withColumn("len", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(F.col("start") + F.col("len") - 1 <= F.length("q"))
    subs = subs.select("query_id", F.substring(F.col("q"), F.col("start"), F.col("len")).alias("part")).distinct()
    return subs.join(parts.select("part").distinct(), "part").select("query_id", "part")


def ranked(hits: DataFrame, *order: Column | str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks(queries: DataFrame, most: int = 2000) -> list[DataFrame]:
    """The queries (query_id, ...) in blocks of about `most`, each small enough to be broadcast."""
    n = max(1, -(-queries.count() // most))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


#: Vectors that are scored against a block of queries at a time.
VECTORS = 128


def _vector_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of few rows at a time, so that a task's scores are bounded by queries times VECTORS."""
    for batch in batches:
        for at in range(0, len(batch), VECTORS):
            block = batch.slice(at, VECTORS)
            x = np.asarray(block.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            yield block.column(0).to_numpy(), x.reshape(len(block), -1)


def cosine_lane(queries: DataFrame, vectors: DataFrame, k: int, most: int = 2000) -> DataFrame:
    """query_id, rank, id, score by cosine, for all queries (query_id, vector) against all vectors (id, vector) but the one of the
    query's own id. Queries go in blocks; a task multiplies its batches with a block and hands on each query's k best so far."""
    sent, found = queries.sparkSession.sparkContext, None
    for block in blocks(queries, most):
        rows = block.collect()
        if not rows:
            continue
        asked = sent.broadcast((np.array([r["query_id"] for r in rows], dtype=np.int64), np.array([r["vector"] for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, q = asked.value
            norm = np.sqrt((q * q).sum(1))
            best_s, best_i = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), dtype=np.int64)
            for ids, x in _vector_blocks(batches):
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (q @ x.T) / np.outer(norm, np.sqrt((x * x).sum(1)))
                score[np.isnan(score) | (numbers[:, None] == ids[None, :])] = -np.inf
                # Only queries with a score that reaches their k-th so far are sorted again.
                floor = best_s[:, -1] if best_s.shape[1] == k else np.full(len(q), -np.inf)
                rows = np.flatnonzero((score >= floor[:, None]).any(1)) if best_s.shape[1] == k else np.arange(len(q))
                if not len(rows):
                    continue
                s, i = np.hstack([best_s[rows], score[rows]]), np.hstack([best_i[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
                order = np.lexsort((i, -s))[:, :k]
                s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                if len(rows) == len(q):
                    best_s, best_i = s, i
                else:
                    best_s[rows], best_i[rows] = s, i
            keep = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, keep.sum(1))), pa.array(best_i[keep]), pa.array(best_s[keep])], ["query_id", "id", "score"])

        part = vectors.select(F.col("id").cast("bigint").alias("id"), "vector").where("vector IS NOT NULL").mapInArrow(run, "query_id bigint, id bigint, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double")
    return ranked(found, F.desc("score"), "id", k=k).select("query_id", "rank", "id", "score")


class Buckets(dict):
    """Bucket of each token by its md5 as a number, kept by a worker; starts afresh when full."""

    def __init__(self, dims: int, most: int = 1 << 18):
        super().__init__()
        self.dims, self.most = dims, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = int.from_bytes(hashlib.md5(token.encode()).digest(), "big") % self.dims
        return value


def hash_vectors(owner: np.ndarray, buckets: np.ndarray, n: int, dims: int) -> np.ndarray:
    """Of n texts the counts of their tokens' buckets, each of length one; owner: the text of each token."""
    v = np.bincount(owner * dims + buckets, minlength=n * dims).reshape(n, dims).astype(np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]


#: Chunks that are scored against a block of queries at a time.
CHUNKS = 512


class ChunkQueries:
    """A block of queries (query_id, query, tokens) that blocks of chunks are scored against."""

    def __init__(self, rows: list[tuple[int, str, list[str]]], dims: int):
        self.numbers, self.texts, tokens = zip(*rows)
        self.dims, self.bucket = dims, Buckets(dims)
        own = [set(t) for t in tokens]
        self.words = pa.array(sorted(set().union(*own)), pa.string())
        place = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.asks = np.zeros((len(own), len(place)), np.float32)
        for i, t in enumerate(own):
            self.asks[i, [place[w] for w in t]] = 1
        self.size = np.array([max(1, len(t)) for t in own])
        self.vectors = hash_vectors(np.repeat(np.arange(len(own)), [len(t) for t in tokens]), np.array([self.bucket[w] for t in tokens for w in t], dtype=np.int64), len(own), dims)

    def scores(self, bodies: pa.Array, tokens: pa.Array) -> np.ndarray:
        """Queries by chunks. Each distinct token of the block is looked up once; shares are one product of the words that the block has."""
        n = len(bodies)
        coded, owner = tokens.flatten().dictionary_encode(), pc.list_parent_indices(tokens).to_numpy()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        buckets = np.array(list(map(self.bucket.__getitem__, distinct.to_pylist())), dtype=np.int64)
        number = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy()[code]
        asked = number >= 0
        words, row = np.unique(number[asked], return_inverse=True)
        has = np.zeros((len(words), n), np.float32)
        has[row, owner[asked]] = 1
        share = (self.asks[:, words] @ has).astype(np.float64)
        # A text that holds the query has all of its tokens but the first and the last.
        may = share >= self.size[:, None] - 2
        for j in np.flatnonzero(may.any(0)).tolist():
            body = bodies[j].as_py()
            for i in np.flatnonzero(may[:, j]).tolist():
                if self.texts[i] and self.texts[i] in body:
                    share[i, j] = self.size[i]
        return np.round(0.6 * share / self.size[:, None] + 0.4 * (self.vectors @ hash_vectors(owner, buckets[code], n, self.dims).T), 9)


def chunk_lane(queries: DataFrame, chunks: DataFrame, k: int, dims: int = 64, least: float = 0.0, most: int = 500) -> DataFrame:
    """query_id, rank, id, score of each query's (query_id, query) best k chunks (id, text) by 0.6 times the share of its distinct tokens
    (1 where the text holds the whole query) plus 0.4 times the cosine of hash vectors; scores of 0 or below `least` go.

    Queries go in blocks; a task scores its chunks against a block, few at a time, and hands on each query's k best so far."""
    context, found = queries.sparkSession.sparkContext, None
    for block in blocks(queries, most):
        rows = block.select("query_id", F.coalesce("query", F.lit("")).alias("query"), T.tokens(F.coalesce("query", F.lit(""))).alias("tokens")).collect()
        if not rows:
            continue
        asked = context.broadcast([(r["query_id"], r["query"], r["tokens"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = ChunkQueries(asked.value, dims)
            best: list[list[tuple[float, str]]] = [[] for _ in q.numbers]
            floor = np.full(len(best), least)
            for batch in batches:
                for at in range(0, len(batch), CHUNKS):
                    part = batch.slice(at, CHUNKS)
                    score = q.scores(part.column(1), part.column(2))
                    hit = (score > 0) & (score >= floor[:, None])
                    for i in np.flatnonzero(hit.any(1)).tolist():
                        take = np.flatnonzero(hit[i])
                        new = zip((-score[i, take]).tolist(), part.column(0).take(pa.array(take)).to_pylist())
                        best[i] = heapq.nsmallest(k, [*best[i], *new])
                        if len(best[i]) == k:
                            floor[i] = max(least, -best[i][-1][0])
            out = [(q.numbers[i], n, -s) for i, own in enumerate(best) for s, n in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.float64()))], ["query_id", "id", "score"])

        rows_ = chunks.where("text IS NOT NULL").select("id", "text", T.tokens("text").alias("tokens"))
        part = rows_.mapInArrow(run, "query_id bigint, id string, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query_id bigint, id string, score double")
    return ranked(found, F.desc("score"), "id", k=k).select("query_id", "rank", "id", "score")


#: The sets of a claim's parts that a query can hold.
PART_SETS = [("subject",), ("predicate",), ("object",), ("subject", "predicate"), ("subject", "object"), ("predicate", "object"), ("subject", "predicate", "object")]


def claim_hits(queries: DataFrame, claims: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: claims (id, subject, predicate, object) by how many of their parts a query (query_id, query) holds, best k.

    Claims that agree in the parts a query holds score alike at least, so only the k least ids of each set of values can be among the
    best k: a predicate that all claims share costs k rows a query."""
    low = claims.select("id", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in PART_SETS[-1]])
    key = lambda name, values: F.concat_ws("\x1f", F.lit("+".join(name)), *values)
    sets = F.array(*[F.when(F.least(*[F.length(c) for c in name] + [F.lit(1)]) > 0, F.struct(key(name, name).alias("key"), F.lit(len(name)).alias("score"))) for name in PART_SETS])
    keyed = low.select("id", F.explode(F.filter(sets, lambda x: x.isNotNull())).alias("s")).select("id", "s.key", "s.score")
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k).drop("n")
    parts = low.select(F.explode(F.array(*PART_SETS[-1])).alias("part")).where("part <> ''").distinct()
    span = parts.agg(F.min(F.length("part")), F.max(F.length("part"))).first()
    held = substring_hits(queries, parts, (span[0] or 1, span[1] or 0)).groupBy("query_id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    x = held.select("query_id", "parts", F.explode("parts").alias("x"))
    y = x.select("*", F.explode("parts").alias("y"))
    z = y.select("*", F.explode("parts").alias("z"))
    asked = None
    for rows, values in ((x, ["x"]), (y, ["x", "y"]), (z, ["x", "y", "z"])):
        part = rows.select("query_id", F.explode(F.array(*[key(name, values) for name in PART_SETS if len(name) == len(values)])).alias("key"))
        asked = part if asked is None else asked.unionByName(part)
    hits = asked.join(first, "key").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return ranked(hits, F.desc("score"), "id", k=k).select("query_id", "rank", "id", "score")


def hits_by_mode(queries: DataFrame, lanes: dict[str, DataFrame], k: int) -> DataFrame:
    """query_id, claim_id, key, score: hits of each query (query_id, mode) from the lane that its mode names, best k; in the mode `hybrid` all
    lanes' hits, one for each claim or snippet, uncut. Lanes: query_id, lane, claim_id, snippet, score."""
    asked = queries.select("query_id", "mode").distinct()
    both, one = None, None
    for name, lane in lanes.items():
        rows = lane.select("query_id", "lane", "claim_id", "snippet", "score")
        mine = rows.join(asked.where(F.col("mode") == name).select("query_id"), "query_id", "left_semi")
        every = rows.join(asked.where("mode = 'hybrid'").select("query_id"), "query_id", "left_semi")
        one, both = (mine, every) if one is None else (one.unionByName(mine), both.unionByName(every))
    key = F.lower(F.trim(F.regexp_replace("snippet", r"\s+", " ")))
    best = ranked(one, F.desc("score"), F.asc_nulls_last("claim_id"), "snippet", k=k).select("query_id", "claim_id", key.alias("key"), "score")
    return best.unionByName(merge_hits(both))


def fuse(lanes: dict[str, tuple[DataFrame, float]], constant: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of lanes (query_id, rank from 1, id); ranks count from 0. Ties by lane order, then rank."""
    parts = [df.select("query_id", F.lit(i).alias("lane"), "rank", F.concat_ws(":", F.lit(name), F.col("id").cast("string")).alias("key"), (F.lit(w) / (constant + F.col("rank") - 1)).alias("s")) for i, (name, (df, w)) in enumerate(lanes.items()) if w > 0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "key").agg(F.sum("s").alias("score"), F.min(F.struct("lane", "rank")).alias("place"))


def normalise(hits: DataFrame, order: list) -> DataFrame:
    """Scores of a query stretched to 0..1; where all are equal, by rank: n/n, (n-1)/n, ..."""
    every, w = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(*order)
    out = hits.withColumns({"lo": F.min("score").over(every), "hi": F.max("score").over(every), "n": F.count("*").over(every), "rank": F.row_number().over(w)})
    score = F.when(F.col("hi") - F.col("lo") < 1e-12, (F.col("n") - F.col("rank") + 1) / F.col("n")).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return out.withColumn("score", F.round(score, 6)).drop("lo", "hi", "n")


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits (query_id, lane, claim_id, snippet, score): one for each claim, with the best score; a hit without a claim whose
    snippet a claim hit has is absorbed; others are one for each snippet."""
    h = hits.withColumn("key", F.lower(F.trim(F.regexp_replace("snippet", r"\s+", " "))))
    by_claim = h.where("claim_id IS NOT NULL").groupBy("query_id", "claim_id").agg(F.max("score").alias("score"), F.min_by("key", "lane").alias("key"))
    loose = h.where("claim_id IS NULL").groupBy("query_id", "key").agg(F.max("score").alias("extra"))
    one = by_claim.groupBy("query_id", "key").agg(F.min("claim_id").alias("claim_id"))
    raised = by_claim.join(loose.join(one, ["query_id", "key"]).select("query_id", "claim_id", "extra"), ["query_id", "claim_id"], "left")
    claims = raised.select("query_id", "claim_id", "key", F.greatest("score", F.coalesce("extra", "score")).alias("score"))
    rest = loose.join(one, ["query_id", "key"], "left_anti").select("query_id", F.lit(None).cast("string").alias("claim_id"), "key", F.col("extra").alias("score"))
    return claims.unionByName(rest)
