"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Components are turned into floor(scale * x); scores are exact integers. Candidates are dealt once to shards of bounded
size; a shard's ball tree is built there and written as one row of a table, so that searches read shards without any
exchange. A shard is searched best bound first, a node's bound being the inner product of query and centre plus the query's
norm times the radius. Shards come in waves, each about as large as all waves before it together; after a wave the
queries' kth scores so far go along to the next one, so most shards are searched under a tight bound. Queries come in
blocks of bounded size, each broadcast to the tasks.

Vectors that are null or empty, or hold a null or non-finite component, take no part; nor do those with a component that is, scaled,
over sqrt(2**62 / length) in size, since a long could not hold their scores. Vectors meet only vectors of their
own length. A row is no candidate for a query with its own id, so repeated rows of a query are left out, and
repeated candidate rows each count. Rows of one id with different vectors are a query each. Ties go to the smaller id. Fewer than k
candidates are all given. Only id and vector are read, so extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialise


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs; null for vectors that take no part."""
    most = F.sqrt(F.lit(2.0**62) / F.size(vector))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < most), F.lit(False)))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


class Ball:
    """A ball tree over the rows of a matrix, which it puts in order: each node is a run of rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 64):
        exact = x
        x = x.astype(np.float64)
        order, nodes = np.arange(len(x)), []

        def build(a: int, b: int) -> int:
            me = len(nodes)
            nodes.append(None)
            own = x[order[a:b]]
            centre = own.mean(0)
            far = np.sqrt(((own - centre) ** 2).sum(1))
            radius, left, right = float(far.max()), -1, -1
            if b - a > leaf and radius > 0:
                u = own[int(far.argmax())]
                v = own[int(((own - u) ** 2).sum(1).argmax())]
                order[a:b] = order[a:b][(own @ (v - u)).argsort(kind="stable")]
                left, right = build(a, (a + b) // 2), build((a + b) // 2, b)
            nodes[me] = (centre, radius, left, right, a, b)
            return me

        build(0, len(x))
        self.centre, self.radius = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.links = np.array([n[2:] for n in nodes], dtype=np.int64)
        self.x, self.ids = exact[order], ids[order]

    def search(self, q: np.ndarray, own: int, k: int, known: float) -> list[tuple[int, int]]:
        """The k best (score, -id) of this shard that can still be among the best: no score under the known kth one."""
        best: list[tuple[int, int]] = []
        up = self.centre @ q.astype(np.float64) + math.sqrt(float(q.astype(np.float64) @ q.astype(np.float64))) * self.radius
        bound = up + np.abs(up) * 1e-9 + 1
        queue = [(-bound[0], 0)]
        while queue:
            up, i = heapq.heappop(queue)
            floor = max(known, best[0][0]) if len(best) == k else known
            if -up < floor:
                break  # nothing left can reach the kth score
            left, right, a, b = self.links[i]
            if left >= 0:
                heapq.heappush(queue, (-bound[left], left))
                heapq.heappush(queue, (-bound[right], right))
                continue
            scores = self.x[a:b] @ q
            hit = np.flatnonzero(scores >= floor)
            for s, v in zip(scores[hit].tolist(), self.ids[a:b][hit].tolist()):
                if v != own:
                    (heapq.heappushpop if len(best) == k else heapq.heappush)(best, (int(s), -v))
        return sorted(best, reverse=True)

    def data(self) -> bytes:
        return pickle.dumps(self, protocol=5)


def trees(rows: DataFrame) -> DataFrame:
    """rows(shard, dim, vec_id, v), each shard and dim in one run -> shard, wave, dim, tree: a record a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def record() -> pa.RecordBatch:
            ball = Ball(np.array(vectors, dtype=np.int64), np.array(ids, dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([int(key[0]).bit_length()], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ball.data()], pa.binary())], ["shard", "wave", "dim", "tree"])

        for batch in batches:
            for s, d, i, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "dim", "vec_id", "v"))):
                if (s, d) != key:
                    if ids:
                        yield record()
                    key, ids, vectors = (s, d), [], []
                ids.append(i)
                vectors.append(v)
        if ids:
            yield record()

    return rows.select("shard", "dim", "vec_id", "v").mapInArrow(run, "shard int, wave int, dim int, tree binary")


def search(shards: DataFrame, queries: list[tuple[int, int, list[int], float]], k: int) -> DataFrame:
    """shards of `trees`, queries of (number, vec_id, vector, known kth score) -> number, query_id, vec_id, score of each shard's best."""
    sent = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(n, i, np.array(v, dtype=np.int64), low) for n, i, v, low in sent.value]
        for batch in batches:
            for dim, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ball, out = pickle.loads(data.as_buffer()), []
                mine = [a for a in asked if len(a[2]) == dim]
                top = max([np.abs(ball.x).max(initial=0), *(np.abs(v).max(initial=0) for _, _, v, _ in mine)])
                if float(top) ** 2 * dim < 2**52:  # floats are faster, and exact up to here
                    ball.x = ball.x.astype(np.float64)
                    mine = [(n, i, v.astype(np.float64), low) for n, i, v, low in mine]
                for n, i, v, low in mine:
                    out += [(n, i, -w, s) for s, w in ball.search(v, i, k, low)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], [], []))], ["number", "query_id", "vec_id", "score"])

    return shards.select("dim", "tree").mapInArrow(run, "number bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, per_shard: int = 4096, query_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that is_query picks (by the column vec_id)."""
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), whole(vectors[vector_col], scale).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    rows = materialise(rows, "vectors")
    shards = max(1, math.ceil(rows.count() / per_shard))
    # Rows that repeat are dealt by a number of their own, so that no vector, however often it occurs, fills a shard.
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "vec_id", "v")
    parts = min(shards, max(math.ceil(shards / 32), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tree = materialise(trees(dealt.repartition(parts, "shard").sortWithinPartitions("shard", "dim")), "trees", "wave")
    asked = materialise(rows.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    found = rows.sparkSession.createDataFrame([], "number bigint, query_id bigint, vec_id bigint, score bigint")
    for b in range(blocks):
        own = [(r["number"], r["vec_id"], r["v"]) for r in asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).collect()]
        low: dict[int, int] = {}
        hits = None
        waves = (shards - 1).bit_length() + 1  # the last ones hold an eighth of the shards and more
        for wave in [range(0, max(1, waves - 3)), *[range(w, w + 1) for w in range(max(1, waves - 3), waves)]]:
            part = search(tree.where(F.col("wave").isin([*wave])), [(n, i, v, low.get(n, -math.inf)) for n, i, v in own], k)
            both = part if hits is None else hits.unionByName(part)
            best = both.withColumn("rank", F.row_number().over(_best())).where(F.col("rank") <= k)
            former, hits = hits, materialise(best.drop("rank"), "hits")
            if former is not None:
                drop(former)
            low = {r["number"]: r["score"] for r in hits.groupBy("number").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        found = found.unionByName(hits)
    return found.withColumn("rank", F.row_number().over(_best())).select("query_id", "rank", "vec_id", "score")


def _best():
    return Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")


def sql(k: int = 10, scale: int = 1024, every: int = 100) -> str:
    """The same over the view `embeddings`, for DuckDB."""
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id % {every} = 0 AND q.vec_id <> e.vec_id AND len(q.v) = len(e.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
