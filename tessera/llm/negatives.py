"""Hard negatives by inner product: a vertical, branch-and-bound scan over columnar vectors (BOND).

Rows are dealt to shards of bounded size; a shard is one record that holds its vectors dimension by dimension, each with
its least and greatest value. An anchor reads a shard's dimensions in descending order of its own magnitudes. After each step a row's
score lies between its partial score plus the least and plus the greatest that the dimensions not yet read can add; the bitmap of
candidates loses every row whose interval shows that it cannot be returned. What is left at the end has exact scores.

There are two scans over the shards. The first finds each anchor's positives: its best rows of its own label. Their scores
give the windows that the second scan fills: of the rows of other labels whose score s satisfies
low * positive <= 100 * s <= high * positive, the best few. In the second scan a row stays while its interval meets some window which
`count` rows sure to lie within it don't beat. Anchors come in blocks of bounded bytes, each sent to all tasks. A task keeps
its kth scores from shard to shard, and gives its best rows an anchor and window when it ends; a window function merges these. Each
block's rows are written beside the others', so that the plan does not grow with the blocks.

Rows with a null id, label or vector, an empty vector, a null or non-finite component, or a component that is, scaled, over
sqrt(2**62 / length) in size (a long could not hold its scores) take no part. Vectors meet only vectors of their own length. A row with the
anchor's id is never its positive or negative. Repeated rows each count, as candidates; rows of one id with different vectors or labels are an
anchor each and are told apart by `anchor`. Ties go to the smaller id. An anchor without positives, or a positive without
negatives, gives no row; fewer rows than asked for are all given. Very long vectors make shards of fewer rows. Only the named columns
are read, so extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm.common import drop, focus, materialise, shared_dir
from tessera.llm.topk import whole

#: Bytes of a shard's vectors, and of a block of anchors.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
#: Dimensions that are read between two looks at the bitmap.
STEP = 4

RESULT = StructType([StructField(c, IntegerType() if c == "rank" else LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor")])
Window_ = tuple[int, int]  # least and greatest score


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Columns:
    """A shard: one array a dimension, with its bounds, and the rows' ids and labels. Rows go by id, so ties need no second key."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = ids.argsort(kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.least, self.most = self.columns.min(1), self.columns.max(1)

    def exact(self, top: int) -> None:
        """Floats are faster, and exact while no sum of products passes 2**52."""
        if float(top) * float(max(-self.least.min(), self.most.max(), 0)) * len(self.columns) < 2**52:
            self.columns, self.least, self.most = (x.astype(np.float64) for x in (self.columns, self.least, self.most))

    def scan(self, q: np.ndarray, rows: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows that keep(least scores, greatest scores) leaves until the last dimension, and their scores."""
        q = q.astype(self.columns.dtype)
        order = np.abs(q).argsort(kind="stable")[::-1]
        low, high = np.minimum(q * self.least, q * self.most), np.maximum(q * self.least, q * self.most)
        rest_low, rest_high = (np.append(np.cumsum(x[order][::-1])[::-1], 0) for x in (low, high))  # of dimensions from each place on
        score = np.zeros(len(rows), self.columns.dtype)
        every = len(rows) == self.columns.shape[1]
        for at in range(0, len(order), STEP):
            for d in order[at : at + STEP]:
                score += q[d] * (self.columns[d] if every else self.columns[d][rows])
            to = min(at + STEP, len(order))
            stay = keep(score + rest_low[to], score + rest_high[to])
            if not stay.all():
                rows, score, every = rows[stay], score[stay], False
                if not len(rows):
                    break
        return rows, score


def shards(rows: DataFrame) -> DataFrame:
    """rows(shard, dim, vec_id, label, v), each shard and dim in one run -> dim, data: one record a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def record() -> pa.RecordBatch:
            data = Columns(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.int32()), pa.array([pickle.dumps(data, protocol=5)], pa.binary())], ["dim", "data"])

        for batch in batches:
            shard, dim = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0)) + 1).tolist(), len(shard)] if len(shard) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if (shard[a], dim[a]) != key:
                    if held:
                        yield record()
                    key, held = (shard[a], dim[a]), []
                part = batch.slice(a, b - a)
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4))))
        if held:
            yield record()

    return rows.select("shard", "dim", "vec_id", "label", "v").mapInArrow(run, "dim int, data binary")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -math.inf


def positives(shard: Columns, q: np.ndarray, own: int, label: int, k: int, known: float) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the shard's rows of that label that can be among the k best; known: the kth score so far."""
    rows = np.flatnonzero((shard.labels == label) & (shard.ids != own))
    if not len(rows):
        return rows, rows
    rows, scores = shard.scan(q, rows, lambda low, high: high >= max(known, kth(low, k)))
    return best(shard.ids[rows], scores, k)


def negatives(shard: Columns, q: np.ndarray, own: int, label: int, k: int, windows: list[Window_], known: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, ids and scores of the shard's rows of other labels that can be among its k best."""
    rows = np.flatnonzero((shard.labels != label) & (shard.ids != own))

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for (a, b), least in zip(windows, known):
            sure = kth(low[(low >= a) & (high <= b)], k)
            stay |= (low <= b) & (high >= max(a, least, sure))
        return stay

    if len(rows):
        rows, scores = shard.scan(q, rows, keep)
    if not len(rows):
        return [(rows, rows)] * len(windows)
    inside = [(scores >= a) & (scores <= b) for a, b in windows]
    return [best(shard.ids[rows[i]], scores[i], k) for i in inside]


def window(score: int, low: int, high: int) -> Window_:
    """Scores s with low * score <= 100 * s <= high * score; empty (least over greatest) where there are none."""
    return -(-low * score // 100), high * score // 100


def anchors(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """number, id, label and vector of each row of a batch that is in order of dim."""
    dim = batch.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(dim)) + 1).tolist(), len(dim)]
    for a, b in zip(cuts, cuts[1:]):
        part = batch.slice(a, b - a)
        yield from zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), matrix(part.column(4)) if b > a else ())


def scanned(table: DataFrame, asked: list[tuple], k: int, bounds: tuple[int, int] | None) -> DataFrame:
    """A scan of all shards for a block of anchors (number, id, label, vector, positive scores) -> anchor, window (the positive score; null for
    positives themselves), vec_id, score: the best of each task."""
    sent = table.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("negatives")
        held: dict[tuple[int, int | None], tuple[np.ndarray, np.ndarray]] = {}

        def note(key: tuple[int, int | None], ids: np.ndarray, scores: np.ndarray) -> None:
            if len(ids):
                have = held.get(key)
                scores = scores.astype(np.int64)
                held[key] = best(ids, scores, k) if have is None else best(np.append(have[0], ids), np.append(have[1], scores), k)

        def known(key: tuple[int, int | None]) -> float:
            have = held.get(key)
            return have[1][-1] if have is not None and len(have[1]) == k else -math.inf

        by_dim: dict[int, list[tuple]] = {}
        for n, i, label, v, scores in sent.value:
            by_dim.setdefault(len(v), []).append((n, i, label, v, scores))
        for batch in batches:
            for dim, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = by_dim.get(dim, [])
                if not mine:
                    continue
                shard = pickle.loads(data.as_buffer())
                shard.exact(max(int(np.abs(v).max()) for _, _, _, v, _ in mine))
                for n, i, label, v, scores in mine:
                    if bounds is None:
                        note((n, None), *positives(shard, v, i, label, k, known((n, None))))
                    else:
                        got = negatives(shard, v, i, label, k, [window(s, *bounds) for s in scores], [known((n, s)) for s in scores])
                        for s, (ids, found) in zip(scores, got):
                            note((n, s), ids, found)
        keys = [(key, len(ids)) for key, (ids, _) in held.items()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([n for (n, _), c in keys for _ in range(c)], pa.int64()),
                pa.array([s for (_, s), c in keys for _ in range(c)], pa.int64()),
                pa.array(np.concatenate([ids for ids, _ in held.values()]) if held else [], pa.int64()),
                pa.array(np.concatenate([s for _, s in held.values()]) if held else [], pa.int64()),
            ],
            ["anchor", "window", "vec_id", "score"],
        )

    return table.select("dim", "data").mapInArrow(run, "anchor bigint, window bigint, vec_id bigint, score bigint")


def first(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and anchor (a number for each anchor row). is_anchor: by the column vec_id."""
    spark = vectors.sparkSession
    labels = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), labels.cast("bigint").alias("label"), whole(vectors[vector_col], scale).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL")
    rows = materialise(rows.withColumn("dim", F.size("v")), "vectors")
    size = rows.agg(F.sum(F.col("dim").cast("double") * 8)).first()[0] or 0
    parts = max(1, math.ceil(size / shard_bytes))
    # Rows that repeat are dealt by a number of their own, so that no vector, however often it occurs, fills a shard.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    tasks = min(parts, max(math.ceil(parts / 32), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = materialise(shards(dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "dim")), "columns")
    asked = materialise(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "v"]).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    bytes_asked = asked.agg(F.sum(F.col("dim").cast("double") * 8)).first()[0] or 0
    blocks = max(1, math.ceil(bytes_asked / block_bytes))
    path = f"{shared_dir(spark)}/tessera-negatives-{uuid.uuid4().hex}"
    for at in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == at)
        own = [(n, i, label, v) for batch in block.orderBy("dim").select("dim", "anchor", "vec_id", "label", "v").toArrow().to_batches() for n, i, label, v in anchors(batch)]
        near = materialise(first(scanned(table, [(*a, ()) for a in own], n_positives, None), n_positives), "positives")
        scores: dict[int, tuple[int, ...]] = {}
        for r in near.select("anchor", "score").distinct().collect():
            scores[r["anchor"]] = (*scores.get(r["anchor"], ()), r["score"])
        windows = [(*a, tuple(s for s in scores.get(a[0], ()) if window(s, low, high)[0] <= window(s, low, high)[1])) for a in own]
        far = first(scanned(table, [w for w in windows if w[4]], n_negatives, (low, high)), n_negatives)
        pairs = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        got = far.select("anchor", "rank", F.col("vec_id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "positive_score"])
        got = got.join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(RESULT.names)
        got.write.parquet(f"{path}/block={at}")
        drop(near)
    return spark.read.schema(RESULT).parquet(path).select(RESULT.names)


def sql(n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, every: int = 100) -> str:
    """The contract's query over the view `embeddings`, for DuckDB."""
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % {every} = 0 AND a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {n_positives})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {n_negatives}"""
