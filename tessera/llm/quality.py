"""Quality rules: statistics of whole texts, base rules, and an isolation forest calibrated on labelled rows.

The forest is fitted on a bounded sample of labelled rows of good quality (`trees * per_tree` rows,
the smallest md5 of the id first). A document's path lengths over the random splits give its anomaly
score. The threshold is set on all labelled rows: the lowest score, on a grid of 1/1000, at which at most
`max_loss` of the good rows that pass the base rules would be rejected.

Null and empty texts have no words: they fail the base rules. Null ids are rows without a label. Repeated rows are
judged each; of several labels of one id the worst counts. Very long texts are measured whole, one at a time. `judge` reads the id and the text
alone, so extra columns do no harm and are not in its result; `keep` gives all of them back. Without any
labelled good row there is no forest and the base rules decide alone; an empty table gives an empty result. What comes to the driver
is the sample, at most 25,600 rows of eight numbers (2 MB) at any size of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, focus, fresh, give_back, materialise, trimmed, windows, word_hashes

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics the forest splits on; shares, so that length alone is no anomaly.
FEATURES = ["chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "punct_share", "digit_share", "bare_share"]
PUNCTUATION = "!?;:.,"
BARE = [f" {c} ".encode() for c in SYMBOLS]
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in k-word windows found twice or more, first finds included."""
    if len(words) <= k:
        return 0
    h = windows(word_hashes(words), k)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(h), dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    """The five counts of the base rules and the features."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on ASCII white space only, as the rules say
    n, chars = len(words), len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    raw = np.frombuffer(data, dtype=np.uint8)
    kinds = np.bincount(raw, minlength=256)
    upper, digits = int(kinds[65:91].sum()), int(kinds[48:58].sum())
    letters = upper + int(kinds[97:123].sum())
    c = max(chars, 1)
    return (n, chars, symbols, dup, repeat, chars / max(n, 1), symbols / c, dup / max(len(lines), 1), repeat / max(n, 1), upper / max(letters, 1), sum(int(kinds[ord(p)]) for p in PUNCTUATION) / c, digits / c, sum(map(data.count, BARE)) / max(n, 1))


def counted(texts: pa.Array) -> pa.Array:
    """The counts and features of texts, as structs."""
    focus("words")
    rows = [row for part in by_bytes(texts) for row in map(statistics, part.to_pylist())]
    give_back()
    cols = list(zip(*rows)) or [()] * (len(COUNTS) + len(FEATURES))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64() if i < len(COUNTS) else pa.float64()) for i, x in enumerate(cols)], [*COUNTS, *FEATURES])


def statistics_of(text: Column) -> Column:
    kinds = ", ".join([f"{c}: bigint" for c in COUNTS] + [f"{c}: double" for c in FEATURES])
    return F.arrow_udf(counted, f"struct<{kinds}>").asNondeterministic()(text)  # else the optimizer evaluates it once for each field


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the five counts, base_failed and the features. Narrow, no shuffle."""
    out = docs.select(docs[id_col].cast("bigint").alias("doc_id"), statistics_of(docs[text_col]).alias("s"))
    return out.select("doc_id", "s.*").withColumn("base_failed", base_failed())


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """One isolation tree as arrays: feature (-1 in a leaf), cut, left, right, path length at a leaf.

    Cuts are drawn over a node's box, which starts as [low, high]; so a cut can part good rows from empty
    space where junk lies, even in features that do not vary among good rows.
    """
    feature, cut, left, right, length = [], [], [], [], []

    def node(x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        me = len(feature)
        for a in (feature, cut, left, right, length):
            a.append(0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(x) <= 1 or not len(wide):
            feature[me], length[me] = -1, depth + mean_path(len(x))
            return me
        f = int(rng.choice(wide))
        feature[me], cut[me] = f, rng.uniform(low[f], high[f])
        went, top, bottom = x[:, f] < cut[me], high.copy(), low.copy()
        top[f] = bottom[f] = cut[me]
        left[me] = node(x[went], low, top, depth + 1)
        right[me] = node(x[~went], bottom, high, depth + 1)
        return me

    node(rows, low, high, 0)
    return tuple(map(np.array, (feature, cut, left, right, length)))


class Forest:
    """Isolation forest; `score` is 2 ** (-mean path length / expected path length), in (0, 1)."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, per_tree: int, seed: int):
        rng = np.random.default_rng(seed)
        per_tree = min(per_tree, len(sample))
        self.norm = max(mean_path(per_tree), 1.0)
        limit = math.ceil(math.log2(max(per_tree, 2)))
        self.trees = [grow(sample[rng.choice(len(sample), per_tree, replace=False)], low, high, rng, limit) for _ in range(trees)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while len(go := np.flatnonzero(feature[at] >= 0)):
                here = at[go]
                f = feature[here]
                at[go] = np.where(x[go, f] < cut[here], left[here], right[here])
            total += length[at]
        return 2.0 ** (-total / (len(self.trees) * self.norm))


def fit_forest(stats: DataFrame, labels: DataFrame, trees: int = 100, per_tree: int = 256, seed: int = 7) -> Forest | None:
    """Fit on at most trees * per_tree good labelled rows that pass the base rules; the box is that of all labelled rows."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    rows = stats.where(~F.col("base_failed")).join(marks, "doc_id")
    sample = rows.where("good").orderBy(F.md5(rows["doc_id"].cast("string")), *FEATURES).limit(trees * per_tree).select(*FEATURES).toArrow()
    box = rows.agg(*[f(c).alias(f"{c}_{n}") for n, f in (("low", F.min), ("high", F.max)) for c in FEATURES]).first()
    low, high = (np.array([box[f"{c}_{n}"] for c in FEATURES], dtype=float) for n in ("low", "high"))
    return Forest(np.column_stack([sample[c].to_numpy() for c in FEATURES]), low, high, trees, per_tree, seed) if len(sample) else None


def score(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """stats with anomaly (double; null without a forest)."""
    if forest is None:
        return stats.withColumn("anomaly", F.lit(None).cast("double"))
    model = stats.sparkSession.sparkContext.broadcast(forest)

    def anomaly(*columns: pa.Array) -> pa.Array:
        return pa.array(model.value.score(np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])))

    return stats.withColumn("anomaly", F.arrow_udf(anomaly, "double")(*FEATURES))


def threshold(scored: DataFrame, labels: DataFrame, max_loss: float = 0.005, grid: int = 1000) -> float:
    """The lowest cut at which at most max_loss of the good labelled rows that pass the base rules lie above it."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    cells = scored.where(~F.col("base_failed") & F.col("anomaly").isNotNull()).join(good, "doc_id", "left_semi").groupBy(F.floor(F.col("anomaly") * grid).cast("int").alias("cell")).count().collect()
    total, above = sum(r["count"] for r in cells), 0
    for r in sorted(cells, key=lambda r: -r["cell"]):
        if above + r["count"] > max_loss * total:
            return (r["cell"] + 1) / grid
        above += r["count"]
    return 1.0


def verdict(cut: float) -> Column:
    return ~F.col("base_failed") & (F.coalesce(F.col("anomaly"), F.lit(0.0)) < cut)


def judge(docs: DataFrame, labels: DataFrame, stats: DataFrame | None = None, max_loss: float = 0.005, **forest) -> DataFrame:
    """Per row of docs: doc_id, counts, base_failed, anomaly, cut, kept. stats: what `measure` gave, if already stored."""
    stats = measure(docs) if stats is None else stats
    scored = score(stats, fit_forest(stats, labels, **forest))
    cut = threshold(scored, labels, max_loss)
    return scored.select("doc_id", *COUNTS, "base_failed", "anomaly", F.lit(cut).alias("cut"), verdict(cut).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, max_loss: float = 0.005, id_col: str = "doc_id", text_col: str = "text", **forest) -> DataFrame:
    """docs without the rows that the base rules or the forest reject; all columns stay, whatever their names. No row is
    shuffled; texts are measured once, and the statistics stored beside the rows that pass the base rules."""
    names, (row, mark) = docs.columns, fresh(docs, "_row", "_stats")
    told = docs.withColumn(mark, statistics_of(docs[text_col])).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), f"{mark}.*")
    told = materialise(told.withColumn("base_failed", base_failed()).where("NOT base_failed"), "measured")
    stats = told.drop(row)
    model = fit_forest(stats, labels, **forest)
    cut = threshold(score(stats, model), labels, max_loss)
    return score(told, model).where(verdict(cut)).select(f"{row}.*")
