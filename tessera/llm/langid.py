"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's likelihood is the sum,
by the forward algorithm, over all its segmentations into pieces; a text's is the product over its words.
Piece probabilities come from expectation maximisation on word counts of a bounded sample of labelled rows
(about `per_lang` documents of each language, chosen by the md5 of their ids). Predictions look at the text alone.

Words are runs of letters, lower-cased. A null text, or one without a letter, gets `und` and score 0. A
character that no piece covers has the same small probability in each language. With nothing to learn from,
every text gets `und`, and an empty table gives an empty result. Ties go to the first language in order. Repeated rows
are each predicted, null ids too. Very long texts are taken whole, one at a time. `predict` gives the columns asked for and two more,
which must not be among them; `keep` gives all columns of docs.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import by_bytes, cached_by, focus, fresh, give_back, leave, trimmed

WORD = regex.compile(r"\p{L}+")
MARK, UNKNOWN = "▁", 1e-9
#: Bytes that a worker's memory of runs may take before it starts afresh, and what a run takes besides its letters and likelihoods.
CACHE_BYTES, RUN_BYTES = 32 << 20, 160
BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def pieces(model_file: str) -> list[str]:
    """The vocabulary's pieces of letters as lower-case text, of any length, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for i in own if (p := sp.id_to_piece(i).lower()).replace(MARK, "", 1).isalpha() or p == MARK})


class Lattice:
    """Numbers the pieces (0 is none) and lists, for words of one length, the piece that ends at each place.

    Substrings are found by rolling 64-bit hashes in tables of one slot an entry; pieces that clash in a table
    go to the next one."""

    def __init__(self, vocabulary: list[str]):
        self.number = {p: i + 1 for i, p in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)
        hashes = {p: int(self.hashes(self.codes([p]), len(p))[0, -1]) for p in vocabulary}
        self.tables, left, bits = [], list(vocabulary), 18
        while left:
            keys, ids, clashed = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32), []
            for p in left:
                slot = hashes[p] >> (64 - bits)
                if ids[slot]:
                    clashed.append(p)
                else:
                    keys[slot], ids[slot] = hashes[p], self.number[p]
            self.tables.append((np.uint64(64 - bits), keys, ids))
            left, bits = clashed, 14

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)

    @staticmethod
    def hashes(codes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all substrings of length k."""
        n = codes.shape[1]
        total = np.zeros((len(codes), n - k + 1), dtype=np.uint64)
        for j in range(k):
            total = total * BASE + codes[:, j : n - k + 1 + j]
        return total * SPREAD

    def grid(self, words: list[str]) -> np.ndarray:
        """Of words of equal length with their mark: piece numbers by word, end and piece length."""
        codes = self.codes(words)
        n = codes.shape[1]
        out = np.zeros((len(words), n, min(self.longest, n)), dtype=np.int32)
        ends = codes.copy()  # hash of the last k letters up to each end, before it is spread
        power = int(BASE)
        for k in range(1, min(self.longest, n) + 1):
            if k > 1:
                ends[:, k - 1 :] += codes[:, : n - k + 1] * np.uint64(power)
                power = power * int(BASE) % 2**64
            h = ends[:, k - 1 :] * SPREAD
            for shift, keys, ids in self.tables:
                slot = (h >> shift).astype(np.int64)
                out[:, k - 1 :, k - 1] += np.where(keys[slot] == h, ids[slot], 0)
        return out


def forward(grid: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[word, end, language], scaled at each end, and the logs of the scales summed up to each end. prob[0] is 0."""
    words, n, longest = grid.shape
    alpha, scale = np.zeros((words, n + 1, prob.shape[1])), np.zeros((words, n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for e in range(1, n + 1):
        total = UNKNOWN * alpha[:, e - 1]
        for k in range(1, min(e, longest) + 1):
            ids = grid[:, e - 1, k - 1]
            if (some := np.flatnonzero(ids)).size:
                step = np.exp(scale[some, e - k] - scale[some, e - 1]) if k > 1 else 1
                total[some] += alpha[some, e - k] * step * prob[ids[some]]
        total = np.maximum(total, 1e-300)
        alpha[:, e] = 1
        scale[:, e] = scale[:, e - 1] + np.log(total)
    return alpha, scale


def by_length(words: list[str], longest: int, most: int = 2_000_000) -> Iterator[list[int]]:
    """Indices of words of equal length, in blocks whose grids stay small."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for n, ids in groups.items():
        step = max(1, most // (n * min(n, longest) * 4))
        for a in range(0, len(ids), step):
            yield ids[a : a + step]


def log_likelihoods(words: list[str], lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """log P(word | language), by word and language, all segmentations summed."""
    marked = [MARK + w for w in words]
    out = np.zeros((len(words), prob.shape[1]))
    for ids in by_length(marked, lattice.longest):
        _, scale = forward(lattice.grid([marked[i] for i in ids]), prob)
        out[ids] = scale[:, -1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur counts times; prob: of one language, as a column."""
    marked = [MARK + w for w in words]
    out = np.zeros(len(prob))
    for ids in by_length(marked, lattice.longest):
        grid = lattice.grid([marked[i] for i in ids])
        _, scale = forward(grid, prob)
        pre, weight = scale[:, :, 0], counts[ids]
        n, longest = grid.shape[1:]
        back = np.full((len(ids), n + 1), -np.inf)  # log of what follows each place
        back[:, n] = 0
        for a in range(n - 1, -1, -1):
            terms = [np.log(UNKNOWN) + back[:, a + 1]]
            for k in range(1, min(longest, n - a) + 1):
                p = prob[grid[:, a + k - 1, k - 1], 0]
                terms.append(np.where(p > 0, np.log(np.maximum(p, 1e-300)) + back[:, a + k], -np.inf))
            back[:, a] = np.logaddexp.reduce(terms, axis=0)
        for e in range(1, n + 1):
            for k in range(1, min(e, longest) + 1):
                pid = grid[:, e - 1, k - 1]
                use = weight * np.exp(np.minimum(pre[:, e - k] + np.log(np.maximum(prob[pid, 0], 1e-300)) + back[:, e] - pre[:, n], 0)) * (pid > 0)
                np.add.at(out, pid, use)
    out[0] = 0
    return out


class Model:
    """Languages and their piece probabilities; predicts texts."""

    def __init__(self, langs: list[str], lattice: Lattice, prob: np.ndarray):
        self.langs, self.lattice, self.prob, self.shared = langs, lattice, prob, None
        self.key = hashlib.sha1(prob.tobytes() + "|".join(langs).encode()).hexdigest()

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text, in slices of bounded bytes."""
        focus("langid")
        langs, scores = [], []
        for part in by_bytes(texts, 1 << 20):
            for out, got in zip((langs, scores), self.predict_slice(part.to_pylist())):
                out += got
        return langs, scores

    def predict_slice(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        memory = _MEMORY.setdefault(self.key, Memory(self))
        langs, scores = [], []
        runs = [(t or "").lower().split() for t in texts]
        memory.learn(r for own in runs for r in own)
        for own in runs:
            total = memory.rows[np.array(list(map(memory.at.__getitem__, own)), dtype=np.int64)].sum(0)
            if not total[0] or not self.langs:  # no letter
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmax(total[1:]))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total[1:] - total[1 + best]).sum()))
        return langs, scores


class Memory:
    """What a worker has met between white space: words of letters in each run and their log-likelihoods, summed.

    A cache of bounded bytes that starts afresh when full.
    """

    def __init__(self, model: Model):
        self.model, self.at, self.rows, self.bytes = model, {}, np.zeros((1 << 14, 1 + len(model.langs))), 0

    def learn(self, runs) -> None:
        runs = set(runs)
        fresh = [r for r in runs if r not in self.at]
        more = sum(map(len, fresh)) + len(fresh) * (RUN_BYTES + 8 * self.rows.shape[1])
        if self.bytes + more > CACHE_BYTES:
            self.at, fresh = {}, list(runs)
            self.bytes = sum(map(len, fresh)) + len(fresh) * (RUN_BYTES + 8 * self.rows.shape[1])
        else:
            self.bytes += more
        if not fresh:
            return
        words = [[w] if (w := r.rstrip(".,;:!?")).isalpha() else WORD.findall(r) for r in fresh]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for own in words for w in own))}
        known = log_likelihoods(list(number), self.model.lattice, self.model.prob)[:, : len(self.model.langs)]
        many = np.array([len(own) for own in words], dtype=np.int64)
        rows = np.zeros((len(fresh), 1 + len(self.model.langs)))
        rows[:, 0] = many
        if (some := np.flatnonzero(many)).size:
            flat = known[np.array([number[w] for own in words for w in own], dtype=np.int64)]
            rows[some, 1:] = np.add.reduceat(flat, (np.cumsum(many) - many)[some], axis=0)
        have = len(self.at)
        while have + len(fresh) > len(self.rows):
            more_rows = np.zeros((2 * len(self.rows), self.rows.shape[1]))  # pages take memory when they are first written
            more_rows[:have] = self.rows[:have]
            self.rows = more_rows
        self.rows[have : have + len(fresh)] = rows
        self.at.update(zip(fresh, range(have, have + len(fresh))))


_MEMORY: dict[str, Memory] = {}
_LIVE: dict[str, Model] = {}
cached_by("langid", _MEMORY.clear)
cached_by("langid", _LIVE.clear)


def sent(model: Model, sc: SparkContext) -> Callable[[], Model]:
    """The model as tasks get it: the lattice, which takes most of the memory, is sent once for fitting and prediction, and a worker keeps one model."""
    lattice, rest, key = model.shared or sc.broadcast(model.lattice), sc.broadcast((model.langs, model.prob)), model.key
    leave(lattice, rest)

    def at_work() -> Model:
        focus("langid")
        if key not in _LIVE:
            _LIVE.clear()
            langs, prob = rest.value
            _LIVE[key] = Model(langs, lattice.value, prob)
        return _LIVE[key]

    return at_work


def fit(rows: DataFrame, model_file: str, per_lang: int = 400, rounds: int = 3, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from rows with a language and a letter in the text: about per_lang documents of each language.

    Word counts of the sample stay distributed; each round's expected piece counts (vocabulary times
    languages at most) come back to the driver.
    """
    vocabulary = pieces(model_file)
    lattice = Lattice(vocabulary)
    known = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    cut = known.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in cut)
    # A share of each language by its hash gives per_lang documents on average, whatever the table's size.
    share = F.lit(1.0)
    for r in cut:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_lang / r["count"]))).otherwise(share)
    sample = known.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0 < share)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            of = iter(batch.column(0).to_pylist())
            for part in by_bytes(batch.column(1)):
                for text in part.to_pylist():
                    seen[next(of)].update(WORD.findall(text.lower()))
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counts = sample.select("lang", "text").mapInArrow(trimmed(words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    order = {lang: i for i, lang in enumerate(langs)}
    prob = np.full((len(vocabulary) + 1, max(len(langs), 1)), 1.0 / max(len(vocabulary), 1))
    prob[0] = 0
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(lattice)
    for _ in range(rounds if langs else 0):
        now = sc.broadcast(prob)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            focus("langid")
            lat, p = shared.value, now.value
            total = np.zeros_like(p)
            for batch in batches:
                by: dict[str, list] = defaultdict(list)
                for lang, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                    by[lang].append((w, n))
                for lang, wn in by.items():
                    i = order[lang]
                    total[:, i] += expected_counts([w for w, _ in wn], np.array([n for _, n in wn], float), lat, p[:, i : i + 1])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype("int32")), pa.array(piece.astype("int32")), pa.array(total[piece, lang])], ["lang", "piece", "n"])

        got = counts.mapInArrow(trimmed(expect), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        prob = np.full_like(prob, 0.01)  # a small count for each piece, so that none is impossible
        prob[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        prob[0] = 0
        prob /= prob.sum(0)
        now.destroy()
    counts.unpersist()
    model = Model(langs, lattice, prob)
    model.shared = shared
    return model


def predict(docs: DataFrame, model: Model, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score. Narrow, no shuffle."""
    at_work = sent(model, docs.sparkSession.sparkContext)
    part = docs.select(*keep, F.col(text_col).alias("_text"))
    names = part.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = at_work().predict(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType(part.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")
    return part.mapInArrow(trimmed(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows of no language or of a score under least; a null language becomes the predicted one.
    Only texts go to Python. All columns stay, whatever their names."""
    at_work = sent(model, docs.sparkSession.sparkContext)

    @F.arrow_udf("string")
    def language(texts: pa.Array) -> pa.Array:
        langs, scores = at_work().predict(texts)
        give_back()
        return pa.array([a if a != "und" and s >= least else None for a, s in zip(langs, scores)], pa.string())

    names, (found,) = docs.columns, fresh(docs, "_found")
    once = language.asNondeterministic()  # so that the optimizer doesn't evaluate it again for the filter
    out = docs.withColumn(found, once(docs[text_col])).where(F.col(found).isNotNull())
    return out.withColumn(lang_col, F.coalesce(lang_col, found)).select(*names)
