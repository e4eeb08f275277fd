"""URL filters: listed rules first, then naive Bayes over segmented host and path words.

Host and path names are cut at other characters than letters; each run of letters is split into words by a
unigram Viterbi search over a fixed public dictionary, its words weighted by their counts in all pages. A multinomial naive Bayes
over the words judges urls that no rule fits. It learns from the verdicts of the rules on all pages that one fits, less a fifth by the crc32
of their ids, on which `held_out_accuracy` measures it; the seed words, a list for users to set, are `seed_weight` further
finds each in blocked urls. What comes back to the driver is bounded by the dictionary (about 49,000
words), not by the data.

Null urls and urls without `://` have empty host and path and the verdict of the class prior. Letters beyond a-z
cut words. Words outside the dictionary count as one unknown word. Null ids count as not held out. Repeated rows are judged each; very long urls
whole; an empty table gives an empty result. Only id, url and html are read, so extra columns do no harm. Ties allow.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The listed rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Further finds of each seed word in blocked urls.
SEED_WEIGHT = 20
# Seed words of unwanted hosts and paths.
SEEDS = frozenset("adult ads bet bets betting casino cialis escort gambling jackpot malware phishing pills poker porn sex spam slots torrent viagra warez xxx".split())
UNKNOWN, RUN, TAG = "<unknown>", re.compile("[a-z]+"), re.compile("<[^>]*>")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # later ones, being longer, go on top
        top, slash, rest = text.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit("." + top))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def dictionary(vocabulary_file: str) -> dict[str, int]:
    """Whole words of a public vocabulary, with their place in it."""
    with open(vocabulary_file, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, t[:-4]) for t, i in vocab.items() if t.endswith("</w>"))
    return {w: n for n, (_, w) in enumerate((i, w) for i, w in words if RUN.fullmatch(w) and (len(w) > 1 or w in "ai"))}


class Splitter(dict):
    """Run of letters -> its words, by the cheapest path; remembers what it split, up to a bound."""

    def __init__(self, counts: dict[str, float]):
        super().__init__()
        total = sum(counts.values()) or 1.0
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)

    def __missing__(self, run: str) -> list[str]:
        best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for e in range(1, len(run) + 1):
            for b in range(max(0, e - self.longest), e):
                c = best[b] + self.cost.get(run[b:e], 25.0 if e - b == 1 else math.inf)
                if c < best[e]:
                    best[e], back[e] = c, b
        out, e = [], len(run)
        while e:
            w = run[back[e] : e]
            w = w if w in self.cost else UNKNOWN
            if not (w == UNKNOWN and out and out[-1] == UNKNOWN):
                out.append(w)
            e = back[e]
        if len(self) > 200_000:
            self.clear()
        self[run] = out[::-1]
        return self[run]

    def words(self, text: str) -> list[str]:
        return [w for run in RUN.findall(text.lower()) for w in self[run]]


def word_counts(pages: DataFrame, words: dict[str, int], html_col: str = "html", prior: float = 1e5) -> dict[str, float]:
    """Counts of the dictionary's words in the text of all pages, plus a prior that falls with the word's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                total.update(w for w in RUN.findall(TAG.sub(" ", (html or "").lower())) if w in words)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    got = pages.select(html_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {r["word"]: r["n"] for r in got}
    return {w: seen.get(w, 0) + prior / (place + 100) for w, place in words.items()}


class Bayes:
    """seeds: finds added to a word's own count in blocked urls, but not to the class's total, which is the data's."""

    def __init__(self, counts: Counter, pages: Counter, seeds: dict[str, int] | None = None):
        seeds = seeds or {}
        vocab = {w for _, w in counts} | {UNKNOWN, *seeds}  # each with one find more than it has, in either class
        size = {v: sum(n for (s, _), n in counts.items() if s == v) + len(vocab) for v in ("allow", "block")}
        self.word = {w: math.log((counts["block", w] + seeds.get(w, 0) + 1) / size["block"]) - math.log((counts["allow", w] + 1) / size["allow"]) for w in vocab}
        self.prior = math.log((pages["block"] + 1) / (pages["allow"] + 1))

    def score(self, words: list[str]) -> float:
        """Log odds of being blocked."""
        return self.prior + sum(self.word.get(w, self.word[UNKNOWN]) for w in words)


def held_out(id_col: str = "page_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(pages: DataFrame, splitter: Splitter, seeds: frozenset[str] = SEEDS, seed_weight: int = SEED_WEIGHT) -> Bayes:
    """Word counts of all pages (columns host, path, said: a rule's verdict) that have a verdict, and the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for host, path, label in zip(*(c.to_pylist() for c in batch.columns)):
                total[label, ""] += 1
                total.update((label, w) for w in splitter.words(host + " " + path))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], ["label", "word", "n"])

    rows = pages.select("host", "path", "said").where("said IS NOT NULL").mapInArrow(run, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n")).collect()
    counts = Counter({(r["label"], r["word"]): r["n"] for r in rows if r["word"]})
    return Bayes(counts, Counter({r["label"]: r["n"] for r in rows if not r["word"]}), dict.fromkeys(seeds, seed_weight))


def held_out_accuracy(judged: DataFrame) -> DataFrame:
    """n and accuracy of the method alone on held-out pages that a rule judges (judged: what `judge` gave)."""
    rows = judged.where(held_out() & F.col("rule").isNotNull())
    return rows.agg(F.count("*").alias("n"), F.avg(((F.col("log_odds") > 0) == (F.col("verdict") == "block")).cast("double")).alias("accuracy"))


def judge(pages: DataFrame, vocabulary_file: str, rules: list[tuple[str, str]] = RULES, seeds: frozenset[str] = SEEDS, seed_weight: int = SEED_WEIGHT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, words (split host and path) and log_odds of the method."""
    host, path = parts(pages[url_col])
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    splitter = Splitter(word_counts(pages, dictionary(vocabulary_file), html_col))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    model = fit(rows.where(~held_out()).withColumn("said", said), splitter, seeds, seed_weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [splitter.words(h + " " + p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([" ".join(w) for w in words], pa.string()), pa.array([model.score(w) for w in words], pa.float64())], ["page_id", "host", "path", "words", "log_odds"])

    scored = rows.mapInArrow(run, "page_id bigint, host string, path string, words string, log_odds double")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "words", "log_odds")
