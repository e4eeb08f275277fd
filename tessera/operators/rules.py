"""Rule packs over texts: one scan a text for the words that rules need, and only the rules whose words occur are matched."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.packs import PRODUCT

FOUND = "id string, pack string, ord bigint, subject string, predicate string, object string, confidence double, quote string, start bigint, end bigint"


def required(pattern: str) -> frozenset[str]:
    """Words one of which is in every match of the pattern: of all such sets that its parts give, the one whose shortest word is longest; empty if there is none."""
    return _needs(re._parser.parse(pattern))


def _needs(parts) -> frozenset[str]:
    sets, run = [], ""
    for kind, value in [*parts, (None, None)]:
        if kind is re._constants.LITERAL:
            run += chr(value)
            continue
        if run:
            sets.append(frozenset([run]))
            run = ""
        if kind is re._constants.SUBPATTERN and not value[1] & re.IGNORECASE:
            sets.append(_needs(value[3]))
        elif kind is re._constants.BRANCH:
            options = [_needs(option) for option in value[1]]
            sets.append(frozenset().union(*options) if all(options) else frozenset())
        elif kind in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and value[0] > 0:
            sets.append(_needs(value[2]))
    return max(sets, key=lambda words: min(map(len, words), default=0), default=frozenset())


class Packs:
    """The rules of all packs, and an automaton over the words they need."""

    def __init__(self, rules: list[tuple[str, int, str, str, str, float]]):
        self.by_pack: dict[str, list[int]] = {}
        self.rules, self.free, needed = [], set(), {}
        for i, (pack, ord_, subject, predicate, pattern, confidence) in enumerate(rules):
            self.by_pack.setdefault(pack, []).append(i)
            self.rules.append((ord_, subject, predicate, re.compile(pattern), confidence))
            words = required(pattern)
            for word in words:
                needed.setdefault(word, []).append(i)
            if not words:
                self.free.add(i)
        self.words = ahocorasick.Automaton()
        for word, owners in needed.items():
            self.words.add_word(word, owners)
        if needed:
            self.words.make_automaton()

    def able(self, text: str) -> set[int]:
        """Rules that may match the text."""
        out = set(self.free)
        if len(self.words):
            for _, owners in self.words.iter(text):
                out.update(owners)
        return out

    def match(self, text: str, pack: str | None) -> Iterator[tuple]:
        own = self.by_pack.get(pack, [])
        able = self.able(text) if own else ()
        for i in own:
            if i not in able:
                continue
            ord_, subject, predicate, pattern, confidence = self.rules[i]
            for n, m in enumerate(pattern.finditer(text)):
                value = m["object"].strip()
                if value:
                    who = m["product"].strip() if subject == PRODUCT else subject
                    yield ord_ * 1_000_000 + n, who, predicate, value, confidence, m[0], m.start(), m.end()


def apply_packs(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """id, pack, ord, subject, predicate, object, confidence, quote, start, end: every match of each rule (pack, ord, subject, predicate, pattern, confidence) of
    a text's own pack (id, text, pack), in order of rule and place; matches with a blank object are dropped.

    Rules are a few hundred rows at most and are sent to the tasks; they can't cross from one pack to another. Texts without a pack, or of one without rules, give
    nothing, nor do null texts. Offsets are code points of the whole text."""
    sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.select("pack", "ord", "subject", "predicate", "pattern", "confidence").orderBy("pack", "ord").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Packs(sent.value)
        for batch in batches:
            rows = [(i, pack, *m) for i, text, pack in zip(*(c.to_pylist() for c in batch.columns)) if text for m in packs.match(text, pack)]
            columns = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    with_rules = rules.select("pack").distinct()
    return texts.select(F.col("id").cast("string").alias("id"), "text", "pack").join(F.broadcast(with_rules), "pack", "left_semi").select("id", "text", "pack").mapInArrow(run, FOUND)  # a row a pack


def sentence(form: Column, subject: Column, predicate: Column, object_: Column) -> Column:
    """A claim in words: its form with subject and object put in, or the three in a row."""
    return F.coalesce(F.replace(F.replace(form, F.lit("{s}"), subject), F.lit("{o}"), object_), F.concat(subject, predicate, object_))
