"""The corpus pipeline: documents through quality rules, language ID, near-duplicate removal, mixing and BPE.

Each stage works on all rows its predecessor kept and finds its input written, so whatever the stage before wrote on its way
is deleted when the next one begins. The first four return the columns of documents; the last
one gives each remaining document's token count and the digests of its ids and of its decoded text.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, langid, mixing, quality
from tessera.llm.common import clear, delete, materialise, scope, small_batches, table
from tessera.llm.queries import vocabulary

#: Target shares of the mixing stage are token shares to these powers, so mild that the share of tokens asked for can be kept (`mixing.margins` tells both).
TEMPER, KEEP = dict.fromkeys(mixing.DIMS, 0.9), 0.6

#: Tables and broadcasts that the last stage made on its way, by driver thread, so that pipelines side by side keep apart.
#: A stage's result is written by the time that the next stage begins.
_THREAD = threading.local()


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes what the stage before it left."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _THREAD.__dict__.setdefault("left", [])
        clear(spark, left)
        small_batches(spark)
        with scope(left):
            return work(spark, docs, sf_dir)

    return run_stage



@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; null languages are filled in."""
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()), vocabulary("piece_bpe_32k.model"))
    return langid.keep(docs, model)


@stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a word 5-gram Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, k=5, percent=80)


@stage
def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of KEEP of the tokens by raked weights of source, language and topic."""
    return mixing.sample(docs, TEMPER, keep=KEEP)


@stage
def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return bpe.round_trips(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mixing_weights),
    ("BPE encoding and decoding", bpe_round_trip),
]
#: SQL can't state the forest, the language model or the tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for k, (_, work) in enumerate(STAGES):
        docs = materialise(work(spark, docs, sf_dir), f"stage{k}")
        if last is not None:
            delete(spark, last)
        last = docs._table
    return docs
