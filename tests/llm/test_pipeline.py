"""The pipeline's stages, each held against its operator or a brute-force version, on the smallest tables."""

import hashlib

import corpus_pipeline as P
from test_topk_jaccard import brute_components
from tessera.llm import mixing, quality
from tessera.llm.common import materialise
from tessera.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = {}
    for name, stage in P.STAGES:
        steps[name] = (docs, docs := materialise(stage(spark, docs, SF), "test-stage"))
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == names for name, (_, after) in steps.items() if name != P.STAGES[-1][0])
    before, after = steps["quality rules"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in quality.judge(before, labels).where("kept").collect())
    before, after = steps["language ID"]
    assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() > 0.95 * before.count()
    before, after = steps["n-gram Jaccard join"]
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)}
    assert {r["doc_id"] for r in after.collect()} == want and after.count() == len(want)
    before, after = steps["mixing sources to target weights"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in mixing.mix(before, P.TEMPER, keep=P.KEEP).where("sampled").collect())
    before, after = steps["BPE encoding and decoding"]
    lib = Tokenizer.from_file(vocabulary())
    lib.no_truncation()
    lib.no_padding()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    got = after.collect()
    assert len(got) == len(texts) > 0
    for r in got:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_a_worker_keeps_no_codec_for_other_stages():
    import weakref

    from tessera.llm import bpe, common

    common.focus("bpe")
    held = weakref.ref(bpe.codec(vocabulary()))
    held().encode("some words")
    common.focus("langid")
    assert held() is None


def test_rows_of_language_memory_keep_their_values_as_they_grow():
    import numpy as np

    from tessera.llm import langid

    pieces = ["\u2581", *"abcdefghij"]
    prob = np.random.default_rng(5).random((len(pieces) + 1, 2))
    prob[0] = 0
    memory = langid.Memory(langid.Model(["x", "y"], langid.Lattice(pieces), prob / prob.sum(0)))
    runs = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(40_000)]
    memory.learn(runs[:10_000])
    first = {r: memory.rows[memory.at[r]].copy() for r in runs[:10_000:97]}
    memory.learn(runs[10_000:])
    assert len(memory.rows) >= 40_000 and all((memory.rows[memory.at[r]] == v).all() for r, v in first.items())
