"""What bounds the memory of Python tasks, whatever the size of a table."""

import numpy as np
import pyarrow as pa

from tessera.operators import chunks as K
from tessera.operators import retrieve as R
from tessera.sources import bindings as B


def test_batches_are_small(spark):
    B.read(spark, "/root/testdata/sf0.001", "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(B.BATCH_BYTES)


def test_vectors_are_scored_few_at_a_time():
    n = 3 * R.VECTORS + 5
    vectors = pa.array([[float(i), None, 1.0] for i in range(n)], pa.list_(pa.float32()))
    got = list(R._vector_blocks(iter([pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), vectors], ["id", "vector"])])))
    assert max(len(ids) for ids, _ in got) <= R.VECTORS
    assert np.concatenate([ids for ids, _ in got]).tolist() == list(range(n))
    assert np.concatenate([x[:, 0] for _, x in got]).tolist() == [float(i) for i in range(n)]


def test_cosine_lane_keeps_the_best_over_all_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (700, 4)).astype(float)
    x[5] = x[17] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r.id for r in R.cosine_lane(df.where("id % 50 = 0").withColumnRenamed("id", "query_id"), df, 6).collect()}
    norm = np.sqrt((x * x).sum(1))
    for q in range(0, 700, 50):
        s = (x[q] @ x.T) / np.where(norm > 0, norm * norm[q], np.nan) if norm[q] else np.full(700, np.nan)
        s[q] = np.nan
        assert [np.round(s[got[q, r]], 9) for r in range(1, 7) if (q, r) in got] == np.round(np.sort(s[~np.isnan(s)])[::-1][:6], 9).tolist()


def test_headings_of_odd_lines():
    text = "a # no\r\n  ## Two  \u2028#\n####### seven\n# \n\x0b#\tTab \x0b\n### deep\n## x ## \n"
    got = [(text[a:b], t) for a, b, t in K.headed(text)]
    assert "".join(x for x, _ in got) == text
    assert [t for _, t in got] == [None, "Two\u2028", "\tTab", "x ##"]
    assert K.headed("") == [] and K.headed("## a") == [(0, 4, "a")] and K.headed("plain") == [(0, 5, None)]


def test_grouped_edges_lie_in_parts_of_bounded_size(spark, monkeypatch):
    from tessera.plans import govern

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(B, "PART_ROWS", 500)
    sizes = govern.QUERIES["g2_merged_relations"](spark, sf).rdd.glom().map(len).collect()
    assert max(sizes) < 700 and sum(sizes) == B.relations(spark, sf).count()
    assert max(B.relations(spark, sf).rdd.glom().map(len).collect()) < 700
