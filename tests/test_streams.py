"""Streams: the state equals one compile of all input after batches are killed and come again; session state is bounded."""

import datetime as dt
import random

import pytest

from test_compile import CAND, taken
from tessera.operators import compile as K
from tessera.streaming import families as S
from tessera.streaming import ingest as I

T0 = dt.datetime(2024, 1, 1)


def ontology(spark):
    return spark.createDataFrame([("B2", "b")], "alias string, canonical string"), spark.createDataFrame([("u", "Unit")], "mention string, type string"), spark.createDataFrame([("Concept", "p", "Unit")], "subject_type string, predicate string, object_type string")


def test_killed_and_repeated_batches_change_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    terms = ["a", "b", "ab", "abc；d", "long words here", "x、y", "B2", "u"]
    rows = [(i, rng.choice(["S", "T", "V"]), rng.choice(["p", "only"]), rng.choice(terms), rng.randint(1, 9) / 10, f"s{i % 7}", f"q{i}", 0, 2, T0 + dt.timedelta(minutes=i)) for i in range(120)]
    df = spark.createDataFrame(rows, CAND)
    want = K.ingest(df, spark.createDataFrame([], K.CLAIM), *ontology(spark), exclusive=["only"])
    claims, evidence = taken(want.claims), sorted(map(tuple, want.evidence.collect()))
    store = S.FamilyStore(spark, str(tmp_path / "store"), exclusive=["only"], full=2, buckets=5)
    batch = lambda n: df.where(f"ord >= {n * 30} AND ord < {n * 30 + 30}")
    for n in range(4):
        store.take(n, batch(n), *ontology(spark))
        if n in (1, 3):
            store.take(n, batch(n), *ontology(spark))  # comes again
        if n == 2:
            with monkeypatch.context() as m:  # killed after its evidence was written
                m.setattr(S, "bucket_of", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    store.take(3, batch(3), *ontology(spark))
    assert taken(store.claims(4)) == claims and sorted(map(tuple, store.evidence(4).collect())) == evidence
    assert len(taken(store.claims(3))) < len(claims)


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    rows = [(i, "S", "p", f"object number {i % 11}", 0.5, f"s{i}", "q", 0, 1, T0) for i in range(40)]
    df = spark.createDataFrame(rows, CAND)
    source = S.slices(df, df.ord, 4)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store, state, calls = S.FamilyStore(spark, str(tmp_path / "store"), exclusive=[]), str(tmp_path / "state"), []

    def failing(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return batch

    with pytest.raises(Exception):
        S.stream_claims(stream(), failing, *ontology(spark), store, state)
    assert S.batches_done(spark, state) == 1
    assert S.stream_claims(stream(), failing, *ontology(spark), store, state) == 4
    want = K.ingest(df, spark.createDataFrame([], K.CLAIM), *ontology(spark), exclusive=[])
    assert taken(store.claims(4)) == taken(want.claims) and len(calls) == 5


def test_idle_sessions_leave_the_state(spark, tmp_path):
    schema = "session_id string, seq long, at timestamp"
    minutes = lambda m: T0 + dt.timedelta(minutes=m)
    early = [("a", s, minutes(s)) for s in range(15, 0, -1)] + [("b", 1, minutes(1)), (None, 1, minutes(1)), ("a", None, minutes(2))]
    later = [("c", 1, minutes(200)), ("a", 9, minutes(201))]
    last = [("c", 2, minutes(400)), ("d", 1, minutes(401))]
    source = tmp_path / "in"
    for k, rows in enumerate((early, later, last)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    told = I.session_memory(stream, str(tmp_path / "out"), str(tmp_path / "state"), most=4)
    assert told["numRowsTotal"] == 2  # c and d; a and b are idle for more than an hour
    got = sorted(tuple(r) for r in I.remembered(spark, str(tmp_path / "out"), 4).collect())
    assert got == [("a", 12), ("a", 13), ("a", 14), ("a", 15), ("b", 1), ("c", 1), ("c", 2), ("d", 1)]
