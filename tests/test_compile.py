"""Compiling into existing history against a loop that takes candidates one by one, and what must not change."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import compile as K

CAND = "ord long, subject string, predicate string, object string, confidence double, source_id string, quote string, start long, end long, at timestamp"
T0 = dt.datetime(2024, 1, 1)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()[:16]


def glue(values):
    """Joined objects, by the rules' words."""
    kept = []
    for v in values:
        v = v.strip()
        for p in filter(None, map(str.strip, v.split("；") if "；" in v else v.split(";"))):
            if [k for k in kept if p in k]:
                continue
            kept = [k for k in kept if k not in p]
            kept.append(p)
    long = [k for k in kept if len(k) > 8 or set(k) & set("，。、")]
    return ("；" if long else "、").join(kept)


def loop(rows, table, aliases, types, allowed, exclusive, staging=False, open_predicates=False):
    """table: family -> list of versions as dicts, changed in place; returns evidence and quarantine."""
    evidence, bad = [], []
    for o, s, p, ob, conf, src, quote, a, b, at in sorted(rows, key=lambda r: (r[0], r[3])):
        s, ob = aliases.get(s, s), aliases.get(ob, ob)
        st, ot = types.get(s, "Concept"), types.get(ob, "Concept")
        if not (st == ot == "Concept" or (st, p, ot) in allowed or open_predicates):
            bad.append((o, s, p, ob))
            continue
        own = table.setdefault(sha(f"{s}|{p}|{ot}"), [])
        if any(v["object"] == ob or v["status"] != "superseded" and glue([v["object"], ob]) == v["object"] for v in own):
            continue
        active = [v for v in own if v["status"] == "active"]
        new = {"object": ob, "confidence": conf, "sources": [src], "from": at, "to": None, "subject": s}
        if active and p not in exclusive:
            new["object"] = glue([v["object"] for v in active] + [ob])
            if len(active) == 1 and new["object"] == active[0]["object"]:
                continue
            new["confidence"] = max(conf, *(v["confidence"] for v in active))
            new["sources"] = list(dict.fromkeys(x for v in [*active, new] for x in v["sources"]))
            for v in active:
                v["status"], v["to"] = "superseded", at
            new["status"] = "active"
        else:
            new["status"] = "staging" if staging or any(v["object"] != ob for v in active) else "active"
        own.append(new)
        evidence.append((sha(f"{sha(f'{s}|{p}|{ot}')}|{len(own)}"), src, a, b, quote, conf))
    return evidence, bad


def make(rng, n, start):
    terms = ["a", "b", "ab", "abc；d", "a;c", "long words here", "x、y", "A1", "B2", "u"]
    return [(start + i // 2, rng.choice(["S", "A1", "T", "u"]), rng.choice(["p", "only", "q"]), rng.choice(terms), rng.randint(1, 9) / 10, f"src{rng.randint(0, 5)}", f"q{i}", i, i + 2, T0 + dt.timedelta(hours=start + i // 2)) for i in range(n)]


def as_rows(table):
    return sorted((f, i, v["object"], v["status"], round(v["confidence"], 6), tuple(v["sources"]), v["from"], v["to"]) for f, own in table.items() for i, v in enumerate(own, 1))


def taken(df):
    return sorted((r["family_id"], r["version"], r["object"], r["status"], round(r["confidence"], 6), tuple(r["source_ids"]), r["valid_from"], r["valid_to"]) for r in df.collect())


@pytest.mark.parametrize("staging,open_predicates", [(False, False), (True, True)])
def test_compile_into_history_equals_one_by_one(spark, staging, open_predicates):
    rng = random.Random(9 + staging)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    aliases, types, allowed = {"A1": "S", "B2": "b"}, {"S": "Shop", "b": "Rule", "u": "Unit"}, {("Shop", "p", "Rule"), ("Shop", "only", "Concept"), ("Unit", "q", "Concept")}
    frames = spark.createDataFrame(list(aliases.items()), "alias string, canonical string"), spark.createDataFrame(list(types.items()), "mention string, type string"), spark.createDataFrame(list(allowed), "subject_type string, predicate string, object_type string")
    table, claims = {}, spark.createDataFrame([], K.CLAIM)
    for turn in range(2):
        rows = make(rng, 90, 100 * turn)
        want_evidence, want_bad = loop(rows, table, aliases, types, allowed, {"only"}, staging, open_predicates)
        df = spark.createDataFrame([*rows, (1, None, "p", "a", 0.5, "s", "q", 0, 1, T0), (1, "S", "p", None, 0.5, "s", "q", 0, 1, T0)], CAND)
        got = K.ingest(df, claims, *frames, exclusive=["only"], staging=staging, open_predicates=open_predicates)
        assert sorted(tuple(r) for r in got.evidence.collect()) == sorted(want_evidence)
        assert sorted((r["ord"], r["subject"], r["predicate"], r["object"]) for r in got.quarantine.collect()) == sorted(want_bad)
        assert taken(got.claims) == as_rows(table)
        assert (got.registered.count() > 0) == open_predicates
        claims = spark.createDataFrame(got.claims.collect(), K.CLAIM)
        again = K.ingest(df, claims, *frames, exclusive=["only"], staging=staging, open_predicates=open_predicates)
        assert again.changed.count() == 0 and taken(again.claims) == as_rows(table)
    statuses = {v["status"] for own in table.values() for v in own}
    assert statuses == ({"active", "superseded", "staging"} if not staging else {"staging"})
    ends = [(r["valid_to"], n["valid_from"]) for own in [sorted((x for x in claims.collect() if x["family_id"] == f), key=lambda x: x["version"]) for f in table] for r, n in zip(own, own[1:]) if r["status"] == "superseded" and n["status"] != "staging"]
    assert all(a == b for a, b in ends)


def test_extracted_claims_pass_their_gates_in_order(spark):
    rows = [
        ("d", 1, "Ship", "fee", "buyer", 0.9, "buyer pays", 0, 0),
        ("d", 2, "Ship", "fee", "seller", 0.4, "seller pays", 0, 0),  # weak: must not be joined
        ("d", 3, " Ship ", "fee", "agent", 0.8, "agent pays", 0, 0),
        ("d", 4, "Ship", "time", "2 days", 0.8, "not there", 0, 0),
        ("d", 5, "Ship", "zone", "EU", 0.8, "", 0, 0),
        ("d", 6, "Shop", "has", "EU", 0.8, "ß EU", 0, 0),
        ("e", 1, "Ship", "fee", "x", 0.8, "buyer pays", 0, 0),  # a source without text
        ("d", 7, "Ship", "运费承担方", "buyer", 0.8, "buyer", 0, 0),
        ("d", 8, "Ship", "运费承担方", "agent", 0.8, "agent", 0, 0),
    ]
    ex = spark.createDataFrame(rows, "source_id string, ord long, subject string, predicate string, object string, confidence double, quote string, start long, end long")
    texts = spark.createDataFrame([("d", "ß EU: buyer pays; agent pays"), ("f", None)], "source_id string, text string")
    none = spark.createDataFrame([], K.CLAIM)
    types = spark.createDataFrame([("Shop", "Shop")], "mention string, type string")
    args = none, spark.createDataFrame([], "alias string, canonical string"), types, spark.createDataFrame([], "subject_type string, predicate string, object_type string"), F.lit(T0)
    got = K.apply_extracted(ex, texts, *args)
    assert sorted((r["ord"], r["reason"]) for r in got.quarantine.where("source_id = 'd'").collect()) == [(2, "low_confidence"), (4, "span_missing"), (5, "span_missing"), (6, "invalid_predicate")]
    assert [r["reason"] for r in got.quarantine.where("source_id = 'e'").collect()] == ["span_missing"]
    made = {(r["predicate"], r["object"]): r["status"] for r in got.claims.collect()}
    assert made == {("fee", "buyer、agent"): "active", ("运费承担方", "buyer"): "active", ("运费承担方", "agent"): "staging"}
    spans = {r["quote"]: (r["start"], r["end"]) for r in got.evidence.collect()}
    assert spans == {"buyer pays": (6, 16), "buyer": (6, 11), "agent": (18, 23)}
    opened = K.apply_extracted(ex, texts, *args, open_predicates=True)
    assert [tuple(r) for r in opened.registered.collect()] == [("Shop", "has", "Concept")] and opened.quarantine.where("reason = 'invalid_predicate'").count() == 0


def test_version_diffs_write_versions(spark):
    def claim(i, f, v, o, status):
        return (i, f, v, "s", "p", o, "Concept", "Concept", 0.5, status, T0, None, ["src"])

    claims = spark.createDataFrame([claim("a1", "A", 1, "x", "active"), claim("a2", "A", 2, "y", "staging"), claim("a3", "A", 3, "z", "staging"), claim("b1", "B", 1, "n", "staging"), claim("c1", "C", 1, "k", "active")], K.CLAIM)
    diff = spark.createDataFrame([(1, "a1", "a2", "new"), (2, "c1", "gone", "new"), (3, None, "b1", "new"), (4, None, "a3", "new"), (5, None, "lost", "new")], "ord long, old_id string, new_id string, source_id string")
    now = dt.datetime(2024, 6, 1)
    after, events, errors = K.apply_versions(claims, diff, F.lit(now))
    got = {(r["family_id"], r["version"]): (r["object"], r["status"], r["valid_from"], r["valid_to"]) for r in after.collect()}
    assert got == {("A", 1): ("x", "superseded", T0, now), ("A", 2): ("y", "staging", T0, None), ("A", 3): ("z", "staging", T0, None), ("A", 4): ("y", "active", now, None), ("A", 5): ("z", "active", now, None), ("B", 1): ("n", "staging", T0, None), ("B", 2): ("n", "active", now, None), ("C", 1): ("k", "active", T0, None)}
    assert sorted((r["ord"], r["type"], r["claim_id"]) for r in events.collect()) == [(1, "policy_changed", sha("A|4")), (3, "claim_added", sha("B|2")), (4, "claim_added", sha("A|5"))]
    assert sorted((r["ord"], r["error"]) for r in errors.collect()) == [(2, "staging claim not found: gone"), (5, "staging claim not found: lost")]
