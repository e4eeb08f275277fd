"""Name hierarchy and canonical names against loops that take the names one by one."""

import random

from tessera.operators import hierarchy as H

PARENTS, SNIPPETS = "kb_id string, name string, hub string, leaf string, role string", "kb_id string, name string, hub string, target string"


def one_by_one(names, parents, snippets):
    """The rules for one knowledge base as they are told: seeds first, then each name in turn."""
    out, hubs, counts, order = {}, set(), {}, []

    def count(hub):
        counts[hub] = counts.get(hub, 0) + 1
        if counts[hub] == 1:
            order.append(hub)

    for n in names:
        if n in snippets:
            out[n] = (snippets[n][0], None, "snippet", snippets[n][1])
        elif n in parents:
            hub, leaf, role = parents[n]
            out[n] = (hub, None, "hub", None) if role == "hub" or leaf is None else (hub, leaf, "leaf", None)
        if n in out:
            count(out[n][0])
    hubs = {v[0] for v in [*parents.values(), *snippets.values()]} - {"未分类"}
    for n in names:
        if n in out:
            continue
        if any(m in n for m in ("一级", "二级", "三级")):
            out[n] = ("投诉升级", n, "leaf", None)
        elif len(n) <= 4 and not any(k in n for k in ("流程", "规范", "指南", "升级")):
            most = max(counts.values(), default=0)
            out[n] = (next((h for h in order if counts[h] == most), "未分类"), None, "snippet", None)
            continue
        else:
            fits = sorted((-len(h), h) for h in hubs if h != n and (n.startswith(h) or n[:2] == h[:2]))
            if fits:
                hub = fits[0][1]
                out[n] = (hub, n.removeprefix(hub) or n, "leaf", None)
            else:
                out[n] = (n, None, "hub", None)
        hubs.add(out[n][0])
        count(out[n][0])
    return out


def test_hierarchy_equals_one_by_one(spark):
    rng = random.Random(4)
    names, parents, snippets, want = [], [], [], set()
    for kb in range(12):
        letters = ["客", "服", "投", "诉", "a", "b", "流程", "一级", "升级", "x y"][: rng.randint(2, 10)]
        pool = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 90))})
        rng.shuffle(pool)
        p = {n: (rng.choice(pool)[: rng.randint(1, 3)], rng.choice([None, "leaf", n]), rng.choice(["hub", "leaf"])) for n in rng.sample(pool, len(pool) // 6)} if pool else {}
        s = {n: (rng.choice(["客服", "未分类", "投诉", "b"]), rng.choice([None, "t"])) for n in rng.sample(pool, len(pool) // 9)} if pool else {}
        p["never there"] = ("客服话术", "x", "leaf")
        names += [(str(kb), 10 * i, n) for i, n in enumerate(pool)] + [(str(kb), 5000 + i, n) for i, n in enumerate(pool[:5])]
        parents += [(str(kb), n, *v) for n, v in p.items()]
        snippets += [(str(kb), n, *v) for n, v in s.items()]
        want |= {(str(kb), n, *v) for n, v in one_by_one(pool, p, s).items()}
    names += [(None, 1, "no base"), ("0", 2, None), ("0", 3, "")]
    args = spark.createDataFrame(names, "kb_id string, ord long, name string"), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(snippets, SNIPPETS)
    for block in (7, 1 << 20):
        got = [tuple(r) for r in H.hierarchy(*args, block=block).select("kb_id", "name", "hub", "leaf", "role", "target").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    roles = {r[4] for r in want}
    assert roles == {"hub", "leaf", "snippet"} and len(want) > 300


def test_hierarchy_of_customer_service(spark):
    names = ["客服话术", "客服开场", "退款流程", "退款流程说明", "你好", "二级投诉处理", "投诉登记办法", "再见"]
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate(names)], "kb_id string, ord long, name string")
    got = {r["name"]: (r["hub"], r["leaf"], r["role"]) for r in H.hierarchy(df, spark.createDataFrame([("k", "客服话术", "客服话术", None, "hub")], PARENTS), spark.createDataFrame([], SNIPPETS)).collect()}
    assert got["客服话术"] == ("客服话术", None, "hub") and got["客服开场"] == ("客服话术", None, "snippet")
    assert got["退款流程"] == ("退款流程", None, "hub") and got["退款流程说明"] == ("退款流程", "说明", "leaf")
    assert got["二级投诉处理"] == ("投诉升级", "二级投诉处理", "leaf") and got["投诉登记办法"] == ("投诉升级", "投诉登记办法", "leaf")
    assert got["再见"][2] == "snippet" and H.hierarchy(df.limit(0), spark.createDataFrame([], PARENTS), spark.createDataFrame([], SNIPPETS)).count() == 0
    leaves = {(r["hub"], r["leaf"]) for r in H.hub_leaves(H.hierarchy(df, spark.createDataFrame([], PARENTS), spark.createDataFrame([("k", "你好", "客服话术", "问候")], SNIPPETS))).collect()}
    assert ("客服话术", "问候") in leaves and ("退款流程", "说明") in leaves


def test_canonical_names(spark):
    names = ["尺码 表", "尺码指南", "尺码选择（女）", "Refund-Policy 2", "refund", "REFUNDS", "", " ?! ", None, "refundable goods"]
    aliases = spark.createDataFrame([("refundpolicy2", "refund"), ("x", "refundable"), ("y", "")], "alias string, canonical string").unionByName(H.default_aliases(spark))
    got = {r["name"]: r["canon"] for r in H.canonical_names(spark.createDataFrame([(n,) for n in names], "name string"), aliases).collect()}
    assert got == {"尺码 表": "尺码选择", "尺码指南": "尺码选择", "尺码选择（女）": "尺码选择", "Refund-Policy 2": "refund", "refund": "refund", "REFUNDS": "refund", "": "", " ?! ": "", None: None, "refundable goods": "refundable"}


def test_hub_leaves_read_the_tree_once(spark):
    names = [("k", "hub", "a", "leaf", None, 0, 3), ("k", "hub", None, "hub", None, 0, 1), ("k", "bare", None, "hub", None, 1, 2), ("k", "hub", None, "snippet", "a", 0, 2)]
    rows = spark.createDataFrame(names, "kb_id string, hub string, leaf string, role string, target string, phase int, ord long")
    got = H.hub_leaves(rows)
    assert sorted(tuple(r) for r in got.collect()) == [("k", "bare", None, 1, 2), ("k", "hub", "a", 0, 2)]
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_hubs_of_two_characters(spark):
    """A name meets the two best hubs that it shares two characters with, not all of them, and steps aren't repeated."""
    hubs = [f"ab{'c' * (i % 9)}{i}" for i in range(300)]
    names = [("k", i, n) for i, n in enumerate([*hubs, "abcdefg", "abcdefgh", "xyzuvw", "xyzuvwx"])]
    seeds = spark.createDataFrame([("k", h, h, None, "hub") for h in hubs], PARENTS)
    open_ = H.hierarchy(spark.createDataFrame(names, "kb_id string, ord long, name string"), seeds, spark.createDataFrame([], SNIPPETS))
    got = {r["name"]: (r["hub"], r["leaf"], r["role"], r["target"]) for r in open_.collect()}
    assert got == one_by_one([n for _, _, n in names], {h: (h, None, "hub") for h in hubs}, {})
    plan = open_._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Join" not in plan
