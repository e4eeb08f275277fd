"""Rule packs against matching pattern by pattern."""

import random
import re

from tessera.operators import packs as P
from tessera.operators import rules as R

TEXTS = [
    "七天无理由退货运费由买家承担。非定制商品适用七天无理由退货；定制商品不适用七日无理由。签收后 7 日内可以申请七天无理由退货",
    "是否支持无理由退货：支持\n商品应当保持完好。商品完好是指包装齐全；退回的商品应当完好。7天内可申请无理由退货，运费承担方为平台",
    "员工手册倡导诚信协作。公司倡导廉洁诚信；严禁贿赂。不得泄露公司保密信息。行为准则适用于全体员工及实习生。适用范围：正式员工",
    "个人信用贷款最高额度30万；年化利率3.15%起。还款方式：等额本息、等额本金。贷款对象：年满18周岁。贷款期限最长不超过五年。自贷款发放日起计息",
    "某某银行装修贷用于住房装修。担保方式采取抵押、保证、信用方式；不得用于购房。授信额度最高可达 50万元。  ",
    "Released under the MIT License\nmail a.b@c.example now",
    "",
]


def by_pattern(text, pack):
    out = []
    for i, (subject, predicate, pattern) in enumerate(P.RULES.get(pack, [])):
        for n, m in enumerate(re.finditer(pattern, text)):
            if m.group("object").strip():
                out.append((i * 1_000_000 + n, m.group("product").strip() if subject == P.PRODUCT else subject, predicate, m.group("object").strip(), P.CONFIDENCE[pack], m.group(0), m.start(), m.end()))
    return out


def test_all_packs_equal_pattern_by_pattern(spark):
    rng = random.Random(8)
    pieces = [p for t in TEXTS for p in re.findall(".{1,6}", t)]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rows = [(f"{i}-{pack}", t, pack) for i, t in enumerate(texts) for pack in [*P.RULES, "unknown"]] + [("null", None, P.SHOP), ("none", TEXTS[0], None)]
    got = R.apply_packs(spark.createDataFrame(rows, "id string, text string, pack string"), P.rules(spark)).collect()
    want = [(i, pack, *m) for i, t, pack in rows if t and pack for m in by_pattern(t, pack)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len({(r["pack"], r["ord"] // 1_000_000) for r in got}) > 30
    assert {r["pack"] for r in got} == {P.SHOP, P.CULTURE, P.LOAN, P.ENGLISH}


def test_every_rule_needs_a_word_and_few_rules_are_tried():
    assert all(R.required(pattern) or pattern.startswith("(?P<object>[A-Za-z0-9._]+@") for own in P.RULES.values() for _, _, pattern in own)
    assert R.required("a(?:bc|de)+f?gh") == {"gh"} or R.required("a(?:bc|de)+f?gh") == {"bc", "de"}
    assert R.required("[ab]+x?") == set() and R.required("(?:foo|b?)") == set()
    every = R.Packs([(pack, i, *rule, 0.9) for pack, own in P.RULES.items() for i, rule in enumerate(own)])
    assert len(every.able("Nothing of the kind stands here at all")) == 0 and len(every.able(TEXTS[2])) < 20
    assert sum(map(len, P.RULES.values())) == 77


def test_sentences(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("{o}不适用{s}", "s", "p", "o"), (None, "s", "p", "o")], "form string, s string, p string, o string")
    assert [r[0] for r in df.select(R.sentence(*map(F.col, "form s p o".split()))).collect()] == ["o不适用s", "spo"]
    assert P.risks(spark).count() == 7 and P.predicates(spark).count() == 33 and P.aliases(spark).count() == 15 and P.forms(spark).count() == 15
