"""License scans, mixing, sharding, quality rules, language ID, URL filters, packing and BPE on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, licenses, mixing, packing, quality, sharding, urls
from tessera.llm.queries import vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2020 A. Person
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
ISC = """Copyright 2020 A. Person
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""


def unwrapped(text):
    return "\n\n".join(" ".join(x.lstrip("#* ") for x in p.split("\n")) for p in text.replace("Person\n", "Person\n\n").replace("\n#\n", "\n\n").replace("\n *\n", "\n\n").split("\n\n"))


def test_licenses(spark):
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    whole = {"MIT": (MIT, 4), "Apache-2.0": (APACHE, 4), "BSD-3-Clause": (BSD, 6), "GPL-3.0-or-later": (GPL, 5), "ISC": (ISC, 3)}
    texts = [None, "", "plain", "x\nReleased under the MIT License.\ny", "Released under the MIT License. Released under the MIT License.", notice, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."]
    want = [("", 0, 0), ("", 0, 0), ("", 0, 0), ("MIT", 1, 0), ("MIT", 2, 0), ("", 1, 1), ("Apache-2.0,CC-BY-NC-4.0", 2, 0)]
    for name, (text, n) in whole.items():  # as shipped, on long lines, with other line ends, and amid other text
        texts += [text, unwrapped(text), text.replace("\n", "\r\n"), "code before it\n\n" + text + "\ncode after it " * 2000]
        want += [(name, n, 0)] * 4
    got = {r["doc_id"]: (r["licenses"], r["n_sentences"], r["n_unclaimed"]) for r in licenses.scan(docs(spark, texts).withColumn("ids", F.lit(1))).collect()}
    assert got == dict(enumerate(want))
    assert licenses.scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.check_anchors([("X", "nothing to hold on to")])


def test_mixing_meets_targets(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["en", "de", None][int(rng.integers(0, 3))], ["hot", "hot", "a", "b"][int(rng.integers(0, 4))], 0) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("prob", F.lit("clash")).withColumn("t", F.lit(0))
    out = mixing.mix(df, sweeps=8, keep=0.3).cache()
    p = out.toPandas()
    assert len(p) == 4000 and p["prob"].between(0, 1).all()
    share = (p["n_tokens"] * p["prob"]).groupby(p["source"]).sum()
    raw = p["n_tokens"].groupby(p["source"]).sum() / p["n_tokens"].sum()
    want = raw**0.5 / (raw**0.5).sum()
    assert np.allclose(share / share.sum(), want, atol=0.02)
    assert abs(p["sampled"].mean() - p["prob"].mean()) < 0.03
    assert set(p["lang"]) == {"en", "de", "<null>"}
    clash = df.withColumn("_prob", F.lit("x")).withColumn("_source", F.lit(2))
    assert mixing.sample(clash, sweeps=2).columns == clash.columns
    rows, cells = mixing.traits(df), mixing.rake(mixing.traits(df), None, 2, 0.3)[0].select(*mixing.DIMS, "prob")
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)  # beyond the bound: a salted join
    assert mixing.met(rows, cells, list(mixing.DIMS)).select("doc_id", "prob").exceptAll(rows.join(cells, list(mixing.DIMS), "left").select("doc_id", "prob")).count() == 0
    assert [r[0] for r in spark.createDataFrame([("a  b\tc",), ("漢字 x",), (None,), ("",)], "s string").select(mixing.tokens(F.col("s"))).collect()] == [3, 3, 0, 0]
    assert mixing.mix(docs(spark, [])).count() == 0
    none = mixing.mix(docs(spark, [None, ""])).collect()
    assert [(r["n_tokens"], r["prob"], r["sampled"]) for r in none] == [(0, 0.0, False)] * 2


def test_mixing_meets_all_margins_at_production_parameters(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = mixing.mix(real).toPandas()
    assert 0 < (p["n_tokens"] * p["prob"]).sum() <= 0.601 * p["n_tokens"].sum() and p["prob"].between(0, 1).all()
    told = {(r["margin"], r["value"]): r for r in mixing.margins(real).collect()}
    for d, alpha in (("source", 0.5), ("lang", 0.7), ("topic", 0.5)):
        raw = p["n_tokens"].groupby(p[d]).sum() / p["n_tokens"].sum()
        want = raw**alpha / (raw**alpha).sum()
        share = (p["n_tokens"] * p["prob"]).groupby(p[d]).sum() / (p["n_tokens"] * p["prob"]).sum()
        assert np.allclose(share, want, atol=0.005), (d, share, want)
        assert all(abs(told[d, v]["target"] - want[v]) < 1e-6 and abs(told[d, v]["achieved"] - share[v]) < 1e-4 for v in want.index if want[v])


def test_mixing_takes_few_jobs_for_few_cells(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    assert mixing.mix(real).where("sampled").count() > 0
    assert scheduler.numTotalJobs() - before < 60  # twelve sweeps of three margins; each job is held in the driver's memory


@pytest.mark.parametrize("weights", [None, {"lang": {"en": 3.0, "de": 1.0}}])
def test_mixing_is_the_same_in_one_partition_and_dealt_out(spark, monkeypatch, weights):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 400)), ["en", "en", "en", "de", None][int(rng.integers(0, 5))], f"s{int(rng.integers(0, 60) ** 2) // 60}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = {}
    for most in (mixing.CELLS_A_TASK, 0):
        monkeypatch.setattr(mixing, "CELLS_A_TASK", most)
        got[most] = {r["doc_id"]: r for r in mixing.mix(df, keep=0.4, weights=weights).collect()}
        told = mixing.margins(df, keep=0.4, weights=weights).collect()
        assert {r["margin"] for r in told} == set(mixing.DIMS) and max(abs(r["achieved"] - r["target"]) for r in told) <= 0.002
    one, dealt = got.values()
    assert one.keys() == dealt.keys() == set(range(3000)) and any(r["sampled"] for r in one.values())
    for i, r in one.items():
        assert abs(r["prob"] - dealt[i]["prob"]) < 2e-6 and (r["sampled"], r["n_tokens"]) == (dealt[i]["sampled"], dealt[i]["n_tokens"])


def test_mixing_to_given_weights_equals_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    real = spark.read.parquet(path)
    weights = {"lang": {"en": 2.0, "de": 1.0, "fr": 1.0, "xx": 5.0, "es": 0.0}, "topic": {"long": 3, "medium": 3, "table": 1}}
    got = {r["doc_id"]: (r["prob"], r["sampled"], r["margin_miss"]) for r in mixing.mix(real, keep=0.2, weights=weights).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
    want = {r[0]: (r[5], r[6], r[7]) for r in duckdb.sql(mixing.sql(keep=0.2, weights=weights)).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 2e-6 and got[i][1] == want[i][1] for i in got)
    told = {(r["margin"], r["value"]): r for r in mixing.margins(real, keep=0.2, weights=weights).collect()}
    assert {v for m, v in told if m == "lang"} == {"en", "de", "fr"} and abs(told["lang", "en"]["target"] - 0.5) < 1e-9 and abs(told["topic", "table"]["target"] - 1 / 7) < 1e-9
    assert all(abs(r["target"] - r["achieved"]) < 0.003 and r["asked"] == 0.2 and 0 < r["kept"] <= 0.2001 for r in told.values())
    kept = mixing.sample(real, keep=0.2, weights=weights).groupBy("lang").count().collect()
    assert {r["lang"] for r in kept} == {"en", "de", "fr"}


def test_mild_tempering_keeps_the_share_asked_for(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = mixing.margins(real, dict.fromkeys(mixing.DIMS, 0.9)).collect()
    assert all(abs(r["kept"] - 0.6) < 0.01 and abs(r["target"] - r["achieved"]) < 0.003 for r in told)


SHIPPED = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_licences_as_shipped(spark):
    import os

    there = {f: n for f, n in SHIPPED.items() if os.path.isfile(f"/usr/share/common-licenses/{f}")}
    texts = [open(f"/usr/share/common-licenses/{f}", errors="replace").read() for f in there]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(there.values())
    names = [t.replace("the copyright holder", who).replace("the copyright holders", who) for t in (BSD,) for who in ("Example Inc.", "the University of Somewhere, Dept. 7")]
    assert {r["licenses"] for r in licenses.scan(docs(spark, names)).collect()} <= {"BSD-3-Clause", "BSD-2-Clause"}


def test_sharding(spark):
    texts = ["x" * (i % 90) for i in range(800)] + [None, "", "y" * 5000]
    df = docs(spark, texts).withColumn("bytes", F.lit(1)).withColumn("shard", F.lit("clash"))
    out = sharding.shard(df, 1000).toPandas()
    assert sorted(out["doc_id"]) == list(range(803))
    size = out.groupby("shard")["bytes"].agg(["sum", "count"])
    assert ((size["sum"] <= 1000) | (size["count"] == 1)).all()
    prefixes = [s for s in size.index if "." not in s]
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    same = spark.createDataFrame([(1, "z" * 100, "en", "s", 100)] * 57 + [(1, "q" * 90, "en", "s", 90)] * 20, DOCS)
    over = sharding.shard(same, 1000).toPandas()
    assert len(over) == 77 and over.groupby("shard")["bytes"].sum().max() <= 1000
    assert sharding.shard(docs(spark, []), 1000).count() == 0


def brute_buckets(sizes, limit, bits=32):
    """Bucket of each hash by splitting from the empty prefix on: hash -> depth, none for hashes over the limit alone."""
    out, queue = {}, [(0, list(sizes))]
    while queue:
        depth, own = queue.pop()
        if sum(sizes[h] for h in own) <= limit:
            out |= dict.fromkeys(own, depth)
        elif depth < bits and own:
            for bit in (0, 1):
                queue.append((depth + 1, [h for h in own if h >> (bits - depth - 1) & 1 == bit]))
    return out


def test_sharding_with_hot_ids_beside_small_neighbours(spark):
    import hashlib
    import time

    rows = [(None, "n" * 400, "en", "s", 0)] * 90 + [(7, "m" * 90, "en", "s", 0)] * 60 + [(i, "x" * (i % 50), "en", "s", 0) for i in range(400)]
    start = time.time()
    out = sharding.shard(spark.createDataFrame(rows, DOCS), 1000).toPandas()
    assert time.time() - start < 60  # a directory of all cells in between would take far more
    sizes = {}
    for i, t, *_ in rows:
        h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16)
        sizes[h] = sizes.get(h, 0) + len(t)
    want = brute_buckets(sizes, 1000)
    for i, group in out.groupby("doc_id"):
        h = int(hashlib.md5(str(int(i)).encode()).hexdigest()[:8], 16)
        if h in want:
            assert set(group["depth"]) == {want[h]} and set(group["shard"]) == {format(h, "032b")[: want[h]]}
        else:
            assert i == 7 and all("." in s for s in group["shard"])
    assert len(out) == len(rows) and out.groupby("shard")["bytes"].sum().max() <= 1000


@pytest.mark.parametrize("low", [0, 6, 12, 30])
def test_directory_has_an_entry_a_cell(spark, low):
    sizes = {0: 5000, 1: 10, (1 << 26) - 1: 20, 3 << 28: 700, (3 << 28) + 5: 700, (1 << 32) - 1: 1}
    got = sharding.directory(spark.createDataFrame(list(sizes.items()), "cell bigint, bytes bigint"), low, 32, 1000)
    want = {h: max(d, low) for h, d in brute_buckets(sizes, 1000).items()}
    assert {r["cell"]: r["depth"] for r in got.collect()} == want


def brute_quality(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines, dup, known = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")], 0, set()
    for x in lines:
        dup += x in known
        known.add(x)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_quality_counts_and_verdicts(spark):
    random.seed(4)
    texts = [" ".join(random.choice(["ab", "cde", "f#", "é", "a b c d e", "x\ny", " z"]) for _ in range(random.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \n\t", "a\na\na\n\na", "one two three four five " * 4, "w" * 100_000]
    texts += [" ".join(f"good{i}x{j}" for j in range(30)) for i in range(60)] + [" ".join(f"bad{j}###$$$" for j in range(30)) for i in range(12)]
    df = docs(spark, texts)
    n = len(texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n - 72, n - 12)] + [(i, 0, 0) for i in range(n - 12, n - 6)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(df, labels, max_loss=0.02).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t), (i, t)
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(n - 72, n - 12)) and not any(got[i]["kept"] for i in range(n - 12, n))
    kept = quality.keep(df, labels, max_loss=0.02)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])
    none = quality.judge(df, labels.where("false")).where("kept = base_failed")
    assert none.count() == 0 and quality.judge(docs(spark, []), labels).count() == 0


def test_language_id(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(real.where(~langid.held_out()), vocabulary("piece_bpe_32k.model"), per_lang=60)
    out = langid.predict(real, model, "doc_id", "lang", langid.held_out().alias("held_out")).where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95 and out["score"].between(0, 1).all()
    odd = docs(spark, [None, "", "123 ²½ !!", "the " * 20000, "x" * 5000], lang=None)
    got = [(r["lang_pred"], r["score"]) for r in langid.predict(odd, model, "doc_id").orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "en" and got[4][0] in model.langs
    kept = langid.keep(odd, model)
    assert kept.columns == odd.columns and [(r["doc_id"], r["lang"]) for r in kept.where("doc_id = 3").collect()] == [(3, "en")]
    nothing = langid.fit(odd, vocabulary("piece_bpe_32k.model"))
    assert [r["lang_pred"] for r in langid.predict(odd, nothing, "doc_id").collect()] == ["und"] * 5


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["a", "b", "ab", "▁", "▁a", "ba"])
    rng = np.random.default_rng(0)
    prob = rng.random((7, 2))
    prob[0] = 0

    def total(w, j):  # every segmentation, one by one
        if not w:
            return 1.0
        out = langid.UNKNOWN * total(w[1:], j)
        for k in range(1, len(w) + 1):
            if w[:k] in lattice.number:
                out += prob[lattice.number[w[:k]], j] * total(w[k:], j)
        return out

    for w in ("a", "abab", "abxba", "bbaab"):
        got = langid.log_likelihoods([w], lattice, prob)[0]
        assert np.allclose(got, [math.log(total("▁" + w, j)) for j in range(2)])
    counts = langid.expected_counts(["ab"], np.array([3.0]), lattice, prob[:, :1])
    segs = {("▁", "a", "b"): 1, ("▁", "ab"): 1, ("▁a", "b"): 1}
    weight = {s: math.prod(prob[lattice.number[p], 0] for p in s) for s in segs}
    want = sum(w for s, w in weight.items() if "b" in s) / sum(weight.values()) * 3
    assert abs(counts[lattice.number["b"]] - want) < 1e-6


def test_language_id_uses_every_letter_piece():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = {p for p in (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())) if p == "▁" or p.replace("▁", "", 1).isalpha()}
    got = langid.pieces(vocabulary("piece_bpe_32k.model"))
    assert set(got) == want and len(got) == len(want) and "▁recommendations" in want
    lattice, long = langid.Lattice(got), [p for p in got if len(p) > 10]
    assert len(long) > 1000
    for p in long:  # each is found as a whole
        assert lattice.grid([p])[0, -1, len(p) - 1] == lattice.number[p]
    prob = np.zeros((len(got) + 1, 2))
    prob[lattice.number["▁recommendations"]] = 0.25, 0.5
    scores = langid.log_likelihoods(["recommendations"], lattice, prob)[0]
    assert np.allclose(scores, np.log([0.25, 0.5]))
    counts = langid.expected_counts(["recommendations"], np.array([2.0]), lattice, prob[:, :1])
    assert abs(counts[lattice.number["▁recommendations"]] - 2) < 1e-6


def test_urls(spark):
    rows = [(0, "http://a.b.net/x"), (1, "https://Example.NET/en/1?q"), (2, "http://example.net"), (3, "x.example.com/de/"), (4, "http://x.example.com/de/9#t"), (5, None), (6, ""), (7, "http://notnet/"), (8, "ftp://o.ORG/fr/1"), (9, "http://casino-win.example.com/en/"), (10, "http://freecasino.example.com/en/")]
    rows += [(20 + i, f"http://blog.reading{i % 3}.example.com/en/{i}") for i in range(30)]
    rows += [(60 + i, f"http://blog.reading.example.net/en/{i}") for i in range(30)] + [(100 + i, f"http://shop.other.net/de/{i}") for i in range(30)]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.judge(pages, vocabulary("word_bpe_49k.json"), seed_weight=10_000).collect()}  # seeds that outweigh the few rules
    assert len(got) == len(rows)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(9)] == [("a.b.net", "/x", "net/"), ("example.net", "/en/1", "example.net/en/"), ("example.net", "", None), ("", "", None), ("x.example.com", "/de/9", "example.com/de/"), ("", "", None), ("", "", None), ("notnet", "/", None), ("o.org", "/fr/1", "org/fr/")]
    assert [got[i]["verdict"] for i in (0, 1, 4, 8, 9, 10, 20)] == ["block", "allow", "block", "allow", "block", "block", "allow"]
    assert "free casino" in got[10]["words"]
    assert urls.judge(pages.where("false"), vocabulary("word_bpe_49k.json")).count() == 0


def test_host_words_by_viterbi_equal_the_best_of_all_segmentations():
    counts = {"a": 5.0, "ab": 7.0, "b": 2.0, "ba": 9.0, "bab": 1.0}
    splitter = urls.Splitter(counts)
    total = sum(counts.values())

    def cost(words):
        return sum(-math.log(counts[w] / total) if w in counts else 25.0 for w in words)

    def every(run):
        if not run:
            yield []
        for k in range(1, len(run) + 1):
            if run[:k] in counts or k == 1:
                yield from ([run[:k]] + rest for rest in every(run[k:]))

    for run in ("a", "abab", "babab", "xab", "abxxba", "bbbb"):
        best = min(map(cost, every(run)))
        got, rest = [], run
        for w in splitter[run]:  # unknown letters in a row are one unknown word
            if w == urls.UNKNOWN:
                n = next((i for i in range(1, len(rest) + 1) if rest[i : i + 1] in ("a", "b", "")), len(rest))
                got, rest = got + list(rest[:n]), rest[n:]
            else:
                got, rest = got + [w], rest[len(w) :]
        assert not rest and abs(cost(got) - best) < 1e-9, (run, got)


def test_naive_bayes_equals_its_formula():
    from collections import Counter

    counts, pages = Counter({("block", "x"): 3, ("block", "y"): 1, ("allow", "y"): 4}), Counter(block=2, allow=5)
    model, vocab = urls.Bayes(counts, pages), 3  # x, y and the unknown word

    def plain(words):
        of = {}
        for label in ("block", "allow"):
            size = sum(n for (s, _), n in counts.items() if s == label)
            of[label] = math.log(pages[label] + 1) + sum(math.log((counts[label, w] + 1) / (size + vocab)) for w in words)
        return of["block"] - of["allow"]

    for words in ([], ["x"], ["y", "y", "x"], ["never", "y"]):
        assert abs(model.score(words) - plain([w if w in "xy" else "?" for w in words])) < 1e-9


def test_url_method_on_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    judged = urls.judge(pages, vocabulary("word_bpe_49k.json"))
    r = urls.held_out_accuracy(judged).first()
    assert r["n"] > 150 and r["accuracy"] > 0.9
    seeded = judged.where("rule IS NULL").toPandas()
    has = seeded["words"].map(lambda w: bool(urls.SEEDS.intersection(w.split())))
    assert (seeded["verdict"][~has] == "block").any()  # more than the seed list decides


def test_packing_is_best_fit_and_lossless(spark):
    random.seed(3)
    for _ in range(200):
        size = random.choice([1, 2, 5, 8, 33])
        lengths = [random.randint(0, 3 * size) for _ in range(random.randint(0, 50))]
        rows = packing.pack(lengths, size)
        assert all(sum(n for *_, n in r) <= size for r in rows)
        covered = sorted((d, s, n) for r in rows for d, s, n in r)
        for d, n in enumerate(lengths):
            own, at = [x for x in covered if x[0] == d], 0
            for _, s, m in own:
                assert s == at
                at += m
            assert at == n
        rest = sorted(((-(n % size), d) for d, n in enumerate(lengths) if n % size))
        rooms = []  # plain best fit, for the number of rows
        for n, _ in rest:
            fit = [r for r in rooms if r >= -n]
            room = min(fit) if fit else size
            if fit:
                rooms.remove(room)
            rooms.append(room + n)
        assert len(rows) == len(rooms) + sum(n // size for n in lengths)
    texts = ["word " * 3000, None, "", "short one", "Ünïcode ok " * 40] + [f"text {i} " * (i % 50) for i in range(80)]
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    df = docs(spark, texts).withColumn("ids", F.lit(1))
    out = packing.packed(df, ranks, size=128, shard_bytes=4000).cache()
    got = {r["doc_id"]: r["ids"] for r in packing.unpack(out).collect()}
    enc = packing.encoder(ranks)
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts) if t}
    for r in out.collect():
        ids, where = (np.frombuffer(r[c], dtype="<i4") for c in ("ids", "position_ids"))
        assert len(ids) == len(where) == 128 and r["cu_seqlens"][-1] == r["n_ids"] <= 128 and set(ids[r["n_ids"] :]) <= {50256}
        assert len(r["doc_ids"]) == len(r["seqs"]) == len(r["starts"]) == len(r["cu_seqlens"]) - 1
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert where[a:b].tolist() == list(range(b - a))
    assert packing.packed(docs(spark, []), ranks).count() == 0
    # repeated rows and ids: each row comes back, and copies don't gather in one shard
    many = spark.createDataFrame([(1, "same text " * 30)] * 90 + [(1, "other")] * 2 + [(None, "no id")] * 3 + [(None, "b")], "doc_id bigint, text string")
    rows = packing.packed(many.coalesce(1), ranks, size=64, shard_bytes=3000).cache()
    back = sorted((str(r["doc_id"]), r["ids"]) for r in packing.unpack(rows).collect())
    assert back == sorted((str(r["doc_id"]), enc.encode_ordinary(r["text"])) for r in many.collect())
    assert rows.select("shard").distinct().count() > 5


def test_packed_rows_as_matrices(spark, tmp_path):
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    out = packing.packed(docs(spark, [f"text {i} " * (i % 50) for i in range(60)]), ranks, size=32, shard_bytes=4000).cache()
    rows = {(r["shard"], r["row"]): r for r in out.collect()}
    shards = packing.write(out, str(tmp_path / "packed")).collect()
    assert sorted(r["shard"] for r in shards) == sorted({s for s, _ in rows}) and sum(r["n_rows"] for r in shards) == len(rows)
    for r in shards:
        ids = np.frombuffer(r["ids"], dtype="<i4").reshape(r["n_rows"], 32)
        cuts = np.split(np.frombuffer(r["cu_seqlens"], dtype="<i4"), np.cumsum(np.frombuffer(r["n_cu"], dtype="<i4"))[:-1])
        for k in range(r["n_rows"]):
            own = rows[r["shard"], k]
            assert ids[k].tobytes() == own["ids"] and cuts[k].tolist() == own["cu_seqlens"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    lib, own = Tokenizer.from_file(path), bpe.Codec(path)
    lib.no_truncation()
    lib.no_padding()
    random.seed(1)
    alphabet = [chr(c) for c in [*range(0x250), 0x1680, 0x2003, 0x2028, 0x3000, 0x85, 0xFEFF, 0x1F600, 0x1C, 0x1F]]
    texts = ["", " ", "  a  b ", "don't we'll", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "\n\n x\t y", "word " * 500, "x" * 6000, "漢字 かな"]
    texts += ["".join(random.choice(alphabet if random.random() < 0.4 else list(" \n\tab'st12.")) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False), repr(t)
    df = docs(spark, [None, "", "ab ab"]).withColumn("n_tokens", F.lit("clash"))
    import hashlib

    got = [tuple(r) for r in bpe.round_trips(df, path).orderBy("doc_id").collect()]
    empty, ids = hashlib.sha256(b"").hexdigest(), ",".join(map(str, own.encode("ab ab")))
    assert got == [(0, 0, empty, empty), (1, 0, empty, empty), (2, len(own.encode("ab ab")), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"ab ab").hexdigest())]
    assert bpe.encode_documents(df, path).where("size(ids) = 0").count() == 2


def test_bpe_remembers_pre_tokens_alone_and_finds_them_by_spelled_classes():
    c = bpe.Codec(vocabulary())
    plane = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    for text in ("".join(plane), " ".join(plane), "x".join(plane), "it's 'tis we'll I'd they've you're 'm''s  a\n\nb \n"):
        assert c.find_plane(text) == c.find(text)
    text = " ".join(f"word{i % 7}.\nNext,{i}" for i in range(300))
    c.encode(text)
    assert sum(len(m) for m in vars(c).values() if isinstance(m, bpe.Remembered)) == len(set(c.find(text)))
