"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed up into cells of source, language and topic. Cell weights are raked in turn to
the target shares of each margin; a document is then sampled with its cell's probability. The uniform number that
decides is the md5 of the id.

Probabilities are at most 1, and the raking is done again under this bound: a cell's probability is
least(1, product of its margins' multipliers), and each step solves a margin's multipliers exactly. Not every sample size
can meet the targets (a scarce value gives no more than it has), so sizes from the share `keep` of all
tokens down to that at which no cell meets the bound are fitted side by side, and the largest one counts whose three margins
all hold within `TOLERANCE` (or, where none does, that of no bound). `margins` returns target and achieved shares, and every row of `mix` the largest
miss of any margin.

Targets of a margin are the weights given for its values (`weights`; values that are not named get none, their documents are not sampled), or else
tempered shares: a value's token share to the power `alpha`, normalised over the cells that are left. `margins` returns the share of tokens asked for and
kept beside each target. The cell table
is an aggregate (map-side combined, so a hot source is no hot task). It is counted: up to `CELLS_A_TASK` cells are one partition, whose sweeps need no
shuffle and no broadcast and so a job of one short task each; beyond, cells are dealt out by margin. Documents meet their cell by a broadcast of the counted
cells while these are few, beyond by a join on cell and salt, so that no cell's rows gather in one task. The lineage is cut after every sweep by a
table in the shared folder.

Topics are kinds of text told by marks in it (`TOPIC_MARKS`) and by length. Tokens are runs of other than blanks; CJK characters count one each.

Null source, language or topic is a value of its own (`<null>`); null and empty texts have no tokens and get the
probability of their cell (0 in a cell without tokens). Rows with equal ids share one fate. Very long texts are counted whole; an empty table gives
an empty result. `mix` reads id, text, source and language, `sample` gives all columns back, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, fresh, materialise, unit_hash

DIMS = ("source", "lang", "topic")
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
# Topics by what a text holds, first match wins; then by length.
TOPIC_MARKS = [("licensed", "Licensed under"), ("licensed", "Released under"), ("table", " | "), ("symbols", "###"), ("contact", "@"), ("shout", "!! ")]
# What counts as one token, a character or a run.
CJK = r"\x{3040}-\x{30ff}\x{4e00}-\x{9fff}"
TOKEN = rf"[{CJK}]|[^ \t\r\n{CJK}]+"
#: Bytes that a cell takes in a broadcast, and the tasks that a cell's rows are dealt to where cells are too many for one.
CELL_BYTES, SALTS = 512, 64
#: Cells that one partition may hold while they are raked (times SIZES + 1 where sizes are fitted side by side).
CELLS_A_TASK = 4096
#: Sample sizes fitted side by side, less one, and the largest miss of a margin's share that counts as met.
SIZES, TOLERANCE = 24, 0.002
TOPIC_LENGTHS = [("short", 500), ("medium", 3000)]


def topic(text: Column) -> Column:
    out = F.when(text.isNull(), F.lit("<null>"))
    for name, mark in TOPIC_MARKS:
        out = out.when(F.contains(text, F.lit(mark)), F.lit(name))
    for name, most in TOPIC_LENGTHS:
        out = out.when(F.length(text) < most, F.lit(name))
    return out.otherwise(F.lit("long"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def traits(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias(c) for c in ("source", "lang")], topic(F.col("text")).alias("topic"), tokens(F.col("text")).alias("n_tokens"))


#: Target weights by margin (source, lang, topic) and value.
Weights = dict[str, dict[str, float]]


def gathered(cells: DataFrame, few: bool) -> DataFrame:
    """Few cells in one partition, in which what follows needs no exchange."""
    return cells.coalesce(1) if few else cells


def by_margin() -> Column:
    """A cell's value in each margin, as rows of a struct."""
    return F.explode(F.array(*[F.struct(F.lit(d).alias("margin"), F.col(d).alias("value")) for d in DIMS])).alias("m")


def raked(rows: DataFrame, alphas: dict[str, float], sweeps: int, weights: Weights | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Cells with tokens t, raked weight w, not bounded by t, and the targets of their values (to_source, ...); the targets in tokens by margin and value; whether cells are few."""
    given = {d: F.create_map(*[F.lit(x) for v, w in ws.items() if w > 0 for x in (v, float(w))]) for d, ws in (weights or {}).items()}
    wanted = rows
    for d, ws in given.items():
        wanted = wanted.where(F.try_element_at(ws, F.col(d)).isNotNull())
    cells = materialise(wanted.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("t")).where("t > 0"), "cells")
    few = cells.count() <= CELLS_A_TASK
    cells = gathered(cells, few)
    total = F.broadcast(cells.agg(F.sum("t").alias("total")))  # one row
    p = F.lit(None).cast("double")
    for d in DIMS:
        share = F.try_element_at(given[d], F.col("value")) if d in given else F.pow(F.col("t") / F.col("total"), F.lit(alphas[d]))
        p = F.when(F.col("margin") == d, share).otherwise(p)
    shares = cells.select("t", by_margin()).groupBy("m.margin", "m.value").agg(F.sum("t").alias("t")).crossJoin(total).withColumn("p", p)
    norms = F.broadcast(shares.groupBy("margin").agg(F.sum("p").alias("norm")))  # one row a margin
    targets = materialise(shares.join(norms, "margin").select("margin", "value", (F.col("p") / F.col("norm") * F.col("total")).alias("target")), "targets")
    for d in DIMS:
        cells = cells.join(targets.where(F.col("margin") == d).select(F.col("value").alias(d), F.col("target").alias(f"to_{d}")), d)
    cells = gathered(materialise(cells.withColumn("w", F.col("t")), "aimed"), few)
    for sweep in range(sweeps):
        for d in DIMS:
            if few:
                own = Window.partitionBy(d).orderBy(*DIMS).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                cells = cells.withColumn("have", F.sum("w").over(own))
            else:  # sums are combined before the shuffle, so that a hot value is no hot task
                cells = cells.join(cells.groupBy(d).agg(F.sum("w").alias("have")), d)
            cells = cells.withColumn("w", F.col("w") * F.col(f"to_{d}") / F.col("have")).drop("have")
        cells = gathered(materialise(cells, f"sweep{sweep}"), few)
    return cells, targets, few


def refit(cells: DataFrame, targets: DataFrame, few: bool, sweeps: int, keep: float) -> DataFrame:
    """Cells with their probability, raked again under the bound 1: source, lang, topic, t, prob, miss (the largest of a margin's share)."""
    free = F.least(F.lit(keep), F.try_divide(F.lit(1.0), F.max(F.col("w") / F.col("t"))))  # no cell meets the bound up to this size
    sizes = F.broadcast(cells.agg(free.alias("free")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(SIZES)), lambda k: F.struct(k.alias("k"), (F.lit(keep) * F.pow(F.col("free") / F.lit(keep), k / SIZES)).alias("size")))).alias("s")).select("s.*"))  # SIZES + 1 rows
    aims = [f"to_{d}" for d in DIMS]
    fits = cells.crossJoin(sizes).select(*DIMS, *aims, "t", "k", "size", (F.col("w") / F.col("t") * F.col("size")).alias("q"))
    for sweep in range(sweeps):
        for d in DIMS:
            # The tokens expected under a multiplier x are the least, over cuts in the order of q, of those before the cut plus x times those after it;
            # so the multiplier that gives the target is the greatest over cuts. Running sums from the least q up give both sides of a cut in one pass.
            order = Window.partitionBy("k", d).orderBy("q", *map(F.desc, DIMS))
            upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            before = F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("t").over(upto)
            at = fits.withColumn("x", (F.col(f"to_{d}") * F.col("size") - before) / F.sum(F.col("t") * F.col("q")).over(upto))
            fits = at.select(*DIMS, *aims, "t", "k", "size", (F.col("q") * F.max("x").over(Window.partitionBy("k", d))).alias("q"))
        fits = gathered(materialise(fits, f"refit{sweep}"), few)
    fits = fits.select(*DIMS, "t", "k", F.least(F.lit(1.0), "q").alias("prob"))
    misses = achieved(fits, targets, "k").groupBy("k").agg(F.max(F.abs(F.col("achieved") - F.col("target"))).alias("miss"))
    sized = misses.agg(F.collect_list(F.struct("k", "miss")).alias("s"))  # SIZES + 1 structs
    least = F.greatest(F.lit(TOLERANCE), F.array_max("s")["miss"])
    best = F.broadcast(sized.select(F.array_min(F.filter("s", lambda x: x["miss"] <= least)).alias("s")).select("s.*"))  # one row
    return materialise(fits.join(best, "k").select(*DIMS, "t", "prob", "miss"), "refitted")


def achieved(cells: DataFrame, targets: DataFrame, *by: str) -> DataFrame:
    """Expected shares of the sample's tokens by margin and value, beside their targets."""
    have = cells.select(*by, (F.col("t") * F.col("prob")).alias("e"), by_margin()).groupBy(*by, "m.margin", "m.value").agg(F.sum("e").alias("e"))
    own = Window.partitionBy(*by, "margin")
    return have.join(targets, ["margin", "value"]).select(*by, "margin", "value", (F.col("target") / F.sum("target").over(own)).alias("target"), (F.col("e") / F.sum("e").over(own)).alias("achieved"))


def rake(rows: DataFrame, alphas: dict[str, float] | None, sweeps: int, keep: float, weights: Weights | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells with their probability (source, lang, topic, t, prob, miss), and the targets."""
    cells, targets, few = raked(rows, alphas or ALPHAS, sweeps, weights)
    return refit(cells, targets, few, sweeps, keep), targets


def met(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their cell; keys in the order of source, lang, topic, under the same names on both sides."""
    if cells.count() * CELL_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(cells), keys, "left")
    (salt,) = fresh(rows, "_salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c not in keys]), F.lit(SALTS)))
    return dealt.join(cells.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), [*keys, salt], "left").drop(salt)


def margins(docs: DataFrame, alphas: dict[str, float] | None = None, sweeps: int = 6, keep: float = 0.6, weights: Weights | None = None) -> DataFrame:
    """margin, value, the target and achieved (expected) shares of the sample's tokens, and the shares of all wanted tokens asked for and kept."""
    cells, targets = rake(traits(docs), alphas, sweeps, keep, weights)
    size = F.broadcast(cells.agg((F.sum(F.col("t") * F.col("prob")) / F.sum("t")).alias("kept")))  # one row
    return achieved(cells, targets).withColumn("asked", F.lit(keep)).crossJoin(size)


def mix(docs: DataFrame, alphas: dict[str, float] | None = None, sweeps: int = 6, keep: float = 0.6, weights: Weights | None = None) -> DataFrame:
    """Per row of docs: doc_id, source, lang, topic, n_tokens, prob, sampled and margin_miss (the same in every row; null without tokens at all)."""
    rows = materialise(traits(docs), "traits")  # a few short columns, so that texts are read once
    cells, _ = rake(rows, alphas, sweeps, keep, weights)
    out = met(rows, cells.select(*DIMS, "prob"), list(DIMS)).withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    miss = F.broadcast(cells.agg(F.round(F.max("miss"), 6).alias("margin_miss")))  # one row
    return out.crossJoin(miss).select("doc_id", *DIMS, "n_tokens", F.round("prob", 6).alias("prob"), (unit_hash("doc_id") < F.col("prob")).alias("sampled"), "margin_miss")


def sample(docs: DataFrame, alphas: dict[str, float] | None = None, sweeps: int = 6, keep: float = 0.6, weights: Weights | None = None) -> DataFrame:
    """The rows of docs that `mix` samples, with all their columns."""
    cells, _ = rake(traits(docs), alphas, sweeps, keep, weights)
    *keys, prob = fresh(docs, "_source", "_lang", "_topic", "_prob")
    own = [F.coalesce(docs["source"].cast("string"), F.lit("<null>")), F.coalesce(docs["lang"].cast("string"), F.lit("<null>")), topic(docs["text"])]
    known = cells.select(*[F.col(d).alias(k) for d, k in zip(DIMS, keys)], F.col("prob").alias(prob))
    return met(docs.withColumns(dict(zip(keys, own))), known, keys).where(unit_hash("doc_id") < F.coalesce(prob, F.lit(0.0))).select(*docs.columns)


def sql(alphas: dict[str, float] | None = None, sweeps: int = 6, keep: float = 0.6, weights: Weights | None = None) -> str:
    """`mix` over the view `documents`, for DuckDB."""
    alphas, weights = alphas or ALPHAS, weights or {}
    wanted = "".join(f" AND {d} IN ({', '.join(repr(v) for v, w in ws.items() if w > 0)})" for d, ws in weights.items())
    cases = " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" for n, m in TOPIC_MARKS) + " " + " ".join(f"WHEN length(text) < {m} THEN '{n}'" for n, m in TOPIC_LENGTHS)
    ctes = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang, CASE WHEN text IS NULL THEN '<null>' {cases} ELSE 'long' END AS topic,
        coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::BIGINT AS n_tokens FROM documents)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t, sum(n_tokens)::DOUBLE AS w FROM d WHERE true" + wanted + " GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for x in DIMS:
        given = " ".join(f"WHEN {v!r} THEN {float(w)}::DOUBLE" for v, w in weights.get(x, {}).items())
        share = f"CASE {x} {given} END" if given else f"pow(sum(t) / (SELECT sum(t) FROM c0), {alphas[x]})"
        ctes.append(f"p_{x} AS MATERIALIZED (SELECT {x}, {share} AS p FROM c0 GROUP BY {x})")
        ctes.append(f"g_{x} AS MATERIALIZED (SELECT {x}, p / (SELECT sum(p) FROM p_{x}) * (SELECT sum(t) FROM c0) AS target FROM p_{x})")
    i = 0
    for _ in range(sweeps):
        for x in DIMS:
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, t, w * target / have AS w FROM c{i} c JOIN (SELECT {x}, sum(w) AS have FROM c{i} GROUP BY {x}) m USING ({x}) JOIN g_{x} USING ({x}))")
            i += 1
    ctes.append(f"free AS MATERIALIZED (SELECT least({keep}::DOUBLE, 1.0::DOUBLE / max(w / t)) AS free FROM c{i})")
    ctes.append(f"sizes AS MATERIALIZED (SELECT k, {keep}::DOUBLE * pow(free / {keep}::DOUBLE, k / {SIZES}.0::DOUBLE) AS size FROM free, (SELECT unnest(range(0, {SIZES + 1})) AS k))")
    ctes.append(f"f0 AS MATERIALIZED (SELECT source, lang, topic, t, k, size, w / t * size AS q FROM c{i}, sizes)")
    j = 0
    for _ in range(sweeps):
        for x in DIMS:
            ctes.append(f"""f{j + 1} AS MATERIALIZED (SELECT source, lang, topic, t, k, size, q * max(x) OVER (PARTITION BY k, {x}) AS q FROM (
        SELECT f.*, (target * size - coalesce(sum(t) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(t * q) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x
        FROM f{j} f JOIN g_{x} USING ({x}) WINDOW o AS (PARTITION BY k, {x} ORDER BY q DESC, source, lang, topic)))""")
            j += 1
    ctes.append(f"fit AS MATERIALIZED (SELECT source, lang, topic, t, k, least(1.0::DOUBLE, q) AS prob FROM f{j})")
    parts = " UNION ALL ".join(f"SELECT k, '{x}' AS margin, {x} AS value, sum(t * prob) AS e, any_value(target) AS target FROM fit JOIN g_{x} USING ({x}) GROUP BY k, {x}" for x in DIMS)
    ctes.append(f"shares AS MATERIALIZED (SELECT k, abs(e / sum(e) OVER o - target / sum(target) OVER o) AS miss FROM ({parts}) WINDOW o AS (PARTITION BY k, margin))")
    ctes.append("misses AS MATERIALIZED (SELECT k, max(miss) AS miss FROM shares GROUP BY k)")
    ctes.append(f"best AS MATERIALIZED (SELECT min(k) AS k, arg_min(miss, k) AS miss FROM misses WHERE miss <= (SELECT greatest({TOLERANCE}::DOUBLE, arg_max(miss, k)) FROM misses))")
    ctes.append("q AS MATERIALIZED (SELECT source, lang, topic, prob FROM fit WHERE k = (SELECT k FROM best))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(prob, 0.0), 6) AS prob, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(prob, 0.0) AS sampled, (SELECT round(miss, 6) FROM best) AS margin_miss FROM d LEFT JOIN q USING (source, lang, topic)"
