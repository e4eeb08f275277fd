"""Claims: merging of extracted facts, conflicts, versions, diffs, as-of reads and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed value: predicates whose objects exclude one another.
EXCLUSIVE = ["运费承担方"]


def object_parts(value: Column) -> Column:
    """Parts by the first kind of semicolon that occurs, trimmed, blanks dropped."""
    v = F.trim(value)
    cut = F.when(F.contains(v, F.lit("；")), F.split(v, "；")).otherwise(F.split(v, ";"))
    return F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")


def join_objects(objects: Column) -> Column:
    """Objects joined in order: a part inside a kept one goes, kept parts inside a new one give way."""
    flat = F.flatten(F.transform(objects, object_parts))
    kept = F.aggregate(flat, F.array().cast("array<string>"), lambda acc, p: F.when(F.exists(acc, lambda e: F.contains(e, p)), acc).otherwise(F.array_append(F.filter(acc, lambda e: ~F.contains(p, e)), p)))
    long = F.exists(kept, lambda x: (F.length(x) > 8) | x.rlike("[，。、]"))
    return F.when(long, F.array_join(kept, "；")).otherwise(F.array_join(kept, "、"))


def merge_complementary(extracted: DataFrame, exclusive: list[str] = EXCLUSIVE) -> DataFrame:
    """One row for each source, subject and predicate with its joined objects; exclusive predicates pass through.

    extracted(source_id, ord, subject, predicate, object, confidence, quote, start, end)."""
    e = extracted.withColumn("subject", F.trim("subject")).withColumn("predicate", F.trim("predicate"))
    alone = e.where(F.col("predicate").isin(exclusive)).select("source_id", "subject", "predicate", "object", "confidence", "quote", "start", "end")
    rows = F.array_sort(F.collect_list(F.struct("ord", "object", "quote", "start", "end")))
    g = e.where(~F.col("predicate").isin(exclusive)).groupBy("source_id", "subject", "predicate").agg(rows.alias("r"), F.max("confidence").alias("confidence"))
    first = F.coalesce(F.get(F.filter("r", lambda x: F.trim(x["quote"]) != ""), F.lit(0)), F.get("r", F.lit(0)))
    object_ = F.when(F.size("r") == 1, F.col("r")[0]["object"]).otherwise(join_objects(F.transform("r", lambda x: x["object"])))
    return g.select("source_id", "subject", "predicate", object_.alias("object"), "confidence", first["quote"].alias("quote"), first["start"].alias("start"), first["end"].alias("end")).unionByName(alone)


def union_extracted(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Triples of both extractors: a rule's span where it has a quote, the higher confidence, at most 1."""
    keys = ["source_id", "subject", "predicate", "object"]
    r, m = (x.select(*keys, F.col("confidence").alias(f"{n}_conf"), F.col("quote").alias(f"{n}_quote")) for n, x in (("r", rules), ("m", model)))
    both = r.join(m, keys, "full_outer")
    return both.select(*keys, F.least(F.lit(1.0), F.greatest("r_conf", "m_conf")).alias("confidence"), F.when(F.trim("r_quote") != "", F.col("r_quote")).otherwise(F.coalesce("m_quote", "r_quote")).alias("quote"))


def intersect_extracted(rules: DataFrame, model: DataFrame) -> DataFrame:
    keys = ["source_id", "subject", "predicate", "object"]
    m = model.groupBy(*keys).agg(F.max_by("confidence", "ord").alias("m_conf"))
    return rules.join(m, keys).select(*keys, F.least(F.lit(1.0), F.greatest("confidence", "m_conf")).alias("confidence"), "quote")


def conflicts(claims: DataFrame) -> DataFrame:
    """Families with more than one active claim."""
    return claims.where("status = 'active'").groupBy("family_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("claim_ids")).where("n > 1")


def as_of(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """The latest version of each probed family that is valid at the probe's time (family_id, at)."""
    hit = claims.join(probes, "family_id").where((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("at"))) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    return hit.groupBy("family_id", "at").agg(F.max_by(F.struct("id", "object", "version"), "version").alias("c")).select("family_id", "at", "c.id", "c.object", "c.version")


def latest(claims: DataFrame) -> DataFrame:
    return claims.groupBy("family_id").agg(F.max_by(F.struct("id", "object"), "version").alias("c")).select("family_id", "c.id", "c.object")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """family_id, kind (added, superseded, same), old_id, new_id."""
    o, n = latest(old).select("family_id", F.col("id").alias("old_id"), F.col("object").alias("old_object")), latest(new).select("family_id", F.col("id").alias("new_id"), F.col("object").alias("new_object"))
    kind = F.when(F.col("old_id").isNull(), "added").when(F.col("old_object") != F.col("new_object"), "superseded").otherwise("same")
    return n.join(o, "family_id", "left").select("family_id", kind.alias("kind"), "old_id", "new_id")


def verify(evidence: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, verified: every quote occurs in its source's text, and there is one. Each text is read once for all its quotes."""
    quotes = evidence.groupBy("source_id").agg(F.collect_set("quote").alias("quotes"))
    read = sources.select(F.col("id").alias("source_id"), "text").join(quotes, "source_id")
    checked = read.select("source_id", F.explode(F.transform("quotes", lambda q: F.struct(q.alias("quote"), F.contains(F.col("text"), q).alias("found")))).alias("x")).select("source_id", "x.quote", "x.found")
    each = evidence.join(checked, ["source_id", "quote"], "left").groupBy("claim_id").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("ok"))
    return claims.select(F.col("id").alias("claim_id")).join(each, "claim_id", "left").select("claim_id", F.coalesce("ok", F.lit(False)).alias("verified"))


def first_per_source(claims: DataFrame) -> DataFrame:
    """The first active claim of each source, by order."""
    return claims.where("status = 'active'").groupBy("source_id").agg(F.min_by("id", F.struct("ord", "id")).alias("claim_id"))


def compile_versions(candidates: DataFrame) -> DataFrame:
    """Exclusive facts compiled in order (family_id, ord, object): an object already seen in its family is covered; the
    first is active, later ones are staged for review. Repeats are dropped before the window, which cannot change it."""
    first = candidates.groupBy("family_id", "object").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("family_id").orderBy("ord", "object")
    return first.withColumn("version", F.row_number().over(w)).withColumn("status", F.when(F.col("version") == 1, "active").otherwise("staging"))


def edge_claims(edges: DataFrame, claims: DataFrame, at: Column) -> DataFrame:
    """subject, predicate, object, claim_id: for each edge by those names the first claim (by ord) that bears it and is valid at a time."""
    held = claims.where(T.valid_at(at)).groupBy("subject", "predicate", "object").agg(F.min_by("id", "ord").alias("claim_id"))
    return edges.join(held, ["subject", "predicate", "object"]).select("subject", "predicate", "object", "claim_id")


def effective(verdicts: DataFrame) -> DataFrame:
    """query_id, status, claim_id: the claims (query_id, claim_id, verified) that an answer may use: all of a query's where some are verified and
    some not (partial), else the verified ones; a query without any gives one row without a claim."""
    by = Window.partitionBy("query_id")
    status = F.when(F.bool_and("verified").over(by), "verified").when(~F.bool_or("verified").over(by), "unverified").otherwise("partial")
    told = verdicts.withColumn("status", status)
    used = told.where((F.col("status") == "partial") | F.col("verified")).select("query_id", "status", "claim_id")
    none = told.where("status = 'unverified'").select("query_id", "status").distinct().withColumn("claim_id", F.lit(None).cast("string"))
    return used.unionByName(none)


def lint(claims: DataFrame, evidence: DataFrame, sources: DataFrame, quarantined: DataFrame) -> DataFrame:
    """severity, code, n: families in conflict (errors), claims whose quotes are not found, sources without evidence and rows in quarantine (warnings); kinds without any are left out."""
    told = evidence.select(F.col("claim_id").alias("id")).distinct()
    kinds = [
        ("error", "conflict", conflicts(claims)),
        ("warning", "missing_evidence", verify(evidence, sources, told).where("NOT verified")),
        ("warning", "orphan_source", sources.select("id").join(evidence.select(F.col("source_id").alias("id")), "id", "left_anti")),
        ("warning", "quarantine_backlog", quarantined),
    ]
    out = None
    for severity, code, rows in kinds:
        one = rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("severity", "code").agg(F.count("*").alias("n"))


def compile_claims(candidates: DataFrame, allowed: DataFrame, exclusive: list[str] = EXCLUSIVE) -> tuple[DataFrame, DataFrame]:
    """(versions, quarantined) of candidates (family_id, ord, subject, predicate, object, subject_type, object_type, confidence, source_id, quote).

    Types that `allowed` (subject_type, predicate, object_type) lacks are quarantined as invalid_predicate. The rest of a family is
    compiled in order of (ord, object): what an earlier version says or the current one holds is covered; of an exclusive predicate the first object is
    active and others are staged; otherwise each new object gives a version with all objects joined and ends the one before it. A version keeps
    its order, the highest confidence, its sources and its quote as evidence. Repeats of an object are covered by its first, so they
    are dropped before a family is gathered: a gathered family holds its distinct objects only."""
    keys = ["subject_type", "predicate", "object_type"]
    marked = candidates.join(allowed.select(*keys, F.lit(True).alias("known")).distinct(), keys, "left")
    bad = marked.where("known IS NULL").select("family_id", "ord", "subject", "predicate", "object", F.lit("invalid_predicate").alias("reason"))
    row = F.struct("ord", "object", "subject", "predicate", "confidence", "source_id", "quote")
    first = marked.where("known").groupBy("family_id", "object").agg(F.min(row).alias("x"))
    item = F.struct(F.col("x.object").alias("object"), F.col("x.confidence").cast("double").alias("confidence"), F.array("x.source_id").alias("source_ids"), F.col("x.quote").alias("quote"), F.col("x.ord").alias("ord"))
    family = first.groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("x.ord", "x.object", item.alias("c")))).alias("cs"), F.min(F.struct("x.ord", "x.subject", "x.predicate")).alias("head"))
    family = family.select("family_id", "head.subject", "head.predicate", F.col("cs.c").alias("cs"))
    none = F.slice("cs", 1, 0)
    told = lambda acc, c: F.exists(acc, lambda v: v["object"] == c["object"])
    held = lambda acc, c: F.exists(acc, lambda v: join_objects(F.array(v["object"], c["object"])) == v["object"])

    def joined(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        whole = F.struct(join_objects(F.array(last["object"], c["object"])).alias("object"), F.greatest(last["confidence"], c["confidence"]).alias("confidence"), F.array_union(last["source_ids"], c["source_ids"]).alias("source_ids"), c["quote"].alias("quote"), c["ord"].alias("ord"))
        return F.get(F.transform(F.array(whole), lambda w: F.when(w["object"] == last["object"], acc).otherwise(F.array_append(acc, w))), F.lit(0))

    folded = F.aggregate("cs", none, lambda acc, c: F.when(F.size(acc) == 0, F.array(c)).when(told(acc, c), acc).otherwise(joined(acc, c)))
    staged = F.aggregate("cs", none, lambda acc, c: F.when(told(acc, c) | held(acc, c), acc).otherwise(F.array_append(acc, c)))
    alone = F.col("predicate").isin(exclusive)
    out = family.select("family_id", "subject", "predicate", F.when(alone, staged).otherwise(folded).alias("v")).select("family_id", "subject", "predicate", F.size("v").alias("n"), F.posexplode("v").alias("i", "c"))
    status = F.when(alone, F.when(F.col("i") == 0, "active").otherwise("staging")).when(F.col("i") == F.col("n") - 1, "active").otherwise("superseded")
    return out.select("family_id", (F.col("i") + 1).alias("version"), "subject", "predicate", "c.object", status.alias("status"), "c.confidence", "c.source_ids", "c.quote", "c.ord"), bad


def verification(asked: DataFrame, verdicts: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, status, competing, confidence for the claims (query_id, claim_id) of each query: conflict where a family of theirs has more than
    one active claim (competing: how many), else verified, unverified or partial; the mean weight of the evidence, halved by an unverified claim."""
    active = claims.where("status = 'active'").groupBy("family_id").agg(F.count("*").alias("n"))
    mine = asked.join(claims.select(F.col("id").alias("claim_id"), "family_id"), "claim_id").select("query_id", "family_id").distinct().join(active, "family_id").where("n > 1")
    rivals = mine.groupBy("query_id").agg(F.sum("n").alias("rivals"))
    checked = asked.join(verdicts, "claim_id", "left").groupBy("query_id").agg(F.count_if("verified").alias("good"), F.count_if(~F.coalesce("verified", F.lit(False))).alias("bad"))
    weight = asked.join(evidence.select("claim_id", "weight"), "claim_id").groupBy("query_id").agg(F.avg("weight").alias("w"))
    both = checked.join(rivals, "query_id", "left").join(weight, "query_id", "left")
    status = F.when(F.col("rivals") > 0, "conflict").when(F.col("bad") == 0, "verified").when(F.col("good") == 0, "unverified").otherwise("partial")
    confidence = F.coalesce("w", F.lit(0.0)) * F.when(F.col("bad") > 0, 0.5).otherwise(1.0)
    return both.select("query_id", status.alias("status"), F.coalesce("rivals", F.lit(0)).cast("bigint").alias("competing"), confidence.alias("confidence"))


def faq(claims: DataFrame, words: list[str], most: int = 8) -> DataFrame:
    """page_id, place, id: of a page's claims (page_id, id, subject, predicate, confidence) the first of each subject and predicate, those whose predicate
    holds most of the words first, then by confidence and predicate, both falling, and id; a page's first `most` are the report."""
    hits = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("predicate"), w)))
    order = [F.desc("hits"), F.desc("confidence"), F.desc("predicate"), "id"]
    best = F.struct((-F.col("hits")).alias("h"), (-F.col("confidence")).alias("c"), "id")
    one = claims.withColumn("hits", hits).groupBy("page_id", "subject", "predicate").agg(F.min(best).alias("b"))
    one = one.select("page_id", "predicate", (-F.col("b.h")).alias("hits"), (-F.col("b.c")).alias("confidence"), "b.id")
    w = Window.partitionBy("page_id").orderBy(*order)
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("page_id", "place", "id")
