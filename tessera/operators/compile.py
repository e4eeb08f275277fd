"""Compiling facts into versioned claims that exist already: gates, types, the fold of each family, and the application of version diffs.

A family is all versions of one fact (subject, predicate, kind of object). Families are independent of one another, so a compile reads
and changes only those that the candidates touch: candidates and history are gathered a family to a row, folded in order there, and the changes
merged back by key. Repeats of an object within a family change nothing and go before the gathering; what is gathered is a family's distinct
objects and its versions, which the joined text of its last version holds anyway."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.claims import EXCLUSIVE, merge_complementary
from tessera.streaming.ingest import shared_path

CLAIM = "id string, family_id string, version int, subject string, predicate string, object string, subject_type string, object_type string, confidence double, status string, valid_from timestamp, valid_to timestamp, source_ids array<string>"
CLAIM_COLUMNS = [c.split()[0] for c in CLAIM.split(", ")]
#: The kind of a subject or object that the ontology does not name. Two of these may bear any predicate.
CONCEPT = "Concept"


class Compiled(NamedTuple):
    claims: DataFrame  # all claims after the compile
    changed: DataFrame  # versions that are new or have ended, as they are now
    evidence: DataFrame  # claim_id, source_id, start, end, quote, weight of the new versions
    quarantine: DataFrame  # candidates that no claim was made of, with reason
    registered: DataFrame  # subject_type, predicate, object_type that open predicates add to the ontology


def typed(candidates: DataFrame, aliases: DataFrame, types: DataFrame) -> DataFrame:
    """candidates with subject and object in canonical form (aliases: alias, canonical) and subject_type and object_type of these (types: mention, type).

    Each alias and mention counts once (the least). Terms are joined as distinct values, so a subject that many rows share is one row of the join."""
    known = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    kinds = types.groupBy("mention").agg(F.min("type").alias("type"))
    terms = candidates.select(F.col("subject").alias("term")).unionByName(candidates.select(F.col("object").alias("term"))).where("term IS NOT NULL").distinct()
    told = terms.join(known, terms["term"] == known["alias"], "left").select("term", F.coalesce("canonical", "term").alias("name"))
    told = told.join(kinds, told["name"] == kinds["mention"], "left").select("term", "name", F.coalesce("type", F.lit(CONCEPT)).alias("kind"))
    out = candidates
    for side in ("subject", "object"):
        one = told.select(F.col("term").alias(side), F.col("name").alias("_name"), F.col("kind").alias(f"{side}_type"))
        out = out.join(one, side, "left").withColumn(side, F.col("_name")).drop("_name")
    return out


def accepted(candidates: DataFrame, allowed: DataFrame, open_predicates: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates the ontology knows, the others, triples to register): two concepts may bear any predicate, other kinds those of
    `allowed` (subject_type, predicate, object_type). With open predicates nothing is turned away and new triples are registered."""
    keys = ["subject_type", "predicate", "object_type"]
    known = allowed.select(*keys, F.lit(True).alias("_known")).distinct()
    marked = candidates.withColumn("predicate", F.trim("predicate")).join(known, keys, "left")
    fine = ((F.col("subject_type") == CONCEPT) & (F.col("object_type") == CONCEPT)) | F.coalesce("_known", F.lit(False))
    new = marked.where(~fine).select(*keys).distinct()
    if open_predicates:
        return marked.drop("_known"), marked.where("false").drop("_known"), new
    return marked.where(fine).drop("_known"), marked.where(~fine).drop("_known"), new.where("false")


def parts_of(value: str) -> list[str]:
    """The parts that a semicolon of the first kind that occurs divides."""
    return [p for p in (x.strip() for x in value.strip().split("；" if "；" in value else ";")) if p]


def joined(values: list[str]) -> str:
    """Objects as one: a part that lies in a kept one goes, kept parts that lie in a new one give way to it."""
    kept: list[str] = []
    for value in values:
        for part in parts_of(value):
            if not any(part in k for k in kept):
                kept = [*(k for k in kept if k not in part), part]
    return ("；" if any(len(k) > 8 or any(mark in k for mark in "，。、") for k in kept) else "、").join(kept)


class Family:
    """The versions of one family while candidates are taken in; versions that are added or ended are noted."""

    def __init__(self, history: list[dict]):
        self.objects = {v["object"] for v in history}
        self.top = max((v["version"] for v in history), default=0)
        self.live = [v for v in history if v["status"] in ("active", "staging")]
        self.changed: list[dict] = []

    def says(self, value: str) -> bool:
        """An earlier version has this object, or a live one takes it in without a change."""
        return value in self.objects or any(joined([v["object"], value]) == v["object"] for v in self.live)

    def add(self, c: dict, value: str, status: str, confidence: float, source_ids: list[str]) -> None:
        self.top += 1
        v = {"version": self.top, "object": value, "status": status, "confidence": confidence, "source_ids": source_ids, "valid_from": c["at"], "valid_to": None, "new": True, "c": c}
        self.objects.add(value)
        self.live.append(v)
        self.changed.append(v)

    def take(self, c: dict, exclusive: bool, staging: bool, skip: bool) -> None:
        value = c["object"]
        if skip and self.says(value):
            return
        active = [v for v in self.live if v["status"] == "active"]
        if not active or exclusive:
            self.add(c, value, "staging" if staging or any(v["object"] != value for v in active) else "active", c["confidence"], [c["source_id"]])
            return
        whole = joined([*(v["object"] for v in active), value])
        if len(active) == 1 and whole == active[0]["object"]:
            return
        for v in active:
            v["status"], v["valid_to"] = "superseded", c["at"]
            if not v.get("new") and v not in self.changed:
                self.changed.append(v)
        self.live = [v for v in self.live if v["status"] != "superseded"]
        sources = list(dict.fromkeys([*(s for v in active for s in v["source_ids"] or []), c["source_id"]]))
        self.add(c, whole, "active", max([c["confidence"], *(v["confidence"] for v in active)]), sources)


FOLDED = "family_id string, version int, object string, confidence double, status string, valid_from timestamp, valid_to timestamp, source_ids array<string>, is_new boolean, source_id string, start bigint, end bigint, quote string, weight double"


def _folds(exclusive: frozenset[str], staging: bool, skip: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for family_id, predicate, history, candidates in zip(*(batch.column(n).to_pylist() for n in ("family_id", "predicate", "history", "candidates"))):
                family = Family(history or [])
                for c in candidates:
                    family.take(c, predicate in exclusive, staging, skip)
                for v in family.changed:
                    c = v.get("c")
                    said = (c["source_id"], c["start"], c["end"], c["quote"], c["confidence"]) if c else (None,) * 5
                    rows.append((family_id, v["version"], v["object"], v["confidence"], v["status"], v["valid_from"], v["valid_to"], v["source_ids"], c is not None, *said))
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema)], schema=schema)

    return run


def fold(claims: DataFrame, candidates: DataFrame, exclusive: list[str] = EXCLUSIVE, staging: bool = False, skip: bool = True) -> tuple[DataFrame, DataFrame]:
    """(changed versions as claims, evidence) of typed candidates (ord, subject, predicate, object, types, confidence, source_id, quote, start, end, at).

    Candidates of a family go in order of (ord, object). One whose object an earlier version has, or that a live version takes in as it is, is covered.
    Beside an active version, an object of an exclusive predicate is staged; of another predicate all active versions end (valid_to) and one
    with all objects, the highest confidence and all sources begins (valid_from) at the candidate's time. Without an active version, or if
    `staging`, a version of the object alone is added: staged if asked for, else active. skip=False adds covered objects too."""
    c = candidates.withColumn("family_id", T.family_id("subject", "predicate", "object_type"))
    detail = F.struct("ord", "object", F.col("confidence").cast("double").alias("confidence"), "source_id", "quote", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("at").cast("timestamp").alias("at"))
    whole = F.struct(detail.alias("d"), "subject", "subject_type")
    if skip:
        c = c.groupBy("family_id", "predicate", "object_type", "object").agg(F.min(whole).alias("w"))
    else:
        c = c.select("family_id", "predicate", "object_type", "object", whole.alias("w"))
    families = c.groupBy("family_id").agg(F.first("predicate").alias("predicate"), F.first("object_type").alias("object_type"), F.first("w.subject").alias("subject"), F.min("w.subject_type").alias("subject_type"), F.array_sort(F.collect_list("w.d")).alias("candidates"))
    version = F.struct("version", "object", "status", F.col("confidence").cast("double").alias("confidence"), "source_ids", "valid_from", "valid_to")
    held = claims.join(c.select("family_id").distinct(), "family_id", "left_semi").groupBy("family_id").agg(F.array_sort(F.collect_list(version)).alias("history"))
    both = families.join(held, "family_id", "left")
    schema = pa.schema([("family_id", pa.string()), ("version", pa.int32()), ("object", pa.string()), ("confidence", pa.float64()), ("status", pa.string()), ("valid_from", pa.timestamp("us", "UTC")), ("valid_to", pa.timestamp("us", "UTC")), ("source_ids", pa.list_(pa.string())), ("is_new", pa.bool_()), ("source_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("quote", pa.string()), ("weight", pa.float64())])
    out = both.select("family_id", "predicate", "history", "candidates").mapInArrow(_folds(frozenset(exclusive), staging, skip, schema), FOLDED)
    named = out.join(families.select("family_id", "subject", "predicate", "subject_type", "object_type"), "family_id")
    new_id = T.short_hash(F.concat_ws("|", "family_id", "version"))
    old = claims.select("family_id", "version", F.col("id").alias("_id"), F.col("subject").alias("_s"), F.col("subject_type").alias("_st"))
    named = named.join(old, ["family_id", "version"], "left").withColumn("id", F.coalesce("_id", new_id)).withColumn("subject", F.coalesce("_s", "subject")).withColumn("subject_type", F.coalesce("_st", "subject_type"))
    named = _cut(named.select(*CLAIM_COLUMNS, "is_new", "source_id", "start", "end", "quote", "weight"))
    evidence = named.where("is_new").select(F.col("id").alias("claim_id"), "source_id", "start", "end", "quote", "weight")
    return named.select(*CLAIM_COLUMNS), evidence


def _cut(df: DataFrame) -> DataFrame:
    """df written and read again in the shared folder: what a compile changed is read several times, and by the next compile, but folded once."""
    path = shared_path(df.sparkSession, "compiled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """claims in which changed versions take the place of those they were, and new ones are added."""
    return claims.select(*CLAIM_COLUMNS).join(changed.select("id"), "id", "left_anti").unionByName(changed).select(*CLAIM_COLUMNS)


def ingest(candidates: DataFrame, claims: DataFrame, aliases: DataFrame, types: DataFrame, allowed: DataFrame, exclusive: list[str] = EXCLUSIVE, staging: bool = False, open_predicates: bool = False, skip: bool = True) -> Compiled:
    """Candidates (ord, subject, predicate, object, confidence, source_id, quote, start, end, at) compiled into claims: canonical terms, kinds, ontology, then `fold`.

    Those of a predicate that the ontology does not know for their kinds are quarantined as invalid_predicate. A second compile of the same
    candidates changes nothing. Candidates without subject, predicate or object take no part."""
    named = typed(candidates.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL"), aliases, types)
    fine, bad, new = accepted(named, allowed, open_predicates)
    changed, evidence = fold(claims, fine, exclusive, staging, skip)
    return Compiled(merged(claims, changed), changed, evidence, bad.withColumn("reason", F.lit("invalid_predicate")), new)


def apply_extracted(extracted: DataFrame, texts: DataFrame, claims: DataFrame, aliases: DataFrame, types: DataFrame, allowed: DataFrame, at: Column, least: float = 0.5, exclusive: list[str] = EXCLUSIVE, staging: bool = False, open_predicates: bool = False, skip: bool = True) -> Compiled:
    """A model's triples (source_id, ord, subject, predicate, object, confidence, quote, start, end) compiled: those of confidence under `least`
    are quarantined first (low_confidence), so that joining cannot lift them; then the objects of one source, subject and predicate are joined; then
    those whose quote is empty or not in the source's text go (span_missing), the others get its real place; then as `ingest`.

    texts(source_id, text) meets the triples' quotes by source; a source without text has no quotes. A joined triple keeps the least ord of its parts."""
    low = F.coalesce(F.col("confidence") < least, F.lit(True))
    weak, kept = extracted.where(low), extracted.where(~low)
    kept = kept.withColumn("subject", F.trim("subject")).withColumn("predicate", F.trim("predicate"))
    alone, many = kept.where(F.col("predicate").isin(exclusive)), kept.where(~F.col("predicate").isin(exclusive))
    first = many.groupBy("source_id", "subject", "predicate").agg(F.min("ord").alias("ord"))
    one = merge_complementary(many, []).join(first, ["source_id", "subject", "predicate"])
    one = one.unionByName(alone.select(*one.columns))
    quotes = one.select("source_id", "quote").distinct().join(texts.select("source_id", "text"), "source_id", "left")
    place = quotes.select("source_id", "quote", (F.instr("text", F.col("quote")) - 1).alias("start"))
    found = one.drop("start", "end").join(place, (one.source_id.eqNullSafe(place.source_id)) & (one.quote.eqNullSafe(place.quote)), "left").drop(place.source_id).drop(place.quote)
    good = F.coalesce((F.col("quote") != "") & (F.col("start") >= 0), F.lit(False))
    spotted = found.where(good).withColumn("end", F.col("start") + F.length("quote")).withColumn("at", at)
    out = ingest(spotted, claims, aliases, types, allowed, exclusive, staging, open_predicates, skip)
    shape = ["source_id", "ord", "subject", "predicate", "object", "confidence", "quote", "reason"]
    lost = weak.withColumn("reason", F.lit("low_confidence")).select(shape).unionByName(found.where(~good).withColumn("reason", F.lit("span_missing")).select(shape))
    return out._replace(quarantine=lost.unionByName(out.quarantine.select(shape)))


def apply_versions(claims: DataFrame, diff: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, events, errors) of a version diff (ord, old_id, new_id, source_id), old_id null for an added claim.

    Each staged claim that is there gives a new active version of its family from now on, in the order superseding ones, then added ones,
    each by ord; it stays as it is itself. The old claim of a pair ends now. A new_id that is not there is an error, and its old claim stays.
    Events: policy_changed for pairs, claim_added for others, with the id of the version that was made."""
    d = diff.select("ord", "old_id", "new_id", F.col("source_id").alias("by_source"))
    at = d.join(claims.withColumnRenamed("id", "new_id"), "new_id", "left")
    errors = at.where("family_id IS NULL").select("ord", F.concat(F.lit("staging claim not found: "), F.coalesce("new_id", F.lit(""))).alias("error"))
    ok = at.where("family_id IS NOT NULL")
    top = claims.join(ok.select("family_id").distinct(), "family_id", "left_semi").groupBy("family_id").agg(F.max("version").alias("top"))
    turn = Window.partitionBy("family_id").orderBy(F.col("old_id").isNull(), "ord", "new_id")
    made = ok.join(top, "family_id").withColumn("version", (F.col("top") + F.row_number().over(turn)).cast("int"))
    made = made.withColumn("id", T.short_hash(F.concat_ws("|", "family_id", "version")))
    fresh = made.withColumn("status", F.lit("active")).withColumn("valid_from", now).withColumn("valid_to", F.lit(None).cast("timestamp"))
    ended = ok.select(F.col("old_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("_end", F.lit(True))
    old = claims.join(ended, "id", "left").withColumn("status", F.when(F.col("_end"), "superseded").otherwise(F.col("status"))).withColumn("valid_to", F.when(F.col("_end"), now).otherwise(F.col("valid_to")))
    events = made.select("ord", F.when(F.col("old_id").isNull(), "claim_added").otherwise("policy_changed").alias("type"), F.col("by_source").alias("source_id"), F.col("id").alias("claim_id"), now.alias("timestamp"))
    return old.select(*CLAIM_COLUMNS).unionByName(fresh.select(*CLAIM_COLUMNS)), events, errors
