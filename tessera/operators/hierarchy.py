"""Topic names: canonical forms, and the hub, leaf or snippet that each name of a knowledge base becomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.streaming.ingest import shared_path

# Names that are given other canonical ones, and the marks and hubs of the hierarchy rules.
ALIASES = {"尺码表": "尺码选择", "尺码指南": "尺码选择"}
HUB_WORDS = ("流程", "规范", "指南", "升级")
RANK_MARKS = ("一级", "二级", "三级")
RANK_HUB, NO_HUB = "投诉升级", "未分类"
#: Names of at most so many characters are snippets, unless they hold a hub word.
SHORT = 4


def default_aliases(spark) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "alias string, canonical string")


def canonical_names(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """names with canon: the letters and digits of the name in lower case; if that is an alias (alias, canonical), its canonical
    form (the least, if there are several); else the longest of these canonical forms that it begins with; else itself.

    Each distinct form meets the canonical forms by its own beginnings (an equi-join), as many as the longest canonical form has characters."""
    forms = names.select(T.topic_name(column).alias("form")).where("form IS NOT NULL").distinct()
    known = aliases.groupBy("alias").agg(F.min("canonical").alias("known"))
    heads = known.select(F.col("known").alias("head")).where("head <> ''").distinct()
    longest = F.broadcast(heads.agg(F.max(F.length("head")).alias("longest")))  # one row
    ladder = forms.crossJoin(longest).select("form", F.explode(F.expr("transform(sequence(1, least(length(form), longest)), n -> left(form, n))")).alias("head"))
    begun = ladder.where("form <> ''").join(heads, "head").groupBy("form").agg(F.max_by("head", F.length("head")).alias("begun"))
    told = forms.join(known, F.col("form") == F.col("alias"), "left").join(begun, "form", "left").select("form", F.coalesce("known", "begun", "form").alias("canon"))
    return names.withColumn("form", T.topic_name(column)).join(told, "form", "left").drop("form")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: made once, however often it is read."""
    path = shared_path(df.sparkSession, "hierarchy")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _any(name: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])


def _longer(*hubs: Column) -> Column:
    """The longest of the hubs that are there, ties to the lesser text."""
    ranked = F.filter(F.array(*[F.struct((-F.length(h)).alias("n"), h.alias("hub")) for h in hubs]), lambda x: x["hub"].isNotNull())
    return F.array_min(ranked)["hub"]


def _leaders(events: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """asked (kb_id, phase, ord, name) with leader: the hub with most events (kb_id, phase, ord, name, hub) before it in its knowledge base, ties to the hub that came first.

    Counts only grow, so the leader is the running best of (count, first place). Both the counts and the running best are prefix
    aggregates, taken block by block of `ord` and then over the blocks, so that no window holds all of a knowledge base or of a hub."""
    place = F.struct("phase", "ord", "name")
    part = lambda df: df.withColumn("block", F.struct("phase", F.floor(F.col("ord") / block).alias("n")))
    e = part(events)
    before = Window.partitionBy("kb_id", "hub").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = e.groupBy("kb_id", "hub", "block").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    first = e.groupBy("kb_id", "hub").agg(F.min(place).alias("first"))
    within = Window.partitionBy("kb_id", "hub", "block").orderBy("ord", "name")
    counted = e.withColumn("k", F.row_number().over(within)).join(base, ["kb_id", "hub", "block"]).join(first, ["kb_id", "hub"])
    state = F.struct((-(F.col("base") + F.col("k"))).alias("n"), "first", "hub")
    rows = counted.select("kb_id", "block", "ord", "name", state.alias("state"))
    rows = cut(rows.unionByName(part(asked).select("kb_id", "block", "ord", "name", F.lit(None).cast(rows.schema["state"].dataType).alias("state"))))
    over_blocks = Window.partitionBy("kb_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = rows.groupBy("kb_id", "block").agg(F.min("state").alias("best")).withColumn("best", F.min("best").over(over_blocks))
    inside = Window.partitionBy("kb_id", "block").orderBy("ord", "name").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("own", F.min("state").over(inside)).where("state IS NULL").join(so_far, ["kb_id", "block"])
    return told.select("kb_id", "name", F.least("own", "best")["hub"].alias("leader"))


def hierarchy(names: DataFrame, parents: DataFrame, snippets: DataFrame, block: int = 1 << 20) -> DataFrame:
    """kb_id, name, hub, leaf, role (hub, leaf or snippet), target, phase, ord: a row for each name (kb_id, ord, name) of a knowledge base.

    Seeds go first (phase 0): `snippets` (kb_id, name, hub, target), then `parents` (kb_id, name, hub, leaf, role). The other names follow
    in order of (ord, name), as if one by one: a rank mark makes a leaf of RANK_HUB; a short name is a snippet of the hub that most names before it
    have (ties: the hub that came first; without any, NO_HUB); another name is a leaf of the longest known hub that it begins with or shares
    two first characters with (ties to the lesser text), less that beginning; else it becomes a hub itself, known to all after it. Known from the start are all hubs of the seeds.

    Names can only find a new hub under their own first two characters, and the first name there without a hub is one for all later, so a
    pair of characters has at most one such hub: the earliest of the names that no other hub takes. That makes the fold a minimum for each pair.
    A repeated name counts once, by its first place; nulls take no part; `block` is a range of `ord` that one task may hold.
    Each step is written once and read by those after it. Of the hubs that share two first characters a name needs the best two, as one may be itself."""
    n = names.where("kb_id IS NOT NULL AND name IS NOT NULL AND name <> ''").groupBy("kb_id", "name").agg(F.min("ord").alias("ord"))
    ps = parents.groupBy("kb_id", "name").agg(F.min(F.struct("hub", "leaf", "role")).alias("p"))
    ss = snippets.groupBy("kb_id", "name").agg(F.min(F.struct("hub", "target")).alias("s"))
    both = cut(n.join(ss, ["kb_id", "name"], "left").join(ps, ["kb_id", "name"], "left"))
    is_leaf = F.coalesce((F.col("p.role") != "hub") & F.col("p.leaf").isNotNull(), F.lit(False))
    none = F.lit(None).cast("string")
    shape = ["kb_id", "name", "hub", "leaf", "role", "target", "phase", "ord"]
    seeded = both.where("s IS NOT NULL OR p IS NOT NULL").select(
        "kb_id",
        "name",
        F.coalesce("s.hub", "p.hub").alias("hub"),
        F.when(F.col("s").isNull() & is_leaf, F.col("p.leaf")).alias("leaf"),
        F.when(F.col("s").isNotNull(), "snippet").when(is_leaf, "leaf").otherwise("hub").alias("role"),
        F.col("s.target").alias("target"),
        F.lit(0).alias("phase"),
        "ord",
    )
    rest = both.where("s IS NULL AND p IS NULL").select("kb_id", "name", "ord", F.lit(1).alias("phase"))
    name = F.col("name")
    ranked, short = _any(name, RANK_MARKS), (F.length(name) <= SHORT) & ~_any(name, HUB_WORDS)
    rank = rest.where(ranked).select("kb_id", "name", F.lit(RANK_HUB).alias("hub"), name.alias("leaf"), F.lit("leaf").alias("role"), none.alias("target"), "phase", "ord")
    brief = rest.where(~ranked & short)

    key = F.substring("name", 1, 2)
    hubs = parents.select("kb_id", "hub").unionByName(snippets.select("kb_id", "hub")).where((F.col("hub") != "") & (F.col("hub") != NO_HUB)).distinct()
    best = Window.partitionBy("kb_id", "key").orderBy(F.desc(F.length("hub")), "hub")
    two = hubs.where(F.length("hub") > 1).withColumn("key", F.substring("hub", 1, 2)).withColumn("n", F.row_number().over(best)).where("n <= 2")
    two = two.groupBy("kb_id", "key").agg(F.array_sort(F.collect_list(F.struct("n", "hub"))).alias("two"))
    one = hubs.where(F.length("hub") == 1).select("kb_id", F.col("hub").alias("key1"), F.col("hub").alias("one"))
    rank_from = rank.groupBy("kb_id").agg(F.min(F.struct("ord", "name")).alias("rank_from"))
    open_ = rest.where(~ranked & ~short).withColumn("key", key).withColumn("key1", F.substring("name", 1, 1))
    open_ = open_.join(two, ["kb_id", "key"], "left").join(one, ["kb_id", "key1"], "left").join(F.broadcast(rank_from), "kb_id", "left")  # a row a knowledge base
    given = _longer(F.get(F.filter("two", lambda h: h["hub"] != name), F.lit(0))["hub"], F.col("one"))
    by_rank = F.when((F.struct("ord", "name") > F.col("rank_from")) & (F.col("key") == RANK_HUB[:2]) & (name != RANK_HUB), RANK_HUB)
    open_ = cut(open_.select("kb_id", "key", "name", "ord", "phase", _longer(given, by_rank).alias("taken")))
    own = open_.where("taken IS NULL").groupBy("kb_id", "key").agg(F.min(F.struct("ord", "name")).alias("own"))
    open_ = open_.join(own, ["kb_id", "key"], "left")
    later = F.when(F.struct("ord", "name") > F.col("own"), F.col("own.name"))
    hub = _longer(F.col("taken"), later)
    got = open_.select("kb_id", "name", "ord", "phase", hub.alias("found"))
    rest_of = F.when(F.startswith("name", F.col("found")), F.expr("substring(name, length(found) + 1)")).otherwise(name)
    opened = got.select("kb_id", "name", F.coalesce("found", "name").alias("hub"), F.when(F.col("found").isNotNull(), F.coalesce(F.nullif(rest_of, F.lit("")), name)).alias("leaf"), F.when(F.col("found").isNotNull(), "leaf").otherwise("hub").alias("role"), none.alias("target"), "phase", "ord")

    placed = cut(seeded.unionByName(rank).unionByName(opened)).select(shape)
    if brief.isEmpty():
        return placed
    leaders = _leaders(placed.select("kb_id", "phase", "ord", "name", "hub"), brief, block)
    small = brief.join(leaders, ["kb_id", "name"]).select("kb_id", "name", F.coalesce("leader", F.lit(NO_HUB)).alias("hub"), none.alias("leaf"), F.lit("snippet").alias("role"), none.alias("target"), "phase", "ord")
    return placed.unionByName(small).select(shape)


def hub_leaves(assigned: DataFrame) -> DataFrame:
    """kb_id, hub, leaf, phase, ord: the distinct leaves of each hub by first place (targets of snippets are leaves too); a hub without any has one row without leaf."""
    leaf = F.when(F.col("role") == "leaf", F.col("leaf")).when(F.col("role") == "snippet", F.col("target"))
    rows = assigned.withColumn("leaf", F.nullif(leaf, F.lit("")))
    path = shared_path(rows.sparkSession, "leaves")
    first = rows.groupBy("kb_id", "hub", "leaf").agg(F.min(F.struct("phase", "ord")).alias("at"))
    first.write.parquet(path)  # read twice, made once
    first = rows.sparkSession.read.schema(first.schema).parquet(path)
    leaves = first.where("leaf IS NOT NULL")
    bare = first.groupBy("kb_id", "hub").agg(F.count("leaf").alias("n"), F.min("at").alias("at")).where("n = 0").select("kb_id", "hub", F.lit(None).cast("string").alias("leaf"), "at")
    return leaves.unionByName(bare).select("kb_id", "hub", "leaf", "at.phase", "at.ord")
