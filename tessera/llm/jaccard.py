"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of word-shingle hashes. Documents with one and the same set form a class, found by the set's
128-bit digest. Two classes link when 100 * |A and B| >= percent * |A or B|. Links need T shared shingles,
T = ceil(percent * n / 100) for a set of n; so, in any global order of shingles, the first n - T + 1 of both sets
share one (the prefix). The order is first: the shingles of least hashes (a fixed share of all), among
these the rarest. Only this share is counted and shuffled; a shingle that one class alone has cannot make a link,
and a class with as many of these as its prefix takes has no link at all and goes. All shingles of the classes left
are then counted among themselves, and their prefixes taken again, the rarest first; so documents that
share a passage but not the rest go too.

Classes that share prefix shingles form blocks. Within a block each class is a query against an inverted index of the
smaller sets: the short lists are merged by a heap, the long ones are probed by binary search (DivideSkip), and those that
reach the needed overlap link. As links are wanted up to their components, a search goes on only for components that it has
not linked to yet; so a group of near copies costs in proportion to its size. A block over `block` classes is dealt into
random parts; what stays apart after `deals` deals is cut into bands of size (only neighbouring bands can link) and these are compared
part by part, so no link is lost and no task holds more than `block` sets.

Hot keys: copies collapse to classes first; a shingle that very many classes have is dealt to many tasks; joins are
sort-merge joins that Spark splits where skewed, or broadcasts of at most `BROADCAST_BYTES`.

Words are runs of other than ASCII white space, A-Z lower-cased. Fewer words than `k` make one shingle; null and
empty texts have none and link with nothing; an empty table gives an empty result. Rows with a null id take part like others, and their
component is that of their class. Repeated rows fall into one class. Very long texts are taken whole, one at a time. Only id and text
are read, so extra columns do no harm; `keep_one` gives them all back. Shingles are 64-bit hashes (a clash can only add to an overlap); classes
go by 64 bits of their digest and, where two share these, by all 128.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, byte_strings, drop, focus, fresh, materialise, sent, trimmed, windows, word_hashes
from tessera.llm.graph import components

#: Postings held at once; a shingle that so many classes have is dealt to SPLIT tasks.
CHUNK, SPLIT = 1 << 18, 64


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n shingles with any set that it links to."""
    return -(-percent * n // 100)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    return np.unique(windows(word_hashes((text or b"").lower().split()), k))


def sets(docs: DataFrame, k: int, percent: int, whole: bool, id_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, cid (half of the class's digest; null without shingles), rest (the other half), n, u (shingles in the counted share),
    shingles (sorted, 8 bytes each): the whole set, or as much of it as `postings` counts. id_bits: of cid that are used."""
    top, names = np.uint64(int(share(percent) * 2**64) - 1), ["doc_id", "cid", "rest", "n", "u", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("words")
        for batch in batches:
            of = iter(batch.column(0).to_pylist())
            for part in by_bytes(batch.column(1)):
                rows = []
                for text in byte_strings(part):
                    own = shingle_set(text, k)
                    data = own.tobytes()
                    digest = xxhash.xxh3_128_digest(data)
                    cid, rest = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:])) if len(own) else (None, None)
                    cid = cid >> (64 - id_bits) if len(own) else None
                    u = int(np.searchsorted(own, top, side="right"))
                    rows.append((next(of), cid, rest, len(own), u, data if whole else data[: 8 * max(u, len(own) - needed(len(own), percent) + 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (*[pa.int64()] * 5, pa.binary()))], names)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(trimmed(run), "doc_id bigint, cid bigint, rest bigint, n bigint, u bigint, shingles binary")


def told_apart(rows: DataFrame, clashes: list[int]) -> DataFrame:
    """rows with classes whose cid another class has too under a number that takes in the rest of their digests."""
    if not clashes:
        return rows
    return rows.withColumn("cid", F.when(F.col("cid").isin(clashes), F.xxhash64("cid", "rest")).otherwise(F.col("cid")))


def classes_of(base: DataFrame) -> tuple[DataFrame, list[int]]:
    """cid, rep (least doc_id), n, u of every class, and the cids that `told_apart` has to part (none but by a rare accident)."""

    def grouped(clashes: list[int]) -> DataFrame:
        rows = told_apart(base.where(F.col("cid").isNotNull()), clashes)
        return materialise(rows.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("u").alias("u"), (F.min("rest") != F.max("rest")).alias("two")), "classes")

    out = grouped([])
    clashes = [r["cid"] for r in out.where("two").limit(1001).collect()]
    if not clashes:
        return out, []
    drop(out)
    out = grouped(clashes)
    if len(clashes) > 1000 or out.where("two").limit(1).count():
        raise ValueError("too many classes share half of their digests")
    return out, clashes


def share(percent: int) -> float:
    """Share of all shingles that is counted: half as much again as a prefix takes."""
    return min(1.0, 1.5 * (1 - percent / 100))


def postings(base: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """token, cid: of each class the counted shingles, at least as many as its prefix, or all. Copies within a task go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("postings")
        seen: set[int] = set()
        for batch in batches:
            tokens, cids, size = [], [], 0
            for cid, n, u, data in zip(*(c.to_pylist() for c in batch.columns)):
                if cid in seen:
                    continue
                seen.add(cid)
                take = n if every else max(u, n - needed(n, percent) + 1)
                tokens.append(np.frombuffer(data, dtype=np.int64, count=take))
                cids.append(np.full(take, cid))
                if (size := size + take) > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(cids))], ["token", "cid"])
                    tokens, cids, size = [], [], 0
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(cids))], ["token", "cid"])

    return base.where(F.col("cid").isNotNull()).select("cid", "n", "u", "shingles").mapInArrow(trimmed(run), "token bigint, cid bigint")


def hot_tokens(base: DataFrame, percent: int, every: bool, least: int) -> list[int]:
    """Shingles that about `least` classes or more have, by a share of the classes that grows smaller with `least`; the 10,000 hottest at
    most. It only says which shingles to deal to several tasks, so the choice changes no result."""
    share = max(1, least >> 14)
    some = base.where(F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(share)) == 0)
    found = postings(some, percent, every).groupBy("token").agg(F.count("*").alias("many")).where(F.col("many") >= least / share)
    return sorted(r["token"] for r in found.orderBy(F.desc("many"), "token").limit(10_000).collect())


def shared_tokens(posts: DataFrame, hot: list[int] = ()) -> DataFrame:
    """token, cid, df for tokens of two classes or more; df counts up to CHUNK, which also stands for hot tokens. Sorted runs
    stream through a task."""
    known = np.array(hot, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: np.ndarray, c: np.ndarray, capped: int | None) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c = t[new], c[new]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            df = np.repeat(np.diff(np.append(first, len(t))), np.diff(np.append(first, len(t))))
            df = np.where(t == capped, CHUNK, df) if capped is not None else df
            df = np.where(np.isin(t, known), CHUNK, df) if len(known) else df
            many = df > 1
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[many]), pa.array(c[many]), pa.array(np.minimum(df[many], CHUNK).astype(np.int64))], ["token", "cid", "df"])

        focus("postings")
        held: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        size, capped = 0, None
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size <= CHUNK:
                continue
            t, c = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(t, t[-1]))
            if cut == 0:  # one token fills the chunk: its count is the most there is
                capped, cut = int(t[-1]), len(t)
            yield from emit(t[:cut], c[:cut], capped)
            held, size = [(t[cut:], c[cut:])], len(t) - cut
        t, c = (np.concatenate(x) for x in zip(*held))
        if len(t):
            yield from emit(t, c, capped)

    salt = [F.when(F.col("token").isin(list(hot)), F.pmod(F.xxhash64("cid"), F.lit(SPLIT))).otherwise(F.lit(0))] if hot else []
    return posts.repartition("token", *salt).sortWithinPartitions("token", "cid").mapInArrow(trimmed(run), "token bigint, cid bigint, df bigint")


def prefixes(base: DataFrame, classes: DataFrame, percent: int, every: bool = False, hot_at: int = CHUNK) -> DataFrame:
    """cid, token: the prefix shingles that two classes or more have, of classes that may link at all.

    Of the shingles posted for a class, those that it has alone come first, then the others, the rarest first."""
    hot = hot_tokens(base, percent, every, hot_at)
    own = shared_tokens(postings(base, percent, every), hot).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    need = F.expr(f"n - ceil({percent} * n / 100) + 1")
    posted = F.col("n") if every else F.greatest("u", "need")
    open_ = own.join(classes, "cid").withColumn("need", need).withColumn("left", F.col("need") - posted + F.size("shared"))
    return open_.where("left > 0").select("cid", F.explode(F.slice("shared", F.lit(1), F.col("left").cast("int"))["token"]).alias("token"))


def merged(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Distinct entries of sorted lists with their counts, ascending, by a heap."""
    last, count = -1, 0
    for d in heapq.merge(*lists):
        if d == last:
            count += 1
            continue
        if count:
            yield last, count
        last, count = d, 1
    if count:
        yield last, count


class Block:
    """Components of a block's sets; the index grows by one set at a time, in order of size. Tokens are numbers below `tokens`."""

    def __init__(self, percent: int, tokens: int):
        self.percent, self.index, self.sizes = percent, [[] for _ in range(tokens)], []
        self.comp, self.members, self.searches = [], [], 0

    def join(self, a: int, b: int) -> None:
        """Make one component of those of a and b, under the larger one's number."""
        few, many = sorted((self.comp[a], self.comp[b]), key=lambda c: (len(self.members[c]), -c))
        if few != many:
            for i in self.members[few]:
                self.comp[i] = many
            self.members[many] += self.members[few]
            self.members[few] = []

    def search(self, tokens: list[int], n: int, me: int) -> None:
        """DivideSkip: find, for each component of earlier sets, one that shares enough tokens with me, a set of n. Tokens that no other set
        of the block has are left out of `tokens`, as they have no lists."""
        need = needed(n, self.percent)
        low = bisect_left(self.sizes, need, hi=me)  # smaller sets can't link
        lists = sorted((x for t in tokens if (x := self.index[t])), key=len)
        if len(lists) < need or low == me:
            return
        self.searches += 1
        skip = min(need - 1, int(need / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        pending, start = set(self.comp[low:me]), low
        rest = [y for x in short if (y := x[bisect_left(x, low) :])]
        while pending:
            hit = None
            for d, count in merged(rest):
                if count < need - skip or self.comp[d] not in pending:
                    continue
                want = -(-self.percent * (n + self.sizes[d]) // (100 + self.percent))
                for i, x in enumerate(long):
                    if count >= want or count + len(long) - i < want:
                        break
                    p = bisect_left(x, d)
                    count += p < len(x) and x[p] == d
                if count >= want:
                    hit = d
                    break
            if hit is None:
                return
            pending.discard(self.comp[hit])
            self.join(hit, me)
            # Go on behind the hit, with what the components not yet met have in the short lists.
            start, many = hit + 1, sum(len(self.members[c]) for c in pending)
            if 8 * many < me:
                few = sorted(i for c in pending for i in self.members[c] if i >= start)
                rest = [y for x in short if (y := [d for d in few if (p := bisect_left(x, d)) < len(x) and x[p] == d])]
            else:
                rest = [y for x in short if (y := [d for d in x[bisect_left(x, start) :] if self.comp[d] in pending])]

    def add(self, tokens: list[int], n: int) -> None:
        me = len(self.sizes)
        self.sizes.append(n)
        self.comp.append(me)
        self.members.append([me])
        self.search(tokens, n, me)
        for t in tokens:
            self.index[t].append(me)


def components_of_sets(sets_: list[np.ndarray], percent: int) -> Block:
    """Link sets of distinct numbers, in order of size, through one block."""
    flat = np.concatenate(sets_)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    renumbered = np.cumsum(shared) - 1
    block, at = Block(percent, int(shared.sum())), 0
    for own in sets_:
        mine = number[at : at + len(own)]
        block.add(renumbered[mine[shared[mine]]].tolist(), len(own))
        at += len(own)
    return block


def link_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """rows(part, cid, shingles), a part's rows to be compared among themselves -> a, b: each class and its component's first."""

    def solve(group: dict[int, bytes]) -> list[tuple[int, int]]:
        order = sorted(group, key=lambda c: (len(group[c]), c))
        comp = components_of_sets([np.frombuffer(group[c], dtype=np.int64) for c in order], percent).comp
        return [(c, order[r]) for c, r in zip(order, comp) if order[r] != c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("blocks")
        part, group, out = None, {}, []
        for batch in batches:
            for p, cid, data in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    out += solve(group) if len(group) > 1 else []
                    part, group = p, {}
                    if len(out) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                        out = []
                group[cid] = data
        out += solve(group) if len(group) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return rows.select("part", "cid", "shingles").repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(run), "a bigint, b bigint")


def block_edges(prefix: DataFrame) -> DataFrame:
    """a, b: edges whose components are those of classes that share prefix shingles. A class is linked with the least of its shingles' least
    classes alone, and these least classes with that one, as often as they differ: near copies have few of them, whatever the shingles that they share."""
    least = prefix.groupBy("token").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least < most").drop("most")
    pairs = prefix.join(least, "token").where("cid <> least").select("cid", "least")
    drawn = pairs.withColumn("b", F.min("least").over(Window.partitionBy("cid"))).select("b", F.explode(F.array("cid", "least")).alias("a"))
    return drawn.where("a <> b").select("a", "b").distinct()


def block_of(prefix: DataFrame) -> DataFrame:
    """cid, block, size: classes that share prefix shingles, directly or in a chain."""
    comp = components(block_edges(prefix)).select(F.col("v").alias("cid"), F.col("comp").alias("block"))
    return materialise(comp.join(comp.groupBy("block").agg(F.count("*").alias("size")), "block"), "blocks")


def links(docs: DataFrame, base: DataFrame, classes: DataFrame, clashes: list[int], k: int, percent: int, block: int = 2000, deals: int = 2, hot_at: int = CHUNK, id_bits: int = 64) -> DataFrame:
    """Links between classes, as a, b: enough of them that their components are those of all links.

    Whole sets are made again, from the texts, for one document of each class that may link."""
    able = prefixes(base, classes, percent, hot_at=hot_at).select("cid").distinct().join(classes.select("cid", "rep"), "cid")
    able = materialise(able, "able")
    some = able.count()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    mine = texts.join(sent(able.select("rep").distinct(), some), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    again = told_apart(sets(mine, k, percent, whole=True, id_bits=id_bits), clashes)
    left = materialise(again.join(sent(able.select("cid"), some), "cid", "left_semi"), "left")
    drop(able)
    prefix = materialise(prefixes(left, classes, percent, every=True, hot_at=hot_at), "prefix")
    found, deal = base.sparkSession.createDataFrame([], "a bigint, b bigint"), 0
    while True:
        blocks = block_of(prefix)
        shape = blocks.agg(F.count("*"), F.max("size")).first()
        if not shape[0]:
            break
        last = deal >= deals and shape[1] > block
        dealt = tiles(blocks.join(classes.select("cid", "n"), "cid"), percent, block // 2) if last else blocks.withColumn("part", F.concat_ws(":", "block", F.pmod(F.xxhash64("cid", F.lit(deal)), F.ceil(F.col("size") / block))))
        dealt = materialise(dealt.select("cid", "part"), "dealt")
        rows = left.select("cid", "shingles").join(sent(dealt, dealt.count()), "cid")
        found = found.unionByName(materialise(link_blocks(rows, percent), "links"))
        drop(dealt)
        if last or shape[1] <= block:
            break
        # Blocks dealt out: go on with the prefix shingles of big blocks that still lie in two components.
        comp = components(found).select(F.col("v").alias("cid"), "comp")
        big = prefix.join(blocks.where(F.col("size") > block).select("cid"), "cid", "left_semi")
        named = big.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        apart = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
        former, prefix = prefix, materialise(big.join(apart, "token", "left_semi"), "prefix")
        drop(former, blocks)
        deal += 1
    drop(left, prefix, blocks)
    return found


def tiles(blocks: DataFrame, percent: int, most: int) -> DataFrame:
    """Parts in which every two classes of a block meet whose sizes allow a link: bands of size, each with the band
    below, in pairs of random parts of about `most` classes."""
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1.0
    banded = blocks.withColumn("home", F.floor(F.log("n") / width)).withColumn("band", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    full = banded.groupBy("block", "band").agg(F.count("*").alias("here"))
    parts = F.ceil(F.col("here") / most).cast("int")
    mine = F.pmod(F.xxhash64("cid", F.lit(-1)), F.col("parts")).cast("int")
    dealt = banded.join(full, ["block", "band"]).withColumn("parts", parts).withColumn("mine", mine)
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return met.withColumn("part", F.concat_ws(":", "block", "band", F.least("mine", "other"), F.greatest("mine", "other")))


def classify(docs: DataFrame, k: int = 5, percent: int = 80, id_bits: int = 64, **options) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id that links reach, its own included)."""
    made = materialise(sets(docs, k, percent, whole=False, id_bits=id_bits), "sets")
    classes, clashes = classes_of(made)
    base = told_apart(made, clashes)
    found = links(docs, base, classes, clashes, k, percent, id_bits=id_bits, **options)
    comp = components(found).select(F.col("v").alias("cid"), "comp")
    linked = classes.join(comp, "cid").select("cid", "comp", "rep")
    lowest = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    lookup = materialise(classes.select("cid", "rep").join(linked.join(lowest, "comp").select("cid", "component_id"), "cid", "left").select("cid", F.coalesce("component_id", "rep").alias("component_id")), "lookup")
    return base.select("doc_id", "n", "cid").join(lookup, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of each group of docs that links join: that of the least doc_id; all columns stay. Rows without shingles all stay, and so do
    rows with a null id whose group has no other; of rows with one id and text one stays.

    The ids that go are broadcast while they are few enough; beyond, the rows are joined to them by a shuffle."""
    found = materialise(classify(docs, k, percent, **options), "components")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    (gone,) = fresh(docs, "_gone")
    ids = found.groupBy("doc_id").agg(F.count_if(own).alias("n")).select(F.col("doc_id").alias(gone), "n")
    ids = materialise(ids.where("n <> 1"), "gone")
    out_ids = ids.where("n = 0").select(gone)
    out = docs.join(sent(out_ids, out_ids.count()), docs["doc_id"].cast("bigint").eqNullSafe(F.col(gone)), "left_anti")
    return out.dropDuplicates(["doc_id", "text"]) if ids.where("n > 1").limit(1).count() else out
