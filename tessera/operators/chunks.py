"""Chunks as exact, gap-free slices of a text: structural splits, size splits, overflow and coverage.

Everything is narrow: a text is cut inside its row, by array functions or in Arrow batches, then exploded; no shuffle. Time grows with the
text's length, not with its square. Offsets are code points, half-open.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import accumulate, islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.functions import text as T

#: Line ends as the splitter knows them: LF, CR, VT, FF, the separators 1C to 1E, NEL, LS and PS.
LINE_END = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0B\x0C\x1C-\x1E\x85  ])"
HEADING = r"^\s*#{1,6}\s+\S"


#: Lines whose offsets are summed up in one run; runs are summed up among themselves, so cost grows with the lines alone.
RUN = 512


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(sizes: Column) -> Column:
    """For each entry of an int array the sum of all before it."""
    running = lambda xs, zero: F.aggregate(xs, F.struct(zero.alias("pos"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["pos"] + x).alias("pos"), F.array_append(a["out"], a["pos"]).alias("out")), lambda a: a["out"])
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(n) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(n, k + 1, F.lit(RUN)))
    within = lambda r: F.flatten(F.zip_with(r, running(F.transform(r, total), F.lit(0)), lambda xs, at: running(xs, at)))
    return bound(sizes, lambda n: bound(runs(n), within))


def lines(text: Column) -> Column:
    """Lines with their ends, as structs of start and end offset, whether blank, and heading level (0: none)."""
    level = lambda x: F.when(x.rlike(HEADING), F.length(F.regexp_extract(x, r"^\s*(#+)", 1))).otherwise(0)
    blank = lambda x: F.trim(F.regexp_replace(x, r"[\s\x1C-\x1F\x85  ]+", " ")) == ""
    placed = lambda raw: F.zip_with(raw, prefix_sums(F.transform(raw, lambda x: F.length(x))), lambda x, at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), blank(x).alias("blank"), level(x).alias("level"), x.alias("line")))
    return bound(F.filter(F.split(text, LINE_END), lambda x: x != ""), placed)


def spans_table(sources: DataFrame) -> DataFrame:
    """id, line: one row for each line of each source."""
    return sources.select("id", F.length("text").alias("n"), F.explode(lines(F.col("text"))).alias("x")).select("id", "n", "x.*")


def chunk_mode(text: Column, least: int = 2) -> Column:
    """`heading` where there are enough headings of level one or two, else `general`."""
    return F.when(F.regexp_count(text, F.lit(r"(?m)^[ \t]*#{1,2}[ \t]")) >= least, "heading").otherwise("general")


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), r"^[\s]*#+|[\s]+$", ""))


_PLACE = [StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("title", StringType())]
# The functions below are marked as nondeterministic, though they aren't, so that the optimizer evaluates them once, in a projection of their own.
SPAN = ArrayType(StructType(_PLACE))
SECTION = ArrayType(StructType([*_PLACE, StructField("section_path", ArrayType(StringType()))]))
_HEAD = re.compile(r"(#{1,6})\s+\S")
#: Rows whose results are held as Python objects at a time.
HELD = 64


def _rows(values: Iterable, kind: pa.DataType) -> pa.Array:
    """An array of the values, of which few are held as Python objects at a time."""
    parts, it = [], iter(values)
    while some := list(islice(it, HELD)):
        parts.append(pa.array(some, kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def sections(text: str) -> list[tuple[int, int, str | None, list[str]]]:
    """start, end, title and section path of a text's spans, line by line.

    A heading opens a span. A blank line belongs to the span before it and closes it; one that would be a span alone is left to the next cut.
    A heading of level n takes the n-th place of the path, or the first free one before it, and ends it; spans without a heading of their own stand under the last one."""
    out, opened, title, path, place = [], 0, None, [], 0
    for line in text.splitlines(keepends=True):
        bare, after = line.strip(), place + len(line)
        head = _HEAD.match(bare)
        if head or not bare:
            cut = place if head else after
            if opened < place:
                out.append((opened, cut, title, path))
                opened, title = cut, None
        if head:
            name = bare.lstrip("#").strip()
            path = [*path[: len(head[1]) - 1], name]
            opened, title = place, name or None
        place = after
    if opened < place:
        out.append((opened, place, title, path))
    return out


@F.arrow_udf(SECTION)
def _sections(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("title", pa.string()), ("section_path", pa.list_(pa.string()))]))
    return _rows(([{"start": a, "end": b, "title": t, "section_path": p} for a, b, t, p in sections(x.as_py() or "")] for x in text), kind)


_sections = _sections.asNondeterministic()


def section_spans(text: Column) -> Column:
    """Spans cut at heading lines and after blank lines, with their section path; see `sections`. Linear in the text."""
    return _sections(text)


def general_spans(text: Column) -> Column:
    """The same as structs of start, end and title."""
    return F.transform(section_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["title"].alias("title")))


# White space as the patterns of the JVM have it; the last mark of a line may be one that isn't.
_WS = " \t\n\x0b\x0c\r"
#: Spaces of any width, which a title has not at its ends.
_SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_MARK = re.compile(f"[{_WS}]*(#{{1,6}})[{_WS}]+[^{_WS}]")
_NAME_ENDS = re.compile(f"^[{_WS}]*#+|[{_WS}]+(?=[\x85\u2028\u2029]?\\Z)")


def headed(text: str, level: int = 2) -> list[tuple[int, int, str | None]]:
    """start, end and title of a text's spans, line by line: each heading up to a level opens one, and so does the text."""
    heads, place = [], 0
    for line in text.splitlines(keepends=True):
        mark = _MARK.match(line) if "#" in line else None
        if mark and len(mark[1]) <= level:
            heads.append((place, _NAME_ENDS.sub("", line.strip(_SPACES)).strip(_SPACES) or None))
        place += len(line)
    if place and (not heads or heads[0][0] > 0):
        heads.insert(0, (0, None))
    return [(start, end, title) for (start, title), end in zip(heads, [*(h[0] for h in heads[1:]), place])]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("title", pa.string())]))


def _span_rows(values: Iterable[list[tuple]]) -> pa.Array:
    """An array of spans (start, end, title, ...), column by column."""
    parts, it, kind = [], iter(values), _SPANS.value_type
    while some := list(islice(it, HELD)):
        flat = [s for spans in some for s in spans]
        ends = pa.array(accumulate(map(len, some), initial=0), pa.int32())
        parts.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array([s[i] for s in flat], f.type) for i, f in enumerate(kind)], fields=list(kind))))
    return pa.concat_arrays(parts) if parts else pa.array([], _SPANS)


@F.arrow_udf(SPAN)
def _headed(text: pa.Array, level: pa.Array) -> pa.Array:
    return _span_rows(headed(t.as_py() or "", n.as_py()) for t, n in zip(text, level))


@F.arrow_udf(SPAN)
def _by_mode(text: pa.Array, mode: pa.Array) -> pa.Array:
    return _span_rows(headed(t.as_py() or "") if m.as_py() == "heading" else sections(t.as_py() or "") for t, m in zip(text, mode))


_headed, _by_mode = _headed.asNondeterministic(), _by_mode.asNondeterministic()


def heading_spans(text: Column, level: int = 2) -> Column:
    """Spans cut before headings up to a level; what stands before the first is a span without title. Linear in the text."""
    return _headed(text, F.lit(level))


def size_split(spans: Column, most: int) -> Column:
    """Spans cut into pieces of at most `most` characters; only a span's first piece keeps the title."""
    cut = lambda s: F.transform(F.sequence(s["start"], F.greatest(s["end"] - 1, s["start"]), F.lit(most)), lambda p: F.struct(p.alias("start"), F.least(p + most, s["end"]).alias("end"), F.when(p == s["start"], s["title"]).alias("title")))
    return F.flatten(F.transform(spans, cut))


def fold_overflow(spans: Column, most: int) -> Column:
    """At most `most` spans: the last one takes all that would follow."""
    tail = F.struct(F.get(spans, F.lit(most - 1))["start"].alias("start"), F.element_at(spans, -1)["end"].alias("end"), F.get(spans, F.lit(most - 1))["title"].alias("title"))
    return F.when(F.size(spans) > most, F.array_append(F.slice(spans, 1, most - 1), tail)).otherwise(spans)


def merged(spans: list[dict], text: str, least: int) -> list[dict]:
    """Neighbouring spans joined until each has `least` tokens; a small rest joins the last. Each span's words and CJK characters are counted once and added up, which is exact for spans cut at line ends."""
    out: list[dict] = []
    for s in spans:
        piece = text[s["start"] : s["end"]]
        new = {**s, "words": len(_WORD.findall(piece)), "cjk": len(_CJK.findall(piece))}
        if out and _few(out[-1], least):
            out[-1] = _join(out[-1], new)
        else:
            out.append(new)
    if len(out) > 1 and _few(out[-1], least):
        last = out.pop()
        out[-1] = _join(out[-1], last)
    return [{k: s[k] for k in ("start", "end", "title")} for s in out]


_WORD, _CJK = regex.compile(r"[\p{L}\p{N}_]+"), re.compile("[\u4e00-\u9fff]")


def _few(s: dict, least: int) -> bool:
    """Whether a span's token estimate is under `least` (as `token_estimate` counts)."""
    cjk = s["cjk"]
    tokens = max(s["words"], cjk // 2) if cjk > 0 and cjk >= max(1.0, (s["end"] - s["start"]) / 3) else s["words"]
    return tokens < least


def _join(a: dict, b: dict) -> dict:
    return {"start": a["start"], "end": b["end"], "title": a["title"] if a["title"] is not None else b["title"], "words": a["words"] + b["words"], "cjk": a["cjk"] + b["cjk"]}


@F.arrow_udf(SPAN)
def _merged(spans: pa.Array, text: pa.Array, least: pa.Array) -> pa.Array:
    return _rows((merged(s.as_py(), t.as_py() or "", n.as_py()) if s.is_valid else None for s, t, n in zip(spans, text, least)), _SPANS)


_merged = _merged.asNondeterministic()


def merge_small(spans: Column, text: Column, least: int) -> Column:
    """The spans of each text (start, end, title) joined until each has `least` tokens; see `merged`."""
    return _merged(spans, text, F.lit(least))


def plain_chunks(text: Column, max_chars: int = 3000) -> Column:
    """The plain splitter: heading lines stand alone, blank lines part paragraphs, and what is longer than max_chars is cut. An array of texts, not folded."""
    ends = r"^[ \t\r\n]+|[ \t\r\n]+$"
    marked = F.regexp_replace(F.regexp_replace(text, ends, ""), r"(?m)^([ \t]*#{1,6}[ \t]+[^ \t\r\n][^\n]*)$", "\u001e$1\u001e")
    sections = F.filter(F.transform(F.split(marked, "\u001e|\\n[ \\t]*\\n"), lambda x: F.regexp_replace(x, ends, "")), lambda x: x != "")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.length(x) - 1, F.lit(max_chars)), lambda k: F.substring(x, k + 1, F.lit(max_chars)))
    return F.flatten(F.transform(sections, cut))


def plain_table(sources: DataFrame, max_chars: int = 3000, max_chunks: int = 40) -> DataFrame:
    """source_id, chunk_index, text and truncated: the first max_chunks plain chunks of each source; what follows is dropped, as that splitter does."""
    c = sources.select(F.col("id").alias("source_id"), plain_chunks(F.col("text"), max_chars).alias("c"))
    rows = c.select("source_id", (F.size("c") > max_chunks).alias("truncated"), F.posexplode(F.slice("c", 1, max_chunks)).alias("chunk_index", "text"))
    return rows.select("source_id", "chunk_index", "text", "truncated")


@F.arrow_udf(ArrayType(StringType()))
def _pieces(text: pa.Array, spans: pa.Array) -> pa.Array:
    at, start, end = (x.to_numpy() for x in (spans.offsets, spans.values.field("start"), spans.values.field("end")))

    def cut(t: str, own: slice) -> list[str]:
        return [t[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())]

    return _rows((cut(t.as_py() or "", slice(at[i], at[i + 1])) if some else None for i, (t, some) in enumerate(zip(text, spans.is_valid().to_pylist()))), pa.list_(pa.string()))


_pieces = _pieces.asNondeterministic()


def exploded(sources: DataFrame, spans: Column, path: bool = False) -> DataFrame:
    """Chunk rows: id (hash of source, index and content), source_id, chunk_index, title, start, end, text, content_hash, token_count; and section_path, if spans have it.

    A text is cut once, in its row, so that a chunk's row holds the chunk alone."""
    cut = sources.select(F.col("id").alias("source_id"), "text", spans.alias("s")).select("source_id", F.arrays_zip("s", _pieces("text", "s").alias("text")).alias("z"))
    extra = [F.col("z.s.section_path").alias("section_path")] if path else []
    rows = cut.select("source_id", F.posexplode("z").alias("chunk_index", "z"))
    rows = rows.select("source_id", "chunk_index", F.col("z.s.title").alias("title"), F.col("z.s.start").alias("start"), F.col("z.s.end").alias("end"), F.col("z.text").alias("text"), *extra)
    rows = rows.withColumn("content_hash", F.sha2("text", 256)).withColumn("token_count", T.token_estimate("text"))
    return rows.withColumn("id", T.short_hash(F.concat_ws("|", "source_id", "chunk_index", "content_hash")))


def chunk(sources: DataFrame, max_chars: int = 3000, max_chunks: int = 40) -> DataFrame:
    """Chunks of every source by its own mode, cut to size, folded to the limit."""
    placed = sources.select("id", "text", _by_mode(F.col("text"), chunk_mode(F.col("text"))).alias("spans"))
    cut = placed.select("id", "text", size_split(F.col("spans"), max_chars).alias("spans"))
    return exploded(cut, fold_overflow(F.col("spans"), max_chunks))


def coverage_violations(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources whose chunks leave a gap, overlap, or do not give the text back; expected empty."""
    w = Window.partitionBy("source_id").orderBy("start", "chunk_index")
    c = chunks.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    g = c.groupBy("source_id").agg(F.bool_and(F.col("before") == F.col("start")).alias("tight"), F.max("end").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("whole"))
    j = sources.where("length(text) > 0").select(F.col("id").alias("source_id"), "text").join(g, "source_id", "left")
    return j.where(~F.coalesce(F.col("tight") & (F.col("last") == F.length("text")) & (F.col("whole") == F.col("text")), F.lit(False))).select("source_id")
