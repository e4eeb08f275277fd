"""Scalar functions as Column expressions: tokens, ids, scores, excerpts. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str
#: Unicode word runs; a plain \w would be ASCII only.
WORD = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4e00}-\x{9fff}]"


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Text) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def trim_spaces(c: Text) -> Column:
    """Without spaces of any width (no-break and ideographic ones too) at both ends; tabs and line ends stay, as in SQL's trim."""
    return F.regexp_replace(col(c), r"^\p{Zs}+|\p{Zs}+\z", "")


def tokens(c: Text) -> Column:
    """Lower-case word runs."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def tokens_cjk(c: Text) -> Column:
    """Word runs, then each CJK character again."""
    return F.concat(tokens(c), F.regexp_extract_all(col(c), F.lit(CJK), F.lit(0)))


def short_hash(c: Text) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


def family_id(subject: Text, predicate: Text, object_type: Text) -> Column:
    """The id of all versions of a fact: the object's value is not part of it."""
    return short_hash(F.concat_ws("|", col(subject), col(predicate), col(object_type)))


def entity_id(kind: Text, name: Text) -> Column:
    return short_hash(F.concat_ws(":", col(kind), col(name)))


def cluster_id(kb: Text, name: Text) -> Column:
    return short_hash(F.concat_ws("|", col(kb), col(name)))


def casefold(c: Text) -> Column:
    """Lower case in which sharp s is ss."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def contains_folded(text: Text, needle: Text) -> Column:
    return F.contains(casefold(text), casefold(needle))


def token_bucket(token: Column, dims: int) -> Column:
    """md5 of a token as a 128-bit number, modulo dims."""
    part = lambda i: F.conv(F.substring(F.md5(token), i, 8), 16, 10).cast("bigint")
    out = F.lit(0).cast("bigint")
    for i in (1, 9, 17, 25):
        out = F.pmod(out * 4294967296 + part(i), F.lit(dims))
    return out


def dot(a: Text, b: Text) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Text, b: Text) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def overlap_score(query: Text, text: Text) -> Column:
    """Share of the query's distinct tokens that the text has; 1 or more where it holds the whole query."""
    q = F.array_distinct(tokens_cjk(query))
    base = F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens_cjk(text))) / F.size(q)).otherwise(0.0)
    return F.when(F.contains(F.lower(col(text)), F.lower(col(query))), F.greatest(base, F.lit(1.0))).otherwise(base)


def estimate_of(words: Column, cjk: Column, length: Column) -> Column:
    return F.when((cjk > 0) & (cjk >= F.greatest(F.lit(1.0), length / 3)), F.greatest(words, F.floor(cjk / 2))).otherwise(words).cast("bigint")


def token_estimate(c: Text) -> Column:
    """Word runs, or half of the CJK characters where these are a third of the text and more than the words."""
    return estimate_of(F.regexp_count(col(c), F.lit(WORD)), F.regexp_count(col(c), F.lit(CJK)), F.length(col(c)))


def normalise_text(c: Text) -> Column:
    """CRLF to LF, lines stripped at the right, three or more newlines to two, ends stripped."""
    out = F.regexp_replace(F.regexp_replace(col(c), "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^[ \t\n]+|[ \t\n]+\z", "")


def excerpt(c: Text, most: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(col(c), r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def snippet(text: Text, needle: Text, radius: int = 40) -> Column:
    """What stands around the first find of needle, with ellipses where it is cut; null without a find."""
    t, n = col(text), col(needle)
    at = F.instr(F.lower(t), F.lower(n))
    start, end = F.greatest(at - radius, F.lit(1)), F.least(at + F.length(n) + radius, F.length(t) + 1)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(t, start, end - start), F.when(end <= F.length(t), "…").otherwise(""))
    return F.when((at > 0) & (F.length(n) > 0), cut)


def topic_name(c: Text) -> Column:
    """Lower case with only letters and digits left. Each letter by itself: a sigma is the same at a word's end."""
    return F.regexp_replace(F.lower(F.translate(F.trim(col(c)), "Σ", "σ")), r"[^\p{L}\p{N}]+", "")


#: Letters that have a capital of one character, though their upper case is spelled with two.
_GREEK = [g + i for g in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)]
_LONG = ["ß", *map(chr, _GREEK), "ᾳ", "ῃ", "ῳ"]
_CAPITAL = ["ẞ", *(chr(g + 8) for g in _GREEK), "ᾼ", "ῌ", "ῼ"]


def initial(c: Text) -> Column:
    """The first character as a capital, always one character: what has no capital of its own stays as it is."""
    first = F.substring(col(c), 1, 1)
    return F.when(F.length(F.upper(first)) < 2, F.upper(first)).otherwise(F.translate(first, "".join(_LONG), "".join(_CAPITAL)))


def keywords(c: Text, stop: list[str]) -> Column:
    """Word runs of two characters and more (or CJK), first seen first, without stop words."""
    own = F.filter(F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0)), lambda w: ((F.length(w) > 1) | w.rlike(CJK)) & ~F.lower(w).isin(stop))
    return F.array_distinct(own)


def source_id(path: Text) -> Column:
    """Relative path without suffix, folders joined by two underscores."""
    return F.replace(F.regexp_replace(F.regexp_replace(col(path), r"^/+", ""), r"\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def directory(path: Text) -> Column:
    own = F.regexp_extract(F.concat(F.lit("/"), F.regexp_replace(col(path), r"^/+", "")), r"^(.*)/[^/]*$", 1)
    return F.when(own == "", "/").otherwise(own)


def sanitise_filename(c: Text) -> Column:
    """Each character that a file name can't hold as an underscore, without white space at both ends."""
    clean = strip(F.regexp_replace(col(c), r'[/\\:*?"<>|]', "_"))
    return F.when(clean == "", "unnamed").otherwise(clean)


def link(page: Column, label: Column) -> Column:
    return F.concat(F.lit("[["), page, F.lit("|"), label, F.lit("]]"))


def source_link(source_id: Text, title: Text | None = None) -> Column:
    """Link to a source's page, under its title or else its id."""
    label = col(source_id) if title is None else F.coalesce(F.nullif(col(title), F.lit("")), col(source_id))
    return link(F.concat(F.lit("source-"), sanitise_filename(source_id)), label)


def entity_link(subject: Text) -> Column:
    return link(sanitise_filename(subject), col(subject))


def chunk_page(source_id: Text, chunk_index: Text) -> Column:
    return F.concat(F.lit("chunk-"), sanitise_filename(source_id), F.lit("-"), col(chunk_index))


def page_path(folder: Text, slug: Text) -> Column:
    """Folder and slug without unsafe characters; each level of the folder by itself."""
    levels = F.filter(F.split(F.replace(col(folder), F.lit("\\"), F.lit("/")), "/"), lambda x: strip(x) != "")
    return F.concat(F.when(F.size(levels) > 0, F.array_join(F.transform(levels, sanitise_filename), "/")).otherwise("未分类"), F.lit("/"), sanitise_filename(slug))


def topic_link(hub: Text, leaf: Text | None = None) -> Column:
    """Link to a hub's index, or to the page of one of its leaves."""
    page = F.lit("_index") if leaf is None else sanitise_filename(leaf)
    return link(F.concat(sanitise_filename(hub), F.lit("/"), page), col(hub) if leaf is None else col(leaf))


def strip_citations(c: Text) -> Column:
    """Inline citation marks and footnotes removed, blanks before punctuation tidied."""
    out = F.regexp_replace(F.regexp_replace(col(c), r"\[\^?[0-9]+\]", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r" ([.,;:!?])", "$1"))


def valid_at(as_of: Column, strict_active: bool = False) -> Column:
    """Whether a claim holds at a time, half-open; without a time, whether it is active."""
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (as_of < F.col("valid_to")))
    held = F.when(as_of.isNull(), F.col("status") == "active").otherwise(inside)
    return held & (F.col("status") == "active") if strict_active else held
