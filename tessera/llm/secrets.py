"""Secrets in texts: three plain patterns, and encoded candidates that must decode to a key or token before they count.

The patterns (assign, access, hex) are reported as found. Every base64 or hex run of some length is a candidate: it is decoded,
and reported only if the bytes are built like a secret to the last one. Kinds:

key     a private key: DER (PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA, PKCS#12) whose nested lengths fill one another
        exactly, an OpenSSH key with its counted strings, or a chain of OpenPGP packets that starts with a secret key
token   three dot-joined base64url parts: a JSON header that names a signing algorithm, a JSON object, and a
        signature of that algorithm's size
nested  text that holds a finding of its own (assign, access, key or token)

Public keys, certificates, digests, images and chance runs fail this and are left alone. A base64 candidate may be wrapped into lines
of equal width (also with line breaks written as \\n); hex may have colons between bytes. A decoded text is searched in turn, DEPTH levels deep.

Whole texts are read, of any length, in time about linear in it. Null and empty texts have no spans. Spans may overlap across
kinds, never within one; they come by start, then by kind as listed, as code point offsets with the end exclusive. Repeated rows, null
ids and extra columns (one named `spans` too) are kept as they are: each row of the input gives one row. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm.common import by_bytes, byte_strings, focus, fresh

KINDS = ("assign", "access", "hex", "key", "token", "nested")
DEPTH = 3
#: Sizes in bytes of signatures by algorithm (RFC 7518, RFC 8037); RSA's are those of the key.
_RSA = frozenset((128, 256, 384, 512, 1024))
SIGNATURES = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}} | {a + n: _RSA for a in ("RS", "PS") for n in ("256", "384", "512")}

# All patterns are ASCII, so UTF-8 bytes are searched; ignored case is then A-Z alone.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:(?:\r?\n|\\n|\\r\\n)[A-Za-z0-9+/_-]+)*={0,2}")
BREAK = re.compile(rb"\r?\n|\\n|\\r\\n")
BYTES = re.compile(rb"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{48,}|[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){23,})(?![0-9A-Fa-f:])")
TOKEN = re.compile(rb"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
URL_SAFE = bytes.maketrans(b"-_", b"+/")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base64_bytes(run: bytes) -> bytes | None:
    """What a base64 run in either alphabet, padded or not, stands for."""
    run = run.rstrip(b"=").translate(URL_SAFE)
    if len(run) % 4 == 1:
        return None
    return base64.b64decode(run + b"=" * (-len(run) % 4))


# ---- structures


class Malformed(Exception):
    """The bytes are not built as their first ones say."""


def der(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    """tag, start and end of each value between start and end, which they must fill exactly, with lengths in their shortest form."""
    out = []
    while start < end:
        if end - start < 2:
            raise Malformed
        tag, size, at = data[start], data[start + 1], start + 2
        if tag & 31 == 31 or size == 128:
            raise Malformed
        if size > 128:
            n = size - 128
            if n > 8 or at + n > end or data[at] == 0:
                raise Malformed
            size, at = int.from_bytes(data[at : at + n]), at + n
            if size < 128:
                raise Malformed
        if at + size > end:
            raise Malformed
        out.append((tag, at, at + size))
        start = at + size
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
# Object identifiers' first bytes (PKCS#5 and PKCS#12 encryption, PKCS#7 data and signed data).
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
PKCS7 = (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702"))


def private_der(data: bytes) -> bool:
    """One DER value that is a private key (or a PKCS#12 store of keys)."""
    try:
        outer = der(data, 0, len(data))
        if len(outer) != 1 or outer[0][0] != SEQUENCE:
            return False
        parts = der(data, *outer[0][1:])
        tags = [t for t, _, _ in parts]
        first = data[parts[0][1] : parts[0][2]] if parts else b""
        if tags[:1] == [INTEGER] and len(first) == 1:
            version = first[0]
            if len(tags) >= 9 and set(tags[:9]) == {INTEGER} and version <= 1:  # modulus = prime * prime
                n, p, q = (int.from_bytes(data[a:b]) for _, a, b in (parts[1], parts[4], parts[5]))
                return n > 0 and n == p * q
            if tags == [INTEGER] * 6 and version == 0:  # DSA: p, q, g, public, secret
                return all(b > a for _, a, b in parts)
            if tags[1:3] == [SEQUENCE, OCTETS] and version <= 1 and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
                method, inner = der(data, *parts[1][1:]), parts[2]
                return bool(method) and method[0][0] == OID and inner[2] - inner[1] >= 16 and (data[inner[1]] not in (SEQUENCE, OCTETS) or len(der(data, *inner[1:])) == 1)
            if tags[1:2] == [OCTETS] and version == 1 and set(tags[2:]) <= {0xA0, 0xA1}:
                wrapped = [der(data, a, b) for _, a, b in parts[2:]]
                return 16 <= parts[1][2] - parts[1][1] <= 66 and all(len(w) == 1 for w in wrapped)
            if tags[1:2] == [SEQUENCE] and version == 3:
                content = der(data, *parts[1][1:])
                return bool(content) and content[0][0] == OID and data[content[0][1] : content[0][2]] in PKCS7
        if tags == [SEQUENCE, OCTETS]:
            method = der(data, *parts[0][1:])
            return bool(method) and method[0][0] == OID and data[method[0][1] : method[0][2]].startswith(ENCRYPTION) and parts[1][2] > parts[1][1]
    except Malformed:
        pass
    return False


OPENSSH = b"openssh-key-v1\0"


def private_openssh(data: bytes) -> bool:
    """The counted strings of an OpenSSH private key: cipher, function, options, public keys, then the secret part."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def string() -> bytes:
        nonlocal at
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            raise Malformed
        at += 4 + size
        return data[at - size : at]

    try:
        cipher, function, _ = string(), string(), string()
        keys = int.from_bytes(data[at : at + 4])
        at += 4
        if not cipher or not function or not 1 <= keys <= 16:
            return False
        for _ in range(keys):
            string()
        secret = string()
        return at == len(data) and len(secret) >= 8 and len(secret) % 8 == 0 and (cipher != b"none" or secret[:4] == secret[4:8])
    except Malformed:
        return False


def private_pgp(data: bytes) -> bool:
    """OpenPGP packets that fill the data, the first one a secret key of a known version."""
    at, first = 0, True
    while at < len(data):
        head = data[at]
        if not head & 128 or at + 2 > len(data):
            return False
        if head & 64:
            tag, size, at = head & 63, data[at + 1], at + 2
            if 192 <= size < 224:
                size, at = (size - 192 << 8) + data[at] + 192 if at < len(data) else len(data), at + 1
            elif size == 255:
                size, at = int.from_bytes(data[at : at + 4]), at + 4
            elif size >= 224:
                return False
        else:
            tag, width = head >> 2 & 15, 1 << (head & 3)
            if width == 8:
                return False
            size, at = int.from_bytes(data[at + 1 : at + 1 + width]), at + 1 + width
        if size < 1 or at + size > len(data) or first and (tag != 5 or data[at] not in (3, 4, 5, 6) or size < 24):
            return False
        at, first = at + size, False
    return not first


def is_key(data: bytes) -> bool:
    if data[:1] == b"\x30":
        return private_der(data)
    return private_openssh(data) if data[:1] == b"o" else bool(data[:1]) and data[0] & 128 != 0 and private_pgp(data)


def is_token(run: bytes) -> bool:
    """header.body.signature, as the header's algorithm wants them."""
    parts = [base64_bytes(p) for p in run.split(b".")]
    if None in parts:
        return False
    try:
        header, body = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(body, dict) and isinstance(alg := header.get("alg"), str) and len(parts[2]) in SIGNATURES.get(alg, ())


def is_text(data: bytes) -> bool:
    try:
        return len(data) >= 8 and not any(c < " " and c not in "\t\n\r" or c == "\x7f" for c in data.decode("utf-8"))
    except UnicodeDecodeError:
        return False


# ---- search


def wrapped(text: bytes, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """Ways to read a base64 match: lines of one width with a last one of no more, then each long line alone."""
    lines, at = [], start
    for m in BREAK.finditer(text, start, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    i = 0
    while i < len(lines):
        a, b = lines[i]
        j = i + 1
        while j < len(lines) and lines[j - 1][1] - lines[j - 1][0] == b - a and lines[j][1] - lines[j][0] <= b - a:
            j += 1
        if j > i + 1:
            yield a, lines[j - 1][1], b"".join(text[c:d] for c, d in lines[i:j])
        for c, d in lines[i:j]:
            if d - c >= 32:
                yield c, d, text[c:d]
        i = j


def meaning(data: bytes, depth: int) -> str | None:
    """The kind that decoded bytes are confirmed as."""
    if is_key(data):
        return "key"
    if depth and is_text(data) and any(k != 2 for _, k, _ in spans(data, depth - 1)):  # digests alone tell nothing
        return "nested"
    return None


def spans(text: bytes, depth: int = DEPTH) -> list[Span]:
    """All findings, as byte offsets in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found: list[tuple[int, int, str]] = [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if is_token(m[0])]
    for m in BYTES.finditer(text):
        run = m[0].replace(b":", b"")
        if len(run) % 2 == 0 and (kind := meaning(binascii.unhexlify(run), depth)):
            found.append((*m.span(), kind))
    for m in BASE64.finditer(text):
        done = m.start()
        for a, b, run in wrapped(text, *m.span()):
            if a >= done and (data := base64_bytes(run)) is not None and (kind := meaning(data, depth)):
                found.append((a, done := b, kind))
    ends = dict.fromkeys(KINDS, 0)
    for a, b, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if a >= ends[kind]:
            out.append((a, KINDS.index(kind), b))
            ends[kind] = b
    return sorted(out)


def code_points(text: bytes, found: list[Span]) -> list[Span]:
    """The same with code point offsets."""
    place, n, last = {}, 0, 0
    for at in sorted({x for a, _, b in found for x in (a, b)}):
        n += len(text[last:at].decode("utf-8", "replace"))
        place[at], last = n, at
    return [(place[a], k, place[b]) for a, k, b in found]


def _per_slice(work: Callable[[list[bytes | None]], pa.Array], out: str) -> Callable:
    """Batches whose first column is the text, which work turns into another column; the others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("secrets")
        for batch in batches:
            at = 0
            for texts in by_bytes(batch.column(0)):
                rest = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], work(byte_strings(texts))], [*rest.schema.names[1:], out])

    return run


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPAN_TYPE = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs but the text, and spans: array<struct<kind, start, end>>."""

    def work(texts: list[bytes | None]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in code_points(t, spans(t))] if t else [] for t in texts], SPANS)

    text, = fresh(docs.drop(text_col), "text")
    rows = docs.select(docs[text_col].alias(text), *[docs[c] for c in docs.columns if c.lower() != text_col.lower()])
    rest = rows.drop(text)
    out, = fresh(rest, "spans")
    return rows.mapInArrow(_per_slice(work, out), StructType([*rest.schema, StructField(out, SPAN_TYPE)]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the texts' findings replaced by their kind in angle brackets (overlapping ones by the first one's); nulls stay null."""

    def one(t: bytes | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for a, k, b in spans(t):
            if a >= at:
                out += [t[at:a], b"<" + KINDS[k].encode() + b">"]
            at = max(at, b)
        return b"".join([*out, t[at:]]).decode("utf-8", "replace")

    rest = [c for c in docs.columns if c.lower() != text_col.lower()]
    rows = docs.select(docs[text_col], *[docs[c] for c in rest])
    schema = StructType([*rows.drop(text_col).schema, StructField(text_col, StringType())])
    return rows.mapInArrow(_per_slice(lambda texts: pa.array([one(t) for t in texts], pa.string()), text_col), schema).select(*docs.columns)


def count(found: Column | str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
