"""Operator 3: secrets in texts, confirmed by their structure.

Plain patterns find assignments, access ids and hex runs. Beyond them, base64 and hex candidates are decoded, and a
span is reported only if the bytes are what a secret consists of: a DER private key whose nested lengths fit exactly,
an OpenSSH key whose length-prefixed fields do, or a signed token whose header names a signing algorithm.

All expressions are linear in the length of the text. So is the search for keys in lines: a head's nested lengths are
followed on the encoded lines, a few bytes at a time, and lines are joined and decoded only if they all fit.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import by_row, key_type, pick, table

#: Kinds in the order of spans that start together; the first three are the plain patterns.
KINDS = ("assign", "access", "hex", "pem", "key", "token")
BASE = KINDS[:3]

# Fixed values of the contract: the three plain patterns and the least lengths of what they must hold.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGNED, ACCESS = 6, 20

_ARMOR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{32,}")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_DOTTED = re.compile(r"[A-Za-z0-9_-]+")
#: Lines of base64 or hex below each other.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{32,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+={0,2})+", re.ASCII)
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
_OPENSSH = "b3BlbnNzaC1rZXktdjEA"
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> Iterator[Span]:
    """Leftmost matches per kind that do not overlap; a match that is too short is dropped, with what it covers."""
    lower = text.encode().lower()  # bytes: A-Z only
    if any(word in lower for word in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGNED:
                yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= ACCESS:
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


# --- structures -----------------------------------------------------------------------------------------------------


class _Wrapped:
    """The bytes of encoded lines of one width, decoded where they are looked at."""

    def __init__(self, lines: list[tuple[int, str]], first: int, size: int, hexed: bool):
        self.lines, self.first, self.size, self.hexed = lines, first, size, hexed
        self.width = len(lines[first][1])

    def __len__(self) -> int:
        return self.size

    def _chars(self, start: int, end: int) -> str:
        low, high = start // self.width, (end - 1) // self.width
        text = "".join(x for _, x in self.lines[self.first + low : self.first + high + 1])
        return text[start - low * self.width : end - low * self.width]

    def __getitem__(self, at: int | slice) -> int | bytes:
        start, end, _ = at.indices(self.size) if isinstance(at, slice) else (at, at + 1, 1)
        if self.hexed:
            got = bytes.fromhex(self._chars(2 * start, 2 * end))
        else:
            got = (_decoded(self._chars(start // 3 * 4, -(-end // 3) * 4)) or b"")[start % 3 :][: end - start]
        return got if isinstance(at, slice) else got[0]


def _items(data: bytes | _Wrapped, start: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the DER elements between `start` and `end`; None unless at most so many fill it exactly."""
    found = []
    while start < end:
        if end - start < 2 or len(found) == most:
            return None
        head = data[start : start + 6]
        tag, size, at = head[0], head[1], start + 2
        if size >= 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            size, at = int.from_bytes(head[2 : 2 + count]), at + count
            if size < 0x80:
                return None  # DER takes the short form there
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        start = at + size
    return found


def is_der_key(data: bytes | _Wrapped) -> bool:
    """A private key: PKCS#1, DSA, SEC1, PKCS#8, or encrypted PKCS#8. Public keys and certificates are not secret.

    Reads heads of elements only, a bounded number of them whatever the length.
    """
    outer = _items(data, 0, len(data), 1)
    if not outer or outer[0][0] != 0x30:
        return False
    parts = _items(data, *outer[0][1:], 9)
    if not parts:
        return False
    tags, sizes = [p[0] for p in parts], [b - a for _, a, b in parts]
    version = data[parts[0][1]] if sizes[0] == 1 else None
    if tags in ([0x02] * 9, [0x02] * 6):
        return version == 0 and min(sizes) >= 1 and sizes[1] >= 32
    if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:
        return version == 1 and sizes[1] >= 16
    if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x80, 0x81}:
        # An algorithm is an identifier and its parameters.
        algorithm, inner = _items(data, *parts[1][1:], 2), _items(data, *parts[2][1:], 1)
        return version in (0, 1) and bool(algorithm) and algorithm[0][0] == 0x06 and bool(inner)
    if tags == [0x30, 0x04]:
        scheme = _items(data, *parts[0][1:], 2)
        return bool(scheme) and [t for t, _, _ in scheme] == [0x06, 0x30] and sizes[1] >= 16 and sizes[1] % 8 == 0
    return False


def is_openssh_key(data: bytes) -> bool:
    """The magic string, then length-prefixed cipher, key derivation, options, public keys and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, count = len(magic), -1
    for field in range(5):
        if field == 3:
            count, at = int.from_bytes(data[at : at + 4]), at + 4
            if not 1 <= count <= 16:
                return False
            for _ in range(count):
                at += 4 + int.from_bytes(data[at : at + 4])
        elif at + 4 > len(data):
            return False
        else:
            size = int.from_bytes(data[at : at + 4])
            at += 4 + size
            if field == 4:
                return at == len(data) and size >= 32
        if at > len(data):
            return False
    return False


def _decoded(text: str) -> bytes | None:
    text = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def _object(part: str) -> dict | None:
    try:
        value = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """A JSON header that names a signing algorithm, a JSON payload, and a signature of a plausible length."""
    head = _object(header) if header.startswith("ey") else None
    if not head or not isinstance(head.get("alg"), str) or head["alg"].lower() in ("", "none"):
        return False
    return _object(payload) is not None and len(_decoded(signature) or b"") >= 16


def _armored(text: str) -> Iterator[Span]:
    begin = None
    for m in _ARMOR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            lines = text[begin.end() : m.start()].replace("\\r", "").replace("\\n", "\n").split("\n")
            body = "".join("".join(x.split()) for x in lines if ":" not in x)
            data = _decoded(body)
            locked = any("ENCRYPTED" in x for x in lines if ":" in x)
            if is_key(data) or locked and data and len(data) >= 64 and len(data) % 8 == 0:
                yield "pem", begin.start(), m.end()
            begin = None


def _der_size(head: bytes | None) -> int:
    """Bytes of the DER sequence that begins so; 0 for none."""
    if not head or len(head) < 6 or head[0] != 0x30:
        return 0
    count = head[1] & 0x7F if head[1] >= 0x80 else 0
    return 2 + count + int.from_bytes(head[2 : 2 + count]) if 1 <= count <= 4 else 2 + head[1] if head[1] < 0x80 else 0


def _wrapped(text: str) -> Iterator[Span]:
    """Keys without armour in lines of one width; the last line may be shorter. A DER key's head says where it ends."""
    for block in _LINES.finditer(text):
        lines = [(m.start(), m[0]) for m in _LINE.finditer(text, block.start(), block.end())]
        # The first line after i whose width is not that of line i.
        other = [len(lines)] * len(lines)
        for i in range(len(lines) - 2, -1, -1):
            other[i] = other[i + 1] if len(lines[i][1]) == len(lines[i + 1][1]) else i + 1
        # The first line from i on that is padded, and the first one that is not hex.
        padded, plain = [len(lines)] * (len(lines) + 1), [len(lines)] * (len(lines) + 1)
        for i in range(len(lines) - 1, -1, -1):
            padded[i] = i if "=" in lines[i][1] else padded[i + 1]
            plain[i] = plain[i + 1] if _HEX_ONLY.fullmatch(lines[i][1]) else i
        i = 0
        while i < len(lines) - 1:
            start, first = lines[i]
            width, ends, hexed = len(first), [], False
            if width >= 32 and first.startswith(_OPENSSH):
                # Up to the first line that is not full; else full lines alone, up to the next key.
                again = next((k for k in range(i + 1, other[i]) if lines[k][1].startswith(_OPENSSH) or "=" in lines[k - 1][1]), other[i])
                short = again == other[i] < len(lines) and len(lines[again][1]) < width
                ends = [again + 1, again] if short else [again]
            elif width >= 32 and first.startswith(("M", "30")):
                hexed = first.startswith("30") and bool(_HEX_ONLY.fullmatch(first)) and width % 2 == 0
                size = _der_size(bytes.fromhex(first[:32]) if hexed else _decoded(first[:32]))
                chars = 2 * size if hexed else -(-size * 4 // 3)
                last = i + -(-chars // width) - 1
                fits = i < last < len(lines) and other[i] >= last and len(lines[last][1].rstrip("=")) == chars - (last - i) * width
                if fits and (plain[i] > last if hexed else padded[i] >= last) and is_der_key(_Wrapped(lines, i, size, hexed)):
                    ends = [last + 1]
            for end in ends:
                if end <= i + 1:
                    continue
                value = "".join(x for _, x in lines[i:end])
                if not hexed:
                    data = _decoded(value)
                else:
                    data = bytes.fromhex(value) if _HEX_ONLY.fullmatch(value) and len(value) % 2 == 0 else None
                if is_key(data):
                    yield "key", start, lines[end - 1][0] + len(lines[end - 1][1])
                    i = end - 1
                    break
            i += 1


def confirmed_spans(text: str) -> Iterator[Span]:
    """Spans whose decoded bytes have the structure of a secret."""
    armored = list(_armored(text)) if "PRIVATE KEY-----" in text else []
    yield from armored
    # The lines of an armoured key are that key.
    yield from (x for x in _wrapped(text) if not any(a <= x[1] and x[2] <= b for _, a, b in armored))
    for run in _RUN.finditer(text):
        start, value = run.start(), run.group()
        if value.count(".") >= 2 and "ey" in value:
            parts = list(_DOTTED.finditer(value))
            for a, b, c in zip(parts, parts[1:], parts[2:]):
                if value[a.end() : b.start()] == value[b.end() : c.start()] == "." and is_signed_token(a[0], b[0], c[0]):
                    yield "token", start + a.start(), start + c.end()
        for m in _ENCODED.finditer(value):
            # A DER sequence begins with M in base64, an OpenSSH key with its magic string.
            if m.end() - m.start() >= 32 and value.startswith(("M", _OPENSSH), m.start()) and is_key(_decoded(m[0])):
                yield "key", start + m.start(), start + m.end()
    for m in _HEX_KEY.finditer(text):
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            yield "key", m.start(), m.end()


def spans(text: str) -> list[Span]:
    """All spans by start, then by the order of KINDS; code points, end exclusive."""
    found = {*base_spans(text), *confirmed_spans(text)}
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- on DataFrames --------------------------------------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): every span of every whole text, each with kind, start and end.

    Null and empty texts have an empty list. Spans of different kinds may overlap; equal spans of a kind appear once.
    Repeated rows and keys give one row each, a null key stays null, other columns are ignored.
    """
    rows = pick(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    schema = pa.schema([("key", key_type(rows)), ("spans", _SPANS)])

    def found(value: str) -> tuple[list[dict]]:
        return ([{"kind": k, "start": a, "end": b} for k, a, b in spans(value)],)

    return rows.mapInArrow(by_row(found, schema), f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)


def redacted(text: str, marker: str = "[secret]") -> str:
    """The text with every maximal group of overlapping spans replaced by one marker."""
    merged: list[list[int]] = []
    for _, start, end in spans(text):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        out += [text[at:start], marker]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", marker: str = "[secret]") -> DataFrame:
    """`docs` with secrets replaced in the text column; all columns and rows stay, a null text stays null.

    Only the text itself goes through Python; the other columns stay in the engine.
    """

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if (t := x.as_py()) is None else redacted(t, marker) for x in batch], pa.string())

    clean.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(text, F.arrow_udf(clean, "string")(F.col(f"`{text}`").cast("string")))


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Digest columns from the spans, in the engine."""
    found = find_secrets(table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans")
    )
