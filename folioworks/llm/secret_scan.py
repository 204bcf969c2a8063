"""Secrets in texts: patterns, and structures that decoded candidates must have.

Patterns give the base spans: assignments to telling names, access identifiers and long hexadecimal runs. Runs in the
alphabets of base64 and hexadecimal are candidates besides: they are decoded, and reported only if the bytes parse from
the first to the last: DER keys (PKCS#1, PKCS#8, encrypted PKCS#8, SEC1) whose nested lengths add up, OpenSSH private keys
whose counted strings do, and signed tokens whose header is JSON with a known algorithm and whose signature has the
length that this algorithm gives. Text that was encoded once more (a key file or token inside base64) is decoded twice.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sliced

# What base spans look like, and the least length of the part that counts.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")  # 18 in all; no shorter run can hold a longer match
HEX = re.compile(rb"[0-9a-f]{16,}")
#: Kinds in the order that spans of one start take.
KINDS = ("assign", "access", "hex", "key", "token")

#: A first line of base64 that is long enough for the shortest key, and the lines that may follow it.
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{24,}={0,2}")
_NEXT_LINE = re.compile(rb"(?:\r?\n|\\r\\n|\\n)[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]{48,}")
#: From the start of a run, and without going back inside it: a long run costs its length once.
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{40,}")
# First bytes of an OpenSSH private key, and signature lengths in bytes by algorithm (of RSA the least).
_OPENSSH = b"openssh-key-v1\x00"
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
    "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024), "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
}
# Object identifiers of RSA keys and of encryption by password.
_RSA = bytes.fromhex("2a864886f70d010101")
_PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
DEPTH = 2
MOST_KEY_BYTES = 1 << 16  # of one key; the largest RSA keys in use have about 10,000


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and last place of the DER value at a place, or None where its length is not canonical or passes the end."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if size < 0x80 or size >> (8 * (width - 1)) == 0:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill a stretch exactly."""
    found = []
    while at < end:
        value = _header(data, at, end)
        if value is None:
            return None
        found.append(value)
        at = value[2]
    return found


def _number(data: bytes, value: tuple[int, int, int]) -> int | None:
    return int.from_bytes(data[value[1] : value[2]], "big", signed=True) if value[0] == _INTEGER and value[1] < value[2] else None


def der_key(data: bytes) -> int:
    """The length of the private key that data begins with, by its nested lengths; 0 if it is none."""
    top = _header(data, 0, len(data))
    if top is None or top[0] != _SEQUENCE:
        return 0
    parts = _children(data, top[1], top[2])
    if not parts:
        return 0
    tags = [t for t, _, _ in parts]
    version = _number(data, parts[0])
    if version in (0, 1) and tags[:9] == [_INTEGER] * 9 and len(tags) <= 10:  # PKCS#1: version and eight numbers
        numbers = [_number(data, p) for p in parts[1:9]]
        n, _, _, p, q = numbers[:5]
        return top[2] if None not in numbers and p * q == n else 0
    if version in (0, 1) and tags[1:3] == [_SEQUENCE, _OCTETS] and parts[2][1] < parts[2][2]:  # PKCS#8
        scheme, inner = _algorithm(data, parts[1]), data[parts[2][1] : parts[2][2]]
        whole = scheme is not None and (scheme != _RSA or der_key(inner) == len(inner))
        return top[2] if whole and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) else 0
    if version == 1 and tags[1:2] == [_OCTETS] and 16 <= parts[1][2] - parts[1][1] <= 66 and len(tags) > 2:  # SEC1
        inner = [_children(data, a, b) for t, a, b in parts[2:] if t in (0xA0, 0xA1)]
        return top[2] if len(inner) == len(tags) - 2 and all(inner) and any(x[0][0] == _OID for x in inner) else 0
    if tags == [_SEQUENCE, _OCTETS] and parts[1][1] < parts[1][2]:  # encrypted PKCS#8: by a password scheme
        return top[2] if (_algorithm(data, parts[0]) or b"").startswith(_PASSWORD_SCHEMES) else 0
    return 0


def _algorithm(data: bytes, value: tuple[int, int, int]) -> bytes | None:
    """The object identifier that an algorithm begins with."""
    parts = _children(data, value[1], value[2])
    return data[parts[0][1] : parts[0][2]] if parts and parts[0][0] == _OID and parts[0][1] < parts[0][2] else None


def openssh_key(data: bytes) -> int:
    """The length of the OpenSSH private key that data begins with, by its counted strings; 0 if it is none."""
    if not data.startswith(_OPENSSH):
        return 0
    at, names = len(_OPENSSH), []

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):  # cipher, key derivation and its options
        names.append(string())
    if None in names or not names[0].isascii() or not names[1].isascii() or not names[0] or at + 4 > len(data):
        return 0
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16:
        return 0
    public = [string() for _ in range(count)]
    private = string()
    if None in public or not private:
        return 0
    if any(int.from_bytes(p[:4], "big") + 4 > len(p) or not p[4:8] for p in public):  # each begins with the counted name of its type
        return 0
    if names[0] == b"none" and (len(private) % 8 or private[:4] != private[4:8]):
        return 0
    return at


def signed_token(token: bytes) -> bool:
    """header.payload.signature with a JSON header that names an algorithm, and a signature as long as this gives."""
    try:
        header, payload, signature = (base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4)) for p in token.split(b"."))
        named = json.loads(header)
        least, most = SIGNATURES[named["alg"]]
        return isinstance(named, dict) and isinstance(json.loads(payload), dict) and least <= len(signature) <= most
    except (ValueError, KeyError, TypeError, RecursionError):
        return False


def _decoded(chars: bytes) -> bytes:
    plain = chars.translate(bytes.maketrans(b"-_", b"+/")).rstrip(b"=")
    plain = plain[: len(plain) - (len(plain) % 4 == 1)]
    try:
        return base64.b64decode(plain + b"=" * (-len(plain) % 4))
    except binascii.Error:
        return b""


def _key_length(data: bytes) -> int:
    return der_key(data) or openssh_key(data)


def _encoded_key(text: bytes, run: re.Match, depth: int) -> tuple[int, int] | None:
    """Start and end of the key, or of the text with secrets, that a base64 run encodes with the lines that follow it; None if it has none."""
    start = run.start() + (run[0][:1] in (b"n", b"r") and text[run.start() - 1 : run.start()] == b"\\")  # a line break that is written out
    first = text[start : run.end()]
    head = _decoded(first[:64])
    if head[:1] == b"\x30" or head.startswith(_OPENSSH):
        need = (_der_size(head) if head[:1] == b"\x30" else MOST_KEY_BYTES) * 4 // 3 + 4
        parts, at = [(start, first.rstrip(b"=")[:need])], run.end()
        have = len(parts[0][1])
        while have < need and text[at - 1 : at] != b"=" and (line := _NEXT_LINE.match(text, at)):
            parts.append((line.start(1), line[1].rstrip(b"=")))
            have, at = have + len(parts[-1][1]), line.end()
        size = _key_length(_decoded(b"".join(chars for _, chars in parts)))
        left = total = (size * 4 + 2) // 3  # characters that hold these bytes
        for place, chars in parts if size else ():
            if left <= len(chars):
                end = place + left
                padding = re.compile(rb"=*").match(text, end, end + -total % 4)
                return start, padding.end()
            left -= len(chars)
    if depth and head.isascii() and (head.startswith(b"-----BEGIN") or _TOKEN_HEAD.match(head)):
        if any(True for _ in structures(_decoded(first), depth - 1)):
            return start, run.end()
    return None


_TOKEN_HEAD = re.compile(rb"[A-Za-z0-9_-]{16,}")


def _der_size(head: bytes) -> int:
    """Bytes that the DER value with this head takes in all."""
    size, width = head[1] if len(head) > 1 else 0, 0
    if size >= 0x80:
        width = size & 0x7F
        size = int.from_bytes(head[2 : 2 + min(width, 4)], "big")
    return min(2 + width + size, MOST_KEY_BYTES)


def structures(text: bytes, depth: int = DEPTH) -> Iterator[tuple[int, int, str]]:
    """start, end and kind (key or token) of what decodes to a structure; places are bytes, none overlap."""
    after = 0
    found: list[tuple[int, int, str]] = [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if signed_token(m[0])]
    for run in _RUN.finditer(text):
        if run.start() >= after and (place := _encoded_key(text, run, depth)) is not None:
            found.append((*place, "key"))
            after = place[1]
    for run in _HEX_RUN.finditer(text):
        even = run[0][: len(run[0]) // 2 * 2]
        if size := _key_length(bytes.fromhex(even.decode())):
            found.append((run.start(), run.start() + 2 * size, "key"))
    last = 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= last:
            yield start, end, kind
            last = end


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """start, end and kind of the pattern matches, in bytes; each kind is searched from left to right without overlaps."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Places as code points, ordered by start and then by kind."""
    if spans and not text.isascii():
        starts = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
        places = np.concatenate([[0], np.cumsum(starts)])
        spans = [(int(places[a]), int(places[b]), k) for a, b, k in spans]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(text: bytes) -> list[tuple[int, int, str]]:
    """All spans of a UTF-8 text: start, end (exclusive) in code points, kind."""
    return _code_points(text, base_spans(text) + list(structures(text)))


def line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_key long, n_token long, base_sha256 string, spans string"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            spans = find_secrets(text or b"")
            counts = [sum(kind == k for _, _, kind in spans) for k in KINDS]
            rows.append((*counts, hashlib.sha256(line([s for s in spans if s[2] in KINDS[:3]]).encode()).hexdigest(), line(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in _FOUND.split(", ")])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the number of spans of each kind, base_sha256 (of the pattern spans), spans (all).

    A span is kind:start:end in code points, end exclusive; spans are ordered by start and kind and joined by commas. A null
    or empty text has none. Kinds may overlap each other. Repeated rows and null identifiers come out as they are; a very
    long text is searched whole by one task. Extra columns are not read; an empty table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scanned, _FOUND)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = []
        for raw in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
            if raw is None:
                texts.append(None)
                continue
            out, at = [], 0
            for start, end, kind in sorted(base_spans(raw) + list(structures(raw))):
                if start >= at:
                    out += [raw[at:start], b"[", kind.encode(), b"]"]
                at = max(at, end)
            texts.append(b"".join([*out, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with [kind] in place of each span; of spans that overlap the first one's kind stands for all. Null texts stay null."""
    rest = [c for c in docs.columns if c != text_col]
    given = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"))
    return given.mapInArrow(_redacted, given.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
