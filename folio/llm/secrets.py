"""Secret scans with structural confirmation.

Base spans come from three patterns (assignments, access keys, hex runs).  The method adds spans of candidates whose
inside has been decoded and parsed to the last byte before they are reported:

* ``der``: a base64 or hex run that decodes to one ASN.1 SEQUENCE whose length, and every nested length, ends where its
  parent ends, and which has the fields of a private key (version, then algorithm or integers: nine of RSA, six of DSA);
* ``jwt``: three dot-joined base64url parts, the last not empty, whose header is a JSON object with a string ``alg`` other than ``none`` (and whose
  payload is a JSON object, unless the header says it is encrypted or compressed);
* ``pem``: a ``BEGIN ... PRIVATE KEY`` block whose body decodes to such a sequence, or to an OpenSSH key, or base64 of such a block;
* ``ssh``: a base64 run that is an ``openssh-key-v1`` container with its counts and nested lengths.

Positions are code points, the end exclusive.  A row is handled alone: no shuffle, memory of one Arrow batch.

Defined cases: null text counts as empty; no spans give an empty list (joined: the empty string); repeated rows are
scanned each; ids may be null; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "der", "jwt", "pem", "ssh")

_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:[\r\n]+[A-Za-z-]+: [^\r\n]*)*([A-Za-z0-9+/=\s\\]+?)-----END \1PRIVATE KEY-----")
#: What follows an escaped line feed begins anew, although a letter precedes it.
_RUN = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{30,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
#: A header's first character holds the upper bits of a brace (e), or of JSON's blanks before it (C, D, I).
_JWT = re.compile(r"(?:(?<![A-Za-z0-9_.-])|(?<=\\[nrt]))([CDIe][A-Za-z0-9_-]{9,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*)?(?![A-Za-z0-9_-])")


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not, blanks and their escapes left out; None if it is neither."""
    body = re.sub(r"\\+[nrt]?|\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content at ``at``; None if the length doesn't fit or isn't in shortest form."""
    if at + 2 > end:
        return None
    tag, n, body = raw[at], raw[at + 1], at + 2
    if n == 0x80 or n > 0x84:
        return None
    if n > 0x80:
        width = n - 0x80
        if body + width > end:
            return None
        n = int.from_bytes(raw[body : body + width], "big")
        body += width
        if n < 0x80 or n >> 8 * (width - 1) == 0:
            return None
    return (tag, body, body + n) if body + n <= end else None


def _items(raw: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The elements from ``at`` to exactly ``end``, constructed ones parsed through; None if anything doesn't close."""
    out = []
    while at < end:
        item = _tlv(raw, at, end)
        if item is None or depth > 16 or item[0] & 0x20 and _items(raw, item[1], item[2], depth + 1) is None:
            return None
        out.append(item)
        at = item[2]
    return out


def is_der_key(raw: bytes | None) -> bool:
    """PKCS#8, encrypted PKCS#8, PKCS#1 (nine integers), DSA (six) or SEC 1 private key, closed at every level."""
    if not raw or raw[0] != 0x30:
        return False
    top = _tlv(raw, 0, len(raw))
    if top is None or top[2] != len(raw):
        return False
    parts = _items(raw, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    small = lambda p: p[2] - p[1] == 1 and raw[p[1]] <= 1
    if tags[0] == 0x30:  # encrypted: algorithm, octets
        first = _items(raw, parts[0][1], parts[0][2])
        return tags == [0x30, 0x04] and bool(first) and first[0][0] == 0x06
    if tags[0] != 0x02 or not small(parts[0]):
        return False
    if tags[1] == 0x30:  # version, algorithm, octets
        first = _items(raw, parts[1][1], parts[1][2])
        inner = _items(raw, parts[2][1], parts[2][2]) if len(tags) >= 3 and tags[2] == 0x04 else None
        return bool(first) and first[0][0] == 0x06 and inner is not None and len(inner) == 1
    if tags[1] == 0x04:  # version 1, octets, optional tagged parts
        return raw[parts[0][1]] == 1 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if len(tags) == 6:  # version 0, p, q, g, y, x
        return raw[parts[0][1]] == 0 and all(t == 0x02 for t in tags)
    return len(tags) >= 9 and all(t == 0x02 for t in tags[:9])


def is_openssh_key(raw: bytes | None) -> bool:
    """``openssh-key-v1``: cipher, kdf and options, a count, that many public keys, the private part, and no more."""
    magic = b"openssh-key-v1\0"
    if not raw or not raw.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n : at]

    if any(string() is None for _ in range(3)) or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    return all(string() for _ in range(keys + 1)) and at == len(raw)


def is_signed_token(header: str, payload: str) -> bool:
    """Whether the header (and a plain payload) decode to JSON objects, the header naming its algorithm."""

    def obj(part: str) -> dict | None:
        raw = decode_base64(part)
        try:
            value = json.loads(raw.decode("utf-8")) if raw else None
        except (ValueError, RecursionError):
            return None
        return value if isinstance(value, dict) else None

    head = obj(header)
    if head is None or not isinstance(head.get("alg"), str) or head["alg"].lower() == "none":
        return False
    return "enc" in head or "zip" in head or obj(payload) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the three base kinds, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of candidates that parse."""
    out = []
    if "-----BEGIN " in text:
        out += [(m.start(), 5, m.end()) for m in _PEM.finditer(text) if is_der_key(raw := decode_base64(m[2])) or is_openssh_key(raw)]
    for m in _RUN.finditer(text):
        raw = decode_base64(m[0])
        if is_der_key(raw):
            out.append((m.start(), 3, m.end()))
        elif is_openssh_key(raw):
            out.append((m.start(), 6, m.end()))
        elif raw and raw.startswith(b"-----BEGIN ") and any(is_der_key(inner := decode_base64(k[2])) or is_openssh_key(inner) for k in _PEM.finditer(raw.decode("latin-1"))):
            out.append((m.start(), 5, m.end()))
    out += [(m.start(), 3, m.end()) for m in _HEX_RUN.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    out += [(m.start(), 4, m.end()) for m in _JWT.finditer(text) if m[3] and is_signed_token(m[1], m[2])]
    return sorted(out)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_spans string, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` with counts, base spans (and their SHA-256) and all spans, ``kind:start:end`` by start."""

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, more = base_spans(text or ""), confirmed_spans(text or "")
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                joined = _joined(base)
                rows.append((doc, *counts, len(more), joined, hashlib.sha256(joined.encode()).hexdigest(), _joined(sorted(base + more))))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCANNED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCANNED)
