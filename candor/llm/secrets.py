"""Secret scans with structural confirmation.

Base patterns report as they match. Further candidates are only reported once their structure is confirmed:
 * jwt: three base64url parts whose first decodes to a JSON object with "alg" and whose second to a JSON object,
 * key: base64 or hex that decodes to a private key: DER with nested lengths that fill it exactly (PKCS#1, PKCS#8,
   SEC 1) or the OpenSSH container, all its nested lengths read to the end,
 * encoded: base64 or hex that decodes to printable text in which a base pattern matches.

Null texts count as empty, which hold nothing. Spans are code points, end exclusive; of one kind they don't
overlap. Repeated rows repeat their result; texts are scanned whole, in one task each. `redact` keeps all
columns and replaces only text (and n_chars).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .units import resident, slices, texts

KINDS = ("assign", "access", "hex", "jwt", "key", "encoded")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: 22 characters hold 16 bytes, as many as the shortest base secret has.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]{32,})-----END ([A-Z0-9]+ )*PRIVATE KEY-----")
_LONG_HEX = re.compile(r"[0-9a-fA-F]{32,}")
#: What a text must hold for a scan of its kind; matched in C++ over whole columns.
_HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{12}", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "more": r"[A-Za-z0-9+/_-]{22}|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{2,}\.|PRIVATE KEY-----"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def from_base64(part: str) -> bytes | None:
    body = part.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER element at `at`, if its length stays inside."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if (e := _element(data, at, end)) is None:
            return None
        out.append(e)
        at = e[2]
    return out


def _strings(data: bytes, at: int, count: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed strings from `at`, so many or all to the end, and where they end."""
    out: list[bytes] = []
    while len(out) != count if count is not None else at < len(data):
        if at + 4 > len(data):
            return None
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
    return out, at


def _is_name(value: bytes) -> bool:
    return 0 < len(value) < 80 and all(33 <= c < 127 for c in value)


def _is_openssh(data: bytes) -> bool:
    """The OpenSSH container to its end: cipher and key derivation, public keys of nested strings, the private block."""
    if (head := _strings(data, 15, 3)) is None:
        return False
    (cipher, derivation, options), at = head
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not (_is_name(cipher) and _is_name(derivation)) or not 1 <= keys <= 64 or (body := _strings(data, at, keys + 1)) is None:
        return False
    *public, private = body[0]
    kinds = []
    for key in public:
        fields = _strings(key, 0)
        if fields is None or len(fields[0]) < 2 or not _is_name(fields[0][0]):
            return False
        kinds.append(fields[0][0])
    rest = len(data) - body[1]
    if cipher != b"none":  # only its length is known, and an authentication tag may follow
        return derivation != b"none" and bool(options) and len(private) >= 16 and len(private) % 8 == 0 and rest in (0, 16)
    first = _strings(private, 8, 1)
    return rest == 0 and derivation == b"none" and not options and len(private) % 8 == 0 and private[:4] == private[4:8] and first is not None and first[0][0] == kinds[0]


def is_private_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return _is_openssh(data)
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = _children(data, top[1], top[2])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    tags = [t for t, _, _ in inner]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm, key
        algorithm = _children(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return len(tags) >= 2 and tags[1] == 0x04 and inner[1][2] - inner[1][1] in (24, 28, 32, 48, 66) and data[inner[0][1]] == 1  # SEC 1


def is_signed_token(head: str, body: str) -> bool:
    try:
        first, second = (json.loads(from_base64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def _decoded_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_private_key(data):
        return "key"
    if all(9 <= c < 127 for c in data) and base_spans(data.decode("ascii")):
        return "encoded"
    return None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    found = [(m.start(), m.end(), "key") for m in _PEM.finditer(text) if _decoded_kind(from_base64(re.sub(r"\s", "", m[2]))) == "key"]
    for pattern, decode in ((_LONG_HEX, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None), (_BASE64, from_base64)):
        for m in pattern.finditer(text):
            if (kind := _decoded_kind(decode(m[0]))) and not any(a < m.end() and m.start() < b for a, b, _ in found):
                found.append((m.start(), m.end(), kind))
    return out + found


def _order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _scan(values: pa.Array) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    hit = {k: pc.match_substring_regex(values, p).to_numpy(zero_copy_only=False) for k, p in _HINTS.items()}
    out: list[tuple[list, list]] = [([], [])] * len(values)
    for k in np.flatnonzero(np.logical_or.reduce(list(hit.values()))):
        text = values[k].as_py()
        base = base_spans(text)
        more = confirmed_spans(text) if hit["more"][k] else []
        out[k] = (_order(base), _order(base + more))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _report(batches):
    resident(None)
    for batch in slices(batches):
        got = _scan(texts(batch))
        count = lambda kind: pa.array([sum(s[2] == kind for s in base) for base, _ in got], pa.int64())
        sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in got]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), count("assign"), count("access"), count("hex"), pa.array(sha, pa.string()), pa.array([_joined(a) for _, a in got], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and all spans of every document; nothing is shuffled."""
    return docs.select("doc_id", "text").mapInArrow(_report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(names: list[str], text: str, mask: str):
    def run(batches):
        resident(None)
        for batch in slices(batches, text):
            values = batch.column(text).cast(pa.string())
            new = None
            for k, (_, spans) in enumerate(_scan(values.fill_null(""))):
                if spans:
                    new = values.to_pylist() if new is None else new
                    old, out, at = new[k], [], 0
                    for a, b, _ in spans:
                        if b > at:
                            out += [old[at:a], mask] if a >= at else []
                            at = b
                    new[k] = "".join(out) + old[at:]
            col = values if new is None else pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([col if c == text else batch.column(c) for c in names], names)

    return run


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All documents with all columns; each secret (overlapping spans as one) is replaced by the mask."""
    fields = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in docs.schema.fields]
    out = docs.mapInArrow(_redacted(docs.columns, text, mask), T.StructType(fields))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
