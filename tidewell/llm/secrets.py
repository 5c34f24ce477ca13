"""Secret scans with structural confirmation.

Base kinds are found by pattern alone: ``assign`` (a named credential with a value of 6 or more characters), ``access``
(AKIA ids of 20 or more characters) and ``hex`` (runs of 24 or more hex digits). On top of these, candidates in base64
or hex are decoded and reported only if the bytes parse as what they seem to be:

* ``pem``: an armoured private key whose body decodes to DER that parses, or that is encrypted (a ``Proc-Type`` header
  says so) or in OpenSSH's format; newlines may be LF, CRLF, CR or written as ``\\n``, as in JSON;
* ``jwt``: three base64url parts of which the first is a JSON object with a string ``alg``, the second a JSON object;
* ``der``: bare base64 or hex holding a private key: a SEQUENCE whose nested lengths fill it exactly and whose first
  members are those of PKCS#1, PKCS#8 or SEC1, or OpenSSH's magic word with well-formed length fields. Base64 may be
  wrapped in lines: the length that the key itself states says how many of them belong to it.

Spans are code-point offsets, end exclusive, non-overlapping within a kind. Null and empty texts have none; repeated
rows are rows of their own; nothing is cut from long texts; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_columns

KINDS = ("assign", "access", "hex", "pem", "jwt", "der")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:[^-]|-(?!----(?:BEGIN|END) ))*+)-----END \1PRIVATE KEY-----")
# a JSON object in base64url: "{" and a quote, or white space around the brace first
_JWT = re.compile(r"(?<![A-Za-z0-9_-])((?:e[wy3]|[ICD][A-Za-z0-9_-])[A-Za-z0-9_-]{8,})\.((?:e[wy3]|[ICD][A-Za-z0-9_-])[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{48,}={0,2}")
_ANYHEX = re.compile(r"[0-9A-Fa-f]{64,}")
_OPENSSH = b"openssh-key-v1\x00"
MOST_KEYS = 64  # of one OpenSSH file; OpenSSH itself writes and reads one
_PADDING = re.compile("={0,2}")
# the first line of a key in base64: it starts with the tag of a SEQUENCE or with OpenSSH's magic word
_FIRST = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M[A-P]|b3BlbnNz)[A-Za-z0-9+/_-]{6,}")
_NEXT = re.compile(r"[ \t]*(?:\\+[nr]|[\r\n])+[ \t]*([A-Za-z0-9+/_-]+)")
_NEWLINE = re.compile(r"\r\n|\r|(?:\\+r)?\\+n|\\+r")
_ESCAPE = re.compile(r"\\+(?:u([0-9A-Fa-f]{4})|/)")


def decode_base64(text: str) -> bytes:
    """Either alphabet, padding optional; empty if it isn't base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_members(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element; None unless definite lengths fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1 or OpenSSH, with every nested length consistent."""
    if data.startswith(_OPENSSH):
        at, fields = len(_OPENSSH), 0
        while fields < 3 and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            fields += at <= len(data)
            if at > len(data):
                return False
        return fields == 3
    outer = der_members(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_members(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:1] == [0x02] and len(inner[0][1]) == 1:
        version = inner[0][1][0]
        if version <= 1 and len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True
        if version <= 1 and tags[:3] == [0x02, 0x30, 0x04]:
            algorithm = der_members(inner[1][1])
            return bool(algorithm) and algorithm[0][0] == 0x06
        return version == 1 and tags[:2] == [0x02, 0x04] and len(inner[1][1]) in (20, 24, 28, 32, 48, 66)
    if tags == [0x30, 0x04]:
        algorithm = der_members(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_armoured_key(body: str) -> bool:
    """``body`` of an armour: header lines, if any, and base64."""
    body = _NEWLINE.sub("\n", body)
    lines = [line.strip() for line in _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "/", body).strip().split("\n")]
    headers = []
    if ":" in lines[0]:
        # headers end at an empty line; without one they are the lines that can't be base64
        end = lines.index("") if "" in lines else sum(":" in line for line in lines)
        headers, lines = lines[:end], lines[end:]
    data = decode_base64("".join("".join(lines).split()))
    encrypted = any(h.lower().startswith("proc-type:") and "ENCRYPTED" in h for h in headers)
    return bool(data) and (encrypted or is_private_key(data))


def stated_length(data: bytes) -> int:
    """Bytes of the SEQUENCE that ``data`` starts with, as its length states; 0 if it can't be a private key."""
    if len(data) < 4 or data[0] != 0x30:
        return 0
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or data[1] == 0x80 or len(data) < 3 + n or data[2 + n] not in (0x02, 0x30):
        return 0
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])


def stated_openssh(body: str, start: int) -> int:
    """Bytes of OpenSSH's key at ``start`` in base64, as its length fields state; only these are decoded. 0 if it is none."""

    def number(at: int) -> int | None:
        data = decode_base64(body[start + at // 3 * 4 : start + (at + 6) // 3 * 4])[at % 3 : at % 3 + 4]
        return int.from_bytes(data, "big") if len(data) == 4 else None

    if decode_base64(body[start : start + 20]) != _OPENSSH:
        return 0
    at = len(_OPENSSH)
    for _ in range(3):
        if (n := number(at)) is None:
            return 0
        at += 4 + n
    keys = number(at)  # a public part each, and one private part
    if keys is None or keys > MOST_KEYS:
        return 0
    at += 4
    for _ in range(keys + 1):
        if (n := number(at)) is None:
            return 0
        at += 4 + n
    return at


class _Lines:
    """Base64 over neighbouring lines, read once for all keys that may start in it."""

    def __init__(self, text: str, first: re.Match):
        parts, self.starts, self.ends, size, end = [first[0]], {first.start(): 0}, {len(first[0]): first.end()}, len(first[0]), first.end()
        while (more := _NEXT.match(text, end)) is not None:
            self.starts[more.start(1)] = size
            parts.append(more[1])
            size, end = size + len(more[1]), more.end()
            self.ends[size] = end
        self.body = "".join(parts)


def wrapped_keys(text: str) -> list[tuple[int, int]]:
    """Spans of private keys in base64 that goes on over lines."""
    found: list[tuple[int, int]] = []
    lines = None
    for m in _FIRST.finditer(text):
        if found and m.start() < found[-1][1]:
            continue
        if lines is None or m.start() not in lines.starts:
            lines = _Lines(text, m)
        at = lines.starts[m.start()]
        if m[0].startswith("b3BlbnNz"):
            size = stated_openssh(lines.body, at)
        else:
            size = stated_length(decode_base64(m[0][: min(12, len(m[0]) // 4 * 4)]))
        need = -(-size * 8 // 6)
        end = lines.ends.get(at + need) if size else None  # a key ends where a line ends
        if end is not None and is_private_key(decode_base64(lines.body[at : at + need])):
            found.append((m.start(), _PADDING.match(text, end).end()))
    return found


def is_signed_token(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(decode_base64(header)), json.loads(decode_base64(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of ``KINDS``."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if is_armoured_key(m[2]):
                found.append(("pem", *m.span()))
    found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    wrapped = wrapped_keys(text)
    der = [m.span() for m in _BASE64.finditer(text) if is_private_key(decode_base64(m[0]))]
    der = wrapped + [s for s in der if not any(a < s[1] and s[0] < b for a, b in wrapped)]
    for m in _ANYHEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])) and not any(a < m.end() and m.start() < b for a, b in der):
            der.append(m.span())
    found += [("der", *s) for s in der]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, stop>>) for every row."""

    def scan(batches):
        for b in batches:
            spans = [[{"kind": k, "start": s, "stop": e} for k, s, e in find_secrets(t)] for t in b["text"]]
            yield {"doc_id": b["doc_id"], "spans": spans}

    return map_columns(documents.select("doc_id", "text"), "doc_id long, spans array<struct<kind:string,start:int,stop:int>>", scan)


def redact(text: str | None) -> str | None:
    """``text`` with every reported span replaced; overlapping spans become one."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at, reach = [], 0, 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= reach:
            out += [text[max(at, reach) : a], "[REDACTED]"]
        reach = max(reach, b)
        at = reach
    return "".join(out) + text[reach:]


def redact_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with redacted texts, and n_chars to match if there is such a column; all else stays as it is."""
    rest = [c for c in documents.columns if c not in ("text", "n_chars")]
    counted = "n_chars" in documents.columns
    kind = f"text string, n_chars {documents.schema['n_chars'].dataType.simpleString()}" if counted else "text string"

    def run(batches):
        for b in batches:
            texts = [redact(t) for t in b["text"]]
            out = {"text": texts}
            if counted:
                out["n_chars"] = [n if t == old else len(t) for n, t, old in zip(b["n_chars"], texts, b["text"])]
            yield out

    return map_columns(documents, kind, run, keep=tuple(rest)).select(*[F.col(f"`{c}`") for c in documents.columns])


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scanned.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
