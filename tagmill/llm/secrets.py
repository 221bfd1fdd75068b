"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, long hex) are reported as they match. Encoded candidates are reported only
after their structure is confirmed: base64 or hex is decoded and must parse as a private key encoding whose nested
lengths fit exactly (DER, OpenSSH), and a signed token needs a JSON header that names an algorithm, a JSON payload and
a signature of a length that the algorithm allows. Candidates span real and escaped line breaks, as in wrapped keys and
in keys inside JSON or source strings, and end with any of their lines. Armour may hold header lines, and may be in base64 again.

Defined cases: a null or empty text has no spans; offsets count code points, end exclusive; equal rows give equal
results; spans of one kind never overlap; an incoming column named like the output is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import giving_back

#: In the order by which spans with the same start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der64", "ssh64", "derhex", "sshhex", "pem64")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Between the lines of a candidate: real line breaks with the blanks around them, or escaped ones of a string.
_BREAK = r"(?:\\+r)?(?:\\+n)|[\x20\t]*(?:\r\n?|\n)[\x20\t]*"
_PEM = re.compile(rf"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----((?:(?:{_BREAK})[A-Z][A-Za-z-]+: ?[\x20-\x5B\x5D-\x7E]*)*)((?:[A-Za-z0-9+/=\s]|\\+[nrt/])+)-----END \1-----")
#: A whole armoured key in base64 again.
_PEM_64 = re.compile(r"(?<![A-Za-z0-9+/])LS0tLS1CRUdJTi[A-Za-z0-9+/]+={0,2}")
#: How keys begin: a DER sequence with MA to MI in base64, by its length byte; an OpenSSH key with its magic word. An escape may precede.
_HEAD_64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nrt]))(?:M[A-I]|b3BlbnNza)(?:[A-Za-z0-9+/]|\\+/){14}")
_HEAD_HEX = re.compile(r"(?:(?<![0-9A-Fa-f])|(?<=\\[nrt]))(?:30|6[Ff]70656[Ee]737368)[0-9A-Fa-f]{14}")
_BODY_64 = re.compile(rf"(?:[A-Za-z0-9+/]|\\+/)+(?:(?:{_BREAK})(?:[A-Za-z0-9+/]|\\+/)+)*+={{0,2}}")
_BODY_HEX = re.compile(rf"[0-9A-Fa-f]+(?:(?:{_BREAK})[0-9A-Fa-f]+)*+")
_ESCAPE = re.compile(r"\\+[nrt]|\\+(?=/)|\s+")
_SIGNATURE_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EDDSA": (64, 114)}
_OPENSSH = b"openssh-key-v1\0"


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[start:end] exactly, or None."""
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length == 0x80 or length > 0x84:
            return None
        if length > 0x80:
            n = length & 0x7F
            length = int.from_bytes(data[start : start + n], "big")
            start += n
            if length < 0x80 or start > end:
                return None
        if start + length > end:
            return None
        items.append((tag, start, start + length))
        start += length
    return items


def der_key(data: bytes) -> str | None:
    """The kind of private key that data encodes as DER, all nested lengths fitting, or None."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return None
    inner = der_items(data, outer[0][1], outer[0][2])
    if not inner:
        return None
    tags = [x[0] for x in inner]
    version = int.from_bytes(data[inner[0][1] : inner[0][2]], "big") if tags[0] == 2 else -1
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {2}:
        return "rsa"
    if version == 0 and tags == [2] * 6:
        return "dsa"
    if version == 1 and tags[1:2] == [4] and set(tags[2:]) <= {0xA0, 0xA1} and all(der_items(data, a, b) for _, a, b in inner[2:]):
        return "ec"
    if version in (0, 1) and tags[1:3] == [0x30, 4]:
        algorithm = der_items(data, inner[1][1], inner[1][2])
        if algorithm and algorithm[0][0] == 6 and _nested(data, *inner[1][1:]) and _nested(data, *inner[2][1:]):
            return "pkcs8"
    if tags == [0x30, 4]:
        algorithm = der_items(data, inner[0][1], inner[0][2])
        if algorithm and [x[0] for x in algorithm] == [6, 0x30] and _nested(data, *inner[0][1:]):
            return "pkcs8-encrypted"
    return None


def _nested(data: bytes, start: int, end: int) -> bool:
    """Whether data[start:end] is DER values, and so are the contents of all sequences and sets in it."""
    items = der_items(data, start, end)
    return bool(items) and all(a == b or _nested(data, a, b) for tag, a, b in items if tag in (0x30, 0x31))


def armoured_key(headers: str, body: str) -> bool:
    """Whether an armoured key's body is a key, or whole cipher blocks where its headers say that it is encrypted."""
    raw = _decoded(_ESCAPE.sub("", body))
    if raw and "ENCRYPTED" in headers:
        return len(raw) % 8 == 0
    return bool(raw) and (der_key(raw) is not None or openssh_key(raw))


def der_size(data: bytes) -> int:
    """How many bytes the DER sequence that data begins with takes by its length field; 0 if it can't be a key."""
    if len(data) < 7 or data[0] != 0x30 or data[1] == 0x80 or data[1] > 0x84:
        return 0
    n = max(0, data[1] - 0x80)
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1]) if data[2 + n] in (2, 0x30) else 0


def openssh_size(data: bytes) -> int:
    """How many bytes the OpenSSH private key that data begins with takes by its nested length fields; 0 if it is none."""
    if not data.startswith(_OPENSSH):
        return 0
    at = len(_OPENSSH)

    def field(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    for _ in range(3):
        at = field(at)
        if at is None:
            return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys + 1):
        at = field(at)
        if at is None:
            return 0
    return at


def openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key whose nested length fields fill it exactly."""
    return len(data) > 0 and openssh_size(data) == len(data)


def _lines(text: str) -> tuple[str, dict[int, int]]:
    """The text without breaks and escapes, and for each length at which one of its lines ends there, the length in the text."""
    parts, ends, at, n = [], {}, 0, 0
    for m in _ESCAPE.finditer(text):
        parts.append(text[at : m.start()])
        n += m.start() - at
        if m[0].strip("\\"):  # a break, not the escape of a slash
            ends[n] = m.start()
        at = m.end()
    clean = "".join([*parts, text[at:]])
    return clean.rstrip("="), ends | {len(clean.rstrip("=")): len(text)}


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    raw = _decoded(part, url=True)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether the three parts make a JSON web signature."""
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    algorithm = head["alg"].upper()
    if algorithm == "NONE":
        return not signature
    raw = _decoded(signature, url=True)
    if not raw:
        return False
    return len(raw) in _SIGNATURE_BYTES[algorithm] if algorithm in _SIGNATURE_BYTES else len(raw) >= 128


def _unhexed(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _keys(text: str, head: re.Pattern, body: re.Pattern, decode: Callable[[str], bytes | None], bits: int, kinds: tuple[str, str]) -> list[tuple[str, int, int]]:
    """Spans of the encoded keys that end with a line or with the candidate, `bits` to a character."""
    found, reach = [], 0
    for m in head.finditer(text):
        start = decode(_ESCAPE.sub("", m[0]))
        if m.start() < reach or not start or not (der_size(start) or _OPENSSH.startswith(start[:8])):
            continue
        clean, ends = _lines(body.match(text, m.start())[0])
        raw = decode(clean[: len(clean) - (len(clean) * bits % 8 >= bits)]) or b""
        size = der_size(raw) or openssh_size(raw)
        end = ends.get(-(-8 * size // bits))
        if size and end and len(raw) >= size and (size == openssh_size(raw) or der_key(raw[:size])):
            reach = m.start() + end
            found.append((kinds[raw.startswith(_OPENSSH)], m.start(), reach))
    return found


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a whole text, by start and then by the order of KINDS."""
    if not text:
        return []
    found = []
    low = text.lower()  # for the quick test alone; it holds the words wherever the pattern can match
    if any(x in low for x in ("passw", "secret", "token", "api_key", "apikey")):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if signed_token(*m.groups())]
    pem = []
    if "PRIVATE KEY-----" in text:
        pem = [(m.start(), m.end()) for m in _PEM.finditer(text) if armoured_key(m[2], m[3])]
        found += [("pem", a, b) for a, b in pem]
    if "LS0tLS1CRUdJTi" in text:
        for m in _PEM_64.finditer(text):
            inside = _PEM.search((_decoded(m[0]) or b"").decode("latin-1"))
            if inside and armoured_key(inside[2], inside[3]):
                found.append(("pem64", m.start(), m.end()))
    found += [x for x in _keys(text, _HEAD_64, _BODY_64, _decoded, 6, ("der64", "ssh64")) if not any(a <= x[1] < b for a, b in pem)]
    if "30" in text or "6f70656e737368" in low:
        found += _keys(text, _HEAD_HEX, _BODY_HEX, _unhexed, 4, ("derhex", "sshhex"))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each stretch covered by spans replaced by the mask."""
    spans = find_secrets(text)
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x.as_py())] for x in texts], _SPANS)


def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([redacted(x.as_py()) for x in texts], pa.string())


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with a column of the spans found in each whole text. One narrow pass: no shuffle, memory of one batch."""
    return docs.withColumn(out, F.arrow_udf(giving_back(_scan), SPAN_TYPE)(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret masked in the text; a null text stays null."""
    return docs.withColumn(text, F.arrow_udf(giving_back(_redact), "string")(F.col(text)))


def secrets_query(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans: a row per document."""
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )
