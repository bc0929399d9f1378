"""Secret scans with structural confirmation (operator 10).

Plain patterns (kinds assign, access, hex) always report. Further candidates, which are runs of base64, of base64url
parts joined by dots and of hex, report only if what they decode to has the structure of a secret: a PEM or bare DER
private key whose nested lengths add up (line breaks may be escaped, RFC 1421 header lines may come first, and
bare base64 may go over lines; a legacy encrypted key has whole cipher blocks), an OpenSSH private key whose length-prefixed fields add up, or a signed token whose
header is JSON that names an algorithm.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows; an empty table gives an empty
table; other columns of the input play no part; whole texts are searched, however long; spans that start together go by kind. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import arrow_rows, bounded_batches, map_texts, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----)){16,})-----END \1-----")
#: A line break as it stands in text, in JSON and in code, there also with the end of one string and the start of the next.
BREAK = r"""(?:(?:[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n))(?:["'][\x20\t]*[+.,]?\s*["'])?[\x20\t]*|["'][\x20\t]*[+.,]?\s*["'][\x20\t]*)"""
BREAKS = re.compile(BREAK)
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:.*")
DEK = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})$")
#: Base64 over several lines, from where a DER sequence or the OpenSSH magic may begin.
START = re.compile(r"(?:(?<![A-Za-z0-9+/=])|(?<=\\n))(?:M[A-Za-z0-9+/]{15}|b3BlbnNzaC1rZXktdjE)")
WRAPPED = re.compile(r"[A-Za-z0-9+/]+(?:" + BREAK + r"[A-Za-z0-9+/]+)+={0,2}")
#: How a sequence begins whose first element is a version number.
VERSION = re.compile(rb"0(?:[\x00-\x7f]|\x81.|\x82..|\x83...|\x84....)\x02\x01[\x00-\x03]", re.S)
#: Signed tokens: the header is an object, so it begins with a brace and a quote, maybe with white space between. What may end
#: in a header is a whole run before a dot, so that each character is looked at a fixed number of times.
RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?=\.)")
OBJECT = re.compile(r"(?:eyJ|eyA|ew[0ko])(?=[A-Za-z0-9_-])")
PAYLOAD = re.compile(r"\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
#: Base64url of a DER sequence, with one of the two characters that plain base64 lacks.
URL64 = re.compile(r"(?<![A-Za-z0-9_-])M(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{39,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "pem", "token", "openssh", "der")


def tokens(text: str) -> list[tuple[int, int]]:
    """Where three runs that dots join may be a signed token, from the first start of an object in the first run on."""
    out, at = [], 0
    for run in RUN.finditer(text):
        begin = OBJECT.search(text, max(run.start(), at), run.end())
        rest = begin and PAYLOAD.match(text, run.end())
        if rest:
            out.append((begin.start(), rest.end()))
            at = rest.end()
    return out


def from_base64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element if their lengths add up to the whole of `data`."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 0 < n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def der_key(data: bytes | None) -> bool:
    """A sequence that fills `data`, begins with a small version number and holds a key: PKCS#1, PKCS#8 or SEC1."""
    outer = der_fields(data) if data and data[0] == 0x30 else None
    if not outer or len(outer) != 1:
        return False
    inner = der_fields(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 3:
        return False
    rest = inner[1:]
    numbers = len(rest) >= 5 and all(tag == 0x02 for tag, _ in rest[:5])
    wrapped = len(rest) >= 2 and rest[0][0] == 0x30 and rest[1][0] == 0x04 and bool((oid := der_fields(rest[0][1]))) and oid[0][0] == 0x06
    curve = rest[0][0] == 0x04 and 16 <= len(rest[0][1]) <= 66
    return numbers or wrapped or curve


def openssh_key(data: bytes | None) -> bool:
    """The private-key magic with cipher, derivation, options and key blobs whose lengths stay within the data. A public key is no secret."""
    return bool(data) and data.startswith(b"openssh-key-v1\0") and key_size(data) is not None


def pem_key(label: str, body: str) -> bool:
    """RFC 1421 header lines may stand first. With them, encrypted content has whole blocks of the size of its start vector."""
    lines, headers = [x.strip() for x in BREAKS.split(body)], []
    while lines and (not lines[0] or HEADER.match(lines[0])):
        if lines[0]:
            headers.append(lines[0])
        del lines[0]
    data = from_base64("".join(lines))
    if not data:
        return False
    if any(re.match(r"Proc-Type:\s*4\s*,\s*ENCRYPTED$", x) for x in headers):
        vector = next((m[1] for x in headers if (m := DEK.match(x))), None)
        return vector is not None and len(data) % (len(vector) // 2) == 0
    return der_key(data) or openssh_key(data) or "ENCRYPTED" in label and bool(der_fields(data))


def key_size(data: bytes) -> int | None:
    """The bytes that a DER sequence or an OpenSSH private key at the start of `data` takes by its own lengths."""
    if data.startswith(b"openssh-key-v1\0"):
        at, left = 15, 3
        while left:
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
            if at + 4 > len(data):
                return None
        left, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
        while left and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
        return at if not left and at <= len(data) else None
    if len(data) < 2 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or data[1] == 0x80:
        return None
    size = 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])
    return size if size <= len(data) else None


def wrapped_key(m: re.Match) -> tuple[str, int, int] | None:
    """The key that starts at a run of base64 lines; it ends where its own lengths say, as text may follow on the next line."""
    runs, at = [], m.start()
    for b in BREAKS.finditer(m.string, m.start(), m.end()):
        runs.append((at, b.start()))
        at = b.end()
    runs.append((at, m.end()))
    joined = "".join(m.string[a:b] for a, b in runs).rstrip("=")
    data = from_base64(joined[: len(joined) // 4 * 4]) or b""
    data += (from_base64(joined[len(joined) // 4 * 4 :]) or b"") if len(joined) % 4 > 1 else b""
    size = key_size(data)
    if size is None or not (der_key(data[:size]) or openssh_key(data[:size])):
        return None
    left = -(-size * 4 // 3)
    for a, b in runs:
        if left <= b - a:
            end = a + left
            break
        left -= b - a
    while end < len(m.string) and m.string[end] == "=" and end - a - left < 2:
        end += 1
    return "openssh" if data.startswith(b"openssh") else "der", m.start(), end


def signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        header, claims = (json.loads(from_base64(x) or b"") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out, taken = [], []
    for m in PEM.finditer(text):
        if pem_key(m[1], m[2]):
            out.append(("pem", *m.span()))
            taken.append(m.span())
    for a, b in tokens(text):
        if signed_token(text[a:b]):
            out.append(("token", a, b))
            taken.append((a, b))
    at = 0
    while m := START.search(text, at):
        at = m.end()
        if (m[0][0] == "b" or VERSION.match(from_base64(m[0]) or b"")) and (run := WRAPPED.match(text, m.start())):
            if not any(a <= m.start() < b for a, b in taken) and (key := wrapped_key(run)):
                out.append(key)
                taken.append(key[1:])
                at = key[2]
    for m in BASE64.finditer(text):
        if any(a < m.end() and m.start() < b for a, b in taken):
            continue
        data = from_base64(m[0])
        if openssh_key(data):
            out.append(("openssh", *m.span()))
        elif der_key(data):
            out.append(("der", *m.span()))
    for m in URL64.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken) and der_key(from_base64(m[0])):
            out.append(("der", *m.span()))
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and der_key(bytes.fromhex(m[0])):
            out.append(("der", *m.span()))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of spans replaced by `mark`."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans (both as kind:start:end lists) and the redacted text."""
    types = {"doc_id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_spans": pa.string(), "spans": pa.string(), "redacted": pa.string()}

    def run(batches):
        for b in batches:
            out = {k: [] for k in types}
            out["doc_id"] = b.column(0)
            for text in map(str, b.column(1)):
                base = base_spans(text)
                spans = base + confirmed_spans(text)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_spans"].append(listed(base))
                out["spans"].append(listed(spans))
                out["redacted"].append(redact(text, spans) if spans else text)
            yield arrow_rows(out, types)

    bounded_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, redacted string")


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with its columns, each run of secret spans replaced by `mark`."""
    return map_texts(docs, lambda texts: [redact(t, spans, mark) if (spans := base_spans(t) + confirmed_spans(t)) else t for t in texts])
