"""Secret scanning with structural confirmation.

Three plain patterns (an assignment, an access key id, a long hex run) are
reported as they match. Candidates of further kinds are reported only when their
structure holds once decoded:

- `jwt`: the first of three base64url parts decodes to a JSON object with `alg`;
- `der`: a hex run, or lines of base64, decode to an ASN.1 SEQUENCE whose nested
  lengths fill them exactly (private and public keys, inside PEM frames or bare);
- `ssh`: lines of base64 decode to length-prefixed fields that fill them exactly,
  the first one a key type's name, or to the header of a private key file.

Each text is scanned whole, one at a time. Null and empty texts have no spans;
repeated rows are scanned each; ties of start go by kind in the order of KINDS.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE = KINDS[:3]


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: One character class a letter: a flag for case would also match letters beyond ASCII.
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Base64 in lines, as PEM has it, or in one run, the first line of 40 characters or more.
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}(?:\r?\n[A-Za-z0-9+/]+)*={0,2}")
HEXES = re.compile(r"[0-9a-fA-F]{64,}")
#: What base64 of a SEQUENCE (and its length), of a first field's length, or of a private key file begins with.
BEGINS = re.compile(r"(?=M[A-I]|AAAA|b3Bl)")
SSH_TYPES = (b"ssh-", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
#: Fixed value: how OpenSSH private key files begin.
OPENSSH = b"openssh-key-v1\0"


def der_ends(raw: bytes, depth: int = 0) -> bool:
    """Whether raw is ASN.1 items whose lengths fill it exactly; at the top one SEQUENCE that holds an INTEGER or SEQUENCE."""
    at, items = 0, 0
    while at < len(raw):
        if at + 2 > len(raw):
            return False
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(raw):
                return False
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        if at + n > len(raw):
            return False
        if depth == 0 and (tag != 0x30 or n < 8 or raw[at] not in (0x02, 0x30)):
            return False
        if tag & 0x20 and depth < 16 and not der_ends(raw[at : at + n], depth + 1):
            return False
        at, items = at + n, items + 1
    return items > 0 and (depth > 0 or items == 1)


def der_size(raw: bytes) -> int:
    """Bytes of the item that raw begins with, by its length; 0 if it has none."""
    if len(raw) < 2:
        return 0
    k = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if raw[1] & 0x80 and (not 1 <= k <= 4 or len(raw) < 2 + k):
        return 0
    return 2 + k + (int.from_bytes(raw[2 : 2 + k], "big") if k else raw[1])


def ssh_ends(raw: bytes) -> list[int]:
    """Places in raw where the second and each later field of a public key may end it."""
    at, out = 0, []
    while at + 4 <= len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + n > len(raw) or at == 0 and not raw[4 : 4 + n].startswith(SSH_TYPES):
            break
        if at:
            out.append(at + 4 + n)
        at += 4 + n
    return out


def openssh_size(raw: bytes) -> int:
    """Bytes of a private key file, by its lengths; 0 if raw ends before it."""
    at, fields = len(OPENSSH), 3  # cipher, kdf, its options
    while fields and at + 4 <= len(raw):
        at, fields = at + 4 + int.from_bytes(raw[at : at + 4], "big"), fields - 1
    fields, at = int.from_bytes(raw[at : at + 4], "big") + 1, at + 4  # public keys, the private part
    while fields and at + 4 <= len(raw):
        at, fields = at + 4 + int.from_bytes(raw[at : at + 4], "big"), fields - 1
    return at if not fields and at <= len(raw) else 0


def signed_token(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _decoded(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return b""


def _key(body: str, at: int, ends: dict[int, int]) -> tuple[str, int] | None:
    """Kind and end of the key that begins at a place of body and ends at one of ends."""
    head = _decoded(body[at : at + 64])
    if head[:1] == b"\x30":
        end = at + -(-4 * der_size(head) // 3)
        return ("der", end) if end in ends and der_ends(_decoded(body[at:end])) else None
    if head.startswith(OPENSSH):
        end = at + -(-4 * openssh_size(_decoded(body[at:])) // 3)
        return "ssh", end if end in ends else len(body)
    if not head[4:].startswith(SSH_TYPES):
        return None
    # The last of them: a wrapped key may have a field that ends with a line.
    found = [end for n in ssh_ends(_decoded(body[at:])) if (end := at + -(-4 * n // 3)) in ends]
    return ("ssh", found[-1]) if found else None


def keys_of(run: str, start: int = 0) -> list[tuple[int, int, str]]:
    """Keys in lines of base64. Lines of other text may stand before and after one, as they are base64 by their letters: a key begins in a line, 40 characters or more before its end, and ends where its lengths say, at the end of a line."""
    parts, size, at = [], 0, start
    for line in run.rstrip("=").split("\n"):
        n = len(line.rstrip("\r"))
        parts.append((size, at, at + n))
        size, at = size + n, at + len(line) + 1
    ends = {b + e - s: e for b, s, e in parts} | {size: start + len(run)}
    body, out, done = re.sub(r"\s+", "", run.rstrip("=")), [], 0
    for b, s, e in parts:
        # Letters may stand before a key in its first line, so every place that spells a beginning is tried.
        for m in BEGINS.finditer(body, b):
            if m.start() > b + e - s - 40:
                break
            if m.start() >= done and (found := _key(body, m.start(), ends)):
                kind, done = found
                out.append((s + m.start() - b, ends[done], kind))
    return out


def hex_keys(run: str, start: int = 0) -> list[tuple[int, int, str]]:
    """The key at the end of a run of hex digits, from the first place at which one begins whose lengths fill it."""
    for m in re.finditer("(?=30)", run):
        rest = len(run) - m.start()
        if rest >= 64 and rest % 2 == 0 and 2 * der_size(bytes.fromhex(run[m.start() : m.start() + 12])) == rest and der_ends(bytes.fromhex(run[m.start() :])):
            return [(start + m.start(), start + len(run), "der")]
    return []


def token_of(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """The signed token in a match, which letters may stand before."""
    for m in re.finditer("(?=eyJ)", text[start:end].split(".", 1)[0]):
        if signed_token(text[start + m.start() : end]):
            return [(start + m.start(), end, "jwt")]
    return []


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    if not text:
        return []
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [x for m in JWT.finditer(text) for x in token_of(text, m.start(), m.end())]
    for m in BASE64.finditer(text):
        out += keys_of(m[0], m.start())
    for m in HEXES.finditer(text):
        out += hex_keys(m[0], m.start())
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """text with each span, or union of overlapping spans, replaced by the mark."""
    out, at, done = [], 0, 0
    for start, end, _ in spans:
        if start >= done:
            out += [text[at:start], mark]
        at = done = max(done, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<kind,start,end>> of each row."""
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span)], [key, "spans"])

    return lean(docs).select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {kind}")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, columns and order kept, with secrets in the text replaced; null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [t if t is None else redact(t, s) if (s := spans_of(t)) else t for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(b.columns)], schema=pa.schema([pa.field(f.name, pa.string()) if i == at else f for i, f in enumerate(b.schema)]))

    return lean(docs).mapInArrow(run, docs.schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op3 returns, from the spans of scan()."""
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(key, *(n(k).alias(f"n_{k}") for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), *(n(k).alias(f"n_{k}") for k in KINDS[3:]))
