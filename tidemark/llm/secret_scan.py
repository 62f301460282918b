"""Secret scans: pattern spans, and structural confirmation of base64, hex, PEM and signed-token candidates.

A candidate run is reported only if it decodes and what it holds has the right structure: a key's DER with nested
lengths that fit exactly, an OpenSSH key's length-prefixed fields, a signed token's JSON header with an algorithm, or
text that itself assigns a secret.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order within equal starts: patterns first, then what structure confirms.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "hex_key", "ssh_key", "signed_token", "encoded")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A maximal run of at least the length; the same as dropping shorter maximal runs.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}")
ASSIGN_LEAST = 8
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Hexadecimal digits in either case, and base64 over several lines; each begins where a run does, so scans are linear.
ANY_HEX = re.compile("[0-9A-Fa-f]{32,}")
LINES = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/]{4,}+)++={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
MARK = "[SECRET]"


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill data exactly, or None where a tag or length doesn't fit."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + size])
            at += size
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        found.append((tag, data[at : at + n]))
        at += n
    return found


def is_private_key(data: bytes) -> bool:
    """Whether data is one DER private key: PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA."""
    outer = _elements(data) if data[:1] == b"\x30" else None
    inner = _elements(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if len(tags) in (9, 10) and set(tags[:9]) == {2} and inner[0][1] in (b"\x00", b"\x01") and len(inner[1][1]) > 16:
        return True
    if len(tags) == 6 and set(tags) == {2} and inner[0][1] == b"\x00" and len(inner[1][1]) > 16:
        return True

    def named(element: tuple[int, bytes]) -> bool:
        parts = _elements(element[1]) if element[0] == 0x30 else None
        return bool(parts) and parts[0][0] == 6 and len(parts[0][1]) >= 3

    if len(tags) >= 3 and tags[0] == 2 and inner[0][1] in (b"\x00", b"\x01") and named(inner[1]) and tags[2] == 4 and len(inner[2][1]) >= 16:
        return True
    if len(tags) >= 2 and tags[0] == 2 and inner[0][1] == b"\x01" and tags[1] == 4 and len(inner[1][1]) in (20, 24, 28, 32, 48, 66) and set(tags[2:]) <= {0xA0, 0xA1}:
        return True
    return len(tags) == 2 and tags[1] == 4 and len(inner[1][1]) >= 16 and named(inner[0])


def is_ssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: magic, then fields whose lengths fill it."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else -1
        if n < 0 or at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)):
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys)) and bool(field()) and at == len(data)


def is_signed_token(header: str, payload: str) -> bool:
    """Whether the first two parts of a signed token are JSON objects and the first names an algorithm."""
    try:
        head, body = (json.loads(_decoded(p) or b"") for p in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def _holds_secret(data: bytes) -> bool:
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return False
    return any(len(m[2]) >= ASSIGN_LEAST for m in ASSIGN.finditer(text)) or bool(ACCESS.search(text))


def _confirmed(run: str, key_kind: str, data: bytes | None) -> str | None:
    if not data:
        return None
    return key_kind if is_private_key(data) else "ssh_key" if is_ssh_key(data) else "encoded" if _holds_secret(data) else None


def _is_pem_key(body: str) -> bool:
    """Whether what stands between a private key's armour is one; line ends may be escaped, headers may come first."""
    lines = [x.strip() for x in re.split(r"\r|\n|\\r|\\n", body)]
    headers = {x.partition(":")[0].strip(): x.partition(":")[2].strip() for x in lines if ":" in x}
    data = _decoded("".join("".join(x for x in lines if ":" not in x).split()))
    if not data:
        return False
    if headers.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED":  # what it holds can't be seen but for whole blocks
        return re.fullmatch(r"[A-Z0-9-]+,[0-9A-Fa-f]{16,}", headers.get("DEK-Info", "")) is not None and len(data) % 8 == 0
    return is_private_key(data) or is_ssh_key(data)


def _block(lines: str) -> str:
    """Of base64 lines those of the first one's length, and the first shorter one, which ends a block."""
    found, at = lines.splitlines(), 0
    for n, line in enumerate(found):
        at = n
        if len(line.strip()) < len(found[0].strip()):
            break
    return "\n".join(found[: at + 1])


def _declared(line: str) -> int | None:
    """How many bytes the DER sequence has that a base64 line begins with, header included; keys have under 64 KB."""
    head = _decoded(line[:8]) if line[:1] == "M" and len(line) >= 8 else None
    if not head or head[0] != 0x30:
        return None
    n = head[1]
    return n + 2 if n < 0x80 else head[2] + 3 if n == 0x81 else int.from_bytes(head[2:4]) + 4 if n == 0x82 else None


def _wrapped_keys(block: str) -> Iterator[tuple[int, int]]:
    """Where private keys stand in base64 lines that may hold other data before and after them: from a line that begins
    a DER sequence to the line at whose end that sequence ends."""
    lines = [(m.start(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/=]+", block)]
    ends = list(accumulate(len(t) for _, t in lines))
    i = 0
    while i < len(lines):
        size, before = _declared(lines[i][1]), ends[i - 1] if i else 0
        if size:
            for chars in dict.fromkeys((-(-size // 3) * 4, -(-size * 8 // 6))):
                j = bisect_left(ends, before + chars)
                if j < len(ends) and ends[j] == before + chars and is_private_key(_decoded("".join(t for _, t in lines[i : j + 1])) or b""):
                    yield lines[i][0], lines[j][0] + len(lines[j][1])
                    i = j
                    break
        i += 1


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans (kind, start, end), in code points, end exclusive, each sorted by start, then kind."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    more = []
    if "-----BEGIN " in text:
        more += [("pem_key", *m.span()) for m in PEM.finditer(text) if _is_pem_key(m[2])]
    for m in RUN.finditer(text):
        kind = _confirmed(m[0], "der_key", _decoded(m[0]))
        if kind:
            more.append((kind, *m.span()))
    for m in LINES.finditer(text):
        block = _block(m[0])
        kind = _confirmed(block, "der_key", _decoded("".join(block.split())))
        if kind and kind != "encoded":
            more.append((kind, m.start(), m.start() + len(block)))
            block = m[0][len(block) :]
        else:
            block = m[0]
        more += [("der_key", m.end() - len(block) + a, m.end() - len(block) + b) for a, b in _wrapped_keys(block)]
    for m in ANY_HEX.finditer(text):
        kind = _confirmed(m[0], "hex_key", bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))
        if kind:
            more.append((kind, *m.span()))
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            at = m[1].find("eyJ")
            if at >= 0 and is_signed_token(m[1][at:], m[2]):
                more.append(("signed_token", m.start() + at, m.end()))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(set(base), key=order), sorted(set(more), key=order)


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            parts += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined).

    Spans are in code points over the whole text, found in linear time; a null text counts as empty. spans holds base and added spans. Rows
    that repeat stay repeated, other columns are ignored, no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = find(text or "")
                kinds = [k for k, _, _ in base]
                every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            n = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in n[:3]), *(pa.array(c, pa.string()) for c in n[3:])], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each secret, overlapping ones together, replaced by MARK; null texts, other columns and repeated rows stay."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _masked(t, s) if (s := sum(find(t), [])) else t for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, of(F.col(text_col)))
