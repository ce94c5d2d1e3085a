"""Secret scan with structural confirmation.

Three patterns give the base spans: assignments to secret names, access key
ids, long hexadecimal strings. Beyond them, candidates are decoded and parsed
before they are reported: base64 and hexadecimal runs as DER keys (nested
lengths must fill the value exactly) and as OpenSSH key containers (length
prefixed fields), also where base64 is wrapped over lines, PEM blocks by their
decoded body (without headers; line ends may be escaped as in JSON), and dotted
tokens by their JSON header, payload and signature. A base span is reported whatever its
inside; whether it decodes to such a structure is told beside it.

One scan of each text by the task that reads it, no shuffle; a pattern runs
only on texts that hold its fixed part.

Cases: null and empty texts have no spans; positions are code points, ends
exclusive; spans that start together come in the order of ``KINDS``; repeated
rows stay; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "pem", "der", "ssh")

ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Runs of the classes are taken whole, so a run is tried once, at its start.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: A DER value in hexadecimal of either case.
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{22,}")
#: The next line of wrapped base64; the line end may be escaped.
WRAPPED = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*([A-Za-z0-9+/_-]+)={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
NAMES = ("passw", "secret", "token", "apikey", "api_key")


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 or base64url, with or without padding; None if it is neither."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill ``data[at:end]`` exactly, else None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes | None) -> bool:
    """A private key: one SEQUENCE that fills the data and begins with a small
    version, followed as in PKCS#8 (algorithm, octets), PKCS#1 (eight
    integers), DSA (five) or SEC 1 (octets)."""
    if not data or data[0] != 0x30:
        return False
    outer = tlv(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    parts = tlv(data, *outer[0][1:])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    tags = [p[0] for p in parts]
    if tags[1] == 0x30:
        algorithm = tlv(data, *parts[1][1:])
        return len(tags) >= 3 and tags[2] == 0x04 and bool(algorithm) and algorithm[0][0] == 0x06
    if tags[1] == 0x02:
        if len(tags) == 6 and set(tags) == {0x02}:  # DSA: p, q, g, y, x
            p, q, g, y, x = (end - start for _, start, end in parts[1:])
            return data[parts[0][1]] == 0 and 20 <= q < p and max(g, y) <= p and 0 < x <= q
        return len(tags) >= 9 and set(tags[:9]) == {0x02}
    return tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16


def is_ssh_key(data: bytes | None) -> bool:
    """An OpenSSH container: its magic, then length-prefixed fields that stay inside."""
    magic = b"openssh-key-v1\0"
    if not data or not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at:at + 4], "big") <= 64


def is_token(text: str) -> bool:
    """A signed token: JSON header with an algorithm, JSON payload, and a
    signature unless the algorithm is none."""
    parts = text.split(".")
    if len(parts) != 3:
        return False
    try:
        header, payload = (json.loads(unbase64(p) or b"") for p in parts[:2])
    except ValueError:
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    signature = unbase64(parts[2])
    return not parts[2] if header["alg"].lower() == "none" else bool(signature)


def unhex(text: str) -> bytes:
    return bytes.fromhex(text[:len(text) & ~1])


def structure(text: str) -> str | None:
    """What a secret's characters decode to, if anything known."""
    if "." in text:
        return "token" if is_token(text) else None
    if HEX_DER.fullmatch(text):
        data = unhex(text)
        if is_der_key(data):
            return "der"
    data = unbase64(text)
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def key_size(data: bytes) -> int | None:
    """Bytes of the key that ``data`` begins with, by its own lengths; None if
    it does not begin like one, or the lengths lie beyond ``data``."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at, fields = len(magic), 3
        while fields:  # cipher, key derivation, its options, number of keys, public keys, private part
            if at + 4 > len(data):
                return None
            at, fields = at + 4 + int.from_bytes(data[at:at + 4], "big"), fields - 1
            if fields == 0 and at + 4 <= len(data) and magic:
                keys, at, magic = int.from_bytes(data[at:at + 4], "big"), at + 4, b""
                if not 1 <= keys <= 64:
                    return None
                fields = keys + 1
        return None if magic else at
    n = data[1] & 0x7F if len(data) > 1 and data[1] & 0x80 else 0
    if n > 4 or data[:1] != b"\x30" or data[2 + n:4 + n] != b"\2\1":
        return None
    return 2 + n + (int.from_bytes(data[2:2 + n], "big") if n else data[1])


def wrapped(text: str, start: int, end: int) -> tuple[str, int] | None:
    """(kind, end) of a key in base64 that begins with the run ``text[start:end]``
    and goes on in the next lines, until its own lengths are filled."""
    first = text[start:end].rstrip("=")
    head = unbase64(first[:len(first) & ~3]) or b""
    if not head.startswith(b"openssh-key-v1\0") and key_size(head) is None:
        return None
    runs, many = [first], len(first)
    while m := WRAPPED.match(text, end):
        runs.append(m[1])
        many, end = many + len(m[1]), m.end()
        size = key_size(head)
        if size is None or head.startswith(b"open"):
            joined = "".join(runs)
            head = unbase64(joined[:many & ~3]) or b""
            runs, size = [joined], key_size(head)
        need = None if size is None else (8 * size + 5) // 6
        if need is not None and many >= need:
            # a container may be padded at its end; what lies beyond that is another line
            data = unbase64("".join(runs))
            kind = "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None
            return (kind, end) if kind and many - need < 4 else None
    return None


def pem_blocks(text: str):
    """(start, end, label, body) of each block: from the last BEGIN line before an END line of the same label."""
    found, ends = list(PEM.finditer(text)), {}
    last = {}
    for m in reversed(found):
        following = last.get(m[1])
        last[m[1]] = m.start()
        mark = f"-----END {m[1]}-----"
        end = text.find(mark, m.end(), len(text) if following is None else following)
        if end >= 0:
            ends[m.start()] = m.start(), end + len(mark), m[1], text[m.end():end]
    return [ends[m.start()] for m in found if m.start() in ends]


def pem_data(body: str) -> bytes | None:
    """Decoded body of a block, without its headers and their folded lines."""
    kept, header = [], None
    for line in re.sub(r"\\+[rn]", "\n", body).splitlines():
        indent = len(line) - len(line.lstrip())
        if ":" in line:
            header = indent
        elif header is None or indent <= header or not line.strip():
            header = None
            kept.append(line)
    return unbase64("".join("".join(kept).split()))


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(all spans, base spans whose inside is confirmed), each (start, kind, end), in order."""
    if not text:
        return [], []
    spans, sure = [], []
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((m.start(), "assign", m.end()))
                if structure(m[2]):
                    sure.append(spans[-1])
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    for m in HEX.finditer(text):
        spans.append((m.start(), "hex", m.end()))
        if m[0].startswith("30") and is_der_key(unhex(m[0])):
            sure.append(spans[-1])
            spans.append((m.start(), "der", m.end()))
    spans += [(m.start(), "der", m.end()) for m in HEX_DER.finditer(text) if is_der_key(unhex(m[0]))]
    if "ey" in text or "ew" in text:
        spans += [(m.start(), "token", m.end()) for m in TOKEN.finditer(text) if is_token(m[0])]
    blocks = []
    if "-----BEGIN " in text:
        for start, end, label, body in pem_blocks(text):
            data = pem_data(body)
            # an encrypted body is no DER value; its headers tell so
            if is_der_key(data) or is_ssh_key(data) or (data and "ENCRYPTED" in label + body):
                spans.append((start, "pem", end))
                blocks.append((start, end))
    for m in BASE64.finditer(text):
        if m[0][0] in "Mb" and not any(a <= m.start() < b for a, b in blocks):
            more = wrapped(text, m.start(), m.end())
            kind, end = more or (structure(m[0]), m.end())
            if kind in ("der", "ssh"):
                spans.append((m.start(), kind, end))
                blocks.append((m.start(), end))
    rank = KINDS.index
    key = lambda s: (s[0], rank(s[1]), s[2])
    return sorted(set(spans), key=key), sorted(set(sure), key=key)


def digits(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, confirmed (the
    base spans that decode to a known structure)."""
    fields = [T.StructField("c0", docs.schema[doc_id].dataType)]
    fields += [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    fields += [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "confirmed")]

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            base = [[s for s in all_ if s[1] in BASE] for all_, _ in found]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in BASE]
            columns.append(pa.array([hashlib.sha256(digits(b).encode()).hexdigest() for b in base], pa.string()))
            columns += [pa.array([digits(x[k]) for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(f"`{doc_id}`").alias("c0"), F.col(f"`{text}`").cast("string").alias("text")) \
        .mapInArrow(run, T.StructType(fields)).withColumnRenamed("c0", doc_id)


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """All rows and columns; every reported span of ``text`` is replaced by ``mask``."""
    @F.pandas_udf("string")
    def cover(texts):
        return texts.map(lambda t: t if t is None else _covered(t, mask))

    return docs.withColumn(text, cover(text))


def _covered(text: str, mask: str) -> str:
    out, at = [], 0
    for start, _, end in scan(text)[0]:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
