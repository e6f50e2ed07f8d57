"""Secret scan: patterns find base spans, and structural confirmation finds keys and signed tokens.

Runs of base64 or hex are decoded and reported only if what they hold parses to its end: a DER key (nested lengths
that add up, the shape of a known key kind), an OpenSSH private key, a PEM block around either, or a signed token
whose header names an algorithm. A PEM block whose body is enciphered counts if its headers name a known cipher, the
starting vector has that cipher's size and the body decodes to whole blocks of it.

A key may begin anywhere inside a run, go on over lines, real or escaped, and be written in hex with colons.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map

#: The base patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)(?:[A-Za-z0-9+/=\s:,.-]|\\{1,4}[nr/]))*+)-----END \1-----")
#: Where a key may begin inside a run or go on over lines: a DER sequence of 30 bytes or more, the OpenSSH magic.
_START = re.compile(r"M[A-I](?=[A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXktdjEAAAAA")
_ESCAPED_END = re.compile(r"\\{1,4}[nr]")
_ESCAPED_SLASH = re.compile(r"\\{1,4}/")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAK = re.compile(r"(?:\r?\n|(?:\\{1,4}r)?\\{1,4}n)[ \t]*(?=[A-Za-z0-9+/_=-])|\\{1,4}(?=/)")
#: The head of a DER key in hex: a sequence, its length, a version or another sequence; or the OpenSSH magic.
_HEX_START = re.compile(
    r"30(?P<s>:?)(?:[0-7][0-9a-f]|81(?P=s)[0-9a-f]{2}|82(?:(?P=s)[0-9a-f]{2}){2}|83(?:(?P=s)[0-9a-f]{2}){3})(?P=s)(?:02(?P=s)01(?P=s)0[01]|30)"
    r"|6f(?P<t>:?)70" + "".join(rf"(?P=t){b:02x}" for b in b"enssh-key-v1"),
    re.IGNORECASE,
)
_HEX_BYTE = re.compile(r"[0-9A-Fa-f]{2}")
_HEX_BREAK = re.compile(r":?(?:\r?\n|(?:\\{1,4}r)?\\{1,4}n)[ \t]*|:")
_DEK = re.compile(r"^DEK-Info: ?([A-Z0-9-]+),([0-9A-Fa-f]+)\s*$", re.MULTILINE)
#: Bytes a block of the ciphers that PEM headers name.
BLOCKS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})")


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the elements that fill data[start:end] exactly, else None."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def der_key(data: bytes) -> str | None:
    """The kind of private key that data holds in DER: pkcs8, encrypted, rsa, ec or dsa."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    items = der_items(data, top[0][1], top[0][2])
    if not items:
        return None
    tags = [t for t, _, _ in items]
    number = int.from_bytes(data[items[0][1] : items[0][2]], "big") if tags[0] == 0x02 and items[0][2] - items[0][1] <= 2 else None
    if number in (0, 1) and tags[1:3] == [0x30, 0x04] and _oid_first(data, items[1]):
        return "pkcs8"
    if number in (0, 1) and tags == [0x02] * 9 and items[1][2] - items[1][1] >= 32:
        return "rsa"
    if number == 0 and tags == [0x02] * 6 and items[1][2] - items[1][1] >= 32:
        return "dsa"
    if number == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]) and 16 <= items[1][2] - items[1][1] <= 66:
        return "ec"
    if tags == [0x30, 0x04] and _oid_first(data, items[0]):
        return "encrypted"
    return None


def _oid_first(data: bytes, item: tuple[int, int, int]) -> bool:
    inner = der_items(data, item[1], item[2])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: its magic, and length-prefixed fields that end where it ends."""
    return openssh_size(data) == len(data) > 0


def openssh_size(data: bytes) -> int:
    """How many bytes the OpenSSH private key takes that data begins with, 0 if it begins with none.

    Negative where data ends too early: at least so many bytes are needed.
    """
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            at += 4
            return None
        (size,) = struct.unpack(">I", data[at : at + 4])
        at += 4 + size
        return data[at - size : at] if at <= len(data) else None

    cipher = field()
    kdf = None if cipher is None else field()
    options = None if kdf is None else field()
    if at > len(data) or None in (cipher, kdf, options):
        return -at
    if not cipher:
        return 0
    if at + 4 > len(data):
        return -at - 4
    (keys,) = struct.unpack(">I", data[at : at + 4])
    at += 4
    if not 1 <= keys <= 16:
        return 0
    return at if all(field() is not None for _ in range(keys + 1)) else -at


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if openssh_key(data):
        return "openssh"
    return "der" if data[0] == 0x30 and der_key(data) else None


def key_at(text: str, start: int) -> tuple[str, int] | None:
    """The kind and the end of the key in base64 that begins at start, by the length that it states itself.

    It may go on over lines, real or escaped; what follows it must not be base64.
    """
    ssh = text[start] == "b"
    size = -24 if ssh else der_size(decoded(text[start : start + 16]) or b"")
    if not ssh and size < 30:
        return None
    parts, have, at = [], 0, start
    while True:
        chars = -(-abs(size) * 4 // 3)
        if chars > len(text) - start:
            return None
        while have < chars:
            if m := _PIECE.match(text, at, at + chars - have):
                parts.append(m[0])
                have, at = have + len(m[0]), m.end()
            elif m := _BREAK.match(text, at):
                at = m.end()
            else:
                return None
        data = decoded("".join(parts))
        if size > 0 or not data:
            break
        size = openssh_size(data)
        if size >= 0:
            break
    kind = key_kind(data)
    if not kind or _PIECE.match(text, at):
        return None
    while chars % 4 and text.startswith("=", at):
        chars, at = chars + 1, at + 1
    return kind, at


def hex_key_at(text: str, start: int) -> tuple[str, int] | None:
    """The kind and the end of the key in hex that begins at start; what follows it must not be hex."""
    data, at, need = bytearray(), start, 16
    while True:
        while len(data) < need:
            m = _HEX_BYTE.match(text, at)
            if m is None and data and (gap := _HEX_BREAK.match(text, at)):
                m = _HEX_BYTE.match(text, gap.end())
            if m is None:
                return None
            data += bytes.fromhex(m[0])
            at = m.end()
        size = der_size(bytes(data[:16])) if data[0] == 0x30 else openssh_size(bytes(data))
        if size == 0 or abs(size) > len(text) or len(data) > abs(size):
            return None
        if len(data) == size:
            break
        need = abs(size)
    kind = key_kind(bytes(data))
    return None if not kind or _HEX_BYTE.match(text, at) else (kind, at)


def enciphered(headers: str, data: bytes | None) -> bool:
    """Whether a PEM body is whole blocks of the cipher that its headers name, with a starting vector of its size."""
    m = _DEK.search(headers)
    size = BLOCKS.get(m[1]) if m else None
    return bool(data) and size is not None and "4,ENCRYPTED" in headers and len(data) % size == 0 and len(data) >= 16 and len(m[2]) == 2 * size


def der_size(head: bytes) -> int:
    """The bytes of the DER sequence that begins with head and holds a version or a sequence first, else 0."""
    if len(head) < 9 or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return 0
    inner = head[2 + n : 5 + n]
    if inner[:1] != b"\x30" and inner not in (b"\2\1\0", b"\2\1\1"):
        return 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def signed_token(head: str, body: str, signature: str) -> bool:
    """Whether the three parts are a signed token: a JSON header with an algorithm, a JSON body, a signature."""
    raw = decoded(head)
    if not raw or not raw.lstrip().startswith(b"{"):
        return False
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not header["alg"]:
        return False
    if not re.fullmatch(r"(HS|RS|ES|PS)(256|384|512)|EdDSA|ES256K", header["alg"]):
        return False
    payload = decoded(body)
    try:
        return payload is not None and decoded(signature) is not None and isinstance(json.loads(payload), dict)
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the base patterns, leftmost and not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def structural_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of confirmed keys and tokens."""
    out = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            whole = _ESCAPED_SLASH.sub("/", _ESCAPED_END.sub("\n", m[2]))
            lines = [x for x in whole.split("\n") if ":" not in x]
            body = "".join("".join(lines).split())
            data = decoded(body)
            if key_kind(data) or enciphered(whole, data):
                out.append((m.start(), 3, m.end()))
    known, near, past = sorted((s, e) for s, _, e in out), 0, 0
    for m in _START.finditer(text):
        while near < len(known) and known[near][1] <= m.start():
            near += 1
        if m.start() < past or near < len(known) and known[near][0] <= m.start():
            continue  # inside a find
        if found := key_at(text, m.start()):
            past = found[1]
            out.append((m.start(), KINDS.index(found[0]), past))
    past = 0
    for m in _HEX_START.finditer(text):
        if m.start() >= past and (found := hex_key_at(text, m.start())):
            past = found[1]
            out.append((m.start(), KINDS.index(found[0]), past))
    if "." in text and "ey" in text:
        out += [(m.start(), 6, m.end()) for m in _JWT.finditer(text) if signed_token(m[1], m[2], m[3])]
    return sorted(set(out))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every row: (id_col, n_assign, n_access, n_hex, base_sha256, spans, n_structural, found).

    spans joins kind:start:end of all finds by start, in code points; found has them as structs. base_sha256 is of
    the base kinds (assign, access, hex) alone; structural kinds are pem, der, openssh and jwt. Null counts as
    empty; texts without secrets have a row with zeros; repeated rows each have theirs; ids are cast to long and may
    be null; other columns are not read; an empty table gives an empty result.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_structural", pa.int64()), ("found", span)])

    def run(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in schema} | {"id": batch.column("id")}
        for text in batch.column("text"):
            text = text.as_py() or ""
            base, more = base_spans(text), structural_spans(text)
            every = sorted(base + more)
            for n, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(k == n for _, k, _ in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
            out["n_structural"].append(len(more))
            out["found"].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long, found array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(arrow_map(run, schema), kinds).withColumnRenamed("id", id_col)
