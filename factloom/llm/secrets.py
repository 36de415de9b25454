"""Secret scans: candidates by pattern, then structural confirmation by decoding them.

Base64 and hex runs are decoded; what comes out must parse as a private key (nested DER lengths that add up
to one of its structures, or the length-prefixed fields of an OpenSSH key), and a dotted token must open with a JSON header that
names an algorithm.  Python looks only at texts that hold a candidate at all, which a byte search over
whole batches tells.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import Piece, pieces, runs

# The kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("token", "key", "pem")

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]+)-----\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n)*)([A-Za-z0-9+/=\s]+?)-----END \1-----"
)

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[[*b"0123456789abcdef"]] = True
_IS_CODE = np.zeros(256, dtype=bool)
_IS_CODE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-."]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

SPAN = "struct<kind: string, start: bigint, end: bigint, base: boolean, form: string>"
_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("form", pa.string())]
)


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """The length written at `at` and where the content begins; None if it is malformed."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if n == 0 or n > 4 or at + 1 + n > len(data):
        return None
    size = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    if size < 0x80 or data[at + 1] == 0:
        return None
    return size, at + 1 + n


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tag and content of a run of DER items whose lengths, nested ones too, use up all bytes; else None."""
    items, at = [], 0
    while at < len(data):
        tag = data[at]
        sized = der_length(data, at + 1)
        if tag in (0, 0xFF) or sized is None or sized[1] + sized[0] > len(data):
            return None
        body = data[sized[1] : sized[1] + sized[0]]
        if tag & 0x20 and (depth > 12 or der_items(body, depth + 1) is None):
            return None
        items.append((tag, body))
        at = sized[1] + sized[0]
    return items


_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
# The object ids under which password-based encryption schemes stand (PKCS #5 and #12).
_ENCRYPTION_IDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_LEAST_SECRET = 16


def _sequence(data: bytes) -> list[tuple[int, bytes]] | None:
    """The items of `data` if it is one whole DER sequence."""
    items = der_items(data)
    return der_items(items[0][1]) if items and len(items) == 1 and items[0][0] == _SEQUENCE else None


def private_key(data: bytes) -> str | None:
    """The structure of a whole DER private key (`rsa`, `dsa`, `ec`, `pkcs8`, `encrypted`), or None.

    By RFC 8017, RFC 5915, RFC 5208 and the older form of DSA keys.  The octet string of a PKCS #8 key
    must hold a key itself: one of these structures, or a secret number or string of 16 bytes at least.
    Public keys, certificates, signatures and digests have other structures.
    """
    items = _sequence(data)
    if not items:
        return None
    tags = [tag for tag, _ in items]
    version = int.from_bytes(items[0][1], "big") if tags[0] == _INTEGER and len(items[0][1]) == 1 else None
    if version in (0, 1) and tags[:9] == [_INTEGER] * 9 and tags[9:] in ([], [_SEQUENCE]):
        return "rsa"
    if version == 0 and tags == [_INTEGER] * 6:
        return "dsa"
    if version == 1 and tags[1:2] == [_OCTETS] and set(tags[2:]) <= {0xA0, 0xA1} and len(items[1][1]) >= _LEAST_SECRET:
        return "ec"
    if version in (0, 1) and tags[1:3] == [_SEQUENCE, _OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        algorithm, inner = der_items(items[1][1]), items[2][1]
        if not algorithm or algorithm[0][0] != _OID:
            return None
        own = der_items(inner)
        single = own and len(own) == 1 and own[0][0] in (_INTEGER, _OCTETS) and len(own[0][1]) >= _LEAST_SECRET
        return "pkcs8" if single or private_key(inner) in ("rsa", "dsa", "ec") else None
    if tags == [_SEQUENCE, _OCTETS] and len(items[1][1]) >= _LEAST_SECRET:
        algorithm = der_items(items[0][1])
        if algorithm and algorithm[0][0] == _OID and algorithm[0][1].startswith(_ENCRYPTION_IDS):
            return "encrypted"
    return None


def openssh_key(data: bytes) -> bool:
    """Whether the bytes are one whole OpenSSH private key: three names, a count, public keys, the private part."""
    at = 15
    if data[:at] != b"openssh-key-v1\0":
        return False

    def string() -> int:
        """Skips a string with its length before it and gives that length, -1 if it is cut off."""
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        whole = at + 4 + size <= len(data)
        at += 4 + size
        return size if whole else -1

    if min(string() for _ in range(3)) < 0:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or min(string() for _ in range(keys)) <= 0:
        return False
    return string() >= _LEAST_SECRET and at == len(data)


def key_form(data: bytes) -> str | None:
    """`der` or `openssh` if the bytes are one whole encoded private key, else None."""
    if openssh_key(data):
        return "openssh"
    if len(data) < 24 or data[0] != _SEQUENCE:
        return None
    return "der" if private_key(data) else None


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_header(text: str) -> bool:
    """Whether a token's first part is a JSON object that names its algorithm."""
    raw = from_base64(text)
    if raw is None or not raw.lstrip().startswith(b"{"):
        return False
    try:
        header = json.loads(raw)
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def encrypted_pem(label: str, headers: str, raw: bytes) -> bool:
    """Whether a block is an encrypted private key of the older form: its headers name cipher and vector."""
    lines = dict(line.split(":", 1) for line in headers.splitlines() if ":" in line)
    cipher, _, vector = lines.get("DEK-Info", "").strip().partition(",")
    return (
        label.endswith("PRIVATE KEY")
        and lines.get("Proc-Type", "").strip() == "4,ENCRYPTED"
        and bool(cipher)
        and re.fullmatch(r"(?:[0-9A-Fa-f]{16}){1,2}", vector.strip()) is not None
        and len(raw) >= _LEAST_SECRET
        and len(raw) % 8 == 0
    )


def decoded_form(text: str) -> str | None:
    """What a candidate proves to be once decoded from hex or base64: `der`, `openssh`, or None."""
    if len(text) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", text) and (form := key_form(bytes.fromhex(text))):
        return form
    raw = from_base64(text)
    return key_form(raw) if raw else None


def spans_of(text: str) -> list[tuple[str, int, int, bool, str | None]]:
    """All spans of one text: (kind, start, end, base, form), by start and then kind; code points."""
    found: list[tuple[str, int, int, bool, str | None]] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            form = "signed" if m[2].count(".") == 2 and signed_header(m[2].split(".")[0]) else decoded_form(m[2])
            found.append(("assign", m.start(), m.end(), True, form))
    for m in ACCESS.finditer(text):
        if len(m[0]) >= 20:
            found.append(("access", m.start(), m.end(), True, None))
    for m in HEX.finditer(text):
        found.append(("hex", m.start(), m.end(), True, decoded_form(m[0])))
    for m in DOTTED.finditer(text):
        if signed_header(m[1]) and (from_base64(m[2]) or b"").lstrip()[:1] == b"{":
            found.append(("token", m.start(), m.end(), False, "signed"))
    for m in ENCODED.finditer(text):
        if form := decoded_form(m[0]):
            found.append(("key", m.start(), m.end(), False, form))
    for m in PEM.finditer(text):
        raw = from_base64(re.sub(r"\s+", "", m[3]))
        if raw and (form := "encrypted" if encrypted_pem(m[1], m[2], raw) else key_form(raw)):
            found.append(("pem", m.start(), m.end(), False, form))
    order = {kind: i for i, kind in enumerate(BASE_KINDS + ADDED_KINDS)}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def _rows_with(piece: Piece) -> np.ndarray:
    """The rows that hold any candidate."""
    raw = piece.data.tobytes()
    small = raw.translate(_LOWER)
    at: list[int] = []
    for text, needles in ((small, _WORDS), (raw, (b"AKIA", b"-----BEGIN"))):
        for needle in needles:
            i = text.find(needle)
            while i >= 0:
                at.append(i)
                i = text.find(needle, i + len(needle))
    rows = [np.array(at, dtype=np.int64)]
    for inside, least in ((_IS_HEX[piece.data], 24), (_IS_CODE[piece.data], 40)):
        starts, ends = runs(inside, piece.offsets)
        rows.append(starts[ends - starts >= least])
    # a dotted token may be short; its header begins with the encoded form of an opening brace
    i = raw.find(b"ey")
    short = []
    while i >= 0:
        if DOTTED_BYTES.match(raw, i):
            short.append(i)
        i = raw.find(b"ey", i + 2)
    rows.append(np.array(short, dtype=np.int64))
    return np.unique(np.searchsorted(piece.offsets, np.concatenate(rows), side="right") - 1)


DOTTED_BYTES = re.compile(rb"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.")


def _spans(text: pa.Array) -> pa.Array:
    found: list[list] = [[]] * len(text)
    for piece in pieces(text):
        for row in _rows_with(piece):
            found[piece.first + row] = [
                dict(zip(("kind", "start", "end", "base", "form"), s, strict=True)) for s in spans_of(piece.text(row))
            ]
    return pa.array(found, pa.list_(_SPAN))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """`docs` with the column `out`: all secret spans of the whole text, by start and kind.

    A null or empty text has none.  Base spans (`assign`, `access`, `hex`) are reported as their patterns
    say; `form` tells what they proved to be when decoded.  `token`, `key` and `pem` spans are added only
    after confirmation.  Offsets are code points, ends exclusive.  Rows are independent, so repeated rows
    get equal results; a column named like `out` is replaced and all other columns are kept.
    """
    spans = F.arrow_udf(_spans, f"array<{SPAN}>")
    return docs.withColumn(out, spans(F.col(f"`{text}`")))


def _listed(spans: Column) -> Column:
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def secret_scan_query(docs: DataFrame) -> DataFrame:
    out = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    s = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")

    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(F.filter(s, lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"),
        _listed(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["form"].isNotNull())).cast("long").alias("n_confirmed"),
    )
