"""Secret scans with structural confirmation: what is decoded and parsed, not only matched, is reported as a structure.

Base kinds are regular expressions. The structural kinds come from candidates in base64, URL-safe base64 or hex, on one line or
wrapped (lines of one length and a shorter last one), in hex with colons, and in PEM armour; a key inside a PEM block is
reported beside the block. What decodes to text again is looked into up to NESTED times (base64 of a PEM block, of hex ...).

* ``der``: decodes to a key in DER: nested lengths that fill their parents exactly, and the fields of PKCS#1 (private or
  public), DSA, PKCS#8 (plain or encrypted), SEC1 or SubjectPublicKeyInfo in their places.
* ``openssh``: decodes to the openssh-key-v1 container with a whole chain of length-prefixed fields.
* ``sshwire``: decodes to an SSH public key: a known algorithm name, and length-prefixed fields to the very end.
* ``jwt``: three dot-joined parts, of which the first two decode to JSON objects and the header names an algorithm.
* ``pem``: a PEM block of a key whose body decodes to one of the structures above; one with encryption headers, whose body is
  whole blocks of the cipher that they name.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from causeway.llm.textbatch import blocks
from causeway.runtime import lean, ship

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "der", "openssh", "sshwire", "jwt", "pem")

#: The base patterns. Whole runs are consumed first, short ones dropped afterwards.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: The shortest structure is an SSH key of 15 bytes, so shorter candidates can't be confirmed.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){15,}+(?![0-9A-Fa-f])")
COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[ \t]*+(?:\r?\n[ \t]*+)?[0-9A-Fa-f]{2}){14,}+(?![0-9A-Fa-f:])")
NOT_HEX = re.compile(r"[^0-9A-Fa-f]+")
#: How many encodings may be wrapped around a key.
NESTED = 3
#: Wrapped base64 or hex: lines of one length and, if there is one, a shorter last line are one candidate.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++={0,2}(?![A-Za-z0-9+/_=-]))+")
LINE = re.compile(r"[A-Za-z0-9+/_-]+(=*)")
LEAST_WIDTH = 16
#: A JSON object begins with a brace or white space, so its base64 with one of four letters.
JWT = re.compile(r"(?<![A-Za-z0-9_.-])([eICD][A-Za-z0-9_-]{3,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)")
PEM_EDGE = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,4}(?:PRIVATE|PUBLIC) KEY)-----")
PEM_HEADER = re.compile(r"^[ \t]*([A-Za-z0-9-]+):[ \t]*([^\n]*)$", re.MULTILINE)
#: Ciphers of encrypted PEM bodies, and the length of their blocks.
CIPHERS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
#: Object identifiers of key algorithms, in DER, and the arc of password-based encryption schemes.
PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OIDS = {
    bytes.fromhex("2a864886f70d010101"): "rsaEncryption",
    bytes.fromhex("2a8648ce3d0201"): "ecPublicKey",
    bytes.fromhex("2a8648ce380401"): "dsa",
    bytes.fromhex("2b656e"): "x25519",
    bytes.fromhex("2b6570"): "ed25519",
}
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_MAGIC = b"openssh-key-v1\x00"
#: Fields of a public key of each algorithm, its name included.
SSH_FIELDS = dict(zip(SSH_NAMES, (3, 5, 2, 3, 3, 3), strict=True))


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None if it can't be any."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at `at`, if its length is minimal and ends by `end`."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        x = tlv(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def _algorithm(data: bytes, x: tuple[int, int, int]) -> bool:
    inner = children(data, x[1], x[2]) if x[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]] in OIDS


def der_key(data: bytes) -> str | None:
    """pkcs1, pkcs8, sec1 or spki if the data is one such key from its first to its last byte."""
    top = tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    inside = children(data, top[1], top[2])
    if not inside:
        return None
    tags = [x[0] for x in inside]
    number = lambda x: int.from_bytes(data[x[1] : x[2]], "big")
    if tags[0] == 0x02 and inside[0][2] - inside[0][1] == 1 and number(inside[0]) in (0, 1):
        if len(tags) >= 9 and set(tags[:9]) == {0x02} and inside[1][2] - inside[1][1] >= 32:
            return "pkcs1"
        if tags == [0x02] * 6 and inside[1][2] - inside[1][1] >= 32:
            return "dsa"
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and _algorithm(data, inside[1]):
            return "pkcs8"
        if len(tags) >= 2 and tags[1] == 0x04 and number(inside[0]) == 1 and 16 <= inside[1][2] - inside[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return "sec1"
    if tags == [0x02, 0x02] and inside[0][2] - inside[0][1] >= 64 and inside[1][2] - inside[1][1] <= 4:
        return "rsa"
    if tags == [0x30, 0x03] and _algorithm(data, inside[0]):
        return "spki"
    if tags == [0x30, 0x04] and inside[1][2] - inside[1][1] >= 16:
        scheme = children(data, *inside[0][1:])
        if scheme and len(scheme) == 2 and scheme[0][0] == 0x06 and data[slice(*scheme[0][1:])].startswith(PBE) and scheme[1][0] == 0x30 and children(data, *scheme[1][1:]):
            return "encrypted"
    return None


def _fields(data: bytes, at: int) -> list[bytes] | None:
    """Fields with 32-bit lengths that end exactly with the data."""
    out = []
    while at < len(data):
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data):
            return None
        out.append(data[at + 4 : end])
        at = end
    return out


def ssh_wire(data: bytes) -> bool:
    """An algorithm's name and as many fields as its public keys have."""
    if len(data) < 15 or data[:3] != bytes(3) or data[4 : 4 + data[3]] not in SSH_FIELDS:
        return False
    fields = _fields(data, 0)
    return bool(fields) and len(fields) == SSH_FIELDS[fields[0]]


def openssh(data: bytes) -> bool:
    """Magic, cipher, key derivation and its options, the number of keys (always one), then the public and the private part."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if data[at : at + 4] != b"\0\0\0\1":
        return False
    fields = _fields(data, at + 4)
    return fields is not None and len(fields) == 2 and ssh_wire(fields[0])


def structure(data: bytes | None, nested: int = NESTED) -> str | None:
    """The kind of key that the bytes are, or that they are the text of."""
    if not data:
        return None
    if der_key(data):
        return "der"
    if openssh(data):
        return "openssh"
    if ssh_wire(data):
        return "sshwire"
    if nested and len(data) >= 20 and data.isascii():
        text = data.decode().strip()
        if "-----BEGIN " in text:
            return "pem" if pem_spans(text) else None
        joined = "".join(text.split())
        for candidate, decode in ((LONG_HEX, bytes.fromhex), (BASE64, decode64)):
            if candidate.fullmatch(joined) and (kind := structure(decode(joined), nested - 1)):
                return kind
    return None


def _confirmed(label: str, body: str) -> bool:
    """Whether a PEM body holds the key that its label and headers speak of."""
    body = body.replace("\\r", "").replace("\\n", "\n")  # as in a JSON string
    headers = dict(PEM_HEADER.findall(body))
    data = decode64("".join(PEM_HEADER.sub("", body).split()))
    if not data:
        return False
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        block = CIPHERS.get(headers.get("DEK-Info", "").split(",")[0].strip().upper())
        return bool(block) and len(data) >= 16 and len(data) % block == 0
    if label.startswith("ENCRYPTED"):
        return der_key(data) == "encrypted"
    return structure(data, 0) is not None


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Blocks from a BEGIN line to the END line of its label that comes next, with no other BEGIN between them."""
    out, opened = [], None
    for m in PEM_EDGE.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened and opened[2] == m[2]:
            if _confirmed(m[2], text[opened.end() : m.start()]):
                out.append((opened.start(), m.end()))
            opened = None
    return out


def unhex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def key_ends(peek: Callable[[int, int], bytes], size: int) -> list[int]:
    """Where a key that starts at byte 0 of so many would end, or nothing; peek(at, n) gives n bytes or fewer."""
    head = peek(0, 6)
    if head[:1] == b"\x30" and len(head) == 6:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        return [2 + n + int.from_bytes(head[2 : 2 + n], "big") if n else 2 + head[1]] if n <= 4 else []

    def walk(at: int, most: int) -> list[int]:
        out = []
        while len(out) < most and at + 4 <= size and (at := at + 4 + int.from_bytes(peek(at, 4), "big")) <= size:
            out.append(at)
        return out

    if head == SSH_MAGIC[:6] and peek(0, len(SSH_MAGIC)) == SSH_MAGIC:
        opening = walk(len(SSH_MAGIC), 3)
        return walk(opening[2] + 4, 2)[1:] if len(opening) == 3 and peek(opening[2], 4) == b"\0\0\0\1" else []
    if head[:3] == bytes(3) and head[3:4] and peek(4, head[3]) in SSH_FIELDS:
        usual = SSH_FIELDS[peek(4, head[3])]
        return walk(0, usual)[usual - 1 :]
    return []


def wrapped_keys(lines: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Spans of keys in consecutive lines (start, end, digits, padded): each from a line's start to a line's end, over two lines at least."""
    out, first = [], 0
    while first < len(lines):
        width, last = len(lines[first][2]), first
        while last < len(lines) and len(lines[last][2]) == width and not lines[last][3]:
            last += 1
        # the shorter line is a part of the candidate only if the key ends there
        full, upto = last - first, last + (last < len(lines) and len(lines[last][2]) < width)
        text = "".join(x[2] for x in lines[first:upto])
        i = 0
        while width >= LEAST_WIDTH and i < full:
            many, kind = _wrapped_key(text, i * width, width, full * width)
            if kind:
                out.append((lines[first + i][0], lines[first + i + many - 1][1], kind))
            i += max(1, many)
        first = max(last, first + 1)
    return out


def _wrapped_key(text: str, start: int, width: int, full: int) -> tuple[int, str | None]:
    """Number of lines and kind of the key that starts there; `full` digits are in lines of the whole width."""
    digits = len(text) - start
    for decode, bits in ((decode64, 6), (unhex, 4)):
        unit = 4 if bits == 6 else 2

        def peek(at: int, n: int, decode=decode, bits=bits, unit=unit) -> bytes:
            a, b = at * 8 // (bits * unit) * unit, -(-(at + n) * 8 // (bits * unit)) * unit
            skip = at - a * bits // 8
            try:
                return (decode(text[start + a : start + min(b, digits)]) or b"")[skip : skip + n]
            except ValueError:
                return b""

        for end in key_ends(peek, digits * bits // 8):
            size = -(-end * 8 // bits)
            whole = size % width == 0 and start + size <= full
            if size <= width or not (whole or size == digits):
                continue
            try:
                kind = structure(decode(text[start : start + size]))
            except ValueError:
                kind = None
            if kind:
                return -(-size // width), kind
    return 0, None


def signed_token(header: str, payload: str) -> bool:
    """Whether both parts decode to JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads((decode64(x) or b"").decode()) for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and bool(head["alg"])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base kinds, leftmost and non-overlapping in each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of candidates that decode to a key or a signed token."""
    out = []
    out += [(*m.span(), "jwt") for m in JWT.finditer(text) if signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        out += [(a, b, "pem") for a, b in pem_spans(text)]
    for m in BASE64.finditer(text):
        if kind := structure(decode64(m[0])):
            out.append((*m.span(), kind))
    for m in LONG_HEX.finditer(text):
        if kind := structure(bytes.fromhex(m[0])):
            out.append((*m.span(), kind))
    for m in COLONS.finditer(text):
        if kind := structure(bytes.fromhex(NOT_HEX.sub("", m[0]))):
            out.append((*m.span(), kind))
    for m in WRAPPED.finditer(text):
        out += wrapped_keys([(x.start(), x.end(), x[0].rstrip("="), bool(x[1])) for x in LINE.finditer(text, *m.span())])
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans, by start and then kind; positions are code points, ends exclusive."""
    return sorted({*base_spans(text), *structural_spans(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed.

    spans lists every span as kind:start:end, by start and then kind; base_sha256 is the hash of the base kinds' list;
    n_confirmed counts structural spans. Null and empty texts have none. Repeated rows, doc_ids and missing ones give a
    row each. Other columns are ignored; an empty table gives no rows. Whole texts are searched, however long, in time
    that grows in proportion to them.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in blocks(batches):
            found = [spans(t) if t else [] for t in part.column(1).to_pylist()]
            joined = [",".join(f"{k}:{a}:{b}" for a, b, k in s) for s in found]
            base = [",".join(f"{k}:{a}:{b}" for a, b, k in s if k in KINDS[:3]) for s in found]
            counts = [pa.array([sum(k == kind for _, _, k in s) for s in found], pa.int64()) for kind in KINDS[:3]]
            confirmed = pa.array([sum(k in KINDS[3:] for _, _, k in s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([sha256(b.encode()).hexdigest() for b in base]), pa.array(joined, pa.string()), confirmed], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
