"""Secret scan by structural confirmation.

Three base patterns are reported as they match. Beyond them, runs of base64 or hex characters and armoured blocks are
candidates only: they are decoded and reported once their inside proves them, as kind ``key`` where the
bytes are a private key whose nested lengths all fit (DER of RSA, DSA, EC, PKCS#8 and encrypted PKCS#8; OpenSSH;
OpenPGP packets; JSON web keys with a private member), as kind ``jwt`` where a dotted token's header is a JSON object that names
its algorithm and its claims are a JSON object. Decoded bytes that are text are scanned again, so a
secret inside an encoded file is found at the outer run. Public keys, certificates and random strings are not reported.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "key")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")  # one of them is in every assignment
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so shorter ones need no match

_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9]+ )?PRIVATE KEY( BLOCK)?-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)?={0,2}")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_DOTTED = re.compile(r"e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.")  # in every token; quicker to rule out
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
_TEXT = re.compile(rb"[\x09\x0A\x0D\x20-\x7E]{8,}\Z")
_URL_SAFE = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    low = text.lower()
    named = any(name in low for name in _NAMES)
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12] if named else []
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not."""
    run = run.rstrip("=").translate(_URL_SAFE)
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


# DER

def _element(data: bytes, at: int, end: int):
    """(tag, start, stop) of the element at ``at``; None where its definite, shortest-form length does not fit in ``end``."""
    if at + 2 > end:
        return None
    size, start = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end or not data[start]:
            return None
        size, start = int.from_bytes(data[start:start + n], "big"), start + n
        if size < 0x80:
            return None
    return (data[at], start, start + size) if start + size <= end else None


def _children(data: bytes, start: int, end: int):
    """Elements that fill [start, end) exactly; None where they do not."""
    found = []
    while start < end:
        one = _element(data, start, end)
        if one is None:
            return None
        found.append(one)
        start = one[2]
    return found


def der_length(head: bytes) -> int:
    """Bytes that the private key at the start of ``head`` would fill, read from its first few; 0 where it cannot be one."""
    outer = _element(head, 0, 1 << 32) if len(head) >= 12 and head[0] == 0x30 else None
    if outer is None:
        return 0
    inside = head[outer[1]:outer[1] + 3]
    version = inside[:2] == b"\x02\x01" and inside[2:] in (b"\x00", b"\x01")
    return outer[2] if version or inside[:1] == b"\x30" else 0


def is_private_der(data: bytes) -> bool:
    """Whether ``data`` is one private key, all nested lengths fitting."""
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _children(data, outer[1], outer[2])
    if not parts:
        return False
    tags = bytes(p[0] for p in parts)

    def algorithm(part):
        inner = _children(data, part[1], part[2])
        return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]

    sized = [p[2] - p[1] for p in parts]
    if tags == b"\x30\x04":
        return algorithm(parts[0]) and sized[1] >= 8  # encrypted PKCS#8
    if tags[:1] != b"\x02" or sized[0] != 1 or data[parts[0][1]] > 1:
        return False
    if tags[:9] == b"\x02" * 9 and tags[9:] in (b"", b"\x30"):
        return sized[1] > sized[4] > 0 and sized[1] >= 32  # RSA: a modulus longer than its first prime
    if tags == b"\x02" * 6:
        return sized[1] >= sized[2] > 0 and sized[1] >= 32  # DSA
    if tags[:3] == b"\x02\x30\x04":
        return algorithm(parts[1]) and sized[2] >= 2 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    if tags[:2] == b"\x02\x04" and data[parts[0][1]] == 1:
        return 20 <= sized[1] <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])  # EC
    return False


# Other key encodings

MAGIC = b"openssh-key-v1\x00"


def openssh_length(data: bytes) -> int:
    """Bytes of the OpenSSH private key at the start of ``data``; 0 where its nested lengths do not fit."""
    if not data.startswith(MAGIC):
        return 0
    at = len(MAGIC)

    def string():
        nonlocal at
        size = int.from_bytes(data[at:at + 4], "big") if at + 4 <= len(data) else len(data)
        start, at = at + 4, at + 4 + size
        return data[start:at] if at <= len(data) else None

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return 0
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= keys <= len(data):
        return 0
    for _ in range(keys):
        public = string()
        if public is None or not 4 <= 4 + int.from_bytes(public[:4], "big") <= len(public):
            return 0
    private = string()
    return at if private else 0


def is_openpgp(data: bytes) -> bool:
    """Whether ``data`` is a row of packets that starts with a secret key."""
    at, first = 0, True
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80 or at >= len(data):
            return False
        if head & 0x40:
            tag, size = head & 0x3F, data[at]
            if size < 192:
                at += 1
            elif size < 224:
                size, at = ((size - 192) << 8) + data[at + 1] + 192 if at + 1 < len(data) else len(data), at + 2
            elif size == 255:
                size, at = int.from_bytes(data[at + 1:at + 5], "big"), at + 5
            else:
                return False
        else:
            tag, width = (head >> 2) & 0x0F, (1, 2, 4, 0)[head & 3]
            if not width:
                return False
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if first and tag != 5:
            return False
        first, at = False, at + size
    return not first and at == len(data)


def _object(data: bytes | None):
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_private_jwk(data: bytes) -> bool:
    value = _object(data) if data[:1] == b"{" else None
    return value is not None and isinstance(value.get("kty"), str) and any(isinstance(value.get(k), str) for k in ("d", "k"))


def token_end(token: str) -> int:
    """Length of the signed or encrypted token at the start of ``token``; 0 where its header does not prove it."""
    parts = token.split(".")
    header = _object(decoded(parts[0]))
    if header is None or not isinstance(header.get("alg"), str):
        return 0
    if isinstance(header.get("enc"), str):
        return sum(map(len, parts[:5])) + 4 if len(parts) >= 5 and all(parts[k] for k in (2, 3, 4)) else 0
    if _object(decoded(parts[1])) is None or not (parts[2] or header["alg"].lower() == "none"):
        return 0
    return sum(map(len, parts[:3])) + 2


def _armoured(label: str, body: str) -> bool:
    """Whether the lines of an armoured block hold what the label says."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    fields = re.findall(r"^[ \t]*([A-Za-z-]+): (.*)$", body, re.MULTILINE)
    lines = [line.strip() for line in body.split("\n") if ": " not in line]
    if label == "PGP ":
        lines = [line for line in lines if not re.fullmatch(r"=[A-Za-z0-9+/]{4}", line)]
    data = decoded("".join("".join(lines).split()))
    if not data:
        return False
    if label == "PGP ":
        return is_openpgp(data)
    if any(k == "Proc-Type" and "ENCRYPTED" in v for k, v in fields):
        return any(k == "DEK-Info" for k, _ in fields) and len(data) % 8 == 0
    return is_private_der(data) or openssh_length(data) > 0


def _inside(data: bytes | None) -> str | None:
    """Kind of the secret that decoded bytes hold, as a key or as text around one."""
    if not data:
        return None
    if is_private_der(data) or openssh_length(data) or is_private_jwk(data):
        return "key"
    if not _TEXT.match(data):
        return None
    return next((kind for _, _, kind in structural(data.decode("ascii"))), None)


def _in_run(run: str) -> list[tuple[int, int, str]]:
    """Keys that begin anywhere in a base64 run, which may go over line ends; else what its lines hold as texts."""
    place = [i for i, c in enumerate(run) if c not in " \t\r\n"] if re.search(r"\s", run) else None
    plain = run if place is None else "".join(run.split())
    bare = plain.rstrip("=")
    out, free = [], 0
    for m in re.finditer(r"M[A-P]|b3BlbnNzaC1rZXktdjE", bare):
        at = m.start()
        if at < free:
            continue
        if m.group()[0] == "M":
            size = der_length(decoded(bare[at:at + 16]) or b"")
            stop = at + -(-size * 4 // 3)
            good = size and stop <= len(bare) and is_private_der((decoded(bare[at:stop]) or b"")[:size])
        else:
            rest = bare[at:]
            data = decoded(rest[:len(rest) - (len(rest) % 4 == 1)])
            size = openssh_length(data or b"")
            stop, good = at + -(-size * 4 // 3), size > 0
        if good:
            free = stop
            while stop < len(plain) and plain[stop] == "=":
                stop += 1
            out.append((at, stop, "key") if place is None else (place[at], place[stop - 1] + 1, "key"))
    if out:
        return out
    kind = _inside(decoded(plain))
    if kind:
        return [(0, len(run), kind)]
    return [(m.start(), m.end(), kind) for m in re.finditer(r"[^ \t\r\n]+", run) if place is not None and (kind := _inside(decoded(m.group())))]


def _in_hex(run: str) -> list[tuple[int, int, str]]:
    out, free = [], 0
    for m in re.finditer(r"30(?=[0-7]|8[1-4])|6f70656e7373682d6b65792d763100", run, re.IGNORECASE):
        at = m.start()
        if at < free:
            continue
        if len(m.group()) == 2:
            head = run[at:at + 32]
            size = der_length(bytes.fromhex(head[:len(head) // 2 * 2]))
            good = size and at + 2 * size <= len(run) and is_private_der(bytes.fromhex(run[at:at + 2 * size]))
        else:
            size = openssh_length(bytes.fromhex(run[at:at + (len(run) - at) // 2 * 2]))
            good = size > 0
        if good:
            free = at + 2 * size
            out.append((at, free, "key"))
    if not out and len(run) % 2 == 0 and (kind := _inside(bytes.fromhex(run))):
        return [(0, len(run), kind)]
    return out


def structural(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the confirmed secrets; one that lies inside another of its kind is left out."""
    found, opened = [], None
    if "PRIVATE KEY" in text:
        for m in _ARMOUR.finditer(text):
            if m.group(1) == "BEGIN":
                opened = m
            elif opened is not None and opened.group(2, 3) == m.group(2, 3):
                if _armoured(m.group(2) or "", text[opened.end():m.start()]):
                    found.append((opened.start(), m.end(), "key"))
                opened = None
    for m in _TOKEN.finditer(text) if _DOTTED.search(text) else ():
        size = token_end(m.group())
        if size:
            found.append((m.start(), m.start() + size, "jwt"))
    for m in _RUN.finditer(text):
        found += [(m.start() + a, m.start() + b, kind) for a, b, kind in _in_run(m.group())]
        for h in _HEX_RUN.finditer(text, m.start(), m.end()):  # hex characters are base64 characters too
            found += [(h.start() + a, h.start() + b, kind) for a, b, kind in _in_hex(h.group())]
    kept, reach = [], {}
    for a, b, kind in sorted(set(found), key=lambda s: (s[0], -s[1], s[2])):
        if b > reach.get(kind, 0):
            kept.append((a, b, kind))
            reach[kind] = b
    return kept


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """Base and confirmed spans by start, then kind as in ``KINDS``, then end."""
    return sorted(set(base_spans(text) + structural(text)), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan_secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) per row; spans are (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans; repeated rows and null ids give their own rows; an empty table gives an empty result.
    Whole texts are scanned, in time that grows with their length.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in secret_spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, fields)], ["id", "spans"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
