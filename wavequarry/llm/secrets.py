"""Secret scans: keyword prefilter, anchored expressions near hits, checksums.

An Aho-Corasick automaton finds the keywords that every kind but ``hex``
needs; each kind's expression is only tried where one of its keywords starts.
Runs of hexadecimal digits have no keyword and are found by a run-length scan
of the bytes.  Kinds whose format holds a checksum are reported only when it
is right.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import full_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Vendor tokens: 30 base-62 characters, then six that hold their CRC-32.
VENDOR = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
#: Bech32 secret keys: 52 characters of data, then six of checksum, all of one case.
BECH32 = re.compile(r"(AGE-SECRET-KEY-|age-secret-key-|NSEC|nsec)1([A-Z0-9]{58}|[a-z0-9]{58})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
KINDS = ["assign", "access", "hex", "vendor", "jwt", "bech32"]
#: Keyword (lower case) -> kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "vendor", "gho_": "vendor", "ghu_": "vendor", "ghs_": "vendor", "ghr_": "vendor", "npm_": "vendor", "eyj": "jwt",
    "age-secret-key-1": "bech32", "nsec1": "bech32",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MARK = "[secret]"

_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _AUTOMATON.add_word(word, (kind, len(word)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def vendor_checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a vendor token's body."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, r = divmod(value, 62)
        digits = BASE62[r] + digits
    return digits


#: Fixed values of Bech32: its alphabet, and the generators of its checksum.
BECH32_ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def bech32_remainder(prefix: str, data: str) -> int:
    """What the checksum polynomial leaves of a prefix and its data; 1 where the checksum is right, -1 for other letters."""
    prefix, data = prefix.lower(), data.lower()
    places = [BECH32_ALPHABET.find(c) for c in data]
    if min(places) < 0:
        return -1
    value = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *places]:
        top, value = value >> 25, (value & 0x1FFFFFF) << 5 ^ v
        for i, generator in enumerate(BECH32_GENERATORS):
            value ^= generator if top >> i & 1 else 0
    return value


def _is_object(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _accepts(kind: str, found: re.Match) -> bool:
    if kind == "assign":
        return len(found[2]) >= 12
    if kind == "access":
        return len(found[0]) >= 18
    if kind == "vendor":
        return vendor_checksum(found[1][:30]) == found[1][30:]
    if kind == "bech32":
        return found[1].isupper() == found[2].isupper() and bech32_remainder(found[1], found[2]) == 1
    return _is_object(found[1]) and _is_object(found[2])


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "vendor": VENDOR, "jwt": JWT, "bech32": BECH32}


def _hex_runs(raw: bytes, least: int = 16) -> Iterator[tuple[int, int]]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _HEX[np.frombuffer(raw, np.uint8)]
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - begin >= least
    return zip(begin[long].tolist(), end[long].tolist(), strict=True)


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, in code points, by start, then kind as listed.

    Within a kind matches are leftmost and do not overlap, counting those
    that fail the kind's check; spans of different kinds may overlap.
    """
    raw = text.encode("utf-8", "surrogatepass")
    ascii_only = len(raw) == len(text)
    spans = []
    # code points of byte offsets, counted only for texts that need it
    points = None if ascii_only else np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    at = (lambda b: b) if ascii_only else (lambda b: int(points[b]) - 1 if b < len(raw) else len(text))
    for a, b in _hex_runs(raw):
        spans.append((at(a), at(b), "hex"))
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")))
    past = dict.fromkeys(_PATTERNS, 0)
    for begin, kind in hits:
        start = at(begin)
        if start >= past[kind] and (found := _PATTERNS[kind].match(text, start)):
            past[kind] = found.end()
            if _accepts(kind, found):
                spans.append((start, found.end(), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return spans


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, mark: str = MARK) -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, past = [], 0
    merged: list[list[int]] = []
    for a, b, _ in find_secrets(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[past:a], mark]
        past = b
    return "".join([*out, text[past:]])


def secret_spans(text: Column) -> Column:
    """struct<n_assign, n_access, n_hex, base, spans> of a text column; null counts as empty."""

    @arrow_udf("struct<n_assign long, n_access long, n_hex long, base string, spans string>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            spans = find_secrets(t.as_py() or "")
            kinds = [s[2] for s in spans]
            rows.append({**{f"n_{k}": kinds.count(k) for k in KINDS[:3]}, "base": _listed([s for s in spans if s[2] in KINDS[:3]]), "spans": _listed(spans)})
        return pa.array(rows, pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())]))

    return scan(F.coalesce(text.cast("string"), F.lit("")))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every row, repeated ones too.

    Columns read: doc_id, text; others of any name are ignored.  A null or
    empty text has no spans; a text of any length is scanned whole, at about
    eight bytes for each of its bytes where it is not ASCII.  Spans that begin
    together are listed in the order of ``KINDS``.  An empty table gives no
    rows.
    """
    found = docs.select("doc_id", secret_spans(full_text()).alias("f"))
    return found.select("doc_id", "f.n_assign", "f.n_access", "f.n_hex", F.sha2("f.base", 256).alias("base_sha256"), "f.spans")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; ``n_chars`` follows.

    A null text stays null; all rows and columns are kept, an empty table
    stays empty.
    """

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([None if not t.is_valid else redact(t.as_py()) for t in texts], pa.string())

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
