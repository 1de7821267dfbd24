"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

Rules and defined cases
- Spans are in code points of the whole text, end exclusive. A null or empty text has no spans.
- Base kinds are leftmost and non-overlapping per kind; a match that is too short still uses up its
  characters, then is dropped.
- Added kinds: ``github`` and ``npm`` (token prefix, 30 base-62 characters, then a base-62 CRC-32 of
  these that must be right) and ``jwt`` (three base64url parts, the first a JSON object with "alg").
- Rows keep their place and number: repeated rows and null ids are scanned like any other row.
- A very long text is scanned whole, in time that grows with its length. Spans of different kinds that
  begin together go by kind as listed. An empty table gives no rows. Columns other than the id and the
  text are not looked at, whatever their names.
- Each row is scanned alone, so there is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("github", "npm", "jwt")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + EXTRA_KINDS)}

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword, found in the lower-cased text, and the kinds to try where it begins.
KEYWORDS = {
    "password": ("assign",), "passwd": ("assign",), "secret": ("assign",), "token": ("assign",), "apikey": ("assign",),
    "api_key": ("assign",), "akia": ("access",), "ghp_": ("github",), "gho_": ("github",), "ghu_": ("github",),
    "ghs_": ("github",), "ghr_": ("github",), "npm_": ("npm",), "eyj": ("jwt",),
}

_LOWER = {c: c + 32 for c in range(65, 91)}
#: Lower-case hex digits become "h", every other byte a blank: a run is then a keyword of its own.
_HEX_BYTES = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_HEX_RUN = re.compile(rb"h{24,}")


def crc_token_ok(body: str) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of what stands before them."""
    value = 0
    for ch in body[-6:]:
        value = value * 62 + _BASE62.index(ch)
    return value == binascii.crc32(body[:-6].encode())


def crc_token(prefix: str, body: str) -> str:
    """A token with a right checksum, for tests and fixtures."""
    value, digits = binascii.crc32(body.encode()), ""
    for _ in range(6):
        value, r = divmod(value, 62)
        digits = _BASE62[r] + digits
    return prefix + body + digits


def _jwt_ok(head: str) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(found, dict) and "alg" in found


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind in ("github", "npm"):
        return crc_token_ok(m[1])
    return _jwt_ok(m[1])


_PATTERNS = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM, "jwt": _JWT}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kinds in KEYWORDS.items():
        a.add_word(word, (len(word), kinds))
    a.make_automaton()
    return a


def scan(text: str | None, auto) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters have a longer lower case
        low = text.translate(_LOWER)
    found: list[tuple[str, int, int]] = []
    hits: dict[str, list[int]] = {}
    for end, (n, kinds) in auto.iter(low):
        for kind in kinds:
            hits.setdefault(kind, []).append(end - n + 1)
    for kind, starts in hits.items():
        pattern, free = _PATTERNS[kind], 0
        starts.sort()
        for s in starts:
            if s >= free and (m := pattern.match(text, s)):
                free = m.end()
                if _accept(kind, m):
                    found.append((kind, s, free))
    data = text.encode("utf-8", "surrogatepass")
    mapped = data.translate(_HEX_BYTES)
    if b"hhhhhhhhhhhhhhhhhhhhhhhh" in mapped:
        at = s = 0  # bytes and characters gone through
        for m in _HEX_RUN.finditer(mapped):
            s += len(data[at : m.start()].decode("utf-8", "surrogatepass"))
            at = m.start()
            found.append(("hex", s, s + m.end() - m.start()))
    found.sort(key=lambda x: (x[1], ORDER[x[0]]))
    return found


SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and its spans, as an array of (kind, start, end) named ``spans``."""
    schema = T.StructType([T.StructField(id_col, T.StringType()), T.StructField("spans", SPAN)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = automaton()
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, auto)] for t in b["t"].tolist()]
            yield pd.DataFrame({id_col: b["i"], "spans": spans})

    #: Ids go as strings: pandas would round whole numbers beside a null.
    out = docs.selectExpr(f"CAST(`{id_col}` AS STRING) AS i", f"`{text_col}` AS t").mapInPandas(run, schema)
    return out.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))


def digest_columns(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as one string."""
    base = "filter(spans, x -> x.kind IN ('assign', 'access', 'hex'))"
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, string(x.start), string(x.end))), ',')"
    count = "CAST(size(filter(spans, x -> x.kind = '{}')) AS BIGINT) AS n_{}"
    return spans.selectExpr(
        f"`{id_col}`",
        *(count.format(k, k) for k in BASE_KINDS),
        f"sha2({joined.format(base)}, 256) AS base_sha256",
        f"{joined.format('spans')} AS spans",
    )


def base_spans_plain(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by plain expressions over the whole text, for tests."""
    text = text or ""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
