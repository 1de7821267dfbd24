"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates are found by their form and must be valid (Luhn or mod-97 check digits, octets
under 256, dates of the calendar). The value is ranked within its format, permuted there by a keyed
Feistel network with cycle walking, and written back in the same form with right check digits. The
permutation depends on the key, the kind and the format alone, so equal values stay equal across
documents, in whatever way they are spaced, and the key's holder can reverse it. A phone with and
without its country code, and a day with slashes and without, are values of different formats.

kind   what is permuted                                what stays
email  letters and digits of the local part and host   case, length, signs, the last host label
card   13 to 19 digits, check digit made anew          grouping
iban   digits and letters after the check digits       country, grouping
ipv4   the 32-bit address                              dotted form
date   the day, 1900-01-01 to 2099-12-31               order, separators
ssn    nine digits of valid areas                      dashes
phone  digits after the country code                   country code, separators

The key is given or taken from ``spark.gridtrace.pii.key``; without one there is an error.

Defined cases: null and empty texts stay as they are; invalid numbers stay, as do addresses with
leading zeros; very long texts are gone through whole, in time that grows with their length; of kinds
that fit at one place the first listed is taken, and e-mail addresses go before all; repeated rows
get equal results; other columns are carried along unchanged, but one named as ``spans`` is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gridtrace.llm.workers import tidy

KEY = "spark.gridtrace.pii.key"
_DAY0, _DAYS = datetime.date(1900, 1, 1), 73049


class Feistel:
    """A keyed permutation of range(size) for any size, by tweak."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, i: int, half: int, bits: int, tweak: bytes) -> int:
        n = (bits + 7) // 8
        seed = tweak + bytes([i]) + half.to_bytes(n, "big")
        out = b""
        while len(out) < n:
            out += hashlib.blake2b(seed + len(out).to_bytes(4, "big"), key=self.key, digest_size=min(64, n)).digest()
        return int.from_bytes(out[:n], "big") & ((1 << bits) - 1)

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        bits = max(2, ((size - 1).bit_length() + 1) // 2)
        mask, t = (1 << bits) - 1, f"{tweak}/{size}/".encode()
        while True:
            a, b = x >> bits, x & mask
            for i in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
                a, b = (b ^ self._round(i, a, bits, t), a) if back else (b, a ^ self._round(i, b, bits, t))
            x = a << bits | b
            if x < size:  # otherwise walk on along the cycle
                return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _digits(f: Feistel, kind: str, digits: str, back: bool) -> str:
    return f"{f.permute(int(digits), 10 ** len(digits), kind, back):0{len(digits)}d}"


def _letters(f: Feistel, kind: str, text: str, back: bool) -> str:
    """Permute ASCII letters and digits among their own classes."""
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
    rank, size = 0, 1
    for c, r in zip(text, radix, strict=True):
        if r > 1:
            rank = rank * r + (ord(c) - 48 if r == 10 else ord(c.lower()) - 97)
            size *= r
    if size == 1:
        return text
    shape = "".join({10: "9", 26: "a"}.get(r, c) for c, r in zip(text, radix, strict=True))
    rank, out = f.permute(rank, size, f"{kind}/{shape}", back), []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if r == 1:
            out.append(c)
        else:
            rank, x = divmod(rank, r)
            out.append(chr(48 + x) if r == 10 else chr((65 if c.isupper() else 97) + x))
    return "".join(reversed(out))


def _refill(form: str, chars: str, at: Callable[[str], bool] = str.isdigit) -> str:
    it = iter(chars)
    return "".join(next(it) if at(c) else c for c in form)


def _email(f, m, back):
    local, _, host = m[0].rpartition("@")
    name, dot, last = host.rpartition(".")
    return f"{_letters(f, 'local', local, back)}@{_letters(f, 'host', name, back)}{dot}{last}"


def _card(f, m, back):
    d = re.sub(r"\D", "", m[0])
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = _digits(f, "card", d[:-1], back)
    return _refill(m[0], body + luhn_digit(body))


_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
        "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


def _iban_end(form: str) -> int | None:
    """Where the number ends in a run of groups, as words in capitals may follow: by the country's length, else the longest valid."""
    length = _IBAN_LENGTHS.get(form[:2])
    ends = [len(form), *(i for i in range(len(form) - 1, 14, -1) if form[i] == " ")]
    own = [i for i in ends if len(form[:i].replace(" ", "")) == length]
    for i in own + (ends[:1] if length else ends):
        s = form[:i].replace(" ", "")
        if 15 <= len(s) <= 34 and iban_check(s[:2], s[4:]) == s[2:4]:
            return i
    return None


class _Iban:
    """The pattern, its matches cut to where the number ends."""

    run = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

    def match(self, text: str, at: int) -> re.Match | None:
        m = self.run.match(text, at)
        end = _iban_end(m[0]) if m else None
        return self.run.fullmatch(text, at, at + end) if end else None


def _iban(f, m, back):
    s, tail = m[0].replace(" ", ""), _Iban.run.match(m.string, m.start())[0][len(m[0]) :]
    rest = s[4:]
    while True:  # what follows must not be taken for a part of the new number
        rest = _letters(f, "iban" + s[:2], rest, back)
        new = _refill(m[0], s[:2] + iban_check(s[:2], rest) + rest, str.isalnum)
        if _iban_end(new + tail) == len(new):
            return new


def _ipv4(f, m, back):
    parts = [int(x) for x in m[0].split(".")]
    if any(x > 255 for x in parts) or ".".join(map(str, parts)) != m[0]:
        return None
    x = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(f, m, back):
    a, sep, b, c = m[1], m[2], m[3], m[4]
    if len(a) == 4:
        orders = [(a, b, c, "ymd")]
    elif sep == "/":
        orders = [(c, a, b, "mdy"), (c, b, a, "dmy")]
    else:
        orders = [(c, b, a, "dmy")]
    for y, mo, d, order in orders:
        try:
            day = (datetime.date(int(y), int(mo), int(d)) - _DAY0).days
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            continue
        if order in ("mdy", "dmy") and sep == "/":
            # An order that can't be told apart must stay so, or the way back would be lost.
            def both(x):
                return x.day <= 12

            known = both(datetime.date(int(y), int(mo), int(d)))
        else:
            known = None
        while True:
            day = f.permute(day, _DAYS, "date" if known is None else f"date/{order if known is not True else 'mdy'}", back)
            new = _DAY0 + datetime.timedelta(days=day)
            if known is None or (new.day <= 12) == known:
                break
        y2, mo2, d2 = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return sep.join({"ymd": (y2, mo2, d2), "mdy": (mo2, d2, y2), "dmy": (d2, mo2, y2)}[order])
    return None


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f, m, back):
    d = m[0].replace("-", "")
    if not _ssn_ok(d):
        return None
    while True:
        d = _digits(f, "ssn", d, back)
        if _ssn_ok(d):
            return f"{d[:3]}-{d[3:5]}-{d[5:]}"


_CODES = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


def _phone(f, m, back):
    text = m[0]
    keep = 0
    d = re.sub(r"\D", "", text)
    if text[0] == "+":
        keep = _CODES.match(d).end() if _CODES.match(d) else 0
        if not 8 <= len(d) <= 15:
            return None
    elif len(d) != 10:
        return None
    return _refill(text, d[:keep] + _digits(f, f"phone{d[:keep]}", d[keep:], back))


_END = r"(?![A-Za-z0-9])"
_DATE_END = rf"(?:(?=[Tt]\d\d)|{_END})"  # a time may follow
KINDS: list[tuple[str, re.Pattern | _Iban, Callable]] = [
    ("ipv4", re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"), _ipv4),
    ("date", re.compile(r"(\d{4})([-/.])(\d\d)\2(\d\d)" + _DATE_END), _date),
    ("date", re.compile(r"(\d\d)([-/.])(\d\d)\2(\d{4})" + _DATE_END), _date),
    ("ssn", re.compile(r"\d{3}-\d\d-\d{4}" + _END), _ssn),
    ("card", re.compile(r"\d{4}(?:[ -]\d{4}){2}(?:[ -]\d{1,7})" + _END), _card),
    ("card", re.compile(r"\d{4}[ -]\d{6}[ -]\d{5}" + _END), _card),
    ("card", re.compile(r"\d{13,19}" + _END), _card),
    ("phone", re.compile(r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}" + _END), _phone),
    ("phone", re.compile(r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}" + _END), _phone),
    ("phone", re.compile(r"\d{3}([.-])\d{3}\1\d{4}" + _END), _phone),
    ("iban", _Iban(), _iban),
]
#: Empty, so that after a sign the digit behind it is a start of its own.
_START = re.compile(r"(?<![A-Za-z0-9])(?=[+(]?\d|[A-Z]{2}\d\d)")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def find(text: str | None, f: Feistel, back: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of all valid values in a text, in order, not overlapping."""
    if not text:
        return []
    found = []
    at = text.find("@")
    while at >= 0:
        s, last = at, found[-1][2] if found else 0
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _EMAIL.match(text, s) if s < at else None
        if m and m.end() > at:
            found.append(("email", s, m.end(), _email(f, m, back)))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    taken = [(s, e) for _, s, e, _ in found]
    taken.append((len(text) + 1, len(text) + 1))
    free = near = 0
    for start in _START.finditer(text):
        s = start.start()
        while taken[near][1] <= s:
            near += 1
        if s < free or taken[near][0] <= s:
            continue
        for kind, pattern, change in KINDS:
            m = pattern.match(text, s)
            if m and taken[near][0] < m.end():
                continue
            new = change(f, m, back) if m else None
            if new is not None:
                found.append((kind, s, m.end(), new))
                free = m.end()
                break
    found.sort(key=lambda x: x[1])
    return found


def replace(text: str, found: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, s, e, new in found:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


@lru_cache(maxsize=8)
def _feistel(key: bytes) -> Feistel:
    return Feistel(key)


def key_of(docs: DataFrame) -> bytes:
    """The key that the session is configured with."""
    key = docs.sparkSession.conf.get(KEY, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: give one or set {KEY}")
    return key.encode()


def pseudonymize(docs: DataFrame, text_col: str = "text", key: bytes | None = None, back: bool = False, spans: str | None = "pii") -> DataFrame:
    """The rows with pseudonyms in their text; ``spans`` names a column of kind:start:end in the old text, in place of any of that name."""
    from pyspark.sql import types as T

    key = key or key_of(docs)
    docs = docs.drop(spans) if spans else docs
    schema = T.StructType([*docs.schema.fields, *([T.StructField(spans, T.StringType())] if spans else [])])

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _feistel(key)
        for b in batches:
            texts, notes = [], []
            for t in b.column(at).to_pylist():
                found = find(t, f, back)
                texts.append(replace(t, found) if found else t)
                notes.append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found))
            cols, names = list(b.columns), list(b.schema.names)
            cols[at] = pa.array(texts, type=b.schema.field(at).type)
            if spans:
                cols.append(pa.array(notes, type=pa.string()))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(tidy(run), schema)
