"""Benchmark decontamination by template windows.

1. Canonical form. Words are lower-cased and stripped of signs at their ends; numbers become NUM, a
   number and its unit QTY, runs of capitalised words inside a sentence NAME. What stood there is the
   slot's value.
2. Windows of ``width`` canonical words (items that are shorter: their whole length) are hashed.
   Windows with fewer literal words than slots, or under three, are not used. An item that has such
   windows is also compared word for word, as a form of its own: windows of its plain words, whose
   numbers and names must be the same.
3. Documents' windows pass a bitmap of fixed size made from the benchmark's, then join on the hash.
4. Matches on one diagonal are an alignment. Its slots must be consistent: a value of the item always
   meets the same value of the document. Then it counts, also if the values differ: a question asked
   anew with other numbers or names.
5. A document holds an item if its consistent alignments cover ``coverage`` of the item's windows, or
   one of them ``run_words`` words in a row, without a gap.

Items of equal canonical form, with equal values in the same slots, are looked up once; then each of
them makes a pair, with its own values compared. Windows that more than ``shared`` different items
have (a common passage or preamble) are compared too, but by the set of items that have them: a
document meets such a set once, and its items are gone through only where the document's windows can
suffice for one, or where it has rarer windows of the same item. ``shared`` changes the cost alone.

Defined cases: null or empty texts and items hold nothing; items with fewer than three literal words
are found word for word only, however short; very long texts are gone through whole; items that match
equally well all make pairs; repeated rows give one pair; null ids are carried along; empty tables
give no rows; ``keep_clean`` returns all columns as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.llm.workers import tidy
from gridtrace.session import materialize

LITERAL, NUM, UNIT, QTY, NAME, DROP = range(6)
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years mph kmh hz khz mhz ghz w kw kwh v volt volts a amp amps j joule joules n newton newtons pa k c f degree degrees percent "
    "dollar dollars euro euros cent cents usd eur gbp kb mb gb tb byte bytes bit bits".split()
)
WORD_NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
_NUMBER = re.compile(r"\d[\d.,:/]*")
_QUANTITY = re.compile(r"(\d[\d.,:/]*)([a-zµ°]+)")
_MONEY = re.compile(r"[$€£¥]\d[\d.,]*|\d[\d.,]*[%$€£¥]")
_PLACE = {NUM: xxhash.xxh3_64_intdigest("<NUM>"), QTY: xxhash.xxh3_64_intdigest("<QTY>"), NAME: xxhash.xxh3_64_intdigest("<NAME>")}
BITS = 26
_P = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Raw word -> row of its canonical forms, within and at the start of a sentence."""

    MOST = 100_000

    def __init__(self):
        self.clear()
        #: Of each row: the two hashes, the two kinds and whether a sentence ends there.
        self.hash = np.zeros((1 << 14, 2), dtype=np.uint64)
        self.kind = np.zeros((1 << 14, 2), dtype=np.int8)
        self.ends = np.zeros(1 << 14, dtype=np.int8)
        self.plain = np.zeros(1 << 14, dtype=np.uint64)
        self.text: list[str] = []
        self.new: list[tuple[int, int, int, int, bool, int]] = []

    def __missing__(self, raw: str) -> int:
        if raw.isalpha():
            bare, ends = raw, False
        else:
            bare = raw.strip(_EDGE)
            ends = raw[-1] in ".!?:" or (len(raw) > 1 and raw[-1] in "\"')»”" and raw[-2] in ".!?")
        low = bare.lower()
        h = h2 = word = xxhash.xxh3_64_intdigest(low)
        kind = first = LITERAL
        if low.isalpha():
            if low in UNITS:
                kind = first = UNIT
            elif low in WORD_NUMBERS:
                kind = first = NUM
            elif low != bare and bare[0].isupper() and bare[1:].islower():
                kind = NAME
        elif not bare:
            kind = first = DROP
        else:
            q = _QUANTITY.fullmatch(low)
            if (q and q[2] in UNITS) or _MONEY.fullmatch(raw.strip(".,;:!?()[]\"'")):
                kind = first = QTY
            elif _NUMBER.fullmatch(low):
                kind = first = NUM
            elif bare[0].isupper() and bare[1:].islower():
                kind = NAME
        if kind:
            h, h2 = _PLACE.get(kind, h), _PLACE.get(first, h)
        n = self[raw] = len(self.text)
        self.text.append(low)
        self.new.append((h, h2, kind, first, ends, word))
        return n

    def rows_of(self, text: str) -> np.ndarray:
        if len(self) > self.MOST:
            self.__init__()
        ids = np.fromiter(map(self.__getitem__, text.split()), dtype=np.int64)
        if self.new:
            while len(self.text) > len(self.ends):
                self.hash, self.kind, self.ends, self.plain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.kind, self.ends, self.plain))
            at = slice(len(self.text) - len(self.new), len(self.text))
            h, h2, kind, first, ends, word = zip(*self.new, strict=True)
            self.hash[at, 0], self.hash[at, 1], self.kind[at, 0], self.kind[at, 1], self.ends[at] = h, h2, kind, first, ends
            self.plain[at] = np.array(word, dtype=np.uint64)
            self.new = []
        return ids


@dataclass
class Canonical:
    """A text in canonical form. Slot values are made only for windows that are asked for."""

    hashes: np.ndarray
    kinds: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    raw: np.ndarray
    words: Vocabulary

    def plain(self) -> np.ndarray:
        """The hashes of all words as they stand."""
        return self.words.plain[self.ids[self.raw != DROP]]

    def values(self, start: int, width: int) -> list[str]:
        out = []
        for n in range(start, start + width):
            if self.kinds[n] != LITERAL:
                i = self.at[n]
                value, j = self.words.text[self.ids[i]], i + 1
                while j < len(self.raw) and (self.raw[j] == NAME if self.raw[i] == NAME else self.raw[i] == QTY and j == i + 1 and self.raw[j] == UNIT):
                    value += " " + self.words.text[self.ids[j]]
                    j += 1
                out.append(value)
        return out


def canonical(text: str, words: Vocabulary) -> Canonical:
    ids = words.rows_of(text)
    first = np.ones(len(ids), dtype=np.int8)
    first[1:] = words.ends[ids[:-1]]
    h, k = words.hash[ids, first], words.kind[ids, first]
    unit = np.flatnonzero((k[1:] == UNIT) & (k[:-1] == NUM))
    k[unit], h[unit] = QTY, np.uint64(_PLACE[QTY])
    keep = k != DROP
    keep[unit + 1] = False
    keep[1:] &= (k[1:] != NAME) | (k[:-1] != NAME)
    at = np.flatnonzero(keep)
    kinds = k[at]
    kinds[kinds == UNIT] = LITERAL
    return Canonical(h[at], kinds, at, ids, k, words)


PLAIN = 1 << 32  # apart from any width


def _hashed(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(seed + width))
        for i in range(width):
            out = out * _P + h[i : i + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def windows(h: np.ndarray, k: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the usable windows of one width."""
    out = _hashed(h, width)
    if not len(out):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = usable(k, width)
    return np.flatnonzero(ok), out[ok].view(np.int64)


def usable(k: np.ndarray, width: int) -> np.ndarray:
    """Which windows have enough literal words."""
    literal = np.concatenate([[0], np.cumsum(k == LITERAL)])
    literal = literal[width:] - literal[:-width]
    return (literal >= 3) & (2 * literal >= width)


def _explode(width: int):
    """Benchmark items -> their windows. ``form``: hash of the canonical words and of which slots are equal; ``vals``: of all slot values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Vocabulary()
        for b in batches:
            rows = []
            for item, text in zip(b["i"], b["t"]):
                c = canonical(text or "", words)
                own = min(width, len(c.hashes))
                if own:
                    first: dict[str, int] = {}
                    slots = c.values(0, len(c.hashes))
                    equal = np.array([first.setdefault(v, i) for i, v in enumerate(slots)], dtype=np.int64)
                    form = xxhash.xxh3_64_intdigest(c.hashes.tobytes() + equal.tobytes()) - (1 << 63)
                    vals = xxhash.xxh3_64_intdigest("\0".join(slots)) - (1 << 63)
                    at, hashes = windows(c.hashes, c.kinds, own)
                    for pos, hash_ in zip(at, hashes, strict=True):
                        rows.append((item, form, vals, own, False, int(pos), int(hash_), c.values(pos, own)))
                    if len(at) < len(c.hashes) - own + 1:
                        words_ = c.plain()
                        form, own = xxhash.xxh3_64_intdigest(words_.tobytes(), seed=PLAIN) - (1 << 63), min(width, len(words_))
                        for pos, hash_ in enumerate(_hashed(words_, own, PLAIN).view(np.int64)):
                            rows.append((item, form, 0, own, True, pos, int(hash_), []))
            yield pd.DataFrame(rows, columns=["item_id", "form", "vals", "width", "plain", "ipos", "hash", "ivals"])

    return run


#: Words of the longest stretch that windows at the places ``at`` cover without a gap.
_LONGEST = """aggregate(sort_array(at), named_struct('f', -1, 'p', -1, 'b', 0), (s, x) -> named_struct(
  'f', IF(s.f < 0 OR x - s.p > width, x, s.f), 'p', x, 'b', greatest(s.b, x + width - IF(s.f < 0 OR x - s.p > width, x, s.f))), s -> s.b)"""


def _found(docs: DataFrame, bench: DataFrame, width: int, coverage: float, run_words: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """Documents and the forms that they hold; and the windows of all items."""
    spark = docs.sparkSession
    #: Ids go as strings: pandas would round whole numbers beside a null.
    items = bench.selectExpr("CAST(item_id AS STRING) AS i", "text AS t").mapInPandas(
        tidy(_explode(width)), "item_id string, form long, vals long, width int, plain boolean, ipos int, hash long, ivals array<string>"
    )
    items = materialize(items.withColumn("item_id", F.col("item_id").cast("long")), "items")
    #: One item stands for all of the same form: whether slots are consistent is the same for all.
    stands = items.groupBy("form").agg(F.min("vals").alias("vals"))
    own = materialize(items.join(stands, ["form", "vals"], "left_semi").dropDuplicates(["form", "ipos"]), "item-windows")
    n_windows = own.groupBy("form").agg(F.count("*").alias("item_windows"), F.max("width").alias("width"), (F.max("ipos") - F.min("ipos") + 1 > F.count("*")).alias("gaps"))
    seen = own.select("plain", "width").distinct().collect()  # at most ``width`` of each
    widths, plain_widths = (sorted(r.width for r in seen if r.plain == p) for p in (False, True))
    top = F.shiftrightunsigned("hash", 64 - BITS)
    words = own.select(F.shiftright(top, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - BITS}) % 64 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(1 << (BITS - 6), dtype=np.int64)  # at most 8 MB, whatever the benchmark's size
    for w, b in words.collect():
        bitmap[w] = b
    shared_bitmap = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, vocab = shared_bitmap.value, Vocabulary()

        def hit_in(hashes: np.ndarray) -> np.ndarray:
            t = hashes.view(np.uint64) >> np.uint64(64 - BITS)
            return np.flatnonzero(bits[(t >> np.uint64(6)).astype(np.int64)] >> (t & np.uint64(63)) & np.uint64(1))

        for b in batches:
            rows = []
            for key, doc, text in zip(b["row_key"], b["i"], b["t"]):
                c = canonical(text or "", vocab)
                for w in widths:
                    hashes = _hashed(c.hashes, w).view(np.int64)
                    hit = hit_in(hashes)
                    if len(hit):
                        hit = hit[usable(c.kinds, w)[hit]]
                    rows += [(key, doc, int(p), int(hashes[p]), c.values(p, w)) for p in hit]
                plain = c.plain() if plain_widths else None
                for w in plain_widths:
                    hashes = _hashed(plain, w, PLAIN).view(np.int64)
                    rows += [(key, doc, int(n), int(hashes[n]), []) for n in hit_in(hashes)]
            yield pd.DataFrame(rows, columns=["row_key", "doc_id", "dpos", "hash", "dvals"])

    hits = docs.select(row_key(docs).alias("row_key"), F.col("doc_id").cast("string").alias("i"), F.col("text").alias("t")).mapInPandas(
        tidy(probe), "row_key long, doc_id string, dpos int, hash long, dvals array<string>"
    )
    hits = materialize(hits.withColumn("doc_id", F.col("doc_id").cast("long")), "hits")
    #: Windows that must be met at least, in whatever places, for an item to be found. Without gaps a stretch has a window at each place.
    stretch = F.when(F.col("gaps"), F.ceil(F.lit(run_words) / F.col("width"))).otherwise(run_words + 1 - F.col("width"))
    need = n_windows.select("form", F.greatest(F.lit(1), F.least(F.ceil(F.lit(coverage) * F.col("item_windows")), stretch)).alias("need"))
    rows = _meetings(hits, own.select("hash", "form", "ipos", "ivals"), need, shared)
    aligned = (
        rows.groupBy("row_key", "doc_id", "form", (F.col("dpos") - F.col("ipos")).alias("diagonal"))
        .agg(
            F.collect_set("ipos").alias("at"),
            F.collect_set(F.xxhash64("ipos", "dvals")).alias("keys"),
            F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("ivals", "dvals")))).alias("vals"),
        )
        .where(F.size("vals") == F.size(F.array_distinct(F.col("vals.ivals"))))
        .join(n_windows.drop("gaps"), "form")
        .withColumn("longest", F.expr(_LONGEST))
    )
    alone = (F.size("at") >= coverage * F.col("item_windows")) | (F.col("longest") >= run_words)
    found = (
        aligned.groupBy("row_key", "doc_id", "form", "item_windows")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("matched"),
            F.max("longest").alias("longest"),
            F.collect_list(F.struct(alone.alias("alone"), "keys")).alias("alignments"),
        )
        .where((F.col("matched") >= coverage * F.col("item_windows")) | (F.col("longest") >= run_words))
    )
    return found, items


def matches(docs: DataFrame, bench: DataFrame, width: int = 8, coverage: float = 0.5, run_words: int = 13, shared: int = 20) -> DataFrame:
    """Pairs: row_key, doc_id, item_id, matched windows, coverage and whether slot values differ from the item's.

    They don't if an alignment that is enough by itself has the item's values, or if all alignments have.
    """
    found, items = _found(docs, bench, width, coverage, run_words, shared)
    members = items.groupBy("form", "item_id", "vals").agg(F.collect_set(F.xxhash64("ipos", "ivals")).alias("own"))
    differs = "size(array_except(a.keys, own)) > 0"
    found = (
        found.join(members, "form").withColumn("coverage", F.col("matched") / F.col("item_windows"))
        .withColumn("reparameterised", F.expr(f"exists(alignments, a -> {differs}) AND NOT exists(alignments, a -> a.alone AND NOT {differs})"))
    )
    #: An item may be found in both its forms. What is found word for word is no other question.
    best = F.max(F.struct("coverage", "matched"))
    return found.groupBy("row_key", "doc_id", "item_id").agg(best.alias("best"), F.min("reparameterised").alias("reparameterised")).select(
        "row_key", "doc_id", "item_id", F.col("best.matched").cast("long").alias("matched"), "best.coverage", "reparameterised"
    )


def _meetings(hits: DataFrame, own: DataFrame, need: DataFrame, shared: int) -> DataFrame:
    """Documents' and items' windows of equal hash. Of windows that many items have, those of items that can be found."""
    held = own.groupBy("hash", "form").agg(F.count("*").alias("c"))
    seeds = [F.bit_xor(F.xxhash64("form", "c", F.lit(i))) for i in range(2)]
    sets = held.groupBy("hash").agg(F.count("*").alias("forms"), F.max("c").alias("most"), F.struct(*seeds).alias("set")).where(f"forms > {shared}")
    sets = materialize(sets, "common-windows")
    if sets.isEmpty():
        return hits.join(own, "hash")
    rare = hits.join(own.join(sets.select("hash"), "hash", "left_anti"), "hash")
    one = sets.groupBy("set").agg(F.min("hash").alias("hash"))
    members = materialize(held.join(one, "hash").join(need, "form").select("set", "form", "need"), "common-members")
    met = hits.join(sets.select("hash", "set", "most"), "hash")
    parts = materialize(met.select("row_key", "hash", "set", "most").distinct().groupBy("row_key", "set").agg(F.sum("most").alias("most")), "common-met")
    bound = parts.groupBy("row_key").agg(F.sum("most").alias("bound"))
    least = members.groupBy("set").agg(F.min("need").alias("least"))
    whole = parts.join(bound, "row_key").join(least, "set").where("bound >= least").select("row_key", "set", "bound")
    alone = whole.join(members, "set").where("bound >= need").select("row_key", "set", "form")
    beside = rare.select("row_key", "form").distinct().join(members, "form").join(parts, ["row_key", "set"], "left_semi").select("row_key", "set", "form")
    common = met.drop("most").join(alone.union(beside).distinct(), ["row_key", "set"]).join(own, ["hash", "form"])
    return rare.unionByName(common.select(*rare.columns))


def row_key(docs: DataFrame):
    """Equal for rows of equal id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), docs["doc_id"], docs["text"])


def pairs(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id) of every benchmark item that a document holds."""
    return matches(docs, bench, **options).drop("row_key").distinct()


def keep_clean(docs: DataFrame, bench: DataFrame, width: int = 8, coverage: float = 0.5, run_words: int = 13, shared: int = 20) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found, _ = _found(docs, bench, width, coverage, run_words, shared)
    bad = materialize(found.select("row_key").distinct(), "leaks")
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, row_key(docs)).join(bad.withColumnRenamed("row_key", key), key, "left_anti").select(*docs.columns)
