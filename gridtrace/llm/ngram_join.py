"""N-gram Jaccard join by a token-group matrix.

Texts are sets of hashed word shingles. Similar texts are partitioned into groups; the matrix says
which tokens occur in which group. A text can only link with a member of a group if the group's token
union holds enough of its tokens, so groups below that bound are never opened; in those that are,
overlaps are counted exactly. All links are found and counted, those within known components too.

1. One pass over the texts gives each document's set a hash, and counts tokens in a sketch of fixed
   size, to tell common ones. The sketch only sets an order of tokens (common ones last) and where
   texts are grouped; results don't depend on it.
2. Texts of equal sets form a class; one row of each goes on.
3. Groups: classes that share their least token (texts that consist of common tokens mostly, as the
   copies of a much copied text do: their least common one), dealt by a hash of the class to parts of
   about half of ``group_texts`` texts and ``group_tokens`` tokens at most.
4. Matrix: (token, group) for the tokens of each member's prefix, of tokens in several groups. If two
   sets link, at least ``extra + n / per`` of the tokens they share (n: what the other must share at
   least) are among the first ``n - ceil(t n) + extra + n / per`` of either, so a text and a group
   that share fewer are below the bound. Texts ask their own group, and groups as large as theirs or
   larger.
5. The groups left are opened, in as many tasks as the texts that ask want: the text's overlap with
   the whole union is bounded first, then it is counted with each member. What leaves a task are sums
   of links for each class and a spanning forest of the links, not the pairs.
6. Connected components over all links.

Groups and the texts that ask are cut by size, never dropped. Sets travel for texts in question only;
they are made anew from the text, so no table of all shingles is written. Counting the links of k
different near copies compares k * k / 2 sets, in blocks over all tasks.

Defined cases: words are runs of bytes other than ASCII white space, A-Z in lower case; a text of
fewer words than a shingle has one shingle, all of it; a text without words or a null has none and
links with nothing; a very long text is one set as any other, and a group of its own if need be;
repeated rows are in one class and link with each other; equal similarities need no order, as all
links count; a null id takes part in links but is no component's name unless all its ids are null;
an empty table gives no rows; columns other than doc_id and text are not looked at, and ``keep_one``
returns them as they are, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.llm.components import connected_components, forest
from gridtrace.llm.workers import tidy
from gridtrace.session import discard, materialize

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
CHUNK = 1 << 16
SAMPLED = 63  # tokens whose hash is under 2 ** 63 are counted: more than any prefix takes


#: Tables of a few whole numbers a row are broadcast if counted and no longer than this.
BROADCAST = 500_000


def _small(df: DataFrame, most: int) -> DataFrame:
    """The table, to be broadcast if it has at most ``most`` rows, and joined by a shuffle beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Words(dict):
    """Word -> 64-bit hash, of bounded size."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, words: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=n)
    k = min(n, width)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            out = (out ^ (out >> np.uint64(31))) * _P + h[i : n - k + 1 + i]
        out ^= out >> np.uint64(30)
        out *= _M
        out ^= out >> np.uint64(27)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Rule:
    """Two sets link when den * intersection >= num * union."""

    width: int = 5
    num: int = 80
    den: int = 100
    extra: int = 3
    per: int = 64

    def least(self, n):
        """Tokens that a set of n must share to link."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.extra + n // self.per)

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def ranks(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """How common each token is, by the sketch: 0 for most."""
    bits = len(sketch).bit_length() - 1
    counted = tokens < np.uint64(1 << SAMPLED)
    at = np.where(counted, tokens >> np.uint64(SAMPLED - bits), np.uint64(0)).astype(np.int64)
    return np.where(counted, sketch[at], 0)


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """A set of ``n`` hashes (column k), as bits: 16 for each, at most 16 MB whatever their number."""
    bits = min(27, max(12, math.ceil(math.log2(16 * max(1, n)))))
    top = f"shiftrightunsigned(k, {64 - bits})"
    got = keys.selectExpr(f"shiftright({top}, 6) AS w", f"shiftleft(1L, CAST({top} % 64 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(bitmap).bit_length() - 1 + 6
    top = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)


class Index:
    """One group: its token union, and who has each token.

    Tokens that many members have are columns of a dense matrix, so that near copies of one text are
    compared by a matrix product; the others are gone through by list.
    """

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.copies = nodes, copies
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.who = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.start = np.unique(tokens[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(tokens)))
        self.column = np.full(len(self.union), -1)
        usual = np.flatnonzero(self.count >= max(16, len(sets) // 8))  # at most 8 of its cells for each of its tokens
        self.column[usual] = np.arange(len(usual))
        self.dense = np.zeros((len(usual), len(sets)), dtype=np.float32)
        for c, i in enumerate(usual):
            self.dense[c, self.who[self.start[i] : self.start[i] + self.count[i]]] = 1

    def linked(self, queries: list[np.ndarray], rule: Rule) -> list[np.ndarray]:
        """For each set, the members that it links with. The union's bound comes first."""
        out = [np.zeros(0, np.int64)] * len(queries)
        at = [np.minimum(np.searchsorted(self.union, q), len(self.union) - 1) for q in queries]
        at = [a[self.union[a] == q] for a, q in zip(at, queries, strict=True)]
        step = max(1, min(256, (1 << 22) // max(1, *self.dense.shape)))
        asked = [i for i, a in enumerate(at) if len(a) and len(a) >= rule.least(len(queries[i]))]
        for some in (asked[k : k + step] for k in range(0, len(asked), step)):
            rows = np.zeros((len(some), len(self.dense)), dtype=np.float32)
            for r, i in enumerate(some):
                c = self.column[at[i]]
                rows[r, c[c >= 0]] = 1
            common = (rows @ self.dense).astype(np.int64)  # whole numbers, exact in float32
            for r, i in enumerate(some):
                rare = at[i][self.column[at[i]] < 0]
                count = self.count[rare]
                first = np.repeat(self.start[rare] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(rare) else np.zeros(0, np.int64)
                common[r] += np.bincount(self.who[first + np.arange(len(first))], minlength=len(self.nodes))
                out[i] = np.flatnonzero(rule.links(common[r], len(queries[i]), self.sizes))
        return out


class Opened:
    """An opened group: compares the sets that ask, sums links for each class, and keeps a forest of the links."""

    MOST = 1 << 18  # pairs held before they are contracted

    def __init__(self, rule: Rule):
        self.rule, self.members, self.own, self.index = rule, [], [], None
        self.asking, self.tokens = [], 0
        self.a, self.b, self.held = [], [], 0
        self.sums: list[tuple[int, int]] = []

    def take(self, kind: int, node: int, copies: int, own: bool, tokens: np.ndarray) -> None:
        if kind == 0:
            self.members.append((node, copies, tokens))
            self.own.append(own)
            return
        self.ready()
        self.asking.append((node, copies, tokens))
        self.tokens += len(tokens)
        if self.tokens >= 1 << 20 or len(self.asking) >= 1024:
            self.ask()

    def ready(self) -> None:
        if self.index is None and self.members:
            nodes, copies, sets = zip(*self.members, strict=True)
            self.index = Index(np.array(nodes, dtype=np.int64), np.array(copies, dtype=np.int64), sets)
            self.credit = np.zeros(len(nodes), dtype=np.int64)
            mine = [i for i, own in enumerate(self.own) if own] if len(sets) > 1 else []
            for some in (mine[k : k + 256] for k in range(0, len(mine), 256)):
                for i, j in zip(some, self.index.linked([sets[i] for i in some], self.rule), strict=True):
                    j = j[j != i]
                    if len(j):
                        self.credit[i] += self.index.copies[j].sum()
                        self.pairs(nodes[i], j)
            self.members = []

    def ask(self) -> None:
        if self.index is not None and self.asking:
            for (node, copies, _), j in zip(self.asking, self.index.linked([t for _, _, t in self.asking], self.rule), strict=True):
                if len(j):
                    self.sums.append((node, int(self.index.copies[j].sum())))
                    self.credit[j] += copies
                    self.pairs(node, j)
        self.asking, self.tokens = [], 0

    def pairs(self, node: int, j: np.ndarray) -> None:
        self.a.append(np.full(len(j), node))
        self.b.append(self.index.nodes[j])
        self.held += len(j)
        if self.held >= self.MOST:
            a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.held = [a], [b], 0

    def close(self) -> Iterator[pd.DataFrame]:
        self.ready()
        self.ask()
        if self.index is not None:
            some = np.flatnonzero(self.credit)
            nodes, sums = zip(*self.sums, strict=True) if self.sums else ((), ())
            nodes = np.concatenate([self.index.nodes[some], np.array(nodes, dtype=np.int64)])
            if len(nodes):
                yield _found(nodes, None, np.concatenate([self.credit[some], np.array(sums, dtype=np.int64)]))
        if self.a:
            a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
            yield _found(a, b, None)


def _found(a: np.ndarray, b: np.ndarray | None, links: np.ndarray | None) -> pd.DataFrame:
    none = pd.array([None] * len(a), dtype="Int64")
    return pd.DataFrame({"a": a, "b": none if b is None else pd.array(b, dtype="Int64"), "links": none if links is None else pd.array(links, dtype="Int64")})


def _open_groups(rule: Rule):
    """Rows sorted by group, members (0) before those that ask (1) -> links between classes, or sums of links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = before = None
        group = Opened(rule)
        for b in batches:
            for g, kind, node, copies, own, tokens in zip(b["grp"], b["kind"], b["node"], b["copies"], b["own"], b["tokens"]):
                if (g, kind, node) == before:  # a row that is there twice
                    continue
                if g != now and now is not None:
                    yield from group.close()
                    group = Opened(rule)
                now, before = g, (g, kind, node)
                group.take(kind, node, copies, own, np.frombuffer(tokens, dtype="<u8"))
        yield from group.close()

    return run


def row_key(docs: DataFrame):
    """Equal for rows of equal id and text."""
    return F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"], docs["text"])


def _rows_of(docs: DataFrame, keys: DataFrame, n: int, most: int) -> tuple[DataFrame, np.ndarray | None]:
    """(rk, t) of rows whose key is among the given, and a filter to be used in the workers.

    Up to ``most`` keys the filter is a bitmap of 16 bits a key, which lets a few others by; beyond
    that there is none, and the rows are joined with the keys.
    """
    rows = docs.select(row_key(docs).alias("rk"), F.col("text").alias("t"))
    if n <= most:
        return rows, _bitmap(keys, n)
    return rows.join(keys.withColumnRenamed("k", "rk"), "rk", "left_semi"), None


def _sets(docs: DataFrame, rule: Rule, keys: DataFrame, n: int, most: int) -> DataFrame:
    """(node, rk, tokens) of the rows whose key is among the given; a few others may come along."""
    rows, bits = _rows_of(docs, keys, n, most)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, bitmap = Words(), shared.value
        for b in batches:
            if bitmap is not None:
                b = b[_in(bitmap, b["rk"].to_numpy(dtype=np.int64))]
            sets = [shingles(t, rule.width, words) for t in b["t"]]
            yield pd.DataFrame({"node": np.array([node_of(s) for s in sets], dtype=np.int64), "rk": b["rk"], "tokens": [s.tobytes() for s in sets]})

    return rows.mapInPandas(tidy(run), "node long, rk long, tokens binary")


def _describe(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """A row for each document (doc_id, rk, n, node), and the sketch, from one pass over the texts.

    The sketch has, for each hash bucket, how many times the usual it is hit, as a power of two; 2 ** 16
    to 2 ** 24 buckets, by the number of rows: at most 16 MB whatever the input.
    """
    bits = min(24, max(16, math.ceil(math.log2(16 * max(1, docs.count())))))
    names = ["doc_id", "rk", "n", "node", "chunk", "sums"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sums = Words(), np.zeros(1 << bits, dtype=np.int32)
        for b in batches:
            n, node, held = [], [], []
            for t in b["t"]:
                s = shingles(t, rule.width, words)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                held.append(s[: np.searchsorted(s, np.uint64(1 << SAMPLED))])
            if held:
                np.add.at(sums, (np.concatenate(held) >> np.uint64(SAMPLED - bits)).astype(np.int64), 1)
            none = pd.array([None] * len(n), dtype="Int64")
            yield pd.DataFrame({"doc_id": b["i"].to_numpy(), "rk": b["rk"].to_numpy(), "n": n, "node": pd.array(node, dtype="Int64"), "chunk": none, "sums": None})
        parts = [(i // CHUNK, sums[i : i + CHUNK]) for i in range(0, 1 << bits, CHUNK)]
        parts = [(i, zlib.compress(np.minimum(p, 65535).astype("<u2").tobytes(), 1)) for i, p in parts if p.any()]
        for i, p in parts:
            yield pd.DataFrame([(None, None, None, None, i, p)], columns=names)

    #: Ids go as strings: pandas would round whole numbers beside a null.
    made = docs.select(F.col("doc_id").cast("string").alias("i"), F.col("text").alias("t"), row_key(docs).alias("rk")).mapInPandas(
        tidy(run), "doc_id string, rk long, n long, node long, chunk int, sums binary"
    )
    made = materialize(made.withColumn("doc_id", F.col("doc_id").cast("long")), "rows")

    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<u2").astype(np.int64) for x in g["sums"])
        return pd.DataFrame({"chunk": [key[0]], "sums": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    total = np.zeros(1 << bits, dtype=np.int64)
    for chunk, sums in made.where("chunk IS NOT NULL").select("chunk", "sums").groupBy("chunk").applyInPandas(add, "chunk int, sums binary").toLocalIterator():
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(sums, "<i4")
    usual = max(4.0, 4 * total.mean())
    sketch = np.where(total > usual, np.ceil(np.log2(np.maximum(total, 1) / usual)), 0).astype(np.uint8)
    return made.where("chunk IS NULL").select(*names[:4]), sketch


def _prefixes(docs: DataFrame, rule: Rule, keys: DataFrame, n: int, sketch: np.ndarray, most: int) -> DataFrame:
    """(node, n, bucket, prefix): the bucket that a class is grouped by, and its first tokens in the sketch's order."""
    rows, bits = _rows_of(docs, keys, n, most)
    shared = docs.sparkSession.sparkContext.broadcast((bits, sketch))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, (bitmap, order) = Words(), set(), shared.value
        for b in batches:
            if bitmap is not None:
                b = b[_in(bitmap, b["rk"].to_numpy(dtype=np.int64))]
            out = []
            for t in b["t"]:
                s = shingles(t, rule.width, words)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                r = ranks(s, order)
                often = s[r > 0]
                kin = often if 2 * len(often) >= np.searchsorted(s, np.uint64(1 << SAMPLED)) > 0 else s
                out.append((node, len(s), int(kin[:1].view(np.int64)[0]), s[np.argsort(r, kind="stable")[: rule.prefix(len(s))]].view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "bucket", "prefix"])

    return materialize(rows.mapInPandas(tidy(run), "node long, n long, bucket long, prefix array<long>"), "prefixes")


def _grouped(prefixes: DataFrame, texts: int, tokens: int) -> DataFrame:
    """The classes with their group: those of one bucket, dealt by hash to parts of about half of what a group may hold."""
    parts = F.ceil(F.greatest(2 * F.count("*") / texts, 2 * F.sum("n") / tokens)).cast("long")
    wide = materialize(prefixes.groupBy("bucket").agg(parts.alias("parts"), F.count("*").alias("c")).where("parts > 1 AND c > 1").drop("c"), "wide")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    return prefixes.join(_small(wide, BROADCAST), "bucket", "left").withColumn("grp", F.xxhash64("bucket", part)).drop("bucket", "parts")


def _shared_tokens(grouped: DataFrame, most: int) -> DataFrame:
    """(token, node, n, grp) of the prefix tokens that are in the matrix for several groups; a few others may come along."""
    cells = grouped.select(F.explode("prefix").alias("k"), "grp")
    keys = materialize(cells.groupBy("k").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("k"), "shared")
    n = keys.count()
    if n > most:
        out = grouped.select(F.explode("prefix").alias("token"), "node", "n", "grp").join(keys.withColumnRenamed("k", "token"), "token", "left_semi")
    else:
        shared = grouped.sparkSession.sparkContext.broadcast(_bitmap(keys, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bitmap = shared.value
            for b in batches:
                lists = b.column("prefix")
                flat, length = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                who = np.repeat(np.arange(len(length)), length)
                hit = np.flatnonzero(_in(bitmap, flat))
                at = pa.array(who[hit])
                yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), *(b.column(c).take(at) for c in ("node", "n", "grp"))], names=["token", "node", "n", "grp"])

        out = grouped.select("prefix", "node", "n", "grp").mapInArrow(tidy(run), "token long, node long, n long, grp long")
    out = materialize(out, "cells")
    discard(keys)
    return out


def _asks(cells: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(node, grp): classes and the other groups, as large as theirs or larger, that pass the matrix's bound."""
    cells = cells.join(sizes, "grp")
    matrix = cells.groupBy("token", F.col("grp").alias("g")).agg(F.first("size").alias("gsize"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    matrix = materialize(matrix, "matrix")
    hit = (
        (F.col("grp") != F.col("g"))
        & ((F.col("size") < F.col("gsize")) | ((F.col("size") == F.col("gsize")) & (F.col("grp") < F.col("g"))))
        & (F.col("n1") * rule.den >= F.col("n") * rule.num)
        & (F.col("n0") * rule.num <= F.col("n") * rule.den)
    )
    least = f"CAST(({rule.num} * n + {rule.den - 1}) DIV {rule.den} AS BIGINT)"
    met = cells.join(matrix, "token").where(hit).groupBy("node", "n", F.col("g").alias("grp")).agg(F.count("*").alias("shared"))
    out = materialize(met.where(f"shared >= least({least}, {rule.extra} + {least} DIV {rule.per})").select("node", "grp"), "asks")
    discard(matrix)
    return out


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), group_texts: int = 2048, group_tokens: int = 1 << 20, salt_texts: int = 2000, most_keys: int = 1 << 23) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_links, component_id, its row key ``rk`` and class ``root``.

    ``n_links`` counts the other rows that a row links with, those of an equal set included. At most
    ``most_keys`` keys go into a bitmap that is broadcast (16 MB); beyond that they are joined.
    """
    docs = docs.select("doc_id", "text")
    rows, sketch = _describe(docs, rule)
    worded = rows.where("node IS NOT NULL")
    classes = worded.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        F.min("rk").alias("rk"),
        F.min("n").alias("n"),
        F.count("*").alias("copies"),
    )
    classes = materialize(classes, "classes")
    n_classes = classes.count()
    prefixes = _prefixes(docs, rule, classes.select(F.col("rk").alias("k")), n_classes, sketch, most_keys)
    grouped = _grouped(prefixes, group_texts, group_tokens)
    placed = grouped.select("node", "grp").distinct().join(classes.drop("doc_id"), "node")
    placed = materialize(placed, "placed")  # node, grp, rk, n, copies
    cells = _shared_tokens(grouped, most_keys)
    discard(prefixes)
    sizes = materialize(placed.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    asks = _asks(cells, sizes, rule)
    discard(cells)
    asks = asks.join(placed.select("node", "rk", "n", "copies"), "node")
    load = asks.select("grp", "n", F.lit(0).alias("own")).union(placed.select("grp", "n", F.lit(1))).groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    salts = load.where("c > 1").select("grp", F.ceil(F.greatest(F.col("c") / salt_texts, F.col("s") / group_tokens)).cast("int").alias("salts"))
    salts = materialize(salts, "salts")
    mine = F.pmod(F.xxhash64("node"), "salts").cast("int")
    asked = asks.join(salts, "grp").select("node", "rk", "copies", "grp", mine.alias("salt"), F.lit(1).alias("kind"), F.lit(False).alias("own"))
    held = placed.join(salts, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("node", "rk", "copies", "grp", "salt", F.lit(0).alias("kind"), (F.col("salt") == mine).alias("own"))
    wanted = materialize(asked.union(held).withColumn("grp", F.xxhash64("grp", "salt")).drop("salt"), "wanted")
    keys = materialize(wanted.select(F.col("rk").alias("k")).distinct(), "keys")
    sets = _sets(docs, rule, keys, keys.count(), most_keys)
    opened = sets.join(_small(wanted, BROADCAST), ["node", "rk"]).select("grp", "kind", "node", "copies", "own", "tokens")
    found = materialize(opened.repartition("grp").sortWithinPartitions("grp", "kind", "node").mapInPandas(tidy(_open_groups(rule)), "a long, b long, links long"), "links")
    discard(placed, sizes, salts, wanted, keys)
    known = connected_components(found.where("b IS NOT NULL"))
    sums = found.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("node", "doc_id", "copies").join(known, "node", "left").join(sums, "node", "left")
    named = materialize(named.select("node", "doc_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    discard(classes, found, known)
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")), "roots")
    #: Most classes are alone; only the roots of several are joined.
    many = named.join(least.where("c > 1").drop("c"), "root", "left").select("node", "root", "n_links", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = worded.join(materialize(many, "classes"), "node").select("doc_id", F.col("n").alias("n_shingles"), "n_links", "component_id", "rk", "root")
    none = F.lit(None).cast("long")
    alone = rows.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), "rk", none.alias("root"))
    return linked.union(alone)


def keep_one(docs: DataFrame, rule: Rule = Rule(), broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, with all its columns.

    Texts without words all stay. Which rows go is joined by key; it is broadcast only if counted and
    no more than ``broadcast_rows`` keys.
    """
    got = materialize(near_duplicates(docs, rule, **options).where("root IS NOT NULL"), "groups")
    best = got.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk"))["rk"].alias("best"))
    key = "row_key"
    while key in docs.columns:
        key += "_"
    marked = got.groupBy("root", "rk").agg(F.count("*").alias("c")).join(best, "root").selectExpr(f"rk AS {key}", "rk = best AS kept", "c")
    touched = materialize(marked.where("NOT kept OR c > 1"), "touched")
    small = touched.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda x: x)
    keyed = docs.withColumn(key, row_key(docs))
    rest = keyed.join(hint(touched.select(key)), key, "left_anti")
    once = keyed.join(hint(touched.where("kept").select(key)), key, "left_semi").dropDuplicates([key])
    return rest.unionByName(once).select(*docs.columns)
