"""Sharding by a k-d tree over metadata, with DataFrame operations only.

Law ``bytes``: sizes of shards near equal. Documents of equal text form a group and stay together,
unless the group holds more than a sixteenth of a shard: then it is cut by a hash of the document id
into pieces of about that size. A node that is to become k shards is split at the weighted quantile
(k // 2) / k, the median where k is even, along the dimension that is widest against its whole range,
until every leaf is one shard of the target bytes.

Dimensions are the document id, the logarithm of the size, and the categories ``dims``. A category's
place is the share of all bytes in categories sorted before it, so its range is a share of the corpus.

One histogram a level, of all dimensions and all nodes at once, gives each node's widths and the bin
that the quantile falls in. That bin is cut into bins again until it holds one value, or so little
that it does not matter (``slack`` of a shard); what is in the last bin is cut by the text's hash in
the same way. Atoms (a group, or a piece of one) are written once: where an atom is in the tree is an
expression over its places. The driver sees at most nodes * dimensions * bins sums, whatever the input's
size. Only groups over a sixteenth of a shard and their pieces are broadcast; there are at most sixteen
of them to a shard, and twice as many pieces.

Defined cases: a null text has size 16 and checksum 0, and is a group with the empty text only by
chance of equal size and hash; null metadata takes a place of its own below all values; repeated rows
are rows of their own; a very long text is one row of its size, which makes its shard larger by as
much at most; ties at a cut go by a hash of the text; other columns are not looked at, whatever their
names; an empty table gives no rows; with few rows some shards stay empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridtrace.operators.reduce import scan
from gridtrace.session import materialize

BINS = 512
OVERHEAD = 16
_TWO64 = float(2**64)


@dataclass
class Node:
    first: int  # its first shard
    k: int  # shards to come of it
    dim: int = 0
    lo: float = 0.0  # what is under lo goes left, what is over hi right
    hi: float = 0.0
    tie: float = -1.0  # between them, hashes up to this go left
    left: int = -1  # places of its parts in the tree
    right: int = -1


@dataclass
class Search:
    """Where a quantile is looked for: between lo and hi, with the weight below lo."""

    at: int
    goal: float
    below: float
    weight: float  # between lo and hi
    lo: float
    hi: float


def _place(tree: list[Node], depth: int, n_dims: int) -> Column:
    """The place in the tree of an atom: as many steps down as there are levels."""
    if not depth:
        return F.lit(0)
    dim, lo, hi, tie, to_left, to_right = (F.array(*(F.lit(getattr(n, f)) for n in tree)) for f in ("dim", "lo", "hi", "tie", "left", "right"))
    c, h = F.array(*(F.col(f"c{i}") for i in range(n_dims))), F.col("h")

    def down(at: Column, _: Column) -> Column:
        x = F.get(c, F.get(dim, at))
        left = (x < F.get(lo, at)) | ((x <= F.get(hi, at)) & (h <= F.get(tie, at)))
        return F.when(F.get(to_left, at) < 0, at).when(left, F.get(to_left, at)).otherwise(F.get(to_right, at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)


def _step(s: Search, bins: list) -> None:
    """Go on in the bin that the quantile falls in."""
    below = s.below
    for r in bins[:-1]:
        if below + r["w"] > s.goal:
            break
        below += r["w"]
    else:
        r = bins[-1]
    s.below, s.weight, s.lo, s.hi = below, r["w"], r["least"], r["most"]


def _narrow(at: DataFrame, searches: list[Search], value: Column, slack: float) -> None:
    """Cut each search's bin again until it holds one value or weighs no more than ``slack``."""
    size = max((s.at for s in searches), default=0) + 1
    while open_ := {s.at: s for s in searches if s.hi > s.lo and s.weight > slack}:
        bound = lambda f: F.get(F.array(*(F.lit(getattr(open_[i], f) if i in open_ else None).cast("double") for i in range(size))), F.col("node"))  # noqa: B023, E731
        rows = at.select("node", "w", value.alias("v"), bound("lo").alias("lo"), bound("hi").alias("hi")).where("v >= lo AND v <= hi")
        share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        got = (
            rows.groupBy("node", F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin"))
            .agg(F.sum("w").alias("w"), F.min("v").alias("least"), F.max("v").alias("most"))
            .collect()
        )
        for i, s in open_.items():
            _step(s, sorted((r for r in got if r["node"] == i), key=lambda r: r["bin"]))


def _grow(atoms: DataFrame, shards: int, n_dims: int, slack: float) -> tuple[list[Node], int]:
    """The tree, level by level, and its depth."""
    whole = atoms.agg(*(f(f"c{i}").alias(f"{k}{i}") for i in range(n_dims) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    tree, live, depth = [Node(0, shards)], [0] if shards > 1 else [], 0
    if whole["lo0"] is None:  # no rows
        return tree, 0
    lows, spans = [whole[f"lo{i}"] for i in range(n_dims)], [max(whole[f"hi{i}"] - whole[f"lo{i}"], 1e-300) for i in range(n_dims)]
    while live:
        at = atoms.withColumn("node", _place(tree, depth, n_dims)).where(F.col("node").isin(live))
        bin_ = lambda i: F.least(F.lit(BINS - 1), F.floor((F.col(f"c{i}") - lows[i]) / spans[i] * BINS)).cast("int")
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), bin_(i).alias("bin"), F.col(f"c{i}").alias("v")) for i in range(n_dims))))
        sums = (
            at.select("node", "w", each.alias("e"))
            .groupBy("node", "e.dim", "e.bin")
            .agg(F.sum("w").alias("w"), F.min("e.v").alias("least"), F.max("e.v").alias("most"))
            .collect()
        )
        by: dict[tuple[int, int], list] = {}
        for r in sorted(sums, key=lambda r: r["bin"]):
            by.setdefault((r["node"], r["dim"]), []).append(r)
        searches = []
        for i in live:
            n = tree[i]
            if (i, 0) not in by:  # no rows: nothing to cut
                continue
            n.dim = max(range(n_dims), key=lambda d: (by[i, d][-1]["most"] - by[i, d][0]["least"]) / spans[d])
            bins = by[i, n.dim]
            total = sum(r["w"] for r in bins)
            s = Search(i, total * (n.k // 2) / n.k, 0.0, total, bins[0]["least"], bins[-1]["most"])
            _step(s, bins)
            searches.append(s)
        _narrow(at, searches, F.get(F.array(*(F.col(f"c{d}") for d in range(n_dims))), F.get(F.array(*(F.lit(n.dim) for n in tree)), F.col("node"))), slack)
        for s in searches:
            tree[s.at].lo, tree[s.at].hi = s.lo, s.hi
        _cut_ties(at, tree, searches, n_dims, slack)
        parts = []
        for i in live:
            n = tree[i]
            half = n.k // 2
            n.left, n.right = len(tree), len(tree) + 1
            tree += [Node(n.first, half), Node(n.first + half, n.k - half)]
            parts += [j for j in (n.left, n.right) if tree[j].k > 1]
        live, depth = parts, depth + 1
    return tree, depth


def _cut_ties(at: DataFrame, tree: list[Node], searches: list[Search], n_dims: int, slack: float) -> None:
    """The last bin's rows are dealt by hash; the atom that the quantile falls in goes to the nearer side."""
    ties = [Search(s.at, s.goal, s.below, s.weight, 0.0, 1.0) for s in searches]
    pick = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("node"))
    x = F.get(F.array(*(F.col(f"c{d}") for d in range(n_dims))), pick([n.dim for n in tree]))
    here = at.where((x >= pick([n.lo for n in tree])) & (x <= pick([n.hi for n in tree])))
    _narrow(here, ties, F.col("h"), slack)
    for s in ties:
        near = abs(s.below + s.weight - s.goal) < abs(s.below - s.goal)
        tree[s.at].tie = s.hi if near else math.nextafter(s.lo, -math.inf)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), pieces_per_shard: int = 16, slot_rows: int = 20_000, slack: float = 0.001) -> DataFrame:
    """Each row's id, size, text_crc32, law, shard, slot and grown_shard."""
    text = F.col(text_col).cast("binary")
    #: Null comes before all values, and the empty one.
    names = [f"m{i}" for i in range(len(dims))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        F.xxhash64(text_col, F.lit(7)).alias("tk"),
        *(F.coalesce(F.concat(F.lit("1"), F.col(d).cast("string")), F.lit("0")).alias(m) for d, m in zip(dims, names, strict=True)),
    )
    rows = materialize(rows, "sizes")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    group = ["tk", "text_crc32", "size"]
    most = max(1.0, total / shards / pieces_per_shard)
    #: A group's metadata are the least of its rows'.
    groups = rows.groupBy(*group).agg(F.sum("size").alias("gw"), F.min("doc_id").alias("gd"), *(F.min(m).alias(m) for m in names))
    groups = materialize(groups.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("gw") / most)).cast("int")), "groups")
    for m in names:
        share = scan(groups.groupBy(m).agg(F.sum("gw").alias("w")), "w", [m], exclusive=True, name="before")
        groups = groups.join(share.select(m, (F.col("before") / max(1, total)).alias(f"{m}_at")), m)
    #: Groups in one piece are atoms as they are; only the others' rows, of at most sixteen groups a shard, are summed by piece.
    heavy = F.broadcast(groups.where("pieces > 1").select(*group, "pieces"))
    piece = F.pmod(F.xxhash64("doc_id", "tk"), F.col("pieces")).cast("int").alias("piece")
    cut = rows.join(heavy, group).select(*group, piece).groupBy(*group, "piece").agg((F.count("*") * F.col("size")).alias("w"))
    places = [F.coalesce(F.col("gd").cast("double"), F.lit(-1.0)), F.log2(F.col("size").cast("double")), *(F.col(f"{m}_at") for m in names)]
    by_group = groups.select(*group, "pieces", *(c.alias(f"c{i}") for i, c in enumerate(places)))
    columns = [*group, "pieces", "piece", F.col("w").cast("double").alias("w"), (F.xxhash64("tk", "piece").cast("double") / _TWO64 + 0.5).alias("h"), *(f"c{i}" for i in range(len(places)))]
    many = F.broadcast(by_group.where("pieces > 1")).join(cut, group).select(*columns)
    light = groups.where("pieces = 1").select(*group, "pieces", F.lit(0).alias("piece"), F.col("gw").alias("w"), *(c.alias(f"c{i}") for i, c in enumerate(places))).select(*columns)
    atoms = materialize(many.unionByName(light), "atoms")
    tree, depth = _grow(atoms, shards, len(places), slack * total / shards)
    first = F.get(F.array(*(F.lit(n.first) for n in tree)), _place(tree, depth, len(places)))
    placed = atoms.select(*group, "pieces", "piece", first.alias("shard"))
    marked = rows.select("doc_id", *group).join(heavy, group, "left")
    cut_up = marked.where("pieces > 1").withColumn("piece", piece).join(F.broadcast(placed.where("pieces > 1").drop("pieces")), [*group, "piece"])
    whole = marked.where("pieces IS NULL").join(placed.where("pieces = 1").drop("pieces", "piece"), group)
    out = cut_up.select("doc_id", *group, "shard").unionByName(whole.select("doc_id", *group, "shard"))
    n_buckets = max(1, -(-n_rows // (shards * slot_rows)))
    out = materialize(out.withColumn("b", F.pmod(F.xxhash64("doc_id", "tk", "size"), F.lit(n_buckets)).cast("int")), "placed")
    counts = out.groupBy("shard", "b").count()
    before = counts.select("shard", "b", (F.sum("count").over(W.partitionBy("shard").orderBy("b")) - F.col("count")).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "b").orderBy("doc_id", "tk", "size"))
    return out.withColumn("r", number).join(before, ["shard", "b"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("r") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
