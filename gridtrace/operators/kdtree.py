"""k-d trees: constrained rebalancing, histogram and sampling medians, leaf links.

One level cuts all its nodes at once: points are counted by (node, bin), cumulated by a window over
bins, and one row a node comes back to the driver. Points get their child by a join with the split
table, which has a row for each node of the level and so is bounded by the number of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtrace.plans.grid import Grid
from gridtrace.session import materialize


@dataclass(frozen=True)
class Node:
    path: int
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    div_lo: tuple[int, ...] = ()
    div_hi: tuple[int, ...] = ()


def levels(n_blocks: int) -> int:
    m = n_blocks.bit_length() - 1
    if n_blocks < 1 or 1 << m != n_blocks:
        raise ValueError("a k-d tree needs a power of two of blocks")
    return m


def schedule(divs: tuple[int, ...]) -> list[int]:
    """Dimensions in turn, without those whose divisions can't be halved any more."""
    left, out, d = list(divs), [], 0
    while any(x > 1 for x in left):
        if left[d] > 1:
            out.append(d)
            left[d] //= 2
        d = (d + 1) % len(divs)
    return out


def legal_range(node: Node, d: int, block: int, ghost: int) -> tuple[int, float, float]:
    """The middle division, and where a split may lie: within the ghost layers around it and the cut box."""
    mid = node.div_lo[d] + (node.div_hi[d] - node.div_lo[d] + 1) // 2
    at = mid * block
    return mid, max(node.lo[d], at - ghost), min(node.hi[d], at - 1 + ghost)


def histogram(points: DataFrame, nodes: DataFrame, bins: int, p: str = "p") -> DataFrame:
    """(node, bin, count): each point's coordinate in its node's dimension, clamped to the last bin."""
    x = F.element_at(p, F.col("dim") + 1).cast("float")
    width = ((F.col("hi") - F.col("lo")) / bins).cast("float")
    bin_ = F.when(width > 0, F.least(F.lit(bins - 1), ((x - F.col("lo")) / width).cast("float").cast("int"))).otherwise(0)
    return points.join(F.broadcast(nodes), "node").groupBy("node", F.greatest(F.lit(0), bin_).alias("bin")).agg(F.count("*").alias("count"))


def _cuts(points: DataFrame, nodes: list[dict], bins: int, p: str) -> dict[int, float | None]:
    """Per node the split before the core-edge rule: None where no bin passes half the total."""
    spark = points.sparkSession
    table = spark.createDataFrame([(n["node"], n["dim"], float(n["lo"]), float(n["hi"]), n.get("range0")) for n in nodes], "node long, dim int, lo float, hi float, range0 double")
    h = histogram(points, table, bins, p).join(F.broadcast(table), "node")
    w = W.partitionBy("node")
    h = h.withColumn("cum", F.sum("count").over(w.orderBy("bin"))).withColumn("half", F.floor(F.sum("count").over(w) / 2))
    low = (F.col("lo") + F.col("bin").cast("float") * ((F.col("hi") - F.col("lo")) / bins).cast("float")).cast("double")
    h = h.withColumn("low", low)
    late = F.coalesce(F.col("low") >= F.col("range0"), F.lit(True))
    got = h.groupBy("node").agg(
        F.coalesce(F.sum(F.when(~late, F.col("count"))), F.lit(0)).alias("skipped"), F.first("half").alias("half"), F.min(F.when(late & (F.col("cum") > F.col("half")), F.col("low"))).alias("low")
    )
    out: dict[int, float | None] = {n["node"]: None for n in nodes}
    for r in got.collect():
        out[r["node"]] = -math.inf if r["skipped"] >= r["half"] and r["skipped"] else r["low"]
    return out


def split_nodes(points: DataFrame | None, nodes: list[Node], d: int, grid: Grid | None, constrained: bool, first: bool, bins: int, p: str) -> list[float]:
    """Where each node of a level is cut along dimension d."""
    if first:
        return [float(legal_range(n, d, grid.size[d] // grid.divs[d], grid.ghosts[d])[0] * (grid.size[d] // grid.divs[d])) for n in nodes]
    ranges = [legal_range(n, d, grid.size[d] // grid.divs[d], grid.ghosts[d])[1:] if constrained else None for n in nodes]
    cuts = _cuts(points, [{"node": n.path, "dim": d, "lo": n.lo[d], "hi": n.hi[d], "range0": float(r[0]) if r else None} for n, r in zip(nodes, ranges, strict=True)], bins, p)
    out = []
    for n, r in zip(nodes, ranges, strict=True):
        at = cuts[n.path]
        if constrained:
            at = float(r[0]) if at is None or at == -math.inf else min(float(r[1]), at)
            at = (r[0] + r[1]) / 2 if at in (n.lo[d], n.hi[d]) else at
        elif at is None or at in (n.lo[d], n.hi[d]):
            at = (n.lo[d] + n.hi[d]) / 2
        out.append(float(np.float32(at)))
    return out


def _children(n: Node, d: int, at: float, grid: Grid | None) -> tuple[Node, Node]:
    left = replace(n, path=n.path * 2, hi=(*n.hi[:d], at, *n.hi[d + 1 :]))
    right = replace(n, path=n.path * 2 + 1, lo=(*n.lo[:d], at, *n.lo[d + 1 :]))
    if n.div_lo:
        mid = n.div_lo[d] + (n.div_hi[d] - n.div_lo[d] + 1) // 2
        left = replace(left, div_hi=(*n.div_hi[:d], mid - 1, *n.div_hi[d + 1 :]))
        right = replace(right, div_lo=(*n.div_lo[:d], mid, *n.div_lo[d + 1 :]))
    return left, right


def _descend(points: DataFrame, nodes: list[Node], d: int, cuts: list[float], p: str) -> DataFrame:
    table = points.sparkSession.createDataFrame([(n.path, float(c)) for n, c in zip(nodes, cuts, strict=True)], "node long, cut double")
    x = F.element_at(p, d + 1).cast("double")
    return points.join(F.broadcast(table), "node").withColumn("node", F.col("node") * 2 + (x >= F.col("cut")).cast("int")).drop("cut")


def constrained(points: DataFrame | None, grid: Grid, bound: bool = True, first: bool = False, bins: int = 2048, p: str = "p") -> tuple[DataFrame | None, list[Node]]:
    """Points with their leaf ``node``, and the leaves. Leaf numbers are path bits, the first split highest.

    ``first`` cuts at the middle divisions and needs no points; ``bound`` keeps splits within the ghost
    layers, so that every point stays inside its block's loaded data.
    """
    levels(grid.n_blocks)
    top = tuple(float(s - 1) for s in grid.size)
    nodes = [Node(0, (0.0,) * grid.dims, top, (0,) * grid.dims, tuple(n - 1 for n in grid.divs))]
    at = points.withColumn("node", F.lit(0).cast("long")) if points is not None else None
    for d in schedule(grid.divs):
        cuts = split_nodes(at, nodes, d, grid, bound, first, bins, p)
        if at is not None:
            at = _descend(at, nodes, d, cuts, p)
        nodes = [c for n, v in zip(nodes, cuts, strict=True) for c in _children(n, d, v, grid)]
    return at, nodes


def histogram_tree(points: DataFrame, lo: tuple[float, ...], hi: tuple[float, ...], n_blocks: int, bins: int = 64, p: str = "p") -> tuple[DataFrame, list[Node]]:
    """Median splits by histogram, dimensions in turn."""
    nodes, at = [Node(0, lo, hi)], points.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels(n_blocks)):
        d = level % len(lo)
        cuts = split_nodes(at, nodes, d, None, False, False, bins, p)
        at = _descend(at, nodes, d, cuts, p)
        nodes = [c for n, v in zip(nodes, cuts, strict=True) for c in _children(n, d, v, None)]
    return at, nodes


def sampling_tree(points: DataFrame, lo: tuple[float, ...], hi: tuple[float, ...], n_blocks: int, samples: int = 64, order: Column | None = None, p: str = "p") -> tuple[DataFrame, list[Node]]:
    """Splits at the median of at most ``samples`` rows a node, the first by ``order`` (a seeded hash unless given)."""
    nodes, at = [Node(0, lo, hi)], points.withColumn("node", F.lit(0).cast("long"))
    order = F.xxhash64(p, F.lit(7)) if order is None else order
    for level in range(levels(n_blocks)):
        d = level % len(lo)
        x = F.element_at(p, d + 1).cast("double")
        picked = at.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(order))).where(F.col("r") <= samples)
        s = F.sort_array(F.collect_list(x))
        got = {r["node"]: r["m"] for r in picked.groupBy("node").agg(F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")).alias("m")).collect()}
        cuts = [got.get(n.path, (n.lo[d] + n.hi[d]) / 2) for n in nodes]
        at = materialize(_descend(at, nodes, d, cuts, p), "kd-level")
        nodes = [c for n, v in zip(nodes, cuts, strict=True) for c in _children(n, d, v, None)]
    return at, nodes


def leaves_df(spark, nodes: list[Node]) -> DataFrame:
    return spark.createDataFrame([(n.path, list(n.lo), list(n.hi)) for n in nodes], "gid long, lo array<double>, hi array<double>")


def leaf_links(leaves: DataFrame, extent: list[float] | None = None) -> DataFrame:
    """Leaves whose closed boxes meet in every dimension; with an extent, periodically, with the wrap direction.

    Leaves are as many as blocks, so the join is over two small tables.
    """
    a = leaves.select("gid", "lo", "hi")
    b = leaves.select(F.col("gid").alias("nbr"), F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))
    if extent is None:
        meet = F.forall(F.arrays_zip("lo", "hi", "nlo", "nhi"), lambda z: (z["lo"] <= z["nhi"]) & (z["nlo"] <= z["hi"]))
        return a.join(b, (F.col("gid") != F.col("nbr")) & meet).select("gid", "nbr")
    import itertools

    shifts = F.array(*(F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=len(extent))))
    ext = F.array(*(F.lit(float(e)) for e in extent))
    b = b.withColumn("wrap", F.explode(shifts))
    moved = lambda c: F.zip_with(c, F.zip_with("wrap", ext, lambda s, e: s * e), lambda v, m: v + m)
    b = b.withColumn("nlo", moved("nlo")).withColumn("nhi", moved("nhi"))
    meet = F.forall(F.arrays_zip("lo", "hi", "nlo", "nhi"), lambda z: (z["lo"] <= z["nhi"]) & (z["nlo"] <= z["hi"]))
    return a.join(b, meet).where("gid <> nbr OR exists(wrap, s -> s <> 0)").select("gid", "nbr", "wrap")


def blocks_of_leaves(spark, nodes: list[Node], grid: Grid) -> DataFrame:
    """Data boxes after the geometric build: the divisions' vertices, ghosts clamped to the domain."""
    rows = []
    for n in nodes:
        bs = [s // k for s, k in zip(grid.size, grid.divs, strict=True)]
        lb = [a * b for a, b in zip(n.div_lo, bs, strict=True)]
        ub = [s - 1 if v == k - 1 else (v + 1) * b - 1 for v, b, s, k in zip(n.div_hi, bs, grid.size, grid.divs, strict=True)]
        glb = [max(0, a - g) for a, g in zip(lb, grid.ghosts, strict=True)]
        gub = [min(s - 1, b + g) for b, g, s in zip(ub, grid.ghosts, grid.size, strict=True)]
        rows.append((n.path, lb, ub, glb, gub, list(n.lo), list(n.hi)))
    return spark.createDataFrame(rows, "gid long, lb array<int>, ub array<int>, glb array<int>, gub array<int>, core_min array<double>, core_max array<double>")


def owner_map(nodes: list[Node], grid: Grid) -> dict[int, int]:
    """Regular cell -> leaf, after the geometric build."""
    from gridtrace.plans.grid import coords_to_gid

    return {coords_to_gid(n.div_lo, grid.divs): n.path for n in nodes}
