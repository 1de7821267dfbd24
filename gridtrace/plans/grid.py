"""Regular decomposition: divisions, block boxes, ghosts, owners, assigners and neighbour links.

Small planning arithmetic runs on the driver; anything per row is a column expression, so locating a
point is a projection and not a join.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = "xyzt"


def factor(n: int) -> list[int]:
    """Prime factors, ascending."""
    out, p = [], 2
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out


def divisions(n_blocks: int, dims: int, given: tuple[int, ...] | None = None, extent: tuple[int, ...] | None = None, smallest_first: bool = False) -> tuple[int, ...]:
    """Blocks along each dimension: factors, largest first, dealt to the open dimensions in turn.

    ``given`` fixes dimensions that are not 0; ``smallest_first`` is the partitioner's order.
    """
    out = [g or 1 for g in (given or (0,) * dims)]
    open_ = [d for d in range(dims) if not (given and given[d])]
    fixed = math.prod(out)
    if n_blocks % fixed or (not open_ and n_blocks != fixed):
        raise ValueError(f"{n_blocks} blocks can't be divided as {given}")
    factors = factor(n_blocks // fixed)
    for k, f in enumerate(factors if smallest_first else reversed(factors)):
        out[open_[k % len(open_)]] *= f
    if extent and any(d > e for d, e in zip(out, extent, strict=True)):
        raise ValueError(f"more blocks than vertices: {out} of {extent}")
    return tuple(out)


def divisions_longest(n_blocks: int, extent: tuple[int, ...]) -> tuple[int, ...]:
    """Divisions by always cutting the longest dimension."""
    size, out = list(map(float, extent)), [1] * len(extent)
    for f in reversed(factor(n_blocks)):
        d = max(range(len(size)), key=lambda i: size[i])
        out[d] *= f
        size[d] /= f
    return tuple(out)


def gid_to_coords(gid: int, divs: tuple[int, ...]) -> tuple[int, ...]:
    out = []
    for d in divs:
        gid, r = divmod(gid, d)
        out.append(r)
    return tuple(out)


def coords_to_gid(coords: tuple[int, ...], divs: tuple[int, ...]) -> int:
    gid = 0
    for c, d in zip(reversed(coords), reversed(divs), strict=True):
        gid = gid * d + c
    return gid


def core_1d(i: int, n: int, lo, hi, continuous: bool = False, shared_face: bool = False):
    """Bounds of block i of n along one dimension; the last discrete block takes the remainder."""
    if continuous:
        return lo + (hi - lo) / n * i, lo + (hi - lo) / n * (i + 1)
    width = (hi - lo + 1) // n
    first = lo + width * i
    last = hi if i == n - 1 else first + width - 1
    return first, last + (1 if shared_face and i < n - 1 else 0)


def _cross(gids: Column, seq: Column, stride: int) -> Column:
    return F.flatten(F.transform(seq, lambda j: F.transform(gids, lambda i: i + j * stride)))


def _places(axis: str, at: Column, n: int, size: int, ghosts: int, wrap: bool) -> Column:
    """Blocks along one dimension whose ghosted box holds the place, with the place."""
    w = size // n
    lo = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((at - ghosts) / w)))
    hi = F.when(at + ghosts >= (n - 1) * w, n - 1).otherwise(F.greatest(F.lit(0), F.floor((at + ghosts) / w)))
    blocks = F.sequence(lo.cast("int"), F.greatest(lo, hi).cast("int"))
    if wrap:
        blocks = F.filter(blocks, lambda _: (at >= -ghosts) & (at <= size - 1 + ghosts))
    return F.transform(blocks, lambda i: F.struct(i.alias("gid"), at.cast("int").alias(axis)))


def _combine(before: Column, here: Column, stride: int, k: int) -> Column:
    def both(i: Column, j: Column) -> Column:
        return F.struct((i["gid"] + j["gid"] * stride).cast("int").alias("gid"), *(i[a].alias(a) for a in AXES[:k]), j[AXES[k]].alias(AXES[k]))

    return F.flatten(F.transform(here, lambda j: F.transform(before, lambda i: both(i, j))))


@dataclass(frozen=True)
class Grid:
    """A discrete domain [0, size - 1] cut into blocks with ghost layers."""

    size: tuple[int, ...]
    divs: tuple[int, ...]
    ghosts: tuple[int, ...]
    wrap: tuple[bool, ...] = ()

    @staticmethod
    def of(size, n_blocks: int, ghosts=1, wrap=(), given=None) -> Grid:
        d = len(size)
        return Grid(tuple(size), divisions(n_blocks, d, given, size), (ghosts,) * d if isinstance(ghosts, int) else tuple(ghosts), tuple(wrap) or (False,) * d)

    @property
    def dims(self) -> int:
        return len(self.size)

    @property
    def n_blocks(self) -> int:
        return math.prod(self.divs)

    def core(self, gid: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        boxes = [core_1d(i, n, 0, s - 1) for i, n, s in zip(gid_to_coords(gid, self.divs), self.divs, self.size, strict=True)]
        return tuple(b[0] for b in boxes), tuple(b[1] for b in boxes)

    def ghosted(self, gid: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        lo, hi = self.core(gid)
        g, w, s = self.ghosts, self.wrap or (False,) * self.dims, self.size
        return (
            tuple(a - x if v else max(0, a - x) for a, x, v in zip(lo, g, w, strict=True)),
            tuple(b + x if v else min(n - 1, b + x) for b, x, v, n in zip(hi, g, w, s, strict=True)),
        )

    def memory(self, n_vars: int = 1, n_runs: int = 1) -> tuple[int, bool]:
        """Bytes of all ghosted blocks of float32 variables, and whether a block holds the whole domain."""
        boxes = [self.ghosted(g) for g in range(self.n_blocks)]
        sizes = [tuple(b - a + 1 for a, b in zip(*box, strict=True)) for box in boxes]
        whole = any(lo == (0,) * self.dims and n == self.size for (lo, _), n in zip(boxes, sizes, strict=True))
        return sum(math.prod(n) for n in sizes) * n_vars * n_runs * 4, whole

    def owner(self, coords: list[Column]) -> Column:
        """The block that owns a point: truncated, divided by the block width, clamped."""
        gid, stride = F.lit(0), 1
        for c, n, s in zip(coords, self.divs, self.size, strict=True):
            cell = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(c.cast("int") / (s // n)).cast("int")))
            gid, stride = gid + cell * stride, stride * n
        return gid.cast("int")

    def owner_np(self, x: np.ndarray) -> np.ndarray:
        gid, stride = np.zeros(len(x), dtype=np.int64), 1
        for d, (n, s) in enumerate(zip(self.divs, self.size, strict=True)):
            gid += np.clip(np.trunc(x[:, d]).astype(np.int64) // (s // n), 0, n - 1) * stride
            stride *= n
        return gid

    def placements(self, coords: list[Column]) -> Column:
        """All places of a vertex in blocks' ghosted boxes: an array of the block and the vertex's coordinates there.

        Along a periodic dimension a vertex is also where it is seen from over the seam, a period further.
        """
        out, stride = None, 1
        for k, (c, n, s, g, wrap) in enumerate(zip(coords, self.divs, self.size, self.ghosts, self.wrap or (False,) * self.dims, strict=True)):
            here = F.flatten(F.array(*(_places(AXES[k], c + shift, n, s, g, wrap) for shift in ((-s, 0, s) if wrap else (0,)))))
            out = here if out is None else _combine(out, here, stride, k)
            stride *= n
        return out

    def owners(self, coords: list[Column]) -> Column:
        """All blocks whose ghosted boxes hold a vertex, as an array."""
        if any(self.wrap):
            return F.array_distinct(F.transform(self.placements(coords), lambda p: p["gid"]))
        per_dim = []
        for c, n, s, g in zip(coords, self.divs, self.size, self.ghosts, strict=True):
            w = s // n
            last = (n - 1) * w  # the last block is wider
            lo = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((c - g) / w)))
            hi = F.when(c + g >= last, n - 1).otherwise(F.greatest(F.lit(0), F.floor((c + g) / w)))
            per_dim.append(F.sequence(lo.cast("int"), F.greatest(lo, hi).cast("int")))
        out, stride = per_dim[0], self.divs[0]
        for seq, n in zip(per_dim[1:], self.divs[1:], strict=True):
            out, stride = _cross(out, seq, stride), stride * n
        return out

    def blocks(self, spark: SparkSession) -> DataFrame:
        """gid, coordinates, core box and ghosted box of every block, by arithmetic over a range."""
        df = spark.range(self.n_blocks).select(F.col("id").cast("int").alias("gid"))
        stride = 1
        for a, n, s, g, w in zip(AXES, self.divs, self.size, self.ghosts, self.wrap or (False,) * self.dims, strict=False):
            i = F.pmod(F.floor(F.col("gid") / stride), F.lit(n)).cast("int")
            width = s // n
            df = df.withColumn(f"c{a}", i).withColumn(f"lb_{a}", (F.col(f"c{a}") * width).cast("int"))
            df = df.withColumn(f"ub_{a}", F.when(F.col(f"c{a}") == n - 1, s - 1).otherwise(F.col(f"lb_{a}") + width - 1).cast("int"))
            lo, hi = F.col(f"lb_{a}") - g, F.col(f"ub_{a}") + g
            df = df.withColumn(f"glb_{a}", (lo if w else F.greatest(F.lit(0), lo)).cast("int")).withColumn(f"gub_{a}", (hi if w else F.least(F.lit(s - 1), hi)).cast("int"))
            stride *= n
        return df

    def complete_links(self, spark: SparkSession) -> DataFrame:
        """Every block's link to every other block. Blocks are few, whatever the field's size."""
        a = self.blocks(spark).select("gid")
        return a.select("gid", F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1))).alias("nbr")).where("gid <> nbr")

    def neighbour_links(self, spark: SparkSession) -> DataFrame:
        """Links to the up to 3^d - 1 blocks around, with direction and wrap flags."""
        offsets = [o for o in itertools.product((-1, 0, 1), repeat=self.dims) if any(o)]
        b = self.blocks(spark).select("gid", *(f"c{a}" for a in AXES[: self.dims]))
        d = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in offsets)))
        df = b.withColumn("dir", d)
        nbr, stride, ok, wraps = F.lit(0), 1, F.lit(True), []
        for k, (a, n, w) in enumerate(zip(AXES, self.divs, self.wrap or (False,) * self.dims, strict=False)):
            c = F.col(f"c{a}") + F.col("dir")[k]
            ok = ok & (F.lit(True) if w else c.between(0, n - 1))
            wraps.append(F.when(c < 0, -1).when(c >= n, 1).otherwise(0))
            nbr, stride = nbr + F.pmod(c, F.lit(n)) * stride, stride * n
        return df.where(ok).select("gid", nbr.cast("int").alias("nbr"), "dir", F.array(*wraps).alias("wrap"))


def round_robin(gid: Column, n: int) -> Column:
    return F.pmod(gid, F.lit(n)).cast("int")


def contiguous(gid: Column, n_blocks: int, n: int) -> Column:
    """Ranks in order; the first ``n_blocks % n`` hold one block more."""
    div, mod = divmod(n_blocks, n)
    edge = mod * (div + 1)
    return F.when(gid < edge, F.floor(gid / (div + 1))).otherwise(mod + F.floor((gid - edge) / max(div, 1))).cast("int")


def linear_id(coords: list[Column], size: tuple[int, ...]) -> Column:
    out, stride = F.lit(0).cast("long"), 1
    for c, s in zip(coords, size, strict=True):
        out, stride = out + c * stride, stride * s
    return out


def block_size(size: tuple[int, ...], n_blocks: int, ghost: int | tuple[int, ...] = 0) -> tuple[int, ...]:
    """Size of block 0 with fixed ghosts on both sides, at most the domain."""
    g = (ghost,) * len(size) if isinstance(ghost, int) else ghost
    return tuple(min(s, s // n + 2 * x) for s, n, x in zip(size, divisions(n_blocks, len(size)), g, strict=True))


def elastic_ghosts(size: tuple[int, ...], n_blocks: int, n_procs: int, limit_mb: int, n_vars: int = 1, n_runs: int = 1, space_only: bool = False, strict_limit: bool = False) -> tuple[int, ...]:
    """Ghost layers that grow in proportion to what is left of each dimension until a block fills its memory.

    The first layers over the limit are returned, as the rule has it; ``strict_limit`` gives the last
    ones under it. A negative limit means full replication.
    """
    dims = 3 if space_only else len(size)
    ds, times = size[:dims], size[3] if space_only else 1
    limit = limit_mb * 2**20 // max(1, n_blocks // n_procs)
    bs = tuple(s // n for s, n in zip(ds, divisions(n_blocks, dims), strict=True))
    if limit_mb < 0:
        return (10000,) * dims
    grow = [np.float32(0 if b == s else 1) for b, s in zip(bs, ds, strict=True)]
    padded = [b if b == s else b + 2 for b, s in zip(bs, ds, strict=True)]
    left = [s - p for s, p in zip(ds, padded, strict=True)]
    widest = max(left)
    if widest <= 0:
        return tuple(int(g) for g in grow)
    ratio = [np.float32(x) / np.float32(widest) for x in left]
    last = tuple(int(g) for g in grow)
    while True:
        ghosts = tuple(int(math.ceil(g)) for g in grow)
        padded = [min(b + 2 * g, s) for b, g, s in zip(bs, ghosts, ds, strict=True)]
        if all(p >= s for p, s in zip(padded, ds, strict=True)):
            return ghosts
        if math.prod(padded) * n_vars * n_runs * 4 * times > limit:
            return last if strict_limit else ghosts
        last = ghosts
        grow = [np.float32(g + r) for g, r in zip(grow, ratio, strict=True)]


def elastic_block_size(size: tuple[int, ...], n_blocks: int, n_procs: int, limit_mb: int, n_vars: int = 1, n_runs: int = 1, factor: int = 1, space_only: bool = False) -> tuple[int, ...]:
    """Size of a block that grows in proportion to what is left, a layer at a time in its nearest dimension, until ``factor`` such blocks fill the memory."""
    dims = 3 if space_only else len(size)
    ds, times = size[:dims], size[3] if space_only else 1
    limit = limit_mb * 2**20 // max(1, n_blocks // n_procs)
    bs = tuple(s // n for s, n in zip(ds, divisions(n_blocks, dims), strict=True))
    grow = [np.float32(b != s) for b, s in zip(bs, ds, strict=True)]
    left = [s - b - int(g) for s, b, g in zip(ds, bs, grow, strict=True)]
    nearest = min((x for x in left if x > 0), default=0)
    ratio = [np.float32(x) / np.float32(nearest) if nearest else np.float32(0) for x in left]
    while True:
        out = tuple(min(b + math.ceil(g), s) for b, g, s in zip(bs, grow, ds, strict=True))
        whole = all(b + g >= s for b, g, s in zip(bs, grow, ds, strict=True))
        if whole or not nearest or math.prod(out) * n_vars * n_runs * 4 * factor * times > limit:
            return out
        grow = [np.float32(g + r) for g, r in zip(grow, ratio, strict=True)]


def ghosts_by_turns(grid: Grid, limit_bytes: int, n_vars: int = 1, n_runs: int = 1) -> tuple[int, ...]:
    """One layer everywhere, then a layer more in each dimension in turn, until all blocks are over the limit or one holds the whole domain."""
    ghosts = [1] * grid.dims
    for turn in itertools.count():
        total, whole = replace(grid, ghosts=tuple(ghosts)).memory(n_vars, n_runs)
        if total > limit_bytes or whole:
            return tuple(ghosts)
        ghosts[turn % grid.dims] += 1


def centred_ghost_box(core_lo: tuple[int, ...], core_hi: tuple[int, ...], ghost_size: tuple[int, ...], size: tuple[int, ...]):
    """A box of a given size around the core, shifted to stay within the domain."""
    lo, hi = [], []
    for a, b, g, s in zip(core_lo, core_hi, ghost_size, size, strict=True):
        g = min(g, s)
        first = min(max(0, a - (g - (b - a + 1)) // 2), s - g)
        lo.append(first)
        hi.append(first + g - 1)
    return tuple(lo), tuple(hi)


def covers_domain(boxes: list[tuple[tuple[int, ...], tuple[int, ...]]], size: tuple[int, ...]) -> bool:
    """Whether disjoint boxes tile the domain."""
    return sum(math.prod(b - a + 1 for a, b in zip(lo, hi, strict=True)) for lo, hi in boxes) == math.prod(size)
