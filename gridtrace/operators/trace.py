"""Tracing particles to the end: fixed blocks, k-d rebalancing, interval quotas, and a whole-field mode.

Every round joins particles with their block's brick by a cogroup. A block with many particles is cut
into parts by a hash of the particle, and its brick goes to each part, so no task holds more than
``chunk`` particles. One aggregate a round comes back to the driver, of a row for each block. Rounds
are written to the shared folder, so a lost executor costs the running round at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrace.functions.kernels import KERNELS, advance
from gridtrace.operators import kdtree
from gridtrace.plans.grid import AXES, Grid
from gridtrace.session import materialize
from gridtrace.sources.fields import brick_of

STATE = ["particle_id", "home_gid", "cur_gid", "num_steps", "num_rounds"]


@dataclass
class Plan:
    """What a trace needs besides particles and bricks."""

    grid: Grid
    kernel: str | Callable = "rk1_2d"
    h: float = 0.2
    max_steps: int = 1024
    round_steps: int = 90
    mode: str = "baseline"  # baseline, kdtree
    constrained: bool = True
    wrap: bool = False
    dtype: str = "float32"
    bins: int = 2048
    max_rounds: int = 10_000
    chunk: int = 200_000
    marks: tuple[int, ...] = ()  # budgets left at which positions are recorded
    owners: dict[int, int] | None = None  # regular cell -> leaf, set by a k-d trace

    def step(self) -> Callable:
        return KERNELS[self.kernel] if isinstance(self.kernel, str) else self.kernel


@dataclass
class Result:
    particles: DataFrame  # every particle where it ended
    rounds: pd.DataFrame  # round, gid, particles, steps, finished
    snapshots: DataFrame | None = None
    leaves: list = field(default_factory=list)


def _map_literal(by: dict[int, int], key: Column, default: int) -> Column:
    if not by:
        return F.lit(default)
    m = F.create_map(*(F.lit(int(v)) for kv in by.items() for v in kv))
    return F.coalesce(F.element_at(m, key), F.lit(default))


def trace_round(particles: DataFrame, bricks: DataFrame, plan: Plan, counts: dict[int, int]) -> DataFrame:
    """One round of every unfinished particle in its block's brick; ``work`` is what it took."""
    axes = list(AXES[: plan.grid.dims])
    salts = {g: -(-n // plan.chunk) for g, n in counts.items() if n > plan.chunk}
    n = _map_literal(salts, F.col("cur_gid"), 1)
    p = particles.withColumn("salt", F.pmod(F.xxhash64("particle_id"), n).cast("int"))
    m = _map_literal(salts, F.col("gid"), 1)
    b = bricks.withColumn("salt", F.explode(F.sequence(F.lit(0), m - 1)))
    kind = "double" if plan.dtype == "float64" else "float"
    schema = ", ".join(["particle_id long", "home_gid int", "cur_gid int", "num_steps int", "num_rounds int", *(f"{a} {kind}" for a in axes), "finished boolean", "status tinyint", "work long", "phase int"])
    step, domain = plan.step(), np.array(plan.grid.size)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        if not len(right):
            raise ValueError(f"no brick for block {key[0]}")
        brick = brick_of(next(right.itertuples()))
        x = left[axes].to_numpy(dtype=plan.dtype)
        x, steps, done, status, work, budget, seen = advance(step, brick, x, left["num_steps"].to_numpy(), plan.h, plan.round_steps, plan.max_steps, domain, plan.wrap, plan.marks)
        out = left[STATE].copy()
        out["num_steps"], out["num_rounds"] = steps, left["num_rounds"] + 1
        for k, a in enumerate(axes):
            out[a] = x[:, k]
        out["finished"], out["status"], out["work"], out["phase"] = done, status, work, -1
        parts = [out]
        for mark, (at, hit) in seen.items():  # a particle that stopped with more budget left is there as it stands
            hit = hit | (~done & (budget >= mark))
            s = out[hit].copy()
            for k, a in enumerate(axes):
                s[a] = np.where(seen[mark][1][hit], at[hit, k], x[hit, k])
            s["phase"], s["work"] = mark, 0
            parts.append(s)
        return pd.concat(parts) if len(parts) > 1 else out

    return p.groupBy("cur_gid", "salt").cogroup(b.groupBy("gid", "salt")).applyInPandas(run, schema)


def trace(particles: DataFrame, bricks: DataFrame, plan: Plan) -> Result:
    """Rounds until no particle is left. No particles give empty results; a round without any work is an error."""
    axes = list(AXES[: plan.grid.dims])
    cols = [*STATE, *axes, "finished", "status"]
    if plan.mode == "kdtree":  # blocks are named by their leaf of the geometric build
        _, nodes = kdtree.constrained(None, plan.grid, first=True)
        plan = replace(plan, owners=kdtree.owner_map(nodes, plan.grid))
        bricks = bricks.withColumn("gid", _map_literal(plan.owners, F.col("gid"), -1))
        particles = particles.withColumn("cur_gid", _owner(plan))
    bricks = materialize(bricks, "bricks")
    done, snaps, rounds, leaves = [], [], [], []
    now = particles.select(*cols)
    counts = {r["cur_gid"]: r["count"] for r in now.groupBy("cur_gid").count().collect()}
    for k in range(plan.max_rounds):
        if not counts:
            break
        got = materialize(trace_round(now, bricks, plan, counts).withColumn("next", _owner(plan)), "round")
        main = got.where("phase < 0")
        left = (~F.col("finished")).cast("long")
        by = main.groupBy("cur_gid", "next").agg(F.count("*").alias("n"), F.sum("work").alias("w"), F.sum(left).alias("left")).collect()  # a row for each pair of blocks
        stats = pd.DataFrame([tuple(r) for r in by], columns=["gid", "next", "n", "w", "left"])
        for g, s in stats.groupby("gid"):
            rounds.append((k, g, int(s["n"].sum()), int(s["w"].sum()), int(s["n"].sum() - s["left"].sum())))
        stays = not stats["w"].sum() and stats["left"].sum() == stats["n"].sum()
        if stays and (plan.mode == "kdtree" or (stats["gid"] == stats["next"]).all()):
            raise RuntimeError("no particle went on: every divided dimension needs a ghost layer")
        done.append(main.where("finished").select(*cols))
        if plan.marks:
            snaps.append(got.where("phase >= 0").select(F.lit(k).alias("round"), "phase", "particle_id", "cur_gid", *axes))
        if not stats["left"].sum():
            break
        now = main.where("NOT finished")
        if plan.mode == "baseline":
            now = now.withColumn("cur_gid", F.col("next")).select(*cols)
            go = stats[stats["left"] > 0].groupby("next")["left"].sum()
            counts = {int(g): int(n) for g, n in go.items()}
        else:
            now, leaves = _balance(now.select(*cols), plan)
            counts = {r["cur_gid"]: r["count"] for r in now.groupBy("cur_gid").count().collect()}
    else:
        raise RuntimeError(f"not done after {plan.max_rounds} rounds")
    union = lambda parts: _union(parts) if parts else None
    frame = pd.DataFrame(rounds, columns=["round", "gid", "particles", "steps", "finished"])
    return Result(union(done) if done else now, frame, union(snaps), leaves)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _owner(plan: Plan) -> Column:
    cell = plan.grid.owner([F.col(a) for a in AXES[: plan.grid.dims]])
    return _map_literal(plan.owners, cell, -1) if plan.owners else cell


def _balance(now: DataFrame, plan: Plan) -> tuple[DataFrame, list]:
    """The unfinished by a k-d tree over where they are, and its leaves."""
    axes = AXES[: plan.grid.dims]
    at, nodes = kdtree.constrained(now.withColumn("p", F.array(*(F.col(a).cast("double") for a in axes))), plan.grid, plan.constrained, bins=plan.bins)
    out = materialize(at.withColumn("cur_gid", F.col("node").cast("int")).drop("p", "node"), "balanced")
    return out, nodes


def trace_whole(particles: DataFrame, data: np.ndarray, plan: Plan, most_bytes: int = 256 << 20) -> DataFrame:
    """All particles to the end against the whole field, in one pass and without a shuffle.

    The field is broadcast, so it must be no larger than ``most_bytes``; larger fields go by blocks.
    """
    if data.nbytes > most_bytes:
        raise ValueError(f"a field of {data.nbytes} bytes is not broadcast: trace it by blocks")
    shared = particles.sparkSession.sparkContext.broadcast(np.ascontiguousarray(data))
    axes, step, domain = list(AXES[: plan.grid.dims]), plan.step(), np.array(plan.grid.size)
    kind = "double" if plan.dtype == "float64" else "float"
    schema = ", ".join(["particle_id long", "num_steps int", *(f"{a} {kind}" for a in axes), "finished boolean", "status tinyint", "work long"])

    def run(batches):
        from gridtrace.functions.kernels import Brick

        brick = Brick.whole(shared.value)
        for b in batches:
            x, steps, done, status, work, _, _ = advance(step, brick, b[axes].to_numpy(dtype=plan.dtype), b["num_steps"].to_numpy(), plan.h, plan.max_steps + 1, plan.max_steps, domain, plan.wrap)
            out = pd.DataFrame({"particle_id": b["particle_id"], "num_steps": steps, **{a: x[:, k] for k, a in enumerate(axes)}})
            yield out.assign(finished=done, status=status, work=work)

    return particles.select("particle_id", "num_steps", *axes).mapInPandas(run, schema)


def intervals(particles: DataFrame, bricks: DataFrame, plan: Plan, n_rounds: int = 40) -> Result:
    """Quota mode: the step limit is shared out over so many rounds, each traced within a block at a time."""
    return trace(particles, bricks, replace(plan, round_steps=max(1, -(-plan.max_steps // n_rounds))))


def misplaced(particles: DataFrame, blocks: DataFrame, axes: list[str]) -> DataFrame:
    """Particles outside their block's ghosted box: none, if all is well."""
    bad = F.lit(False)
    for a in axes:
        bad = bad | (F.col(a) < F.col(f"glb_{a}")) | (F.col(a) >= F.col(f"gub_{a}"))
    return particles.join(F.broadcast(blocks), particles["cur_gid"] == blocks["gid"]).where(bad)
