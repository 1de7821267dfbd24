"""Gridded fields: vertex tables, analytic fields, and bricks with ghost layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrace.functions.kernels import Brick
from gridtrace.plans.grid import AXES, Grid

BRICK = "gid int, start array<int>, shape array<int>, ghost_start array<int>, ghost_size array<int>, dtype string, data binary"


def vertices(spark: SparkSession, size: tuple[int, ...]) -> DataFrame:
    """All vertices, from one range and arithmetic."""
    df, stride = spark.range(int(np.prod(size))), 1
    for a, s in zip(AXES, size, strict=False):
        df = df.withColumn(a, F.pmod(F.floor(F.col("id") / stride), F.lit(s)).cast("int"))
        stride *= s
    return df.drop("id")


def analytic(spark: SparkSession, kind: str, size: tuple[int, ...], c: float = 1.0, velocity: tuple[float, ...] = (), dtype: str = "float") -> DataFrame:
    """A field with a closed-form answer: constant, zero, shear, saddle or rotation."""
    df = vertices(spark, size)
    mx, my = (size[0] - 1) / 2, (size[1] - 1) / 2
    x, y = F.col("x") - mx, F.col("y") - my
    zero = F.lit(0.0)
    uv = {
        "constant": [F.lit(float(v)) for v in (*velocity, 0.0, 0.0, 0.0)],
        "zero": [zero, zero],
        "shear": [F.col("y") * c, zero],
        "saddle": [x * c, -y * c],
        "rotation": [-y * c, x * c],
    }[kind]
    uv = (uv + [zero] * 3)[: max(2, min(3, len(size)))]
    return df.select(*AXES[: len(size)], *(e.cast(dtype).alias(n) for e, n in zip(uv, "uvw", strict=False)))


def to_bricks(field: DataFrame, grid: Grid, variables: list[str], dtype: str = "float32") -> DataFrame:
    """Copy each vertex to the blocks whose ghosted box holds it, over the seam of periodic dimensions too, and gather each block's arrays.

    A task holds one padded block at a time, which the memory limit of elastic ghosts bounds.
    """
    axes = list(AXES[: grid.dims])
    at = [F.col(a) for a in axes]
    if any(grid.wrap):
        rows = field.select(*variables, F.explode(grid.placements(at)).alias("p")).select("p.*", *variables)
    else:
        rows = field.select(*axes, *variables).withColumn("gid", F.explode(grid.owners(at)))

    def gather(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.array(b) for b in grid.ghosted(int(key[0])))
        shape = hi - lo + 1
        data = np.full((len(variables), *shape[::-1]), np.nan, dtype=dtype)
        at = tuple((g[a].to_numpy() - lo[k]) for k, a in reversed(list(enumerate(axes))))
        for v, name in enumerate(variables):
            data[(v, *at)] = g[name].to_numpy()
        return brick_row(int(key[0]), data, lo, lo, shape)

    return rows.groupBy("gid").applyInPandas(gather, BRICK)


def brick_row(gid: int, data: np.ndarray, start, ghost_start, ghost_size) -> pd.DataFrame:
    return pd.DataFrame(
        {"gid": [gid], "start": [list(map(int, start))], "shape": [list(data.shape)], "ghost_start": [list(map(int, ghost_start))], "ghost_size": [list(map(int, ghost_size))], "dtype": [data.dtype.str], "data": [data.tobytes()]}
    )


def brick_of(row) -> Brick:
    data = np.frombuffer(row.data, dtype=row.dtype).reshape(row.shape)
    return Brick(data, np.array(row.start), np.array(row.ghost_start), np.array(row.ghost_size))


def bricks_from_array(spark: SparkSession, data: np.ndarray, grid: Grid) -> DataFrame:
    """Bricks of an array (variables, ..., y, x) that the driver holds: for tests and small fields."""
    rows = []
    for gid in range(grid.n_blocks):
        lo, hi = grid.ghosted(gid)
        cut = tuple(slice(a, b + 1) for a, b in reversed(list(zip(lo, hi, strict=True))))
        part = np.ascontiguousarray(data[(slice(None), *cut)])
        rows.append(brick_row(gid, part, lo, lo, np.array(hi) - np.array(lo) + 1))
    return spark.createDataFrame(pd.concat(rows), BRICK)


def join_variables(parts: list[DataFrame], axes: list[str]) -> DataFrame:
    """One field of several single-variable scans."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, axes)
    return out
