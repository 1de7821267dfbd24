"""Seed generators: lattices, boxes, tables, and the known set-ups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrace.plans.grid import AXES, Grid


@dataclass(frozen=True)
class Setup:
    """Lattice, step limits and kernel of one kind of run."""

    lattice: tuple[int, ...]
    max_steps: int
    h: float
    round_steps: int
    kernel: str
    drop_zero: bool = False
    wrap: bool = False
    box: tuple[tuple[int, int], ...] = ()


#: Fixed values of the known set-ups.
SETUPS = {
    "synthetic_2d": Setup((40, 40), 1024, 0.2, 90, "rk1_2d", drop_zero=True),
    "turbulence_3d": Setup((16, 16, 16), 2048, 1.0, 200, "rk1_3d"),
    "turbulence_3d_dense": Setup((512, 512, 512), 2048, 1.0, 200, "rk1_3d"),
    "hurricane_3d": Setup((250, 250, 50), 2048, 450.0, 50, "hurricane_rk1_3d"),
    "hurricane_4d": Setup((128, 128, 32, 48), 1024, 450.0, 50, "hurricane_rk1_4d"),
    "atmosphere_4d": Setup((), 2048, 0.2, 20, "atmosphere_rk1_4d", wrap=True, box=((59, 96), (119, 142), (0, 71), (0, 23))),
    "atmosphere_4d_full": Setup((64, 36, 18, 24), 2000, 0.2, 50, "atmosphere_rk1_4d", wrap=True),
}


def axis(n: int, size: int, exact: bool = False) -> list[float]:
    """Lattice values along one axis, summed up in float32; the last may be lost to rounding unless exact."""
    if exact:
        return np.linspace(0, size - 1, n).astype(np.float32).astype(float).tolist()
    gap = np.float32(np.float32(1.0) / np.float32(n - 1) * np.float32(size - 1))
    out, v = [], np.float32(0)
    while v <= size - 1:
        out.append(float(v))
        v = np.float32(v + gap)
    return out


def from_axes(spark: SparkSession, axes: list[list[float]], grid: Grid | None = None, drop_zero: bool = False, dtype: str = "float") -> DataFrame:
    """All combinations of axis values, by position in one range: no join and no rescan per block."""
    names, n = AXES[: len(axes)], int(np.prod([len(a) for a in axes]))
    df, stride = spark.range(n), n
    for name, values in zip(names, axes, strict=True):
        stride //= len(values)
        at = F.pmod(F.floor(F.col("id") / stride), F.lit(len(values))).cast("int")
        df = df.withColumn(name, F.element_at(F.array(*map(F.lit, values)), at + 1).cast(dtype))
    if drop_zero:
        df = df.where(" AND ".join(f"{a} <> 0" for a in names))
    return finish(df.withColumnRenamed("id", "particle_id"), list(names), grid)


def finish(df: DataFrame, axes: list[str], grid: Grid | None) -> DataFrame:
    """Add owner and counters."""
    gid = grid.owner([F.col(a) for a in axes]) if grid else F.lit(0)
    return df.withColumns(
        {"home_gid": gid, "cur_gid": gid, "num_steps": F.lit(0), "num_rounds": F.lit(0), "finished": F.lit(False), "status": F.lit(0).cast("tinyint")}
    ).select("particle_id", "home_gid", "cur_gid", "num_steps", "num_rounds", *axes, "finished", "status")


def lattice(spark: SparkSession, n: tuple[int, ...], grid: Grid, drop_zero: bool = False, exact: bool = False, dtype: str = "float") -> DataFrame:
    return from_axes(spark, [axis(k, s, exact) for k, s in zip(n, grid.size, strict=True)], grid, drop_zero, dtype)


def box(spark: SparkSession, bounds: tuple[tuple[int, int], ...], grid: Grid, stride: int = 1, dtype: str = "float") -> DataFrame:
    """Whole-numbered points of a closed box."""
    return from_axes(spark, [[float(v) for v in range(a, b + 1, stride)] for a, b in bounds], grid, dtype=dtype)


def per_block(spark: SparkSession, grid: Grid, stride: int, dtype: str = "float") -> DataFrame:
    """Every block's own strided lattice; ids are the linear index of the vertex."""
    b = grid.blocks(spark)
    axes = AXES[: grid.dims]
    for a in axes:
        b = b.withColumn(a, F.explode(F.sequence(f"lb_{a}", f"ub_{a}", F.lit(stride))))
    from gridtrace.plans.grid import linear_id

    df = b.withColumn("particle_id", linear_id([F.col(a) for a in axes], grid.size)).select("particle_id", *(F.col(a).cast(dtype).alias(a) for a in axes))
    return finish(df, list(axes), grid)


def from_table(df: DataFrame, grid: Grid, id_col: str, coords: list, dtype: str = "float") -> DataFrame:
    """Seeds of a table: an id and a column expression for each coordinate."""
    axes = list(AXES[: grid.dims])
    return finish(df.select(F.col(id_col).cast("long").alias("particle_id"), *(F.expr(c).cast(dtype).alias(a) if isinstance(c, str) else c.cast(dtype).alias(a) for a, c in zip(axes, coords, strict=True))), axes, grid)


def of_setup(spark: SparkSession, name: str, grid: Grid) -> DataFrame:
    s = SETUPS[name]
    return box(spark, s.box, grid) if s.box else lattice(spark, s.lattice, grid, s.drop_zero)
