"""Multilinear interpolation, by numpy gathers over a brick and by joins with a vertex table."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(p: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start <= p < start + size - 1 in every dimension; not so for NaN."""
    return ((p >= start) & (p < start + size - 1)).all(axis=1)


def lerp(p: np.ndarray, data: np.ndarray, start: np.ndarray, ghost_start: np.ndarray | None = None, ghost_size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values (n, variables) at points, and which points lie in the ghosted box.

    ``data`` is (variables, ..., z, y, x) and begins at ``start``; points elsewhere give NaN.
    """
    d = p.shape[1]
    size = np.array(data.shape[:0:-1])
    ok = inside(p, start if ghost_start is None else ghost_start, size if ghost_size is None else ghost_size)
    ok &= inside(p, start, size)
    out = np.full((len(p), len(data)), np.nan, dtype=data.dtype)
    at = np.flatnonzero(ok)
    if len(at):
        q = p[at] - start.astype(p.dtype)
        low = np.floor(q).astype(np.int64)
        part = q - low.astype(p.dtype)
        total = np.zeros((len(data), len(at)), dtype=data.dtype)
        for corner in itertools.product((0, 1), repeat=d):
            w = reduce(np.multiply, [part[:, k] if c else 1 - part[:, k] for k, c in enumerate(corner)])
            index = tuple(low[:, k] + corner[k] for k in reversed(range(d)))
            total += data[(slice(None), *index)] * w.astype(data.dtype)
        out[at] = total.T
    return out, ok


def lerp_join(points: DataFrame, field: DataFrame, coords: list[str], variables: list[str], key: str) -> DataFrame:
    """Interpolated variables of each point, by an equi-join at its 2^d corners.

    ``field`` has integer columns named as ``coords``. Points without all corners are left out.
    """
    d = len(coords)
    corners = F.array(*(F.array(*map(F.lit, c)) for c in itertools.product((0, 1), repeat=d)))
    df = points.withColumn("corner", F.explode(corners))
    weight: Column = F.lit(1.0)
    for k, c in enumerate(coords):
        part = F.col(c) - F.floor(c)
        weight = weight * F.when(F.col("corner")[k] == 1, part).otherwise(1 - part)
        df = df.withColumn(f"v_{c}", (F.floor(c) + F.col("corner")[k]).cast("int"))
    df = df.withColumn("weight", weight)
    f = field.select(*(F.col(c).cast("int").alias(f"v_{c}") for c in coords), *variables)
    return (
        df.join(f, [f"v_{c}" for c in coords])
        .groupBy(key)
        .agg(*(F.sum(F.col("weight") * F.col(v)).alias(v) for v in variables), F.count("*").alias("corners"))
        .where(F.col("corners") == 2**d)
        .drop("corners")
    )
