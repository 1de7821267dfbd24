"""Column expressions: boxes, distances, longitude and latitude, predicates."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtrace.functions.kernels import COLUMNS, EARTH


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def in_block(p: list[Column], lo: list[Column], hi: list[Column], size: tuple[int, ...]) -> Column:
    """Ownership of a seed: up to the next block's first vertex, the domain's last vertex included."""
    return _all([F.when(b == s - 1, x.between(a, b)).otherwise((x >= a) & (x < b + 1)) for x, a, b, s in zip(p, lo, hi, size, strict=True)])


def in_domain(p: list[Column], size: tuple[int, ...]) -> Column:
    return _all([(~F.isnan(x.cast("double"))) & (x >= 0) & (x < s - 1) for x, s in zip(p, size, strict=True)])


def in_ghost(p: list[Column], start: list[Column], size: list[Column]) -> Column:
    return _all([(~F.isnan(x.cast("double"))) & (x >= a) & (x < a + n - 1) for x, a, n in zip(p, start, size, strict=True)])


def in_box(p: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Half-open integer box."""
    return _all([(x >= a) & (x < b) for x, a, b in zip(p, lo, hi, strict=True)])


def critical(v: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [x * x for x in v]) == 0


def no_value(magnitude: Column) -> Column:
    m = magnitude.cast("double")
    return F.isnan(m) | (F.abs(m) == float("inf"))


def finished(p: list[Column], size: tuple[int, ...], steps: Column, most: int) -> Column:
    return ~in_domain(p, size) | (steps >= most)


def intersects(lo1: Column, hi1: Column, lo2: Column, hi2: Column, period: float | None = None) -> Column:
    """Closed intervals meet; with a period also around its end."""
    meet = lambda s: (lo1 <= hi2 + s) & (lo2 + s <= hi1)
    return meet(0) if period is None else meet(0) | meet(period) | meet(-period)


def point_box_distance(p: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    return F.sqrt(sum((F.greatest(a - x, F.lit(0.0), x - b) ** 2 for x, a, b in zip(p, lo, hi, strict=True)), F.lit(0.0)))


def box_box_distance(lo1, hi1, lo2, hi2) -> Column:
    return F.sqrt(sum((F.greatest(a - d, F.lit(0.0), c - b) ** 2 for a, b, c, d in zip(lo1, hi1, lo2, hi2, strict=True)), F.lit(0.0)))


def wrap_bounds(lo: Column, hi: Column, direction: Column, extent: float) -> tuple[Column, Column]:
    return lo + direction * extent, hi + direction * extent


def wrap_x(x: Column) -> Column:
    w = COLUMNS - 1
    return F.when(x > w, x - w).when(x < 0, x + w).otherwise(x)


def x_to_lon(x: Column) -> Column:
    return F.greatest(F.lit(-180.0), F.least(F.lit(180.0), x * (360.0 / (COLUMNS - 1)) - 180.0))


def y_to_lat(y: Column) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), y - 90.0))


def haversine(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    a0, a1 = F.radians(y_to_lat(y0)), F.radians(y_to_lat(y1))
    dlon = F.radians(x_to_lon(x1) - x_to_lon(x0))
    a = F.pow(F.sin((a1 - a0) / 2), F.lit(2)) + F.cos(a0) * F.cos(a1) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(EARTH * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def point_key(coords: list[Column]) -> Column:
    """A point as a binary key of 32-bit whole numbers, and the way back by ``point_from_key``."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for c in coords)))


def point_from_key(key: Column, n: int) -> list[Column]:
    h = F.hex(key)
    parts = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]
    return [F.when(p >= 2**31, p - 2**32).otherwise(p).cast("int") for p in parts]


def big_endian() -> bool:
    return sys.byteorder == "big"


def swap_bytes(data: bytes, dtype: str) -> bytes:
    return np.frombuffer(data, dtype=dtype).byteswap().tobytes()
