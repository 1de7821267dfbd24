"""Parallel sorts: by samples and by histogram. Both cut by dividers and sort within partitions."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dividers_of(samples: list, n: int) -> list:
    """Of m sorted samples, divider i is the one at (i + 1) * (m // n)."""
    s = sorted(samples)
    step = len(s) // n
    return [s[(i + 1) * step] for i in range(n - 1)] if step else s[: n - 1]


def bucket(value: Column, dividers: list, lower: bool = True) -> Column:
    """How many dividers lie under the value (not over it, for an upper bound)."""
    if not dividers:
        return F.lit(0)
    arr = F.array(*map(F.lit, dividers))
    return F.size(F.filter(arr, lambda d: d < value if lower else d <= value))


def sample_dividers(df: DataFrame, by: str, value: str, n: int, per_block: int = 8, order: Column | None = None) -> list:
    """Dividers from at most ``per_block`` rows of each of the blocks, the first by ``order``."""
    order = F.xxhash64(by, value) if order is None else order
    picked = df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(order, value))).where(F.col("__r") <= per_block)
    return dividers_of([r[0] for r in picked.select(value).collect()], n)  # blocks * per_block values


def sample_sort(df: DataFrame, by: str, value: str, n: int, per_block: int = 8, order: Column | None = None, samples_only: bool = False):
    """Rows with their bucket, in order over all partitions: buckets go to partitions by range; or the dividers alone."""
    d = sample_dividers(df, by, value, n, per_block, order)
    if samples_only:
        return d
    return df.withColumn("bucket", bucket(F.col(value), d)).repartitionByRange(n, "bucket").sortWithinPartitions("bucket", value)


def histogram_dividers(df: DataFrame, value: str, lo: float, hi: float, n: int, bins: int = 64) -> list[float]:
    """Middles of the bins at which the cumulated count passes each n-th of the total."""
    from gridtrace.operators.reduce import histogram

    counts = {r["bin"]: r["count"] for r in histogram(df, F.col(value), lo, hi, bins).collect()}  # at most ``bins``
    total, width, cum, out = sum(counts.values()), (hi - lo) / bins, 0, []
    for b in range(bins):
        while len(out) < n - 1 and cum + counts.get(b, 0) > total // n * (len(out) + 1):
            out.append(lo + b * width + width / 2)
        cum += counts.get(b, 0)
    return out


def histogram_sort(df: DataFrame, value: str, lo: float, hi: float, n: int, bins: int = 64) -> DataFrame:
    d = histogram_dividers(df, value, lo, hi, n, bins)
    return df.withColumn("bucket", bucket(F.col(value), d, lower=False)).repartitionByRange(n, "bucket").sortWithinPartitions("bucket", value)


def global_sort(df: DataFrame, *order, n: int | None = None) -> DataFrame:
    """Range partitions, each sorted: what a sort over all blocks comes to in Spark."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def bucket_np(value: float, dividers: list[float]) -> int:
    return bisect_left(dividers, value)
