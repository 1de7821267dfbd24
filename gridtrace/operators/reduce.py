"""Reductions, collectives and scans as aggregates and windows; block functions as grouped maps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPS: dict[str, Callable[[Column], Column]] = {
    "max": F.max, "min": F.min, "plus": F.sum, "multiplies": F.product, "logical_and": lambda c: F.bool_and(c), "logical_or": lambda c: F.bool_or(c),
}


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by bin, the top one closed. Values under ``lo`` are an error, as they belong to no bin."""
    width = (hi - lo) / bins
    raw = F.floor((value - lo) / width)
    bin_ = F.when(raw < 0, F.raise_error(F.lit("value under the histogram"))).otherwise(F.least(F.lit(bins - 1), raw)).cast("int")
    return df.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("count"))


def merge_histograms(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, "bin").agg(F.sum("count").alias("count"))


def vector_sum(df: DataFrame, values: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Elementwise sum of arrays: one row per position, summed map-side first."""
    return df.select(*by, F.posexplode(values).alias("pos", "value")).groupBy(*by, "pos").agg(F.sum("value").alias("value"))


def all_reduce(df: DataFrame, value: str, ops: list[str]) -> DataFrame:
    """The reductions on every row. One row is broadcast."""
    return df.crossJoin(F.broadcast(reduce_ops(df, value, ops)))


def reduce_ops(df: DataFrame, value: str, ops: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    aggs = [OPS[o](F.col(value) != 0 if o.startswith("logical") else F.col(value)).alias(o) for o in ops]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def gather(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Variable-length records of each key in order. For small groups: a block's or rank's own list."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def broadcast_value(df: DataFrame, root: DataFrame, most: int = 1000) -> DataFrame:
    """A root's rows on every row, if they are few."""
    if root.limit(most + 1).count() > most:
        raise ValueError("too many rows to broadcast")
    return df.crossJoin(F.broadcast(root))


def all_to_all(df: DataFrame, dst: str, n: int) -> DataFrame:
    """Rows to the partition of their destination."""
    return df.repartition(n, dst)


def transfer_counts(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    return df.groupBy(src.alias("src"), dst.alias("dst")).agg(F.count("*").alias("count"))


def scan(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, exclusive: bool = False, name: str = "scan", chunk: int = 100_000) -> DataFrame:
    """Prefix sums, over all rows or within groups ``by``.

    Range partitions over group and order are summed first, so neither all rows nor those of a large
    group meet in a task. ``order`` must tell rows apart for a defined result.
    """
    by = by or []
    spark = df.sparkSession
    from gridtrace.session import materialize

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = materialize(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "scan")
    here = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = parts.groupBy("__part", *by).agg(F.sum(value).alias("__sum"))
    #: A group that lies in several partitions ends in each but the last, so these are at most two rows a partition.
    ends = sums.groupBy("__part").agg(*([F.min(F.struct(*by)).alias("lo"), F.max(F.struct(*by)).alias("hi")] if by else []), F.count("*").alias("c"))
    if by:
        edge = sums.join(F.broadcast(ends), "__part").where(F.struct(*by).eqNullSafe(F.col("lo")) | F.struct(*by).eqNullSafe(F.col("hi"))).select("__part", *by, "__sum")
    else:
        edge = sums
    key = F.xxhash64(*(x for c in by for x in (F.col(c).isNull(), F.col(c)))) if by else F.lit(0)
    before = edge.select("__part", key.alias("__key"), (F.sum("__sum").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"))
    out = parts.withColumn("__own", F.sum(value).over(here)).withColumn("__key", key).join(F.broadcast(before), ["__part", "__key"], "left")
    s = F.col("__own") + F.coalesce("__before", F.lit(0))
    return out.withColumn(name, s - F.col(value) if exclusive else s).drop("__part", "__key", "__own", "__before")


def deltas(df: DataFrame, time: str, order: list[str], by: list[str], name: str = "dt") -> DataFrame:
    """Difference from the row before, of the same group."""
    return df.withColumn(name, F.col(time) - F.lag(time).over(W.partitionBy(*by).orderBy(*order)))


def summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """max, min, avg, sum, and the root of summed squared deviations (not divided by n) beside the deviation proper."""
    v = F.col(value).cast("double")
    aggs = [F.max(value).alias("max"), F.min(value).alias("min"), F.avg(v).alias("avg"), F.sum(value).alias("sum")]
    var = F.var_pop(v)
    aggs += [F.sqrt(var * F.count(v)).alias("l2_deviation"), F.stddev_pop(v).alias("stddev")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def bounding_boxes(df: DataFrame, by: list[str], lo: list[str], hi: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.min(c).alias(c) for c in lo), *(F.max(c).alias(c) for c in hi))


def unique_neighbours(links: DataFrame) -> DataFrame:
    return links.groupBy("gid").agg(F.countDistinct("nbr").alias("neighbours"))


def block_counts(df: DataFrame, gid: str) -> DataFrame:
    """Smallest, largest and mean number of rows of a block."""
    return df.groupBy(gid).count().agg(F.min("count").alias("min"), F.max("count").alias("max"), F.avg("count").alias("avg"))


def neighbour_average(df: DataFrame, links: DataFrame, gid: str = "gid", values: str = "values") -> DataFrame:
    """Each block's sum, and the mean of its neighbours' sums, by the link table."""
    own = df.select(gid, F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v).alias("sum"))
    far = links.join(own.withColumnRenamed(gid, "nbr"), "nbr").groupBy("gid").agg(F.avg("sum").alias("average"))
    return own.join(far, "gid")


def chain_average(df: DataFrame, gid: str = "gid", value: str = "sum") -> DataFrame:
    """The same on a chain of blocks. Blocks are few, so one window holds them."""
    w = W.orderBy(gid)
    near = F.array_compact(F.array(F.lag(value).over(w), F.lead(value).over(w)))
    return df.withColumn("average", F.aggregate(near, F.lit(0.0), lambda a, v: a + v) / F.size(near))


def foreach_block(df: DataFrame, gid: str, f: Callable, schema: str) -> DataFrame:
    """A function of each block's rows (a pandas frame in, one out)."""
    return df.groupBy(gid).applyInPandas(f, schema)


def exchange(df: DataFrame, dst: str, gid: str = "gid", n: int | None = None, salts: int = 1) -> DataFrame:
    """Rows enqueued to a destination become the rows of that block, in the partition that has the block.

    With ``salts`` a block's rows lie in so many partitions at most: for blocks that get much.
    """
    moved = df.withColumn("src_gid", F.col(gid)).withColumn(gid, F.col(dst)).drop(dst)
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*(c for c in moved.columns)), F.lit(salts))
    return moved.repartition(n, gid, salt) if salts > 1 else moved.repartition(n, gid)


def swap_reduce(points: DataFrame, coords: list[str], divs: tuple[int, ...], size: tuple[int, ...], k: int = 2) -> DataFrame:
    """Points to the block that holds them, in rounds of groups of ``k``: each settles one digit of a block's coordinate.

    Dimensions take turns. A row carries its block's coordinates so far, so a round is a projection and
    one exchange by block; the last round's blocks are the grid's.
    """
    steps = {d: [g for g, _ in partners(n, k)] for d, n in enumerate(divs)}
    at = {d: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c).cast("int") / (s // n)).cast("int"))) for d, (c, n, s) in enumerate(zip(coords, divs, size, strict=True))}
    done = [1] * len(divs)
    out = points.withColumn("gid", F.lit(0))
    while any(steps.values()):
        for d in range(len(divs)):
            if not steps[d]:
                continue
            done[d] *= steps[d].pop(0)
            gid, stride = F.lit(0), 1
            for e, n in enumerate(divs):  # the leading digits of each coordinate
                gid, stride = gid + F.floor(at[e] / (n // done[e])).cast("int") * stride, stride * done[e]
            out = exchange(out.withColumn("dst", gid), "dst").drop("src_gid")
    return out


def iterate_until_done(df: DataFrame, body: Callable[[DataFrame], DataFrame], done: Column, most: int = 1000) -> tuple[DataFrame, int]:
    """Apply ``body`` until ``done`` holds on all rows; the number of rounds comes with the result."""
    from gridtrace.session import materialize

    for k in range(most):
        df = materialize(body(df), "until-done")
        if df.agg(F.coalesce(F.bool_and(done), F.lit(True))).first()[0]:
            return df, k + 1
    raise RuntimeError(f"not done after {most} rounds")


def partners(n_blocks: int, k: int = 2, contiguous: bool = True) -> list[tuple[int, int]]:
    """(group size, step) of each round of a k-ary reduction tree: the tree that a shuffle stands for."""
    sizes, left = [], n_blocks
    while left > 1:
        g = next((f for f in range(min(k, left), 1, -1) if left % f == 0), None) or next(f for f in range(2, left + 1) if left % f == 0)
        sizes.append(g)
        left //= g
    out, step = [], 1
    for g in sizes if contiguous else sizes[::-1]:
        out.append((g, step))
        step *= g
    return out


def group_members(gid: int, size: int, step: int) -> list[int]:
    base = gid - (gid // step % size) * step
    return [base + i * step for i in range(size)]


def skip_none(df: DataFrame) -> DataFrame:
    return df


def skip_no_incoming(blocks: DataFrame, queue: DataFrame, gid: str = "gid") -> DataFrame:
    """Blocks that something waits for."""
    return blocks.join(queue.select(gid).distinct(), gid, "left_semi")


def skip_inactive_or(blocks: DataFrame, queue: DataFrame, active: Column, gid: str = "gid") -> DataFrame:
    return blocks.where(active).unionByName(skip_no_incoming(blocks.where(~active), queue, gid))


def skip_intermediate(rounds: DataFrame, last: int) -> DataFrame:
    """Only the first and last round of an all-to-all touch blocks."""
    return rounds.where((F.col("round") == 0) | (F.col("round") == last))


def limit_per_group(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """At most so many rows of each block a visit."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def batches(df: DataFrame, by: str, order: list, size: int) -> DataFrame:
    """Messages numbered by batch of ``size`` within their group, by a scan: a large group is not one task."""
    numbered = scan(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, [by], exclusive=True, name="__before_it")
    return numbered.withColumn("batch", F.floor(F.col("__before_it") / size)).drop("__one", "__before_it")


def split_by_state(df: DataFrame, done: str = "finished") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(done)), df.where(~F.col(done))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def log_rounds(n: int, k: int) -> int:
    return max(0, math.ceil(math.log(n, k))) if n > 1 else 0
