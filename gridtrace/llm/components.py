"""Distributed connected components: local contraction, then large-star and small-star rounds.

Links never reach the driver; only a count and a checksum of each round do. Every round is written
to the shared folder, so a lost executor costs the running round at most. A hub's links are summed
map-side, and joined by a plain equi-join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.session import discard, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that connect what the given links connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = flat[: len(a)], flat[len(a) :]
    while True:  # smallest labels spread along links, then labels jump to their label
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for b in batches:
        held.append((b["u"].to_numpy(), b["v"].to_numpy()))
        n += len(b)
        if n >= most:
            u, v = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held, n = [], 0
            yield pd.DataFrame({"u": u, "v": v})
    if held:
        u, v = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pd.DataFrame({"u": u, "v": v})


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    Nulls link with nothing; loops and repeated links change nothing.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = materialize(e.mapInPandas(_contract, "u long, v long"), "links")
    before = _state(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, materialize(small, "links")
        discard(last)
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
