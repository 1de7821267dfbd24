"""Two-phase reads: requests are grouped by file and variable, cut over readers, read once and handed out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_boxes(requests: DataFrame, dims: int) -> DataFrame:
    """The bounding box of each file and variable's requests (start and end arrays, ends exclusive)."""
    lo = F.array(*(F.min(F.col("start")[k]) for k in range(dims)))
    hi = F.array(*(F.max(F.col("end")[k]) for k in range(dims)))
    return requests.groupBy("file", "var").agg(lo.alias("start"), hi.alias("end"))


def split_box(start: tuple[int, ...], end: tuple[int, ...], parts: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Cut a box along its slowest dimensions into about equal parts."""
    out = [(tuple(start), tuple(end))]
    for k in range(len(start)):
        if len(out) >= parts:
            break
        per = max(1, -(-parts // len(out)))
        n = min(per, end[k] - start[k])
        cut = []
        for a, b in out:
            edges = [a[k] + (b[k] - a[k]) * i // n for i in range(n + 1)]
            cut += [((*a[:k], e, *a[k + 1 :]), (*b[:k], f, *b[k + 1 :])) for e, f in zip(edges, edges[1:], strict=False)]
        out = cut
    return out


def assign_readers(groups: list, readers: int) -> list[tuple[int, int, object]]:
    """(stage, first reader, group): groups are dealt to readers evenly, in as many stages as are needed."""
    stages = math.ceil(len(groups) / readers) if groups else 0
    per_stage = math.ceil(len(groups) / stages) if stages else 0
    return [(i // per_stage, (i % per_stage) * readers // per_stage, g) for i, g in enumerate(groups)]


def io_blocks(requests: DataFrame, dims: int, readers: int) -> DataFrame:
    """The boxes that readers read: bounding boxes, cut. Groups are as many as files and variables."""
    spark = requests.sparkSession
    groups = group_boxes(requests, dims).orderBy("file", "var").collect()
    rows = []
    for stage, first, g in assign_readers(groups, readers):
        n = max(1, readers // max(1, len(groups)))
        for i, (a, b) in enumerate(split_box(tuple(g["start"]), tuple(g["end"]), n)):
            rows.append((g["file"], g["var"], stage, first + i, list(a), list(b)))
    return spark.createDataFrame(rows, "file string, var string, stage int, reader int, io_start array<int>, io_end array<int>")


def read_boxes(requests: DataFrame, dims: int, readers: int, read) -> DataFrame:
    """(id, start, shape, dtype, data) of every request: each reader's box is read once, cut and handed out.

    ``read(file, var, start, size)`` gives an array, slowest dimension first, as the boxes are. It runs on
    the executors. A request's parts meet where it is put together, so it must fit in a task's memory.
    """
    import numpy as np
    import pandas as pd

    plan = exchange_plan(requests, io_blocks(requests, dims, readers), dims)
    cols = ["id", "file", "var", "start", "end", "io_start", "io_end", "part_start", "part_end"]

    def phase_one(g: pd.DataFrame) -> pd.DataFrame:
        first = g.iloc[0]
        a, b = list(first["io_start"]), list(first["io_end"])
        box, out = read(first["file"], first["var"], tuple(a), tuple(y - x for x, y in zip(a, b, strict=True))), []
        for r in g.itertuples():
            part = box[tuple(slice(s - x, e - x) for s, e, x in zip(r.part_start, r.part_end, a, strict=True))]
            out.append((r.id, list(r.start), list(r.end), list(r.part_start), list(part.shape), part.dtype.str, np.ascontiguousarray(part).tobytes()))
        return pd.DataFrame(out, columns=["id", "start", "end", "at", "shape", "dtype", "data"])

    def phase_two(g: pd.DataFrame) -> pd.DataFrame:
        first = g.iloc[0]
        start, shape = list(first["start"]), [e - s for s, e in zip(first["start"], first["end"], strict=True)]
        out = np.empty(shape, dtype=first["dtype"])
        for r in g.itertuples():
            out[tuple(slice(p - s, p - s + n) for p, s, n in zip(r.at, start, r.shape, strict=True))] = np.frombuffer(r.data, dtype=r.dtype).reshape(tuple(r.shape))
        return pd.DataFrame({"id": [first["id"]], "start": [start], "shape": [shape], "dtype": [first["dtype"]], "data": [out.tobytes()]})

    kind = requests.schema["id"].dataType.simpleString()
    parts = plan.select(*cols).groupBy("file", "var", "io_start").applyInPandas(phase_one, f"id {kind}, start array<int>, end array<int>, at array<int>, shape array<int>, dtype string, data binary")
    return parts.groupBy("id").applyInPandas(phase_two, f"id {kind}, start array<int>, shape array<int>, dtype string, data binary")


def timed_reads(requests: DataFrame, dims: int, readers: int, read) -> DataFrame:
    """Each reader's box read once, on the executors: bytes read and seconds it took."""
    import time

    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in g.itertuples():
            at = time.perf_counter()
            box = read(r.file, r.var, tuple(r.io_start), tuple(b - a for a, b in zip(r.io_start, r.io_end, strict=True)))
            out.append((r.file, r.var, r.stage, r.reader, box.nbytes, time.perf_counter() - at))
        return pd.DataFrame(out, columns=["file", "var", "stage", "reader", "bytes_read", "io_seconds"])

    blocks = io_blocks(requests, dims, readers)
    return blocks.groupBy("file", "var", "io_start").applyInPandas(run, "file string, var string, stage int, reader int, bytes_read long, io_seconds double")


def exchange_plan(requests: DataFrame, blocks: DataFrame, dims: int) -> DataFrame:
    """Which part of which reader's box goes to which request: the boxes' intersections."""
    meet = F.lit(True)
    for k in range(dims):
        meet = meet & (F.greatest(F.col("start")[k], F.col("io_start")[k]) < F.least(F.col("end")[k], F.col("io_end")[k]))
    part = lambda f, a, b: F.array(*(f(F.col(a)[k], F.col(b)[k]) for k in range(dims)))
    return requests.join(blocks, ["file", "var"]).where(meet).withColumns({"part_start": part(F.greatest, "start", "io_start"), "part_end": part(F.least, "end", "io_end")})
