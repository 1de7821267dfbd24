"""Points near or in neighbour blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.functions.geometry import box_box_distance, point_box_distance


def _with_boxes(points: DataFrame, boxes: DataFrame, links: DataFrame | None, most_boxes: int) -> DataFrame:
    """Points with the boxes of their block's neighbours, or with all boxes but their own.

    Boxes are a table of blocks; it is broadcast only if counted and small.
    """
    if links is not None:
        b = links.join(boxes.withColumnRenamed("gid", "nbr"), "nbr")
        return points.join(b, "gid")
    if boxes.limit(most_boxes + 1).count() > most_boxes:
        raise ValueError("give the links of so many boxes")
    b = boxes.withColumnRenamed("gid", "nbr")
    return points.join(F.broadcast(b), F.col("gid") != F.col("nbr"))


def near(points: DataFrame, boxes: DataFrame, axes: list[str], radius: float, links: DataFrame | None = None, most_boxes: int = 100_000) -> DataFrame:
    """Points and the neighbour blocks no farther off than the radius, with the distance."""
    df = _with_boxes(points, boxes, links, most_boxes)
    d = point_box_distance([F.col(a) for a in axes], [F.col(f"lo_{a}") for a in axes], [F.col(f"hi_{a}") for a in axes])
    return df.withColumn("distance", d).where(F.col("distance") <= radius)


def in_(points: DataFrame, boxes: DataFrame, axes: list[str], links: DataFrame | None = None, most_boxes: int = 100_000) -> DataFrame:
    """Points and the neighbour blocks that hold them."""
    return near(points, boxes, axes, 0.0, links, most_boxes)


def box_distances(boxes: DataFrame, axes: list[str]) -> DataFrame:
    """Distances of all pairs of blocks: as many rows as block pairs, which are few."""
    a = boxes.select("gid", *(F.col(f"{k}_{x}") for x in axes for k in ("lo", "hi")))
    b = boxes.select(F.col("gid").alias("nbr"), *(F.col(f"{k}_{x}").alias(f"n{k}_{x}") for x in axes for k in ("lo", "hi")))
    c = lambda p: [F.col(f"{p}_{x}") for x in axes]
    return a.join(b, F.col("gid") < F.col("nbr")).select("gid", "nbr", box_box_distance(c("lo"), c("hi"), c("nlo"), c("nhi")).alias("distance"))
