"""Block stores: blocks with links, a footer and user data, in one table or one folder a block."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_blocks(df: DataFrame, path: str, extra: dict | None = None, split: bool = False) -> None:
    """Write blocks by ``gid``. ``split`` gives each block a folder of its own, so a read of few prunes the rest."""
    out = df.repartition("gid").sortWithinPartitions("gid")
    (out.write.partitionBy("gid") if split else out.write).mode("overwrite").parquet(f"{path}/blocks")
    footer(df).write.mode("overwrite").parquet(f"{path}/footer")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(extra or {}),)], "extra string").coalesce(1).write.mode("overwrite").json(f"{path}/extra")


def footer(df: DataFrame) -> DataFrame:
    """gid, count and offset of each block's rows: the inclusive prefix sum less its own count."""
    n = df.groupBy("gid").agg(F.count("*").alias("count"))
    return n.withColumn("offset", F.sum("count").over(W.orderBy("gid")) - F.col("count"))  # a row for each block


def read_blocks(spark: SparkSession, path: str, gids: list[int] | None = None, n_ranks: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Blocks, footer and user data. The number of ranks may differ from that at the write."""
    df = spark.read.parquet(f"{path}/blocks")
    if gids is not None:
        df = df.where(F.col("gid").isin(gids))
    if n_ranks:
        df = df.withColumn("rank", F.pmod(F.col("gid"), F.lit(n_ranks)).cast("int"))
    extra = json.loads(spark.read.json(f"{path}/extra").first()["extra"])
    return df, spark.read.parquet(f"{path}/footer").orderBy("gid"), extra


def dump(data: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(data)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
