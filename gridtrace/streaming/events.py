"""The asynchronous surface: particles as a stream of messages, with a state for each block.

Messages are rows in a folder of Parquet files. A stateful stream counts what each block has been
sent and what it has finished; particles that are not done leave as new messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGES = "gid int, kind string, particle_id long, steps long"
TOTALS = "gid int, inits long, finishes long, steps long"


def message_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """INIT, TRACE and FINISH messages from a folder, some files at a time."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    inits, finishes, steps = state.get if state.exists else (0, 0, 0)
    for b in batches:
        inits += int((b["kind"] == "INIT").sum())
        finishes += int((b["kind"] == "FINISH").sum())
        steps += int(b["steps"].fillna(0).sum())
    state.update((inits, finishes, steps))
    yield pd.DataFrame({"gid": [key[0]], "inits": [inits], "finishes": [finishes], "steps": [steps]})


def block_totals(messages: DataFrame) -> DataFrame:
    """Running totals of each block, kept as state between triggers."""
    return messages.groupBy("gid").applyInPandasWithState(_count, TOTALS, "inits long, finishes long, steps long", "update", GroupStateTimeout.NoTimeout)


def all_done(totals: DataFrame) -> bool:
    """Whether all that began has finished, by the latest totals of every block."""
    r = totals.groupBy("gid").agg(F.max("inits").alias("i"), F.max("finishes").alias("f")).agg(F.sum("i"), F.sum("f")).first()
    return bool(r[0]) and r[0] == r[1]


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> None:
    """All there is now, into an in-memory table: for small totals."""
    q = stream.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All there is now, each trigger's updates appended to a table of Parquet files."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trigger={number}")  # a trigger that is run again writes the same folder

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(messages: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Messages a window of event time, with late ones let in up to the watermark."""
    return messages.withWatermark(time, late).groupBy(F.window(time, width), "gid").agg(F.count("*").alias("count"))
