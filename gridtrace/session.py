"""Session helpers: the shared folder, lineage cuts and the workers' import path."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: What goes to a Python worker at once: bounded in rows and in bytes, as texts can be very long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and all runs in one process, as in tests, a temporary folder is made and
    set; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="gridtrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


_MADE: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder. What is written there goes when the driver ends."""
    if not _MADE:  # registered once the JVM runs, so it is called before that ends
        atexit.register(_remove_all)
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def _remove(paths: list[str]) -> None:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    for p in paths if sc else ():
        with contextlib.suppress(Exception):
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _remove_all() -> None:
    _remove(_MADE)


#: Folder of each step, by its frame.
_STEPS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Delete the folders of steps that nothing will read again: what was made of them is written."""
    paths = [p for f in frames if (p := _STEPS.pop(f, None))]
    _remove(paths)
    for p in paths:
        _MADE.remove(p)


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Cut the lineage: write Parquet to the shared folder and read it back.

    What is written survives the loss of any executor and is not computed again.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STEPS[out] = path
    return out
