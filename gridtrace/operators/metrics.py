"""Balance and time metrics, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IO, TRACE, WAIT, REDISTRIBUTE = 0, 1, 2, 3


def round_balance(work: DataFrame, by: str = "gid") -> DataFrame:
    """Per round: the largest and mean work of a worker, their ratio and the imbalance, and cumulated largest work."""
    per = work.groupBy("round", by).agg(F.sum("steps").alias("steps"))
    out = per.groupBy("round").agg(F.max("steps").alias("max"), F.avg("steps").alias("avg"), F.sum("steps").alias("total"), F.count("*").alias("workers"))
    out = out.withColumn("balance", F.try_divide("max", "avg")).withColumn("imbalance", F.try_divide(F.col("max") - F.col("avg"), "max"))
    return out.withColumn("cum_max", F.sum("max").over(W.orderBy("round")))  # a row for each round


def load_balance(work: DataFrame, by: str = "gid") -> DataFrame:
    """Sum over rounds of the largest work, against a worker's mean total."""
    per = work.groupBy("round", by).agg(F.sum("steps").alias("steps"))
    top = per.groupBy("round").agg(F.max("steps").alias("m")).agg(F.sum("m").alias("max_work"))
    mean = work.groupBy(by).agg(F.sum("steps").alias("s")).agg(F.avg("s").alias("mean_work"), F.sum("s").alias("total_steps"), F.count("*").alias("workers"))
    return top.crossJoin(mean).withColumn("load_balance", F.try_divide("max_work", "mean_work"))


def termination(particles: DataFrame) -> DataFrame:
    """How many began and how many are done."""
    return particles.agg(F.count("*").alias("init"), F.coalesce(F.sum(F.col("finished").cast("long")), F.lit(0)).alias("done")).withColumn("stop", F.col("init") == F.col("done"))


def workload(work: DataFrame, by: str) -> DataFrame:
    return work.groupBy(by).agg(F.sum("steps").alias("steps"), F.sum("finished").alias("finished"))


def timeline_deltas(stamps: DataFrame) -> DataFrame:
    """(worker, seq, category, at) -> the time each entry took."""
    w = W.partitionBy("worker").orderBy("seq")
    return stamps.withColumn("dt", F.col("at") - F.lag("at").over(w)).where("dt IS NOT NULL")


def time_summary(timeline: DataFrame, run_seconds: float, n_workers: int) -> dict:
    """Averages by worker and shares of run and reading time."""
    got = {r["category"]: r["s"] for r in timeline.groupBy("category").agg(F.sum("dt").alias("s")).collect()}
    t = {k: got.get(c, 0.0) / n_workers for k, c in (("io", IO), ("trace", TRACE), ("wait", WAIT), ("kdtree", REDISTRIBUTE))}
    pure = run_seconds - t["kdtree"]
    whole = run_seconds + t["io"]
    out = {"time_run": run_seconds, "time_pure_run": pure, "time_idle": pure - t["trace"], **{f"avg_time_{k}": v for k, v in t.items()}}
    return out | {f"share_{k}": v / whole if whole else 0.0 for k, v in t.items()}


def write_timeline(timeline: DataFrame, path: str) -> None:
    """A text line for each worker: category:seconds, comma-separated."""
    w = timeline.groupBy("worker").agg(F.array_sort(F.collect_list(F.struct("seq", "category", "dt"))).alias("e"))
    line = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["category"].cast("string"), x["dt"].cast("string"))), ",")
    w.select(F.concat(F.col("worker").cast("string"), F.lit("\t"), line).alias("value")).write.mode("overwrite").text(path)


def write_balance(balance: DataFrame, elapsed: str, path: str) -> None:
    """A text line for each round: seconds:max/avg."""
    balance.select(F.concat_ws(":", F.col(elapsed).cast("string"), F.col("balance").cast("string")).alias("value")).write.mode("overwrite").text(path)


def parse_logs(spark, path: str, pattern: str = r"time_run=\s*([0-9.]+)") -> DataFrame:
    """Log lines that hold a run time: the file, the process count in its name, and the seconds."""
    df = spark.read.text(path).withColumn("file", F.input_file_name())
    sec = F.regexp_extract("value", pattern, 1)
    n = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d+)\D*$", 1)
    return df.where(sec != "").select("file", F.when(n != "", n.cast("int")).alias("processes"), sec.cast("double").alias("time_run"))


def report(numbers: dict) -> str:
    return "\n".join(["SUMMARY", *(f"{k} = {v}" for k, v in numbers.items())])


def snapshots_to_text(snapshots: DataFrame, path: str) -> None:
    """x:y pairs of each round and phase, comma-separated; a row each."""
    s = snapshots.groupBy("round", "phase").agg(F.array_sort(F.collect_list(F.struct("particle_id", "x", "y"))).alias("p"))
    text = F.array_join(F.transform("p", lambda q: F.concat_ws(":", q["x"].cast("string"), q["y"].cast("string"))), ",")
    s.select("round", "phase", text.alias("value")).write.mode("overwrite").partitionBy("round", "phase").text(path)


def io_counters(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of timed reads: boxes, bytes, seconds of all readers and of the slowest, and bytes a second of all together."""
    per = reads.groupBy(*by, "reader").agg(F.sum("bytes_read").alias("b"), F.sum("io_seconds").alias("s"), F.count("*").alias("n"))
    out = per.groupBy(*by) if by else per
    out = out.agg(F.sum("n").alias("boxes"), F.sum("b").alias("bytes_read"), F.sum("s").alias("io_seconds"), F.max("s").alias("slowest"), F.count("*").alias("readers"))
    return out.withColumn("bandwidth", F.try_divide("bytes_read", "slowest"))
