"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of the documents. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again, so that a lost executor costs one stage's running part at most. A stage
that is called on its own sets the session's limits on batches to Python workers, as ``run`` does.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrace.llm import decontam, ngram_join, packing, pii, toxicity
from gridtrace.llm.queries import TEST_KEY
from gridtrace.session import materialize, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    """The stage, with ``ship`` called first: Spark's own batches have up to 10,000 rows or 64 MB."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is 0.5 or more go. All labels are learned from."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=False)
    name = toxicity.free_name(docs, "toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, ngram_join.Rule(width=5, num=80, den=100))


@shipped
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipped
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid numbers, dates and addresses get pseudonyms of their own form; n_chars follows the text.

    The key is the session's ``spark.gridtrace.pii.key``; where that is unset, as in checks, a public test key.
    """
    out = pii.pseudonymize(docs, spans=None, key=spark.conf.get(pii.KEY, TEST_KEY).encode())
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(out.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


@shipped
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores and tokenizers can't be said in SQL; tests/llm/test_pipeline.py goes through all stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
