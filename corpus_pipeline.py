"""From raw documents to packed training sequences, as stages that each apply one operator.

NULLs, empty texts, repeated rows and extra columns are treated as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sonolog.llm import exact_dedup, near_dedup, packing, quality, toxicity
from sonolog.llm.common import table, tokenizer_path
from sonolog.session import scratch_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Bytes of rows that go to a Python worker at once, so that workers stay small next to a JVM which earlier stages have filled.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def in_small_batches(stage: Stage) -> Stage:
    """Lower the session's batch size for Python before the stage; a smaller one, or one given with a unit, stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark.conf.get(BATCH_CONF).lower().removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# Trained models, signatures and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is stored and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
