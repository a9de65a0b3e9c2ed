"""Plays and metadata stored the way their joins need them.

Keys are normalised once, on storing. Plays lie in a folder per year and in buckets of their key, the metadata's winners in as many
buckets of theirs, so the join and the distinct keys need no shuffle, and a range of years opens only its folders.

A bucket is read by one task. Plays without a key, and those of keys that hold at least a thousandth of all plays, are
therefore kept aside in files of even size; such keys are at most a thousand, and their metadata is broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import with_keys
from ..operators.lookup import hot_keys
from ..operators.metadata import api_columns, dedup
from ..schemas import KEYS

BUCKETS = 16


@dataclass(frozen=True)
class KeyedTables:
    """Names of the bucketed tables and folders of the others."""

    plays: str
    metadata: str
    aside: str
    hot: str
    columns: list[str]
    fields: list[str]


def store(plays: DataFrame, meta: DataFrame, folder: str, buckets: int = BUCKETS, normaliser: str = "sql") -> KeyedTables:
    """Store plays, which have a ``year``, and the metadata's winners below ``folder``."""
    name = f"sonolog_{uuid.uuid4().hex}"
    keyed = with_keys(plays, normaliser)
    hot_keys(keyed, KEYS).write.parquet(f"{folder}/hot")
    hot = plays.sparkSession.read.parquet(f"{folder}/hot").withColumn("__hot", F.lit(True))
    marked = keyed.join(F.broadcast(hot), KEYS, "left")
    is_aside = F.col("__hot").isNotNull() | F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull()
    aside = marked.where(is_aside).drop("__hot").hint("rebalance", "year")
    aside.write.partitionBy("year").parquet(f"{folder}/aside")
    cold = marked.where(~is_aside).drop("__hot").repartition(buckets, *KEYS)
    _bucketed(cold, buckets, f"{folder}/plays", ["year"]).saveAsTable(f"{name}_plays")
    fields = [f for f in api_columns(meta) if f not in plays.columns]
    winners = dedup(meta, normaliser).where(f"{KEYS[0]} is not null and {KEYS[1]} is not null").select(*KEYS, *fields)
    _bucketed(winners.repartition(buckets, *KEYS), buckets, f"{folder}/metadata").saveAsTable(f"{name}_metadata")
    return KeyedTables(f"{name}_plays", f"{name}_metadata", f"{folder}/aside", f"{folder}/hot", plays.columns, fields)


def _bucketed(df: DataFrame, buckets: int, path: str, partitions: list[str] | None = None):
    writer = df.write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path)
    return writer.partitionBy(*partitions) if partitions else writer


def _years(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    df = df if first is None else df.where(F.col("year") >= first)
    return df if last is None else df.where(F.col("year") <= last)


def enriched(spark: SparkSession, tables: KeyedTables, first: int | None = None, last: int | None = None) -> DataFrame:
    """Plays of a range of years LEFT JOIN metadata: buckets meet buckets, what was kept aside meets a broadcast."""
    meta = spark.table(tables.metadata)
    few = F.broadcast(meta.join(F.broadcast(spark.read.parquet(tables.hot)), KEYS, "left_semi"))
    cold = _years(spark.table(tables.plays), first, last).join(meta, KEYS, "left")
    aside = _years(spark.read.parquet(tables.aside), first, last).join(few, KEYS, "left")
    return cold.unionByName(aside).select(*tables.columns, *tables.fields)


def unique_keys(spark: SparkSession, tables: KeyedTables, first: int | None = None, last: int | None = None) -> DataFrame:
    """Distinct normalised keys of a range of years; a bucket's keys are in no other bucket."""
    cold = _years(spark.table(tables.plays), first, last).select(*KEYS).distinct()
    aside = _years(spark.read.parquet(tables.aside), first, last).select(*KEYS).dropna().distinct()
    return cold.unionAll(aside)
