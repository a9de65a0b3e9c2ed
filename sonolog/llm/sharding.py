"""Rendezvous hashing: every key goes to the shard with the highest score for it.

A shard's score for a key is ``-weight / ln(u)`` with ``u`` in (0, 1) drawn from a digest of key and
shard, so a shard takes keys in proportion to its weight, and one more shard only takes keys to
itself. Built-in expressions only.

Defined results: a NULL key counts as the text ``null``; a NULL text has no bytes; repeated rows go
to the same shard and take slots next to each other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hex_digits, text_or_empty

HASH_BITS = 52


def score(key: Column, shard: int, weight: float) -> Column:
    """The weighted score of one shard for a key given as text."""
    head = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, HASH_BITS // 4)
    unit = (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << HASH_BITS)
    return F.lit(-float(weight)) / F.log(unit)


def best_shard(key: Column, weights: list[float]) -> Column:
    """Struct of the highest score and its shard; shards of weight 0 take nothing."""
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights must not be negative, and one must be positive")
    options = [F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w]
    return options[0] if len(options) == 1 else F.greatest(*options)


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def assign(df: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """Add the shard of each row; no shuffle."""
    return df.withColumn(name, best_shard(key_text(key), weights)["shard"])


def slots(df: DataFrame, group: str, columns: list[str], rows: int) -> DataFrame:
    """Rows of ``columns`` with a gapless ``slot`` from 0 within ``group``.

    The order is that of a digest over ``columns``, whose first digits cut a group into buckets;
    equal rows are counted once and spread out again at the end.
    """
    label = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    digits = hex_digits(rows)
    counted = (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__h", F.md5(label))
        .withColumn("__b", F.substring("__h", 1, digits))
    )
    sizes = counted.groupBy(group, "__b").agg(F.sum("__n").alias("__m"))
    upto = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select(group, "__b", (F.sum("__m").over(upto) - F.col("__m")).alias("__start"))
    inside = W.partitionBy(group, "__b").orderBy("__h", *columns).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        counted.withColumn("__upto", F.sum("__n").over(inside))
        .join(starts, [group, "__b"])
        .withColumn("__first", F.col("__start") + F.col("__upto") - F.col("__n"))
    )
    return placed.select(*columns, F.explode(F.expr("sequence(__first, __first + __n - 1)")).alias("slot"))


def shard_documents(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard under one more shard for every document; texts are not shuffled."""
    label = key_text(key)
    base = best_shard(label, weights)
    extra = F.struct(score(label, len(weights), 1.0).alias("score"), F.lit(len(weights)).alias("shard"))
    body = text_or_empty(text)
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        base.alias("__best"),
        extra.alias("__extra"),
    ).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("__best.shard").alias("shard"),
        F.greatest("__best", "__extra")["shard"].alias("grown_shard"),
    )
    columns = [key, "size", "text_crc32", "law", "shard", "grown_shard"]
    return slots(rows, "shard", columns, docs.select(key).count()).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
