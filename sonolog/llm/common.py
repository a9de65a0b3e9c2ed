"""What several operators share: tables, lineage cuts, skew-safe joins, numbering, vocabulary."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

T = TypeVar("T")
TOKENIZER = "word_bpe_49k.json"
# A key is hot from this share of the rows on, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 1000
ROWS_PER_BUCKET = 2_000
ROWS_PER_RANGE = 500_000
BYTES_PER_TASK = 64_000_000


_KEPT: dict[object, object] = {}


def kept(owner: object, make: Callable[[], T]) -> T:
    """What ``owner`` keeps in a Python worker from task to task.

    Workers outlive a step, so what another owner kept there goes: a worker holds one such store at a time.
    """
    if owner not in _KEPT:
        forget()
        _KEPT[owner] = make()
    return _KEPT[owner]


def forget() -> None:
    """Give up what a step that ran in this Python worker before has kept there."""
    _KEPT.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and read it from there: computed once, survives executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are stored.

    The cleaner acts on what the driver's collectors find unused, which on a quiet driver may take longer
    than the next step does to fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks_for(spark: SparkSession, size: int, per_task: int = BYTES_PER_TASK) -> int:
    """Shuffle tasks for ``size`` bytes: the session's number, or more where these would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // per_task + 1)


def text_bytes(texts: DataFrame, text: str = "text") -> int:
    return texts.agg(F.sum(F.octet_length(text))).first()[0] or 0


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def hot_join(left: DataFrame, right: DataFrame, key: str, counted: str | None = None) -> DataFrame:
    """Inner join on ``key``; ``right`` has one row per key and covers every key of ``left``.

    Keys with at least ``HOT_SHARE`` of the rows of ``left`` are joined by broadcast (there are at
    most ``1 / HOT_SHARE`` of them), all others by shuffle. ``counted`` names a column of ``right``
    that holds the number of rows of ``left``; without it they are counted. ``right`` is read
    twice, so it should be stored.
    """
    if counted is None:
        sizes = cut(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
        right, counted = right.join(sizes, key), "__n"
    total = right.agg(F.sum(counted)).first()[0] or 0
    is_hot = F.col(counted) >= max(2.0, total * HOT_SHARE)
    hot = F.broadcast(right.where(is_hot).withColumn("__hot", F.lit(True)))
    marked = left.join(F.broadcast(right.where(is_hot).select(key, F.lit(True).alias("__is"))), key, "left")
    by_broadcast = marked.where("__is").drop("__is").join(hot, key).drop("__hot")
    by_shuffle = marked.where("__is is null").drop("__is").join(right.where(~is_hot), key)
    return by_broadcast.unionByName(by_shuffle).drop("__n")


def numbered(df: DataFrame, groups: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2... within ``groups``, ordered by ``bucket`` and ``order``.

    ``bucket`` splits a group evenly (a hash or its prefix), so that no task holds a whole group: rows
    are numbered inside a bucket and shifted by the sizes of the buckets before it.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("__b", bucket)
    sizes = df.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select(*groups, "__b", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))
    inside = F.row_number().over(W.partitionBy(*groups, "__b").orderBy(*order)) - 1
    return (
        df.withColumn("__r", inside)
        .join(starts, [*groups, "__b"])
        .withColumn(name, (F.col("__start") + F.col("__r")).cast("long"))
        .drop("__b", "__r", "__start")
    )


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one, that is none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, order: list[Column], name: str, rows: int, first: int = 1) -> DataFrame:
    """Add ``name``: ``first``, ``first + 1``... over all rows of ``df`` in the given order.

    One range shuffle brings the rows into order over tasks of about ``ROWS_PER_RANGE`` of the ``rows``; the
    place inside a task is then shifted by the sizes of the tasks before it. Equal rows, however many, are
    spread by a random number that decides last.
    """
    from pyspark.sql import Window as W

    place, part, start = (unused([*df.columns, name], c) for c in ("place", "part", "start"))
    spread = unused([*df.columns, name], "spread")
    full = [*order, F.asc(spread)]
    parts = rows // ROWS_PER_RANGE + 1
    sorted_ = df.withColumn(spread, F.rand(7)).repartitionByRange(parts, *full).sortWithinPartitions(*full).drop(spread)
    # The row number holds the task in its upper bits and the place inside the task in its lower 33.
    sorted_ = cut(sorted_.withColumn(place, F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn(part, F.shiftright(place, 33))
    sizes = sorted_.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select(part, (F.sum("n").over(before) - F.col("n")).alias(start))  # one row per task
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    out = sorted_.join(F.broadcast(starts), part)
    return out.withColumn(name, F.col(start) + inside + first).select(*[F.col(f"`{c}`") for c in df.columns], name)


def hex_digits(rows: int) -> int:
    """Hex digits of a digest that make buckets of at most about ``ROWS_PER_BUCKET`` rows."""
    return max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET + 1, 16)))
