"""Left join of a large fact table to a dimension with one row per key.

Three things hurt such a join at scale: NULL keys all land in one partition, one hot key does
the same, and a broadcast of a dimension that has grown fails. ``left_lookup`` leaves the choice
to adaptive execution, which goes by the dimension's real size: it broadcasts a small one and
splits skewed partitions of the facts for a large one. Where adaptive execution or broadcasts are
off, NULL and hot keys are spread here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"
HOT = "__hot"
# A key is hot from this share of all rows on, so there are never more than 1 / share of them.
HOT_SHARE = 1 / 1000
HOT_SALTS = 512
NULL_SALTS = 4096


def broadcast_threshold(df: DataFrame) -> int:
    """The session's ``autoBroadcastJoinThreshold`` in bytes."""
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    raw = raw.removesuffix("b")
    if raw and raw[-1] in units:
        return int(raw[:-1]) * units[raw[-1]]
    return int(raw)


def left_to_spark(df: DataFrame) -> bool:
    """Whether Spark, which sees real sizes while it runs, may broadcast and else splits skewed partitions."""
    conf = df.sparkSession.conf
    splits = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return broadcast_threshold(df) >= 0 and all(conf.get(name, "true").lower() == "true" for name in splits)


def _any_null(keys: list[str]) -> Column:
    return F.expr(" or ".join(f"{k} is null" for k in keys))


def hot_keys(facts: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding at least ``share`` of all rows that have one: at most ``1 / share`` rows come out.

    The total is summed over the counts, so the facts are counted once and the shuffle is reused.
    """
    counts = facts.where(~_any_null(keys)).groupBy(*keys).agg(F.expr("count(1) as n"))
    total = counts.agg(F.expr("sum(n)")).scalar()
    return counts.where(F.col("n") >= total * F.lit(share)).select(*keys)


def spread(columns: list[str], width: int) -> Column:
    """A number below ``width`` per row that is the same whenever a task is run again.

    The partition id is part of the hash, so exact copies of a row spread as well.
    """
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.spark_partition_id()), F.lit(width)).cast("int")


def salted_left_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    share: float = HOT_SHARE,
    salts: int = HOT_SALTS,
    null_salts: int = NULL_SALTS,
) -> DataFrame:
    """Left join that cuts hot keys into ``salts`` parts and spreads rows with NULL keys.

    Only the hot keys' dimension rows are repeated, at most ``salts / share`` rows in all. The
    hot keys themselves are broadcast; ``hot_keys`` bounds their number.
    """
    hot = F.broadcast(hot_keys(facts, keys, share).withColumn(HOT, F.lit(True)))
    hashable = [name for name, kind in facts.dtypes if "map<" not in kind]
    left = (
        facts.join(hot, keys, "left")
        .withColumn(
            SALT,
            F.when(_any_null(keys), spread(hashable, null_salts))
            .when(F.col(HOT), spread(hashable, salts))
            .otherwise(F.lit(0)),
        )
        .drop(HOT)
    )
    parts = F.when(F.col(HOT), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.where(~_any_null(keys)).join(hot, keys, "left").withColumn(SALT, F.explode(parts)).drop(HOT)
    return left.join(right, [*keys, SALT], "left").drop(SALT)


def left_lookup(facts: DataFrame, dim: DataFrame, keys: list[str], strategy: str = "auto") -> DataFrame:
    """Attach ``dim`` (unique on ``keys``) to ``facts``; no fact row is lost or multiplied.

    ``strategy``: ``plain`` (Spark picks the join), ``salted``, or ``auto`` (plain where Spark adapts).
    """
    if strategy not in ("auto", "plain", "salted"):
        raise ValueError(f"unknown strategy {strategy!r}")
    columns = facts.columns + [c for c in dim.columns if c not in keys]
    if strategy == "plain" or (strategy == "auto" and left_to_spark(facts)):
        joined = facts.join(dim, keys, "left")
    else:
        joined = salted_left_join(facts, dim, keys)
    return joined.select(*columns)
