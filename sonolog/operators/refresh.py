"""Stored enriched plays, brought up to date by what has changed in the metadata.

The metadata row that won for each key is kept with a digest of its fields. A refresh compares the digests, looks
up in which partitions the changed keys have plays, and writes only these again. Plays lie in partitions by a hash of
their key and by year, so a key that changes touches one hash part, and of it only the years it was played in. Plays
without a key have a part of their own and are never touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEYS
from ..sources.versioned import VersionedTable
from .cleaning import with_keys
from .lookup import left_lookup
from .metadata import dedup

PARTS = 32
NO_KEY_PART = -1
PART, YEAR, DIGEST = "key_part", "play_year", "digest"


@dataclass(frozen=True)
class EnrichedStore:
    """Enriched plays and the metadata they were made with."""

    plays: VersionedTable
    winners: VersionedTable
    fields: list[str]


def _part(df: DataFrame) -> DataFrame:
    part = F.when(F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull(), NO_KEY_PART)
    return df.withColumn(PART, part.otherwise(F.pmod(F.xxhash64(*KEYS), F.lit(PARTS))).cast("int"))


def winners_of(meta: DataFrame, fields: list[str], normaliser: str = "sql") -> DataFrame:
    """One row per key with its fields, their digest and the key's part."""
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias(DIGEST)
    best = dedup(meta, normaliser).where(f"{KEYS[0]} is not null and {KEYS[1]} is not null")
    return _part(best.select(*KEYS, *fields, digest))


def store(spark: SparkSession, path: str, plays: T.StructType, meta: T.StructType, fields: list[str]) -> EnrichedStore:
    """A store below ``path`` for plays and metadata of these schemas; the fields' names must be new to the plays."""
    taken = sorted(set(fields) & set(plays.fieldNames()))
    if taken:
        raise ValueError(f"columns {taken} are in the plays already")
    keys = [T.StructField(k, T.StringType()) for k in KEYS]
    part = T.StructField(PART, T.IntegerType())
    own = [meta[f] for f in fields]
    enriched = T.StructType([*plays.fields, *keys, *own, part, T.StructField(YEAR, T.IntegerType())])
    winners = T.StructType([*keys, *own, T.StructField(DIGEST, T.StringType()), part])
    return EnrichedStore(
        VersionedTable(spark, f"{path}/plays", enriched, [PART, YEAR]),
        VersionedTable(spark, f"{path}/winners", winners, [PART]), fields,
    )


def _enriched(store: EnrichedStore, keyed: DataFrame, winners: DataFrame) -> DataFrame:
    """Keyed plays with the winners' fields; those without a key stay out of the join's shuffle."""
    joined = left_lookup(keyed, winners.select(*KEYS, *store.fields), KEYS)
    return joined.select(*store.plays.schema.fieldNames())


def create(store: EnrichedStore, plays: DataFrame, meta: DataFrame, normaliser: str = "sql") -> None:
    """Enrich and store all plays; ``ts`` gives the year, 0 where there is none."""
    keyed = _part(with_keys(plays, normaliser)).withColumn(YEAR, F.coalesce(F.year("ts"), F.lit(0)))
    winners = winners_of(meta, store.fields, normaliser)
    store.plays.replace(_enriched(store, keyed, winners), store.plays.parts_of(keyed))
    store.winners.replace(winners, store.winners.parts_of(winners))


def changed_keys(store: EnrichedStore, winners: DataFrame) -> DataFrame:
    """Keys that are new or whose fields differ from those stored; metadata is append-only, so none goes."""
    before = store.winners.read().select(*KEYS, F.col(DIGEST).alias("before"))
    joined = winners.join(before, KEYS, "left")
    return joined.where(~F.col(DIGEST).eqNullSafe(F.col("before"))).select(*KEYS, PART)


def refresh(store: EnrichedStore, meta: DataFrame, normaliser: str = "sql") -> list[tuple]:
    """Bring plays and winners up to date; the partitions of plays that were written again.

    The plays come first: a run that dies before the winners are stored finds the same changes again.
    """
    winners = winners_of(meta, store.fields, normaliser).persist()
    try:
        changed = changed_keys(store, winners).persist()
        hash_parts = store.winners.parts_of(changed)
        if not hash_parts:
            return []
        version = store.plays.current()
        numbers = [p for (p,) in hash_parts]
        near = store.plays.read(version, [p for p in version.slots if p[0] in numbers])
        touched = store.plays.parts_of(near.join(changed.select(*KEYS), KEYS, "left_semi"))
        if touched:
            rows = store.plays.read(version, touched).drop(*store.fields)
            store.plays.replace(_enriched(store, rows, winners.where(F.col(PART).isin(numbers))), touched)
        store.winners.replace(winners.where(F.col(PART).isin(numbers)), hash_parts)
        changed.unpersist()
        return touched
    finally:
        winners.unpersist()


def read(store: EnrichedStore) -> DataFrame:
    """The enriched plays as of the last refresh."""
    return store.plays.read().drop(*KEYS, PART, YEAR)
