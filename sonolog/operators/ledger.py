"""The progress ledger: one JSON document per key, the latest one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LEDGER
from ..sources.versioned import VersionedTable

BUCKET = "bucket"
# Parts of a stored ledger; a batch rewrites those that its keys fall into.
BUCKETS = 64


def latest(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of every key that comes last by ``order``."""
    by = ", ".join(f"{c} desc nulls last" for c in order)
    rank = f"row_number() over (partition by {', '.join(keys)} order by {by}) as __rn"
    return entries.selectExpr("*", rank).where("__rn = 1").drop("__rn")


def entries(results: DataFrame, updated_at, payload: list[str] | None = None) -> DataFrame:
    """Lookup results -> ledger rows; fields that are NULL stay in the document as ``null``."""
    fields = payload or [c for c in results.columns if c != "key"]
    doc = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return results.select("key", doc.alias("meta_json"), updated_at.alias("updated_at"))


def upsert(ledger: DataFrame, new: DataFrame, remember_misses: bool = False) -> DataFrame:
    """Insert-or-replace by key. Replaying the same entries changes nothing.

    A miss is an entry without a document. Unless ``remember_misses``, it is not stored and
    its key stays queued; it never replaces a stored document either way.
    """
    incoming = new if remember_misses else new.where("meta_json is not null")
    merged = ledger.unionByName(incoming)
    return latest(merged, ["key"], ["(meta_json is not null)", "updated_at", "meta_json"])


def completed_count(ledger: DataFrame) -> DataFrame:
    """Ledger rows, and those holding a document."""
    return ledger.agg(F.expr("count(1) as entries"), F.expr("count(meta_json) as completed"))


def recall(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """What the ledger knows about each key: ``known`` is true for stored misses as well."""
    stored = ledger.selectExpr("key", "meta_json", "true as __known")
    joined = keys.join(stored, "key", "left").selectExpr("*", "coalesce(__known, false) as known")
    return joined.drop("__known")


def stored(spark: SparkSession, path: str) -> VersionedTable:
    """The ledger at ``path``, in buckets of its keys."""
    return VersionedTable(spark, path, T.StructType([*LEDGER.fields, T.StructField(BUCKET, T.IntegerType())]), [BUCKET])


def record(table: VersionedTable, new: DataFrame, remember_misses: bool = False, batch: int | None = None) -> bool:
    """Upsert lookup results into the stored ledger; False if this micro-batch went in before.

    Only the buckets of the new keys are read and written again. A batch that died on the way has changed nothing.
    """
    before = table.current()
    if batch is not None and batch <= before.batch:
        return False
    names = LEDGER.fieldNames()
    incoming = (new if remember_misses else new.where("meta_json is not null")).select(*names)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    incoming = latest(incoming, ["key"], ["(meta_json is not null)", "updated_at", "meta_json"]).withColumn(BUCKET, bucket)
    incoming = incoming.persist()
    try:
        parts = table.parts_of(incoming)
        merged = latest(
            table.read(before, parts).unionByName(incoming), ["key"], ["(meta_json is not null)", "updated_at", "meta_json"]
        )
        table.replace(merged, parts, batch)
    finally:
        incoming.unpersist()
    return True
