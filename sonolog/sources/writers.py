"""Sinks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace the table at ``path``; Parquet unless CSV is asked for."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = (
            w.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to an append-only table."""
    df.write.mode("append").parquet(path)


class SchemaMismatch(ValueError):
    """Rows that do not fit the table they should be added to."""


def _versions(spark: SparkSession, path: str) -> list[tuple[int, T.StructType]]:
    # Spark does not take a folder whose name begins with an underscore for data.
    try:
        rows = spark.read.schema("number bigint, text string").json(f"{path}/_schemas/*").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted((r["number"], T.StructType.fromJson(json.loads(r["text"]))) for r in rows)


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of a checked table; None if there is no such table."""
    found = _versions(spark, path)
    return found[-1][1] if found else None


def evolved(known: T.StructType, new: T.StructType) -> T.StructType:
    """``known`` with the new columns of ``new``, which may be NULL in older rows.

    Columns are told by name in any case. A column keeps its type; one that must not be NULL may not be missing.
    """
    have = {f.name.lower(): f for f in known.fields}
    given = {f.name.lower(): f for f in new.fields}
    if len(given) < len(new.fields):
        raise SchemaMismatch(f"a column comes twice in {new.fieldNames()}")
    for name, f in given.items():
        if name in have and have[name].dataType != f.dataType:
            raise SchemaMismatch(f"{f.name} is {have[name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    missing = [f.name for name, f in have.items() if not f.nullable and name not in given]
    if missing:
        raise SchemaMismatch(f"no column {missing}")
    added = [T.StructField(f.name, f.dataType, True) for name, f in given.items() if name not in have]
    return T.StructType([*known.fields, *added])


def append_checked(df: DataFrame, path: str, schema: T.StructType | None = None, evolve: bool = False) -> T.StructType:
    """Add rows to a table whose schema lies beside its files, and return that schema.

    The first call needs ``schema``. Rows are checked before a file is written: types must be the same, columns that are not
    known fail unless ``evolve``, those that are missing become NULL, and a NULL in a column that must not have any fails the job.
    """
    spark = df.sparkSession
    versions = _versions(spark, path)
    if not versions and schema is None:
        raise SchemaMismatch(f"no schema for the new table {path}")
    known = versions[-1][1] if versions else schema
    wanted = evolved(known, df.schema)
    if len(wanted) > len(known) and not evolve:
        raise SchemaMismatch(f"columns {wanted.fieldNames()[len(known):]} are not in the table")
    if not versions or wanted != known:
        number = versions[-1][0] + 1 if versions else 0
        row = spark.createDataFrame([(number, wanted.json())], "number bigint, text string")
        row.coalesce(1).write.mode("overwrite").json(f"{path}/_schemas/{number}")
    given = {c.lower(): c for c in df.columns}

    def column(f: T.StructField) -> F.Column:
        if f.name.lower() not in given:
            return F.lit(None).cast(f.dataType).alias(f.name)
        own = F.col(f"`{given[f.name.lower()]}`")
        held = own if f.nullable else F.coalesce(own, F.raise_error(F.lit(f"NULL in {f.name}")).cast(f.dataType))
        return held.alias(f.name)

    append(df.select([column(f) for f in wanted.fields]), path)
    return wanted


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """A checked table; columns that came later are NULL in earlier rows."""
    return spark.read.schema(stored_schema(spark, path)).parquet(path)


def overwrite_counted(df: DataFrame, path: str, **kwargs) -> int:
    """Write and return the row count, taken while writing instead of by a second scan."""
    seen = Observation("rows")
    overwrite(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, **kwargs)
    return seen.get["rows"]


def write_by_media(df: DataFrame, path: str) -> dict[str, int]:
    """One pass, two datasets: a folder per media type. Returns the rows of each."""
    seen = Observation("media_rows")
    counted = df.observe(
        seen,
        F.count_if(F.col("media_type") == "song").alias("song"),
        F.count_if(F.col("media_type") == "podcast").alias("podcast"),
    )
    overwrite(counted, path, partition_by=["media_type"])
    return dict(seen.get)
