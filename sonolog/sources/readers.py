"""Readers that find columns by name and give them explicit types.

Spark rows carry no order, so the file readers can add ``src_file``, ``src_block`` and
``src_row``: sorted by these three, rows come in file-name order and, inside a file, in file
order. They are read off the scan itself and so stay the same when a task is run again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PLAYS_RAW

SOURCE_ORDER = ["src_file", "src_block", "src_row"]
CORRUPT = "_corrupt_record"
HISTORY_GLOB = "Streaming_History*.json"
# All fields of an export that the schema does not name.
EXTRA = "extra"
_RECORDS = "array<map<string,variant>>"


def with_source_order(scan: DataFrame) -> DataFrame:
    """Add the three source-order columns; call it on the scan, before anything else."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
    )


def damage_options(keep_damaged: bool) -> dict[str, str]:
    """Fail on a damaged file, or keep its text in ``_corrupt_record``."""
    if keep_damaged:
        return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return {"mode": "FAILFAST"}


def marked(schema: T.StructType, keep_damaged: bool) -> T.StructType:
    extra = [T.StructField(CORRUPT, T.StringType())] if keep_damaged else []
    return T.StructType([*schema.fields, *extra])


def _history_files(spark: SparkSession, name_glob: str):
    return (
        spark.read.option("multiLine", True)
        .option("pathGlobFilter", name_glob)
        .option("recursiveFileLookup", True)
    )


def history_schema(spark: SparkSession, path: str, name_glob: str = HISTORY_GLOB) -> T.StructType:
    """The known columns and, as text, all others that any export below ``path`` has; reads the files once."""
    found = _history_files(spark, name_glob).option("primitivesAsString", True).json(path).schema
    known = {*PLAYS_RAW.fieldNames(), CORRUPT}
    return T.StructType([*PLAYS_RAW.fields, *[f for f in found.fields if f.name not in known]])


def read_history_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = PLAYS_RAW,
    name_glob: str = HISTORY_GLOB,
    ordered: bool = False,
    keep_damaged: bool = False,
) -> DataFrame:
    """All history exports below ``path``; every file is one JSON array of plays.

    Without ``schema`` the files' other columns come along as text, for one more pass over the files.
    A damaged file fails the job. With ``keep_damaged`` it becomes a row with its whole text in
    ``_corrupt_record``, which ``split_damaged`` takes apart.
    """
    schema = schema or history_schema(spark, path, name_glob)
    reader = _history_files(spark, name_glob).schema(marked(schema, keep_damaged))
    scan = reader.options(**damage_options(keep_damaged)).json(path)
    return with_source_order(scan) if ordered else scan


def open_records(texts: DataFrame, schema: T.StructType = PLAYS_RAW, keep_damaged: bool = False) -> DataFrame:
    """Whole export texts (``value``), batch or stream, as plays that keep every field.

    The columns of ``schema`` have their types; all other fields are in the VARIANT ``extra``, NULL without any, and
    are read with ``extra_field``. Exports whose fields drift so need no second pass over the files. A damaged text fails, or
    with ``keep_damaged`` is a row's ``_corrupt_record``; a blank one has no plays.
    """
    mode = {"mode": "PERMISSIVE" if keep_damaged else "FAILFAST"}
    parsed = texts.where("trim(value) <> ''").withColumn("records", F.from_json("value", _RECORDS, mode))
    none = F.array(F.lit(None).cast(_RECORDS.removeprefix("array<").removesuffix(">")))
    rows = parsed.select(
        F.when(F.col("records").isNull(), F.col("value")).alias(CORRUPT), F.explode(F.coalesce("records", none)).alias("r")
    )
    known = [F.expr(f"cast(r['{f.name}'] as {f.dataType.simpleString()})").alias(f.name) for f in schema.fields]
    names = ", ".join(f"'{n}'" for n in schema.fieldNames())
    others = f"map_filter(r, (k, v) -> k not in ({names}))"
    extra = F.expr(f"if(size({others}) > 0, to_variant_object({others}), null)").alias(EXTRA)
    return rows.select(*known, extra, *([CORRUPT] if keep_damaged else []))


def extra_field(name: str, kind: str) -> Column:
    """A field outside the schema as ``kind``; NULL where the export does not have it or it is of another type."""
    if name.isidentifier():
        return F.try_variant_get(EXTRA, f"$.{name}", kind).alias(name)
    own = F.try_element_at(F.col(EXTRA).cast("map<string,variant>"), F.lit(name))
    return F.try_variant_get(own, "$", kind).alias(name)


def read_history_open(
    spark: SparkSession, path: str, schema: T.StructType = PLAYS_RAW, name_glob: str = HISTORY_GLOB, keep_damaged: bool = False
) -> DataFrame:
    """All history exports below ``path`` with all their fields, in one pass; see ``open_records``."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", name_glob).option("recursiveFileLookup", True)
    return open_records(files.text(path), schema, keep_damaged)


def split_damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole rows, and damaged records with all their columns; store the latter before counting them."""
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull())


def _csv(spark: SparkSession, **options):
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .options(**options)
    )


def _all_text(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _header_groups(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """Files with the same first line together, in the order of their names.

    A single file is a group without a look at it; else all are read once, for their first lines.
    """
    lines = spark.read.text(path)
    files = sorted(unquote(f) for f in lines.inputFiles())
    if len(files) < 2:
        return [files] if files else []
    starts = lines.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.monotonically_increasing_id().alias("row"), "value").alias("line")
    )
    first = starts.groupBy("file").agg(F.min("line")["value"].alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    return sorted([unquote(f) for f in r["files"]] for r in groups)


def _csv_text(
    spark: SparkSession,
    path: str | list[str],
    keep_damaged: bool = False,
    also: Callable[[DataFrame], DataFrame] = lambda scan: scan,
    **options,
) -> DataFrame:
    """Every column as text under its header name; what a file does not have is NULL.

    Files are read by groups with the same header, which are put together by name. ``also`` adds columns to each scan.
    """
    groups = _header_groups(spark, path) or [path if isinstance(path, list) else [path]]
    scans = []
    for files in groups:
        names = _csv(spark, **options).csv(files[0]).columns
        unnamed = any(re.fullmatch(r"_c\d+", n) for n in names)
        reader = _csv(spark, **options).option("enforceSchema", unnamed)
        scans.append(also(reader.schema(marked(_all_text(names), keep_damaged)).csv(files)))
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan, allowMissingColumns=True)
    return out


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def by_name(
    df: DataFrame, schema: T.StructType, required: Iterable[str] = (), also: Iterable[str] = ()
) -> DataFrame:
    """The columns of ``schema``, found by name in any case, cast to its types; then those of ``also``.

    What cannot be cast and what is absent is NULL; an absent required column is an error.
    """
    there = {c.lower(): c for c in df.columns}
    missing = [c for c in required if c.lower() not in there]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    typed = [
        (_named(there[f.name.lower()]) if f.name.lower() in there else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*typed, *[_named(c) for c in also])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    ordered: bool = False,
    required: Iterable[str] = (),
) -> DataFrame:
    """Typed CSV scan by header name; only the empty field is NULL and malformed UTF-8 decodes to U+FFFD."""
    scan = _csv_text(spark, path, also=with_source_order) if ordered else _csv_text(spark, path)
    return by_name(scan, schema, required, SOURCE_ORDER if ordered else ())


def read_csv_strict(spark: SparkSession, path: str | list[str], columns: Iterable[str]) -> DataFrame:
    """All-text scan of named columns that fails on a malformed row or an absent column.

    ``filename`` tells the source file.
    """
    columns = list(columns)

    def named(scan: DataFrame) -> DataFrame:
        return scan.select("*", F.col("_metadata.file_path").alias("filename"))

    scan = _csv_text(spark, path, also=named, mode="FAILFAST", multiLine=True, columnPruning=False)
    return by_name(scan, _all_text(columns), columns, ["filename"])


def read_csv_lenient(
    spark: SparkSession, path: str | list[str], columns: Iterable[str], keep_bad: bool = False
) -> DataFrame:
    """All-text scan of named columns that leaves malformed rows out; absent columns are NULL.

    With ``keep_bad`` they stay, marked by their text in ``_corrupt_record``, so a caller can
    store and count them. A row is malformed if it has more or fewer fields than the header.
    """
    columns = list(columns)
    # Without pruning the parser sees all fields of a row and so can tell their number.
    if not keep_bad:
        return by_name(_csv_text(spark, path, mode="DROPMALFORMED", columnPruning=False), _all_text(columns))
    options = damage_options(True) | {"columnPruning": False}
    return by_name(_csv_text(spark, path, True, **options), _all_text(columns), also=[CORRUPT])


def select_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Only those of the wanted columns that are there; the scan reads no others."""
    wanted = set(wanted)
    return df.select([c for c in df.columns if c in wanted])


def read_catalog(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Catalogue CSV with source order, which "first occurrence" refers to.

    The legacy catalogue calls the artist column ``artists``; either name will do, in the file as in
    ``schema``. A file without track or artist names is an error.
    """
    scan = _csv_text(spark, path, also=with_source_order)
    if "artist_name" not in {c.lower() for c in scan.columns}:
        scan = scan.withColumnRenamed("artists", "artist_name")
    fields = [T.StructField("artist_name" if f.name == "artists" else f.name, f.dataType) for f in schema.fields]
    return by_name(scan, T.StructType(fields), ["track_name", "artist_name"], SOURCE_ORDER)


def load_first_available(spark: SparkSession, candidates: Iterable[str]) -> DataFrame:
    """The first Parquet table of the list that exists: final, API, catalogue, cleaned."""
    tried = []
    for path in candidates:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            tried.append(path)
    raise FileNotFoundError(f"none of these tables exists: {tried}")
