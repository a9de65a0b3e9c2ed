"""Incremental processing with Structured Streaming.

Every job runs to the end of what has arrived (``availableNow``) and continues from its
checkpoint the next time. Results that change are written as one folder per micro-batch, which
a repeated batch overwrites, and put together on reading. Exports do not arrive in the order of
time, so these results need no watermark and lose no play, however the files fall into batches.
``suppress_repeats`` and ``windowed_minutes`` are the forms with a watermark, which keep bounded
state; ``window_stream`` counts what comes later than the delay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import numbers, temporal
from ..operators import bitfilter, cleaning, ledger, metadata
from ..schemas import KEYS, PAIR, PLAYS_RAW
from ..sources import readers
from ..sources.versioned import VersionedTable

# Files of one micro-batch; results do not depend on it.
MAX_FILES = 1000
BATCH = "batch"
IDENTITY = ["ts", "ms_played", *PAIR, "spotify_track_uri", "spotify_episode_uri"]
EVENT_TIME = "event_time"
ARRIVED = "arrived"
PLAY_ID, DAY, NO_DAY = "play_digest", "play_day", "none"
# Bits of a day's bitmap: 2 MB, for about a million plays a day of which few are looked up in vain.
DAY_BITS = 1 << 24
PARK_PART, PARK_PARTS, FOUND = "park_part", 64, "metadata_found"


def history_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PLAYS_RAW,
    name_glob: str = readers.HISTORY_GLOB,
    max_files: int = MAX_FILES,
    keep_damaged: bool = False,
) -> DataFrame:
    """History exports as they arrive in a folder.

    A damaged file fails the stream; with ``keep_damaged`` its text is a row's ``_corrupt_record``.
    """
    return (
        spark.readStream.schema(readers.marked(schema, keep_damaged))
        .options(**readers.damage_options(keep_damaged))
        .option("multiLine", True)
        .option("pathGlobFilter", name_glob)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )


def open_history_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PLAYS_RAW,
    name_glob: str = readers.HISTORY_GLOB,
    max_files: int = MAX_FILES,
    keep_damaged: bool = False,
) -> DataFrame:
    """History exports as they arrive, with every field that ``schema`` does not name in the VARIANT ``extra``."""
    files = spark.readStream.option("wholetext", True).option("pathGlobFilter", name_glob).option("recursiveFileLookup", True)
    return readers.open_records(files.option("maxFilesPerTrigger", max_files).text(path), schema, keep_damaged)


def table_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def append_cleaned(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Clean arriving plays and add them to the plays table."""
    return (
        cleaning.clean(raw)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_cleaned_aside(raw: DataFrame, out: str, damaged: str, checkpoint: str) -> StreamingQuery:
    """Clean arriving plays; damaged files of a ``keep_damaged`` stream go to a folder of their own."""

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        whole, broken = readers.split_damaged(rows)
        cleaning.clean(whole).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")
        broken.write.mode("overwrite").parquet(f"{damaged}/{BATCH}={batch_id}")
        rows.unpersist()

    return _each_batch(raw, save, checkpoint)


def identity_of(plays: DataFrame) -> list[str]:
    """The columns that two exports of one play share."""
    return [c for c in IDENTITY if c in plays.columns]


def _identified(plays: DataFrame, period: str) -> DataFrame:
    """Add the play's digest, which also tells NULL from empty, and the first day of its period."""
    whole = F.to_json(F.struct(*identity_of(plays)), {"ignoreNullFields": "false"})
    day = F.coalesce(F.to_date(F.date_trunc(period, "ts")).cast("string"), F.lit(NO_DAY))
    return plays.withColumn(PLAY_ID, F.sha2(whole, 256)).withColumn(DAY, day)


def suppress_repeats(plays: DataFrame, delay: str = "30 days") -> DataFrame:
    """Drop plays that a later export repeats, and those older than the watermark.

    For streams in the order of time only; ``keep_once`` is complete.
    """
    timed = plays.withColumn(EVENT_TIME, temporal.instant("ts")).withWatermark(EVENT_TIME, delay)
    return timed.dropDuplicatesWithinWatermark(identity_of(plays)).drop(EVENT_TIME)


def keep_once(plays: DataFrame, out: str, checkpoint: str, period: str = "day") -> StreamingQuery:
    """Store every play once, whatever the order in which copies arrive.

    Plays lie by day and micro-batch; a longer ``period``, always the same for one ``out``, suits few plays over many years. A micro-batch looks only at its own days: a bitmap of each day tells which of its plays cannot have
    been there before, and only the others meet that day's stored digests. A micro-batch that runs again does not
    see what it stored itself, and replaces it. Copies within it are reduced before the shuffle, so a play that is repeated very
    often is no hot key.
    """
    spark = plays.sparkSession

    def save(rows: DataFrame, batch_id: int) -> None:
        once = _identified(rows, period).dropDuplicates([PLAY_ID]).persist()
        try:
            days = [r[DAY] for r in once.select(DAY).distinct().collect()]  # at most one for each day there is
            fresh = _not_stored(spark, once, out, days, batch_id).withColumn(BATCH, F.lit(batch_id).cast("long"))
            _store_days(fresh, f"{out}/plays")
            bits = bitfilter.build(once, [PLAY_ID], DAY_BITS, [DAY]).withColumn(BATCH, F.lit(batch_id).cast("long"))
            _store_days(bits, f"{out}/bits")
        finally:
            once.unpersist()

    return _each_batch(plays, save, checkpoint)


def _store_days(rows: DataFrame, path: str) -> None:
    spread = rows.hint("rebalance", DAY)
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY, BATCH).parquet(path)


def _stored_days(spark: SparkSession, path: str, schema: str, days: list[str], before: int) -> DataFrame:
    """Rows of these days from earlier micro-batches; other days' folders are not opened."""
    try:
        stored = spark.read.schema(f"{schema}, {DAY} string, {BATCH} bigint").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, {DAY} string, {BATCH} bigint")
    return stored.where(F.col(DAY).isin(days) & (F.col(BATCH) < before))


def _not_stored(spark: SparkSession, once: DataFrame, out: str, days: list[str], batch_id: int) -> DataFrame:
    bits = _stored_days(spark, f"{out}/bits", "part bigint, bits binary", days, batch_id)
    merged = bits.groupBy(DAY, F.col("part").alias("__part")).agg(F.bitmap_or_agg("bits").alias("__bits"))
    probed = bitfilter.probe(once, [PLAY_ID], DAY_BITS).join(merged, [DAY, "__part"], "left")
    marked = probed.withColumn("__maybe", bitfilter.is_set()).select(*once.columns, "__maybe").persist()
    maybe = marked.where("__maybe").drop("__maybe")
    seen_days = [r[DAY] for r in maybe.select(DAY).distinct().collect()]
    new = marked.where("not __maybe").drop("__maybe")
    if seen_days:
        known = _stored_days(spark, f"{out}/plays", f"{PLAY_ID} string", seen_days, batch_id).select(DAY, PLAY_ID)
        new = new.unionByName(maybe.join(known, [DAY, PLAY_ID], "left_anti"))
    return new


def read_once(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Every play that ``keep_once`` has stored; nothing is left to be dropped."""
    return spark.read.schema(schema).parquet(f"{out}/plays").select(*schema.fieldNames())


def windowed_minutes(plays: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Plays and milliseconds per tumbling window; windows that end before the watermark take no more plays.

    ``window_stream`` counts what is left out; ``daily_minutes`` is complete.
    """
    return (
        plays.withColumn(EVENT_TIME, temporal.instant("ts"))
        .withWatermark(EVENT_TIME, delay)
        .observe(ARRIVED, F.count(EVENT_TIME).alias("plays"), F.sum(F.when(F.col(EVENT_TIME).isNotNull(), F.col("ms_played"))).alias("ms"))
        .where(F.col(EVENT_TIME).isNotNull())
        .groupBy(F.window(EVENT_TIME, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms"))
        .select(temporal.to_utc("w.start").alias("start"), temporal.to_utc("w.end").alias("end"), "plays", "ms")
    )


WINDOWS = "start timestamp_ntz, end timestamp_ntz, plays long, ms long"


def window_stream(plays: DataFrame, width: str, delay: str, out: str, checkpoint: str) -> None:
    """Run ``windowed_minutes`` on all that has arrived, with the windows in Spark's state store.

    Each micro-batch stores the windows it changed; what arrived is observed on the way in and stored per micro-batch too.
    A run may have at most as many micro-batches as Spark remembers (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    spark = plays.sparkSession
    query = write_batches(windowed_minutes(plays, width, delay), f"{out}/windows", checkpoint, "update")
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["observedMetrics"].get(ARRIVED)]
    batches = sorted(p["batchId"] for p in query.recentProgress)
    if batches and len(batches) >= int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")):
        raise RuntimeError("more micro-batches than Spark remembers: raise max_files or numRecentProgressUpdates")
    for p in progress:
        seen = p["observedMetrics"][ARRIVED]
        row = [(seen["plays"] or 0, seen["ms"] or 0)]
        spark.createDataFrame(row, "plays long, ms long").coalesce(1).write.mode("overwrite").parquet(
            f"{out}/arrived/{BATCH}={p['batchId']}"
        )


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """The windows as of the last micro-batch."""
    return read_latest(spark, f"{out}/windows", ["start"], T.StructType.fromDDL(WINDOWS))


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """``plays, ms`` that arrived after their window had been closed."""
    arrived = spark.read.schema("plays long, ms long").parquet(f"{out}/arrived").select("plays", "ms")
    kept = read_windows(spark, out).selectExpr("-plays as plays", "-ms as ms")
    return arrived.unionAll(kept).agg(F.sum("plays").alias("plays"), F.sum("ms").alias("ms"))


def enrich_stream(plays: DataFrame, single: DataFrame) -> DataFrame:
    """Arriving plays LEFT JOIN a static table with one row per normalised key."""
    return cleaning.with_keys(plays).join(single, KEYS, "left").drop(*KEYS)


@dataclass(frozen=True)
class LateMetadata:
    """Plays with metadata, and those that still wait for theirs, below ``out``.

    ``fields`` is the schema of what the metadata adds. A play whose key the metadata does not have is parked, in
    parts by its key. Every run begins by storing the metadata's rows, one per key, which all its micro-batches
    read; then the parked plays are tried again. Plays without a key cannot match; they are stored at once.
    """

    spark: SparkSession
    out: str
    plays: T.StructType
    fields: T.StructType

    @property
    def parked(self) -> VersionedTable:
        keys = [T.StructField(k, T.StringType()) for k in KEYS]
        part = T.StructField(PARK_PART, T.IntegerType())
        return VersionedTable(self.spark, f"{self.out}/parked", T.StructType([*self.plays.fields, *keys, part]), [PARK_PART])

    @property
    def _schema(self) -> T.StructType:
        return T.StructType([*self.plays.fields, *self.fields.fields])

    def _matched(self, keyed: DataFrame, single: DataFrame) -> DataFrame:
        """Adaptive execution broadcasts few metadata rows, and splits hot keys where they are many."""
        return keyed.join(single.withColumn(FOUND, F.lit(True)), KEYS, "left")

    def run(self, arriving: DataFrame, meta: DataFrame, checkpoint: str) -> None:
        """Enrich all that has arrived, and what was parked, with the metadata as it is now."""
        dimension = f"{self.out}/metadata"
        names = self.fields.fieldNames()
        fields = metadata.dedup(meta).select(*KEYS, *names).where(f"{KEYS[0]} is not null and {KEYS[1]} is not null")
        fields.write.mode("overwrite").parquet(dimension)
        single = self.spark.read.parquet(dimension)
        self._retry(single)
        _each_batch(arriving, lambda rows, batch: self._save(rows, single, batch), checkpoint).awaitTermination()

    def _retry(self, single: DataFrame) -> None:
        """What now matches moves over; a move that dies half-way is made again into the same folder."""
        before = self.parked.current()
        if not before.slots:
            return
        tried = self._matched(self.parked.read(before), single).persist()
        try:
            found = tried.where(FOUND)
            parts = self.parked.parts_of(found)
            if parts:
                found.select(*self._schema.fieldNames()).write.mode("overwrite").parquet(
                    f"{self.out}/enriched/{BATCH}=retry-{before.number}"
                )
                left = tried.where(f"{FOUND} is null and {PARK_PART} in ({', '.join(str(p) for (p,) in parts)})")
                stay = set(self.parked.parts_of(left))
                self.parked.replace(left, [p for p in parts if p in stay], drop=[p for p in parts if p not in stay])
        finally:
            tried.unpersist()

    def _save(self, rows: DataFrame, single: DataFrame, batch_id: int) -> None:
        before = self.parked.current()
        if batch_id <= before.batch:
            return  # went in whole, maybe with other metadata
        keyed = cleaning.with_keys(rows.select(*self.plays.fieldNames()))
        part = F.pmod(F.xxhash64(*KEYS), F.lit(PARK_PARTS)).cast("int").alias(PARK_PART)
        tried = self._matched(keyed, single).select("*", part).persist()
        try:
            waits = tried.where(f"{FOUND} is null and {KEYS[0]} is not null and {KEYS[1]} is not null")
            done = tried.where(f"{FOUND} or {KEYS[0]} is null or {KEYS[1]} is null")
            done.select(*self._schema.fieldNames()).write.mode("overwrite").parquet(f"{self.out}/enriched/{BATCH}=b-{batch_id}")
            parts = self.parked.parts_of(waits)
            names = self.parked.schema.fieldNames()
            self.parked.replace(self.parked.read(before, parts).unionByName(waits.select(*names)), parts, batch_id)
        finally:
            tried.unpersist()

    def read(self) -> DataFrame:
        """Every play once; those that still wait have no metadata."""
        done = self.spark.read.schema(self._schema).parquet(f"{self.out}/enriched").select(*self._schema.fieldNames())
        return done.unionByName(self.parked.read().select(*self.plays.fieldNames()), allowMissingColumns=True)


def _each_batch(df: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def write_batches(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write each micro-batch to its own folder; running a batch again replaces its folder."""

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, out: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The newest row of every key over all micro-batch folders."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(out)
    return ledger.latest(rows, keys, [BATCH]).drop(BATCH)


def daily_minutes(plays: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Store each micro-batch's milliseconds per day; plays without a time belong to no day."""

    def save(rows: DataFrame, batch_id: int) -> None:
        days = rows.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.sum("ms_played").alias("ms"))
        days.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return _each_batch(plays, save, checkpoint)


def read_daily_minutes(spark: SparkSession, out: str) -> DataFrame:
    """Minutes per day over all micro-batches."""
    stored = spark.read.schema("day date, ms long").parquet(out)
    return stored.groupBy("day").agg(F.sum("ms").alias("ms")).select("day", numbers.minutes("ms").alias("minutes"))


def ledger_stream(entries: DataFrame, out: str, checkpoint: str, remember_misses: bool = False) -> StreamingQuery:
    """Record arriving lookup results in the stored ledger at ``out``; a micro-batch that runs again changes nothing."""
    table = ledger.stored(entries.sparkSession, out)
    return _each_batch(entries, lambda rows, batch: ledger.record(table, rows, remember_misses, batch), checkpoint)


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """The stored ledger as of all micro-batches: stored documents beat misses, later ones earlier ones."""
    return ledger.stored(spark, out).read().drop(ledger.BUCKET)
