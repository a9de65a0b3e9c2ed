"""Queries that go through storage: files written by Spark, read back as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import media
from ..operators import cleaning, day_bitmaps, ledger, metadata, refresh
from ..operators.numbering import number_rows
from ..schemas import API_META, ARTIST, CATALOG, EPISODE_COLUMNS, KEYS, LEDGER, PAIR, PLAYS_RAW, TRACK
from ..session import scratch_path
from ..sources import layout, readers, tables, writers
from ..streaming import jobs
from . import pipeline
from .queries import _ledger_entries, _long, _plays, query

RECORDS_PER_FILE = 10000


def write_history_json(plays: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, more: tuple[str, ...] = ()) -> None:
    """Plays as export files: JSON arrays of at most ``per_file`` records, one per file, with fields ``more`` besides the known."""
    fields = [c for c in PLAYS_RAW.fieldNames() if c in plays.columns] + list(more)
    numbered = number_rows(plays, "cast(play_id as string)")
    arrays = numbered.groupBy(F.expr(f"row_no div {per_file} as file_no")).agg(
        F.to_json(F.collect_list(F.struct(*fields))).alias("value")
    )
    files = arrays.select("value").write.mode("append").option("maxRecordsPerFile", 1)
    files.option("mapreduce.output.basename", "Streaming_History").text(path)


HISTORY_FILES = "Streaming_History*.txt"


def _raw_text(s, d) -> DataFrame:
    """All plays with the timestamp as exported: ISO text in UTC."""
    iso = F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    return tables.plays(s, d).withColumn("ts", iso)


def _events_stream(s, d) -> DataFrame:
    # As a pattern, because a file stream takes a single file only through one.
    return jobs.table_stream(s, f"{d.rstrip('/')}/events[.]parquet")


@query
def json_history_ingest(s, d):
    """Export files arrive, are cleaned and added to the plays table by a stream."""
    files, out, state = (scratch_path(s, n) for n in ("history", "plays", "state"))
    write_history_json(_raw_text(s, d), files)
    jobs.append_cleaned(jobs.history_stream(s, files, name_glob=HISTORY_FILES), out, state).awaitTermination()
    return s.read.parquet(out).select("ts", "ms_played", *PAIR, "weekday", "hour", "minutes_played")


@query
def json_history_ordered(s, d):
    """Batch read of the export files with the name of the file each play came from."""
    files = scratch_path(s, "history")
    write_history_json(_raw_text(s, d), files)
    plays = readers.read_history_json(s, files, name_glob=HISTORY_FILES, ordered=True)
    return cleaning.clean(plays).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("plays"),
        F.count(TRACK).alias("tracks"),
        F.count_distinct("src_file", "src_block", "src_row").alias("positions"),
    )


@query
def json_history_drifting(s, d):
    """Two generations of exports, each with fields of its own, through the stream and in batch; both fields are kept."""
    files, out, state = (scratch_path(s, n) for n in ("history", "plays", "state"))
    raw = _raw_text(s, d).withColumns({"shuffle": F.col("play_id") % 2 == 0, "offline": F.struct(F.col("play_id").alias("at"))})
    old = F.col("ts") < "2024-01-16"
    write_history_json(raw.where(old), files, more=("shuffle",))
    write_history_json(raw.where(~old), files, more=("offline",))
    jobs.append_cleaned(jobs.open_history_stream(s, files, name_glob=HISTORY_FILES), out, state).awaitTermination()
    batch = cleaning.clean(readers.read_history_open(s, files, name_glob=HISTORY_FILES))
    parts = []
    for way, plays in (("stream", s.read.parquet(out)), ("batch", batch)):
        typed = plays.select("ts", readers.extra_field("shuffle", "boolean"), F.expr("try_variant_get(extra, '$.offline.at', 'bigint')").alias("at"))
        parts.append(typed.groupBy(F.lit(way).alias("way"), F.to_date("ts").alias("day"), "shuffle").agg(
            F.count(F.lit(1)).alias("plays"), F.count("at").alias("offline"), F.sum("at").alias("at")
        ))
    return cleaning.combine(*parts)


@query
def csv_history_scan(s, d):
    """Plays written as CSV and read back with an explicit schema."""
    path = scratch_path(s, "csv")
    plays = tables.plays(s, d).select("play_id", F.col("ts").cast("string").alias("ts"), "ms_played", *PAIR)
    writers.overwrite(plays, path, "csv")
    schema = T.StructType(
        [
            T.StructField("play_id", T.LongType()),
            T.StructField("ts", T.StringType()),
            T.StructField("ms_played", T.LongType()),
            T.StructField(TRACK, T.StringType()),
            T.StructField(ARTIST, T.StringType()),
        ]
    )
    return cleaning.clean(readers.read_csv(s, path, schema)).select("play_id", "ts", "ms_played", *PAIR)


def _catalogue_file(s, d, name: str, artist: str) -> str:
    """The catalogue as CSV: columns in another order than the schema's, and one that is not in it."""
    path = scratch_path(s, name)
    rows = tables.catalog(s, d).withColumnRenamed("artist_name", artist)
    shuffled = ["genre", artist, "track_id", "tempo", "track_name", "popularity", "energy"]
    writers.overwrite(rows.select(F.lit("x").alias("note"), *shuffled), path, "csv")
    return path


def _catalogue_by_genre(df: DataFrame) -> DataFrame:
    return df.groupBy("genre").agg(
        F.count("track_name").alias("tracks"),
        F.count_distinct("artist_name").alias("artists"),
        F.sum("popularity").alias("popularity"),
        F.round(F.sum("tempo"), 3).alias("tempo"),
        F.count("valence").alias("valences"),
    )


@query
def catalog_csv_by_name(s, d):
    return _catalogue_by_genre(readers.read_catalog(s, _catalogue_file(s, d, "catalogue", "artist_name"), CATALOG))


@query
def catalog_csv_legacy(s, d):
    return _catalogue_by_genre(readers.read_catalog(s, _catalogue_file(s, d, "legacy", "artists"), CATALOG))


@query
def csv_strict_by_name(s, d):
    path = _catalogue_file(s, d, "strict", "artist_name")
    got = readers.read_csv_strict(s, path, ["track_id", "track_name", "artist_name"])
    return got.where("filename is not null").select("track_id", "track_name", "artist_name")


@query
def csv_lenient_counted(s, d):
    """Lines of which those of large parts have a field too many; both kinds are counted."""
    path, stored = scratch_path(s, "lenient"), scratch_path(s, "marked")
    line = F.concat_ws(",", "p_brand", "p_partkey", F.when(F.col("p_size") > 40, "x"), "p_size")
    # One column whose name and values hold the separators, written as they are.
    lines = tables.table(s, d, "part").select(line.alias("p_brand,p_partkey,p_size"))
    lines.write.mode("overwrite").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    rows = readers.read_csv_lenient(s, path, ["p_size", "p_partkey", "absent"], keep_bad=True)
    writers.overwrite(rows.withColumn("malformed", F.col(readers.CORRUPT).isNotNull()), stored)
    whole = F.when(~F.col("malformed"), F.col("p_size").cast("long"))
    return s.read.parquet(stored).groupBy("malformed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(whole).alias("sizes"), F.count("absent").alias("absent")
    )


@query
def csv_headers_differ(s, d):
    """Two catalogues in one folder: other columns, another order; read by name and put together."""
    path = scratch_path(s, "headers")
    parts = tables.table(s, d, "part")
    small = parts.where("p_size <= 25").select("p_partkey", "p_brand", "p_size")
    writers.overwrite(small, f"{path}/small", "csv")
    writers.overwrite(parts.where("p_size > 25").select("p_size", "p_type", "p_partkey"), f"{path}/large", "csv")
    schema = T.StructType.fromDDL("p_partkey bigint, p_size int, p_brand string, p_type string")
    return readers.read_csv(s, [f"{path}/small", f"{path}/large"], schema)


@query
def csv_bad_bytes(s, d):
    """Names with a byte that is not UTF-8: it is read as the replacement character, and the row stays."""
    path = scratch_path(s, "bytes")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("\u00e9"))).otherwise(F.col("p_name")))
    lines = tables.table(s, d, "part").select(line.alias("p_partkey,name"))
    # Latin-1 writes the accented letter as one byte, which UTF-8 does not know.
    plain = lines.write.mode("overwrite").option("header", True).option("sep", "\u0001").option("quote", "")
    plain.option("encoding", "ISO-8859-1").csv(path)
    return readers.read_csv(s, path, T.StructType.fromDDL("p_partkey bigint, name string"))


@query
def columns_that_exist(s, d):
    """Of the columns a report would like, those that the stored table has; the scan reads no others."""
    path = scratch_path(s, "stored")
    writers.overwrite(_plays(s, d), path)
    wanted = ["ms_played", "energy", "year", "month", "nothing", TRACK]
    some = readers.select_existing(s.read.parquet(path), wanted)
    return some.groupBy("year", "month").agg(F.count(TRACK).alias("tracks"), F.sum("ms_played").alias("ms"))


@query
def published_first_available(s, d):
    """Which stored table is found as more and more of them are published, and its rows."""
    out = scratch_path(s, "published")
    plays, source, stored = _plays(s, d), tables.catalog(s, d), tables.api_meta(s, d)
    done = s.createDataFrame([], LEDGER)
    made = pipeline.tables_and_reports(plays, source, ["src_order"], stored, done)
    found = []
    for name in reversed(pipeline.PREFERENCE):
        if name == pipeline.FINAL:
            writers.write_by_media(made[name], f"{out}/{name}")
        else:
            writers.overwrite(made[name], f"{out}/{name}")
        seen = pipeline.load(s, out)
        count = F.count("spotify_id" if "spotify_id" in seen.columns else "track_id" if "track_id" in seen.columns else "ts")
        found.append(seen.agg(F.lit(name).alias("published"), F.count(F.lit(1)).alias("plays"), count.alias("enriched")))
    return cleaning.combine(*found)


@query
def metadata_checked_append(s, d):
    """Lookup results into a table of 19 fixed columns, then, allowed to, with one more; a changed type is refused."""
    path = scratch_path(s, "checked")
    meta = tables.api_meta(s, d).withColumn("track_popularity", F.col("track_popularity").cast("long"))
    writers.append_checked(meta.where("track_popularity < 50"), path, API_META)
    refused = 0
    for bad in (meta.withColumn("track_popularity", F.lit("high")), meta.withColumn("mood", F.lit(1))):
        try:
            writers.append_checked(bad, path)
        except writers.SchemaMismatch:
            refused += 1
    more = meta.where("track_popularity >= 50").withColumn("mood", F.col("track_popularity") % 3)
    writers.append_checked(more, path, evolve=True)
    rows = writers.read_checked(s, path)
    return rows.groupBy("mood").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("track_popularity").alias("popularity"), F.count("album_name").alias("albums"),
        F.lit(len(rows.columns)).alias("columns"), F.lit(refused).alias("refused"),
    )


@query
def day_bitmap_summary(s, d):
    """Distinct counts of ranges of days out of stored bitmaps; the later half of the days was added afterwards."""
    names = [scratch_path(s, n) for n in ("ids", "more-ids", "bitmaps", "sums")]
    plays = _long(s, d)
    early, late = plays.where("year < 1998"), plays.where("year >= 1998")
    writers.overwrite(day_bitmaps.dictionary(early), names[0])
    writers.overwrite(day_bitmaps.dictionary(late, s.read.parquet(names[0])), names[1])
    ids = s.read.parquet(names[1])
    for part in (early, late):
        writers.append(day_bitmaps.daily_bitmaps(part, ids), names[2])
        writers.append(day_bitmaps.daily_sums(part), names[3])
    bitmaps, sums = s.read.parquet(names[2]), s.read.parquet(names[3])
    parts = []
    for start, end in ((None, None), ("1996-03-05", "1996-03-11"), ("1997-12-01", "1998-01-31"), ("2030-01-01", None)):
        found = day_bitmaps.range_summary(bitmaps, sums, start, end)
        parts.append(found.select(F.lit(start or "all").alias("start"), "*"))
    return cleaning.combine(*parts)


@query
def media_split_written(s, d):
    """Songs and podcasts in two folders, written in one pass and counted from storage."""
    path = scratch_path(s, "media")
    writers.write_by_media(_plays(s, d).withColumn("media_type", media.by_episode_fields()), path)
    return s.read.parquet(path).groupBy("media_type").agg(F.count(F.lit(1)).alias("plays"))


@query
def stream_daily_minutes(s, d):
    out, state = scratch_path(s, "daily"), scratch_path(s, "state")
    plays = tables.plays_from_events(_events_stream(s, d), cleaning.MIN_PLAY_MS).select("ts", "ms_played")
    jobs.daily_minutes(plays, out, state).awaitTermination()
    return jobs.read_daily_minutes(s, out)


@query
def stream_enrich(s, d):
    out, state = scratch_path(s, "enriched"), scratch_path(s, "state")
    plays = tables.plays_from_events(_events_stream(s, d), cleaning.MIN_PLAY_MS)
    single = metadata.dedup(tables.api_meta(s, d)).select(*KEYS, "spotify_id", "track_popularity")
    jobs.write_batches(jobs.enrich_stream(plays, single), out, state).awaitTermination()
    return s.read.parquet(out).select("play_id", "ms_played", *PAIR, "spotify_id", "track_popularity")


def _arriving(rows: DataFrame, path: str, waves: list[str]):
    """Add the rows of each wave to the folder, one wave after the other."""
    for wave in waves:
        writers.append(rows.where(wave), path)
        yield wave


# The newest plays arrive first.
WAVES = ["day(ts) >= 20", "day(ts) between 10 and 19", "day(ts) < 10"]


@query
def stream_suppress_repeats(s, d):
    """Plays arrive in three waves, the newest first, then all of them again, and are kept once."""
    source, out, state = (scratch_path(s, n) for n in ("twice", "once", "state"))
    plays = tables.plays(s, d).select("ts", "ms_played", *PAIR, *EPISODE_COLUMNS)
    for _ in _arriving(plays, source, [*WAVES, "true"]):
        jobs.keep_once(jobs.table_stream(s, source), out, state).awaitTermination()
    return jobs.read_once(s, out, plays.schema).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms")
    )


@query
def stream_late_metadata(s, d):
    """Half of the artists' metadata comes after the first plays; all plays end with theirs."""
    source, out, state = (scratch_path(s, n) for n in ("plays", "enriched", "state"))
    plays = _plays(s, d).select("play_id", "ts", "ms_played", *PAIR)
    meta = tables.api_meta(s, d)
    early = meta.where(F.regexp_extract(ARTIST, r"(\d+)", 1).cast("int") % 2 == 0)
    job = jobs.LateMetadata(s, out, plays.schema, meta.select("spotify_id", "track_popularity").schema)
    for wave, known in zip(_arriving(plays, source, WAVES), [early, meta, meta], strict=True):
        job.run(jobs.table_stream(s, source), known, state)
    return job.read().select("play_id", "ms_played", *PAIR, "spotify_id", "track_popularity")


@query
def stream_windows_late(s, d):
    """Hours and days in a state store while the newest plays come first; what the watermark drops is counted."""
    source = scratch_path(s, "plays")
    rows = _plays(s, d).select("ts", "ms_played")
    widths = {w: (scratch_path(s, "windows"), scratch_path(s, "state")) for w in ("1 hour", "1 day")}
    for _ in _arriving(rows, source, WAVES):
        for width, (out, state) in widths.items():
            jobs.window_stream(jobs.table_stream(s, source), width, "12 days", out, state)
    parts = []
    for width, (out, _) in widths.items():
        name, none = F.lit(width).alias("width"), F.lit(None).cast("timestamp_ntz").alias("start")
        parts.append(jobs.read_windows(s, out).select(name, "start", "plays", "ms"))
        parts.append(jobs.read_late(s, out).select(name, none, "plays", "ms"))
    return cleaning.combine(*parts)


_LAYOUTS: dict[tuple[str, str], layout.KeyedTables] = {}


def _layout(s, d) -> layout.KeyedTables:
    """Plays and metadata stored by key, once for a session and folder of tables."""
    key = (s.sparkContext.applicationId, d)
    if key not in _LAYOUTS:
        _LAYOUTS[key] = layout.store(_plays(s, d), tables.api_meta(s, d), scratch_path(s, "keyed"))
    return _LAYOUTS[key]


@query
def stored_enriched_plays(s, d):
    """``enriched_plays`` from tables that are stored by key: no play is shuffled."""
    return layout.enriched(s, _layout(s, d)).select(
        "play_id", "ts", "ms_played", *PAIR, "spotify_id", "track_popularity",
        "album_release_date", "album_release_date_precision", "api_genres",
    )


@query
def stored_unique_keys(s, d):
    return layout.unique_keys(s, _layout(s, d))


@query
def refreshed_plays(s, d):
    """Plays enriched with half of the metadata, then refreshed with all of it: only touched partitions are written."""
    plays = _plays(s, d).select("play_id", "ts", "ms_played", *PAIR)
    meta = tables.api_meta(s, d)
    fields = [f for f in meta.columns if f not in PAIR]
    store = refresh.store(s, scratch_path(s, "enriched"), plays.schema, meta.schema, fields)
    refresh.create(store, plays, meta.where(F.col("track_popularity") < 50))
    refresh.refresh(store, meta)
    return refresh.read(store)


@query
def stream_ledger(s, d):
    """Lookup results arrive as a stream and end as one ledger row per key."""
    source, out, state = (scratch_path(s, n) for n in ("results", "ledger", "state"))
    old, new = _ledger_entries(s, d)
    writers.overwrite(old, source)
    writers.append(new, source)
    jobs.ledger_stream(jobs.table_stream(s, source, max_files=1), out, state).awaitTermination()
    return jobs.read_ledger(s, out)


@query
def ledger_stored_versions(s, d):
    """Batches into the stored ledger, the newest results first; one batch comes twice, a miss never hides a document."""
    table = ledger.stored(s, scratch_path(s, "ledger"))
    old, new = _ledger_entries(s, d)
    quarter = F.quarter("updated_at")
    for batch, rows in enumerate([new.where(quarter == 4), new.where(quarter.isin(2, 3)), new.where(quarter == 1), old]):
        ledger.record(table, rows, True, batch)
        ledger.record(table, rows.withColumn("updated_at", F.lit("2030-01-01").cast("timestamp_ntz")), True, batch)
    return table.read().drop(ledger.BUCKET)


@query
def ledger_rebuilt_from_metadata(s, d):
    """The ledger derived from the append-only metadata table, so that one write is enough."""
    path = scratch_path(s, "metadata")
    writers.append(metadata.flatten(tables.search_responses(s, d), tables.artist_responses(s, d)), path)
    stored = s.read.parquet(path)
    stamped = ledger.entries(
        stored, F.lit("2025-01-01").cast("timestamp_ntz"), ["spotify_id", "track_popularity", "track_preview_url"]
    )
    return ledger.upsert(stamped.where(F.lit(False)), stamped).select("key", "meta_json")
