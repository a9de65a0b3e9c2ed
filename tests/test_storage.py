"""Readers, writers, streams and the pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from sonolog.operators import cleaning, ledger, metadata, refresh
from sonolog.schemas import ARTIST, CATALOG, PAIR, PLAYS_RAW, TRACK
from sonolog.sources import readers, tables, versioned, writers
from sonolog.streaming import jobs


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    """Fewer parts than in production, which small tables would only wait for."""
    monkeypatch.setattr(ledger, "BUCKETS", 6)
    monkeypatch.setattr(refresh, "PARTS", 4)
    monkeypatch.setattr(jobs, "PARK_PARTS", 3)


def export(folder, name, rows):
    (folder / name).write_text(json.dumps(rows), encoding="utf-8")


def play(ts, track="T", ms=60000, **more):
    return {"ts": ts, "ms_played": ms, TRACK: track, ARTIST: "A", **more}


def test_history_files_in_order(spark, tmp_path):
    export(tmp_path, "Streaming_History_2.json", [play("2024-01-03T00:00:00Z", "c")])
    export(tmp_path, "Streaming_History_1.json", [play("2024-01-02T00:00:00Z", "a"), play("2024-01-01T00:00:00Z", "b", extra=1)])
    export(tmp_path, "Other.json", [play("2024-01-04T00:00:00Z", "x")])
    df = readers.read_history_json(spark, str(tmp_path), ordered=True)
    rows = df.orderBy(*readers.SOURCE_ORDER).collect()
    assert [r[TRACK] for r in rows] == ["a", "b", "c"]
    assert set(PLAYS_RAW.fieldNames()) <= set(df.columns)


def test_csv_readers(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'a,b\n1,"say ""hi"""\n2,bad\xff\n3\n4,x,y\n5,\n')
    lenient = {r.a: r.b for r in readers.read_csv_lenient(spark, str(path), ["a", "b"]).collect()}
    assert lenient["1"] == 'say "hi"' and lenient["2"] == "bad�" and lenient["5"] is None
    assert "3" not in lenient and "4" not in lenient
    marked = readers.read_csv_lenient(spark, str(path), ["a", "b"], keep_bad=True).cache()
    assert marked.where(F.col(readers.CORRUPT).isNotNull()).count() == 2
    marked.unpersist()
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv_strict(spark, str(path), ["a", "b"]).collect()


def test_strict_reader_names_the_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    assert readers.read_csv_strict(spark, str(tmp_path), ["a"]).first().filename.endswith("x.csv")


def test_text_that_looks_missing_stays_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nNA,null\n,None\n")
    got = [tuple(r) for r in readers.read_csv(spark, str(tmp_path), readers._all_text(["a", "b"])).collect()]
    assert got == [("NA", "null"), (None, "None")]


def test_select_existing_prunes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert readers.select_existing(df, ["c", "a", "zzz"]).columns == ["a", "c"]


def test_first_available(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "second"))
    paths = [str(tmp_path / "first"), str(tmp_path / "second")]
    assert readers.load_first_available(spark, paths).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.load_first_available(spark, paths[:1])


def test_writers_count_while_writing(spark, tmp_path):
    out = str(tmp_path / "t")
    assert writers.overwrite_counted(spark.range(7), out) == 7
    writers.append(spark.range(2), out)
    assert spark.read.parquet(out).count() == 9
    tagged = spark.range(10).withColumn("media_type", F.when(F.col("id") < 3, "podcast").otherwise("song"))
    counts = writers.write_by_media(tagged, str(tmp_path / "m"))
    assert counts == {"song": 7, "podcast": 3}
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.where("media_type = 'song'").count() == 7 and back.count() == 10


def test_stream_continues_from_its_checkpoint(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    run = lambda: jobs.append_cleaned(jobs.history_stream(spark, str(src)), out, state).awaitTermination()
    export(src, "Streaming_History_1.json", [play("2024-01-01T00:00:00Z"), play("2024-01-01T01:00:00Z", ms=10)])
    run()
    assert spark.read.parquet(out).count() == 1
    run()
    assert spark.read.parquet(out).count() == 1
    export(src, "Streaming_History_2.json", [play("2024-01-02T00:00:00Z")])
    run()
    batch = cleaning.clean(readers.read_history_json(spark, str(src)))
    cols = ["ts", "ms_played", *PAIR, "weekday"]
    assert sorted(map(str, spark.read.parquet(out).select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


def test_daily_minutes_add_up_late_rows_too(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()

    def run():
        plays = jobs.history_stream(spark, str(src)).withColumn("ts", F.col("ts").cast("timestamp").cast("timestamp_ntz"))
        jobs.daily_minutes(plays, out, state).awaitTermination()
        return {str(r.day): r.minutes for r in jobs.read_daily_minutes(spark, out).collect()}

    export(src, "Streaming_History_1.json", [play("2024-01-10T10:00:00Z")])
    assert run() == {"2024-01-10": 1.0}
    export(src, "Streaming_History_2.json", [play("2024-01-10T12:00:00Z"), play("2024-01-09T12:00:00Z")])
    assert run() == {"2024-01-10": 2.0, "2024-01-09": 1.0}
    export(src, "Streaming_History_3.json", [play("2024-01-01T12:00:00Z")])
    assert run() == {"2024-01-10": 2.0, "2024-01-09": 1.0, "2024-01-01": 1.0}


def test_stream_drops_repeats_across_batches(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()

    def run():
        plays = jobs.history_stream(spark, str(src)).withColumn("ts", F.col("ts").cast("timestamp").cast("timestamp_ntz"))
        jobs.write_batches(jobs.suppress_repeats(plays), out, state).awaitTermination()
        return spark.read.parquet(out).count()

    export(src, "Streaming_History_1.json", [play("2024-01-01T00:00:00Z")] * 2)
    assert run() == 1
    export(src, "Streaming_History_2.json", [play("2024-01-01T00:00:00Z"), play("2024-01-01T00:01:00Z")])
    assert run() == 2


def test_streams_lose_no_old_plays_in_small_batches(spark, sf_dir, tmp_path):
    """Files newest first, one per micro-batch, every play exported twice."""
    import os

    plays = tables.plays_long(spark, sf_dir).select("ts", "ms_played", *PAIR).distinct().cache()
    for i, years in enumerate(["year(ts) < 1995", "year(ts) between 1995 and 1996", "year(ts) > 1996"]):
        part = plays.where(years)
        part.unionAll(part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    source = tmp_path / "in"
    source.mkdir()
    for age, i in enumerate([2, 1, 0]):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            to = source / f"{i}-{f.name}"
            to.write_bytes(f.read_bytes())
            os.utime(to, (1_700_000_000 + age, 1_700_000_000 + age))
    names = [str(tmp_path / n) for n in ("days", "s1", "once", "s2")]
    stream = lambda: jobs.table_stream(spark, str(source), max_files=1)
    jobs.daily_minutes(stream(), names[0], names[1]).awaitTermination()
    jobs.keep_once(stream(), names[2], names[3], "year").awaitTermination()
    assert len(list((tmp_path / "days").glob("batch=*"))) == 3
    got = jobs.read_daily_minutes(spark, names[0]).agg(F.sum("minutes")).first()[0]
    assert got == pytest.approx(plays.agg(F.sum("ms_played")).first()[0] * 2 / 60000)
    assert jobs.read_once(spark, names[2], plays.schema).count() == plays.count()
    plays.unpersist()


def test_damaged_history_fails_or_is_kept_aside(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    export(src, "Streaming_History_1.json", [play("2024-01-01T00:00:00Z"), play("2024-01-02T00:00:00Z")])
    whole = json.dumps([play("2024-01-03T00:00:00Z"), play("2024-01-04T00:00:00Z")])
    (src / "Streaming_History_2.json").write_text(whole[:-20])
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        readers.read_history_json(spark, str(src)).collect()
    rows = readers.read_history_json(spark, str(src), ordered=True, keep_damaged=True).cache()
    good, bad = readers.split_damaged(rows)
    assert good.count() == 2 and [r.src_file[-6:] for r in bad.collect()] == ["2.json"]
    rows.unpersist()
    out = [str(tmp_path / n) for n in ("out", "bad", "state", "state2")]
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        jobs.append_cleaned(jobs.history_stream(spark, str(src)), str(tmp_path / "o2"), out[3]).awaitTermination()
    stream = jobs.history_stream(spark, str(src), max_files=1, keep_damaged=True)
    jobs.append_cleaned_aside(stream, *out[:3]).awaitTermination()
    assert spark.read.parquet(out[0]).count() == 2 and spark.read.parquet(out[1]).count() == 1


def test_other_export_columns_come_along(spark, tmp_path):
    export(tmp_path, "Streaming_History_1.json", [play("2024-01-01T00:00:00Z", shuffle=True)])
    export(tmp_path, "Streaming_History_2.json", [play("2024-01-02T00:00:00Z", offline_timestamp=5)])
    df = readers.read_history_json(spark, str(tmp_path), schema=None)
    assert df.columns == [*PLAYS_RAW.fieldNames(), "offline_timestamp", "shuffle"]
    got = [(r.shuffle, r.offline_timestamp) for r in cleaning.clean(df).orderBy("ts").collect()]
    assert got == [("true", None), (None, "5")]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("genre,artists,track_name,weird col,popularity\nPop,A,Song,x,55\nRock,B,Tune,y,bad\n")
    rows = readers.read_catalog(spark, str(tmp_path / "c.csv"), CATALOG).orderBy(*readers.SOURCE_ORDER).collect()
    got = [(r.track_name, r.artist_name, r.genre, r.popularity, r.energy) for r in rows]
    assert got == [("Song", "A", "Pop", 55, None), ("Tune", "B", "Rock", None, None)]
    lenient = readers.read_csv_lenient(spark, str(tmp_path / "c.csv"), ["track_name", "genre"]).orderBy("genre")
    assert [tuple(r) for r in lenient.collect()] == [("Song", "Pop"), ("Tune", "Rock")]
    (tmp_path / "d.csv").write_text("genre,track_name\nPop,Song\n")
    with pytest.raises(ValueError, match="artist_name"):
        readers.read_catalog(spark, str(tmp_path / "d.csv"), CATALOG)


def test_csv_files_with_different_headers_come_together(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n1,2\n3,\n")
    (folder / "3.csv").write_text("A,c\n5,x\n")
    (folder / "4.csv").write_text("a,b\n7,8\n")
    got = readers.read_csv(spark, str(folder), readers._all_text(["a", "b", "c"]), ordered=True).orderBy(*readers.SOURCE_ORDER)
    rows = [(r.a, r.b, r.c, r.src_file[-5:]) for r in got.collect()]
    assert rows == [
        ("1", "2", None, "1.csv"), ("2", "1", None, "2.csv"), (None, "3", None, "2.csv"), ("5", None, "x", "3.csv"), ("7", "8", None, "4.csv"),
    ]
    strict = readers.read_csv_strict(spark, str(folder), ["a", "b"]).where("filename like '%4.csv'").collect()
    assert [(r.a, r.b) for r in strict] == [("7", "8")]


def test_shared_dir_is_refused_without_setting(spark, monkeypatch):
    from types import SimpleNamespace

    from sonolog import session

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master="spark://host:1", getCheckpointDir=lambda: None, getConf=lambda: {})
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
    named = SimpleNamespace(get=lambda *_: "/mnt/shared/")
    assert session.shared_dir(SimpleNamespace(conf=named, sparkContext=context)) == "/mnt/shared"


def entries(spark, rows):
    df = spark.createDataFrame(rows, "key string, meta_json string, updated_at string")
    return df.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def held(table):
    return sorted((r.key, r.meta_json) for r in table.read().collect())


def files_below(path):
    return len(list(path.rglob("*.parquet")))


def test_stored_ledger_survives_replays_and_dead_writes(spark, tmp_path, monkeypatch):
    table = ledger.stored(spark, str(tmp_path / "ledger"))
    assert held(table) == [] and table.current().number == 0
    first = entries(spark, [(f"k{i}", "{}", "2024-01-01") for i in range(300)] + [("miss", None, "2024-01-01")])
    assert ledger.record(table, first, True, 0)
    before = held(table)
    assert len(before) == 301
    assert not ledger.record(table, entries(spark, [("k1", "other", "2025-01-01")]), True, 0) and held(table) == before

    def die(self, version):
        raise RuntimeError("lost")

    new = entries(spark, [("k1", "later", "2024-02-01"), ("k2", None, "2024-02-01"), ("miss", "found", "2023-01-01")])
    with monkeypatch.context() as m:
        m.setattr(versioned.VersionedTable, "_publish", die)
        with pytest.raises(RuntimeError):
            ledger.record(table, new, True, 1)
    assert held(table) == before and table.current().batch == 0
    assert ledger.record(table, new, True, 1)
    after = dict(held(table))
    assert (after["k1"], after["k2"], after["miss"], len(after)) == ("later", "{}", "found", 301)
    cut = next((tmp_path / "ledger" / "versions" / "slot=0").glob("*.json"))
    cut.write_text("\n".join(cut.read_text().splitlines()[:5]))
    for crc in cut.parent.glob(".*.crc"):
        crc.unlink()
    assert held(table) == before


def test_stored_ledger_stays_as_small_after_many_batches(spark, tmp_path):
    table = ledger.stored(spark, str(tmp_path / "ledger"))
    rows = [(f"k{i}", "{}", "2024-01-01") for i in range(500)]
    ledger.record(table, entries(spark, rows), batch=0)
    ledger.record(table, entries(spark, rows), batch=1)
    files = files_below(tmp_path)
    read = len(table.read().inputFiles())
    for batch in range(2, 8):
        ledger.record(table, entries(spark, [(f"k{i}", f"v{batch}", f"2024-02-{batch:02}") for i in range(500)]), batch=batch)
    assert files_below(tmp_path) == files and len(table.read().inputFiles()) == read
    assert {v for _, v in held(table)} == {"v7"} and table.current().number == 8


def test_only_the_buckets_of_a_batch_are_written(spark, tmp_path):
    table = ledger.stored(spark, str(tmp_path / "ledger"))
    ledger.record(table, entries(spark, [(f"k{i}", "{}", "2024-01-01") for i in range(500)]))
    before = table.current()
    ledger.record(table, entries(spark, [("k7", "new", "2024-02-01"), ("none", None, "2024-02-01")]))
    after = table.current()
    assert sum(after.slots[p] != slot for p, slot in before.slots.items()) == 1


META = f"{TRACK} string, {ARTIST} string, spotify_id string, track_popularity long"


def dated(spark, rows):
    """(ts, track, artist) as plays of 60 s."""
    df = spark.createDataFrame([(t, 60000, a, b) for t, a, b in rows], f"ts string, ms_played long, {TRACK} string, {ARTIST} string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def texts(df):
    return sorted(map(str, df.collect()))


def test_refresh_writes_only_the_partitions_of_changed_keys(spark, tmp_path):
    rows = [(f"{2000 + i % 7}-05-01", f"T{i % 40}", f"A{i % 3}") for i in range(400)]
    rows += [("2003-01-01", None, "A1"), (None, "T1", "A1"), ("2004-01-01", "t1 ", "a1")] * 3
    plays = dated(spark, rows).cache()
    first = [(f"t{i}", f"A{i % 3}", f"S{i}", i) for i in range(0, 40, 2)]
    later = [*first, ("T1", "a1", "S1", 1), ("T2", "a2", "S0", 9), ("never played", "x", "S5", 1)]
    meta = [spark.createDataFrame(m, META) for m in (first, later, [*later, ("t4", "A1", "Z4", 8)])]
    store = refresh.store(spark, str(tmp_path), plays.schema, meta[0].schema, ["spotify_id", "track_popularity"])
    refresh.create(store, plays, meta[0])
    names = refresh.read(store).columns

    def whole(m):
        return texts(metadata.enrich(plays, m).select(*names))

    assert texts(refresh.read(store)) == whole(meta[0])
    assert refresh.refresh(store, meta[0]) == [] and store.plays.current().number == 1
    before = store.plays.current()
    touched = refresh.refresh(store, meta[1])
    after = store.plays.current()
    assert texts(refresh.read(store)) == whole(meta[1])
    # T1 by A1 is the one played key that changed: "t2" by A2 keeps its winner.
    own = {r.y for r in plays.where("lower(trim(master_metadata_track_name)) = 't1' and lower(master_metadata_album_artist_name) = 'a1'")
           .select(F.coalesce(F.year("ts"), F.lit(0)).alias("y")).collect()}
    assert {y for _, y in touched} == own and len({p for p, _ in touched}) == 1
    assert {p for p in after.slots if after.slots[p] != before.slots[p]} == set(touched)
    assert refresh.refresh(store, meta[2]) and texts(refresh.read(store)) == whole(meta[2])
    assert refresh.refresh(store, meta[2]) == []
    with pytest.raises(ValueError):
        refresh.store(spark, str(tmp_path), plays.schema, meta[0].schema, ["ts"])
    plays.unpersist()


def test_a_refresh_that_died_is_done_again(spark, tmp_path, monkeypatch):
    plays = dated(spark, [("2001-01-01", f"T{i}", "A") for i in range(20)])
    meta = [spark.createDataFrame([(f"T{i}", "A", f"S{i}", i) for i in range(n)], META) for n in (5, 20)]
    store = refresh.store(spark, str(tmp_path), plays.schema, meta[0].schema, ["spotify_id", "track_popularity"])
    refresh.create(store, plays, meta[0])

    def die(self, version):
        if "winners" in self.root:
            raise RuntimeError("lost")
        publish(self, version)

    publish = versioned.VersionedTable._publish
    with monkeypatch.context() as m:
        m.setattr(versioned.VersionedTable, "_publish", die)
        with pytest.raises(RuntimeError):
            refresh.refresh(store, meta[1])
    assert refresh.refresh(store, meta[1])
    assert refresh.read(store).where("spotify_id is null").count() == 0 and refresh.read(store).count() == 20


def late_job(spark, tmp_path, plays):
    return jobs.LateMetadata(spark, str(tmp_path / "out"), plays.schema, spark.createDataFrame([], META).select("spotify_id").schema)


def test_plays_end_enriched_when_their_metadata_comes_later(spark, tmp_path, monkeypatch):
    rows = [("2024-01-01", f"T{i % 5}", "A") for i in range(20)] + [("2024-01-02", None, "A"), (None, "T1", None)] * 4
    plays = dated(spark, rows)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    job = late_job(spark, tmp_path, plays)
    meta = [spark.createDataFrame([(f"t{i}", "a", f"S{i}", i) for i in range(n)], META) for n in (1, 3, 5)]
    writers.append(plays, source)
    calls = []
    once = metadata.dedup
    monkeypatch.setattr(jobs.metadata, "dedup", lambda m, *more: calls.append(1) or once(m, *more))
    job.run(jobs.table_stream(spark, source), meta[0], state)
    waiting = lambda: job.parked.read().count()
    assert (job.read().count(), waiting()) == (28, 16)
    writers.append(plays, source)
    job.run(jobs.table_stream(spark, source, max_files=1), meta[1], state)
    assert len(calls) == 2 and (job.read().count(), waiting()) == (56, 16)
    job.run(jobs.table_stream(spark, source), meta[2], state)
    assert len(calls) == 3
    twice = plays.unionAll(plays)
    names = job.read().columns
    assert waiting() == 0 and texts(job.read()) == texts(metadata.enrich(twice, meta[2]).select(*names))


def test_a_move_of_parked_plays_that_died_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    plays = dated(spark, [("2024-01-01", f"T{i}", "A") for i in range(10)])
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    job = late_job(spark, tmp_path, plays)
    meta = [spark.createDataFrame([(f"T{i}", "A", f"S{i}", i) for i in range(n)], META) for n in (0, 4, 9)]
    writers.append(plays, source)
    job.run(jobs.table_stream(spark, source), meta[0], state)

    def die(self, version):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versioned.VersionedTable, "_publish", die)
        with pytest.raises(RuntimeError):
            job.run(jobs.table_stream(spark, source), meta[1], state)
    job.run(jobs.table_stream(spark, source), meta[2], state)
    assert job.read().count() == 10 and job.read().where("spotify_id is null").count() == 1


def test_repeats_are_dropped_in_any_order_and_batches_may_run_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "once")
    early = dated(spark, [("2024-01-01", f"T{i}", "A") for i in range(30)] + [(None, "T", "A")] * 5)
    late = dated(spark, [("2024-02-01", f"T{i}", "A") for i in range(30)] + [("2024-02-01", None, "A"), ("2024-02-01", "", "A")] * 3)
    for wave in (late, early, late, early.unionAll(late)):
        writers.append(wave, source)
        jobs.keep_once(jobs.table_stream(spark, source), out, str(tmp_path / "state")).awaitTermination()
    expect = texts(early.unionAll(late).distinct())
    assert texts(jobs.read_once(spark, out, early.schema)) == expect
    # All over again, without the memory of what was done: every micro-batch replaces its own.
    jobs.keep_once(jobs.table_stream(spark, source), out, str(tmp_path / "other state")).awaitTermination()
    assert texts(jobs.read_once(spark, out, early.schema).distinct()) == expect
    assert len(list((tmp_path / "once" / "plays").glob("play_day=*"))) == 3


def test_late_plays_are_counted(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    waves = [["2024-01-10T10:00", "2024-01-10T10:30"], ["2024-01-10T10:40", "2024-01-01T00:00"], ["2024-01-09T23:00", None]]
    for times in waves:
        writers.append(dated(spark, [(t, "T", "A") for t in times]), source)
        jobs.window_stream(jobs.table_stream(spark, source), "1 hour", "2 hours", out, state)
    got = {str(r.start): (r.plays, r.ms) for r in jobs.read_windows(spark, out).collect()}
    assert got == {"2024-01-10 10:00:00": (3, 180000)}
    assert tuple(jobs.read_late(spark, out).first()) == (2, 120000)


def test_every_field_of_an_export_is_kept(spark, tmp_path):
    export(tmp_path, "Streaming_History_1.json", [play("2024-01-01T00:00:00Z", shuffle=True, **{"it's": 1}), play("2024-01-02T00:00:00Z")])
    export(tmp_path, "Streaming_History_2.json", [play("2024-01-03T00:00:00Z", offline={"at": [1, 2]}, shuffle="yes", gone=None)])
    export(tmp_path, "Streaming_History_3.json", [])
    (tmp_path / "Streaming_History_4.json").write_text(" \n")
    df = readers.read_history_open(spark, str(tmp_path)).orderBy("ts")
    assert df.columns == [*PLAYS_RAW.fieldNames(), "extra"]
    got = df.select("ms_played", readers.extra_field("shuffle", "boolean"), readers.extra_field("it's", "int"),
                    F.expr("try_variant_get(extra, '$.offline.at[1]', 'int')").alias("at"), F.col("extra").isNull().alias("none")).collect()
    assert [tuple(r) for r in got] == [(60000, True, 1, None, False), (60000, None, None, None, True), (60000, True, None, 2, False)]
    (tmp_path / "Streaming_History_5.json").write_text('[{"ts": "2024-01-04T00:00:00Z"}, {"ts"')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_history_open(spark, str(tmp_path)).collect()
    whole, broken = readers.split_damaged(readers.read_history_open(spark, str(tmp_path), keep_damaged=True))
    assert whole.count() == 3 and [r[readers.CORRUPT][:3] for r in broken.collect()] == ['[{"']


def test_appended_rows_must_fit_the_table(spark, tmp_path):
    from pyspark.sql import types as T

    path = str(tmp_path / "t")
    schema = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType())])
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(writers.SchemaMismatch, match="new table"):
        writers.append_checked(rows, path)
    writers.append_checked(rows, path, schema)
    writers.append_checked(spark.createDataFrame([(2,)], "K long"), path)
    files = files_below(tmp_path)
    bad = {
        "k is bigint": "cast(k as int) as k, v", "no column": "v", "not in the table": "k, v, 1 as w", "twice": "k, v, v as V",
    }
    for match, columns in bad.items():
        with pytest.raises(writers.SchemaMismatch, match=match):
            writers.append_checked(rows.selectExpr(*columns.split(", ")), path)
    assert files_below(tmp_path) == files
    writers.append_checked(rows.selectExpr("5L as w", "k + 2 as k"), path, evolve=True)
    with pytest.raises(writers.SchemaMismatch, match="w is bigint"):
        writers.append_checked(rows.selectExpr("'x' as w", "k"), path, evolve=True)
    with pytest.raises(Exception, match="NULL in k"):
        writers.append_checked(spark.createDataFrame([(None,)], "k long"), path)
    got = sorted(map(tuple, writers.read_checked(spark, path).collect()))
    assert got == [(1, "a", None), (2, None, None), (3, None, 5)]
    assert spark.read.parquet(path).count() == 3
