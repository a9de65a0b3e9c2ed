"""Column functions on hand-written rows, compared with Python where Python defines the rule."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sonolog.functions import media, numbers, temporal, text

PADDED = ["\t x", " x　", " x ", "x", "", "  ", "\x1cx\x1f", "a b", " 'Q\" "]


def values(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_full_normaliser_is_python_strip_lower(spark):
    assert values(spark, PADDED, text.norm_full("s")) == [s.strip().lower() for s in PADDED]


def test_unquoted_strips_before_removing_quotes(spark):
    rows = ["' a", "Don't \"Stop\"", None]
    assert values(spark, rows, text.norm_unquoted("s")) == [" a", "dont stop", None]


def test_sql_normaliser_trims_plain_spaces_only(spark):
    assert values(spark, ["\t x", "  X "], text.norm_sql("s")) == ["\t x", "x"]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aZ \t 　'\"éß&-1", max_size=8), min_size=1, max_size=40))
def test_normalisers_match_python(spark, rows):
    assert values(spark, rows, text.norm_full("s")) == [s.strip().lower() for s in rows]
    want = [s.lower().strip().replace("'", "").replace('"', "") for s in rows]
    assert values(spark, rows, text.norm_unquoted("s")) == want


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abZ &-'1é日", max_size=10), min_size=1, max_size=40))
def test_title_case_matches_python(spark, rows):
    assert values(spark, rows, text.title_case("s")) == [s.title() for s in rows]


def test_title_case_of_genres(spark):
    assert values(spark, ["r&b", "k-pop", "", "hip hop"], text.title_case("s")) == ["R&B", "K-Pop", "", "Hip Hop"]


def test_composite_key_is_null_safe(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "t string, a string")
    assert [r[0] for r in df.select(text.composite_key("t", "a")).collect()] == ["a|||b", None, None]


def test_genre_tokens(spark):
    row = ["r&b, k-pop,,R&B"]
    assert values(spark, row, text.genre_tokens("s")) == [["r&b", "k-pop", "", "R&B"]]
    assert values(spark, row, text.genre_tokens_folded("s")) == [["r&b", "k-pop", "r&b"]]
    assert values(spark, [" pop , rock", None], text.primary_genre("s")) == ["pop", "Unknown"]


def test_labels(spark):
    df = spark.createDataFrame([("T", None)], "t string, a string")
    assert df.select(text.pair_label("t", "a")).first()[0] == "T — "
    assert values(spark, ["x" * 20, "x" * 21], text.shorten("s")) == ["x" * 20, "x" * 20 + "..."]
    assert values(spark, ["energy_roll"], text.drop_suffix("s", "_roll")) == ["energy"]
    df = spark.createDataFrame([(2001, 0.4371)], "y int, v double")
    assert df.select(text.feature_at_year("y", "v")).first()[0] == "2001 (0.437)"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_timestamps_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = ["2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "2024-03-10 02:30:00", "2024-01-01T01:00:00+02:00", "garbage", None]
        want = [
            dt.datetime(2024, 11, 3, 5, 30),
            dt.datetime(2024, 11, 3, 6, 30),
            dt.datetime(2024, 3, 10, 2, 30),
            dt.datetime(2023, 12, 31, 23, 0),
            None,
            None,
        ]
        assert values(spark, rows, temporal.parse_utc("s")) == want
        df = spark.createDataFrame([(r,) for r in rows], "s string").select(temporal.parse_utc("s").alias("t"))
        back = df.withColumn("i", temporal.instant("t"))
        assert [r[0] for r in back.select(temporal.to_utc("i")).collect()] == want
        assert [r[0] for r in df.select(temporal.weekday_name("t")).collect()][:3] == ["Sunday"] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_timestamp_fails(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert values(spark, ["2024-01-01T00:00:00Z", None], temporal.parse_utc_strict("s"))[1] is None
        with pytest.raises(Exception, match="not a timestamp"):
            values(spark, ["garbage"], temporal.parse_utc_strict("s"))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-02-29 23:59:59' as ts")
    r = temporal.with_calendar(df).first()
    assert (r.year, r.month, r.day, r.weekday, r.hour) == (2024, 2, 29, "Thursday", 23)
    r = df.select(
        temporal.weekday_number("ts").alias("n"), temporal.weekday_short("weekday(ts)").alias("s"), temporal.month_start("ts").alias("m")
    ).first()
    assert (r.n, r.s, r.m) == (3, "Thu", dt.date(2024, 2, 1))


def test_seasons(spark):
    got = values(spark, list(range(1, 13)), temporal.season("s"), "s int")
    assert got == ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["autumn"] * 3 + ["winter"]


def test_release_dates(spark):
    rows = [("1999-05-07", "day"), ("1999-05", "month"), ("1999", "year"), ("0000", "year"), ("x", "day"), (None, "day"), ("1999", None)]
    df = spark.createDataFrame(rows, "d string, p string")
    got = [r[0] for r in df.select(temporal.release_date("d", "p")).collect()]
    assert got[:3] == [dt.date(1999, 5, 7), dt.date(1999, 5, 1), dt.date(1999, 1, 1)]
    assert got[3:] == [None] * 4
    assert [r[0] for r in df.select(temporal.release_year("d")).collect()][:3] == [1999] * 3


def test_coercions(spark):
    rows = ["1.5", "x", None, ""]
    assert values(spark, rows, numbers.number_or_null("s")) == [1.5, None, None, None]
    assert values(spark, rows, numbers.number_or_zero("s")) == [1.5, 0.0, 0.0, 0.0]
    assert values(spark, ["a", " ", "", None], numbers.is_present("s")) == [True, False, False, False]
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(numbers.any_present("a", "b")).collect()] == [True, False]
    df = spark.createDataFrame([(1, 4), (1, 0)], "a long, b long")
    assert [r[0] for r in df.select(numbers.percent("a", "b")).collect()] == [25.0, None]
    assert values(spark, [90000], numbers.minutes("s"), "s long") == [1.5]
    assert values(spark, [5400000], numbers.hours("s"), "s long") == [1.5]


def test_media_by_episode_fields(spark):
    df = spark.createDataFrame(
        [("", None, ""), (None, None, None), ("E", None, None), (None, None, "spotify:episode:1")],
        "episode_name string, episode_show_name string, spotify_episode_uri string",
    )
    assert [r[0] for r in df.select(media.by_episode_fields()).collect()] == ["song", "song", "podcast", "podcast"]


def test_media_inference_and_labels(spark):
    df = spark.createDataFrame([("spotify:episode:1",), ("spotify:track:1",), (None,)], "track_uri string")
    assert [r.media for r in media.with_media(df).collect()] == ["podcast", "song", "song"]
    df = spark.createDataFrame([("True",), ("False",), ("yes",), (None,)], "is_podcast string")
    assert [r.media for r in media.with_media(df).collect()] == ["podcast", "song", "podcast", "song"]
    df = spark.createDataFrame([("Podcast",), ("song",), ("video",)], "type string")
    assert [r.media for r in media.with_media(df).collect()] == ["podcast", "song", "unknown"]
    df = spark.createDataFrame([(1,)], "x int")
    assert media.with_media(df).first().media == "song"
