"""Listening volume over time, top lists and features by year.

Milliseconds are summed as integers and divided once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.numbers import SUM_MS
from ..schemas import ARTIST, KEYS, PAIR, TRACK
from .catalog import keyed_catalog
from .cleaning import with_keys

MOOD = ["danceability", "energy", "valence"]


def yearly(plays: DataFrame, legacy_rounding: bool = False) -> DataFrame:
    """Hours and plays with a track name, per year."""
    by = plays.groupBy("year").agg(F.expr(f"{SUM_MS} as ms"), F.expr(f"count({TRACK}) as total_plays"))
    hours = numbers.legacy_hours("ms") if legacy_rounding else numbers.hours("ms")
    return by.select("year", hours.alias("total_hours"), "total_plays")


def minutes_by(plays: DataFrame, *columns: str) -> DataFrame:
    """Minutes per group."""
    by = plays.groupBy(*columns).agg(F.expr(f"{SUM_MS} as ms"))
    return by.select(*columns, numbers.minutes("ms").alias("minutes"))


def peak(minutes: DataFrame, column: str) -> DataFrame:
    """The group with the most minutes; of equals the first."""
    return minutes.orderBy(F.desc("minutes"), column).limit(1)


def top_n(df: DataFrame, measure: str, keys: list[str], n: int, ascending_display: bool = False) -> DataFrame:
    """The ``n`` largest rows in a total order; optionally shown smallest first."""
    best = df.orderBy(F.desc(measure), *keys).limit(n)
    return best.orderBy(measure, *[F.desc(k) for k in keys]) if ascending_display else best


def artists(plays: DataFrame, null_label: str | None = None) -> DataFrame:
    """Minutes, hours and plays per artist; a missing artist is dropped or labelled."""
    df = plays.dropna(subset=[ARTIST]) if null_label is None else plays.fillna(null_label, [ARTIST])
    by = df.groupBy(ARTIST).agg(F.expr(f"{SUM_MS} as ms"), F.expr(f"count({TRACK}) as play_count"))
    return by.select(ARTIST, numbers.minutes("ms").alias("minutes"), numbers.hours("ms").alias("hours"), "play_count")


def tracks(plays: DataFrame, null_label: str | None = None) -> DataFrame:
    """The same per (track, artist), with the display label."""
    df = plays.dropna(subset=PAIR) if null_label is None else plays.fillna(null_label, PAIR)
    by = df.groupBy(*PAIR).agg(F.expr(f"{SUM_MS} as ms"), F.expr(f"count({TRACK}) as play_count"))
    return by.select(
        *PAIR,
        numbers.minutes("ms").alias("minutes"),
        numbers.hours("ms").alias("hours"),
        "play_count",
        text.pair_label(TRACK, ARTIST).alias("label"),
    )


def library_summary(plays: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, first and last year, hours, distinct tracks and artists (NULLs do not count).

    The plays are counted per pair first; tracks and artists are then counted out of the pairs, each on its own, so no
    play is repeated for the sake of a second distinct count.
    """
    if approximate:
        return plays.agg(
            F.expr("count(1) as records"),
            F.expr("min(year) as first_year"),
            F.expr("max(year) as last_year"),
            numbers.hours(SUM_MS).alias("total_hours"),
            F.expr(f"approx_count_distinct({TRACK}) as unique_tracks"),
            F.expr(f"approx_count_distinct({ARTIST}) as unique_artists"),
        )
    pairs = plays.groupBy(*PAIR).agg(
        F.expr("count(1) as n"), F.expr("min(year) as low"), F.expr("max(year) as high"), F.expr(f"{SUM_MS} as ms")
    )
    tracks = pairs.groupBy(TRACK).agg(
        F.expr("sum(n) as n"), F.expr("min(low) as low"), F.expr("max(high) as high"), F.expr("sum(ms) as ms")
    )
    one = tracks.agg(
        F.expr("coalesce(sum(n), 0L) as n"), F.expr("min(low) as low"), F.expr("max(high) as high"), F.expr("sum(ms) as ms"),
        F.expr(f"count({TRACK}) as tracks"), F.expr("0L as artists"),
    )
    two = pairs.select(ARTIST).groupBy(ARTIST).agg(F.expr("1 as x")).agg(
        F.expr("0L as n"), F.expr("cast(null as int) as low"), F.expr("cast(null as int) as high"),
        F.expr("cast(null as bigint) as ms"), F.expr("0L as tracks"), F.expr(f"count({ARTIST}) as artists"),
    )
    return one.unionAll(two).agg(
        F.expr("sum(n) as records"),
        F.expr("min(low) as first_year"),
        F.expr("max(high) as last_year"),
        numbers.hours("coalesce(sum(ms), 0)").alias("total_hours"),
        F.expr("sum(tracks) as unique_tracks"),
        F.expr("sum(artists) as unique_artists"),
    )


def rollup_features(plays: DataFrame, catalog: DataFrame, period: list[str], features: list[str]) -> DataFrame:
    """Plays per period and raw pair, under the normalised key, with the catalogue's features.

    Counting comes before the join: the catalogue meets one row per period and pair instead of
    one per play, names are normalised once per pair, and a pair with very many plays weighs no
    more than any other. ``n`` is the number of plays a row stands for.
    """
    counted = plays.groupBy(*period, *PAIR).agg(F.expr("count(1) as n"), F.expr(f"{SUM_MS} as ms"))
    counted = with_keys(counted, "unquoted", no_nulls=True).drop(*PAIR)
    firsts = keyed_catalog(catalog).select(*KEYS, *features)
    return counted.join(firsts, KEYS, "left")


def weighted_mean(column: str, digits: int | None = 6) -> Column:
    """Mean over plays out of counted rows; NULLs are skipped. No rounding with ``digits=None``."""
    mean = f"try_divide(sum({column} * n), sum(if({column} is null, null, n)))"
    return F.expr(f"{mean} as {column}" if digits is None else f"round({mean}, {digits}) as {column}")


def yearly_features(rolled: DataFrame, digits: int = 6) -> DataFrame:
    """Mean danceability, energy, valence and tempo per year over plays having the first three."""
    complete = rolled.dropna(subset=MOOD)
    return complete.groupBy("year").agg(
        F.expr("sum(n) as plays"), *[weighted_mean(f, digits) for f in [*MOOD, "tempo"]]
    )


def feature_extremes(per_year: DataFrame) -> DataFrame:
    """Per feature the years of the highest and the lowest mean, as text; of equals the earlier."""
    long = per_year.unpivot("year", MOOD, "feature", "value").dropna(subset=["value"])
    best = long.groupBy("feature").agg(
        F.expr("max(struct(value, -year as earlier)) as hi"), F.expr("min(struct(value, year)) as lo")
    )
    return best.select(
        text.title_case("feature").alias("feature"),
        text.feature_at_year("-hi.earlier", "hi.value").alias("highest_year"),
        text.feature_at_year("lo.year", "lo.value").alias("lowest_year"),
    )
