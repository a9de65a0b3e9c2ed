"""Seasons, discovery, loyalty, diversity, popularity and mood.

First plays and gaps come from aggregates per key, which combine before the shuffle, instead
of windows that would sort all plays of a key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, temporal
from ..functions.numbers import SUM_MS
from ..schemas import ARTIST, KEYS, PAIR
from .cleaning import with_keys
from .metadata import dedup


def season_stats(plays: DataFrame) -> DataFrame:
    """Hours and plays per season."""
    by = plays.groupBy(temporal.season("month").alias("season")).agg(
        F.expr(f"{SUM_MS} as ms"), F.expr("count(1) as plays")
    )
    return by.select("season", numbers.hours("ms").alias("hours"), "plays")


def season_top_genre(counts: DataFrame) -> DataFrame:
    """The genre with most plays in each season; ``counts`` has ``month, genre, plays``."""
    by = counts.groupBy(temporal.season("month").alias("season"), "genre").agg(F.expr("sum(plays) as plays"))
    rank = "row_number() over (partition by season order by plays desc, genre) as rk"
    return by.selectExpr("*", rank).where("rk = 1").drop("rk")


def volume_delta(volume: DataFrame, period: str, measure: str) -> DataFrame:
    """Volume per period and the change against the period listened to before it.

    The window runs over one row per period.
    """
    return volume.selectExpr(period, measure, f"{measure} - lag({measure}) over (order by {period}) as delta")


def genre_diversity(counts: DataFrame) -> DataFrame:
    """Distinct genres and Shannon entropy (nats) per year; ``counts`` has ``year, genre, plays``."""
    return counts.groupBy("year").agg(
        F.expr("count(1) as genres"),
        F.expr("abs(round(ln(sum(plays)) - sum(plays * ln(plays)) / sum(plays), 6)) as entropy"),
    )


def genre_discovery(rolled: DataFrame, tokens: Column) -> DataFrame:
    """Date of the first play of each genre."""
    exploded = rolled.where("api_genres is not null").select("first_ts", F.explode(tokens).alias("genre"))
    return exploded.groupBy("genre").agg(F.expr("to_date(min(first_ts)) as first_day"))


def new_per_year(first_days: DataFrame) -> DataFrame:
    """Genres first played in each year."""
    return first_days.groupBy(F.expr("year(first_day) as year")).agg(F.expr("count(1) as new_genres"))


def artist_loyalty(plays: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most played artists: share of all plays with an artist, and months active."""
    monthly = (
        plays.dropna(subset=[ARTIST])
        .groupBy(ARTIST, temporal.month_start("ts").alias("month"))
        .agg(F.expr("count(1) as plays"))
    )
    total = monthly.agg(F.expr("sum(plays)")).scalar()
    by = monthly.groupBy(ARTIST).agg(F.expr("sum(plays) as plays"), F.expr("count(1) as active_months"))
    best = by.orderBy(F.desc("plays"), ARTIST).limit(n)
    share = F.try_divide(F.col("plays") * F.lit(100.0), total)
    return best.select(ARTIST, "plays", "active_months", share.alias("share_pct"))


def first_plays(plays: DataFrame, keys: list[str]) -> DataFrame:
    """Plays per month and how many of them are the first of their key.

    A key has exactly one first play, in the first month it occurs in. The window runs over the
    monthly counts, so a key brings one row per month and not one per play.
    """
    monthly = (
        plays.dropna(subset=keys)
        .groupBy(*keys, temporal.month_start("ts").alias("month"))
        .agg(F.expr("count(1) as n"))
    )
    first = f"min(month) over (partition by {', '.join(keys)}) as first_month"
    by = monthly.selectExpr("month", "n", first).groupBy("month").agg(
        F.expr("sum(n) as plays"), F.expr("count_if(month = first_month) as new_plays")
    )
    return by.select(
        "month",
        "plays",
        "new_plays",
        F.expr("plays - new_plays as repeat_plays"),
        numbers.percent("new_plays", "plays").alias("new_pct"),
    )


def repeat_gaps(plays: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most repeated pairs with the mean gap between plays in hours.

    The gaps of consecutive plays add up to last minus first.
    """
    by = plays.dropna(subset=PAIR).groupBy(*PAIR).agg(
        F.expr("count(1) as plays"), F.expr("min(ts) as first"), F.expr("max(ts) as last")
    )
    span = f"({temporal.epoch_micros_sql('last')} - {temporal.epoch_micros_sql('first')})"
    gap = f"round({span} / 3600000000 / (plays - 1), 6) as mean_gap_hours"
    return by.where("plays > 1").orderBy(F.desc("plays"), *PAIR).limit(n).selectExpr(*PAIR, "plays", gap)


def popularity_vs_plays(rolled: DataFrame) -> DataFrame:
    """Correlation of a key's popularity with how often it was played."""
    known = rolled.where("popularity is not null").groupBy(*KEYS, "popularity").agg(F.expr("sum(n) as n"))
    return known.agg(
        F.expr("count(1) as keys"),
        F.expr("round(corr(cast(n as double), cast(popularity as double)), 6) as correlation"),
    )


def popularity_band(popularity: str) -> Column:
    """Quarter of the 0 to 100 scale."""
    p = popularity
    return F.expr(
        f"""case when {p} < 25 then 'niche' when {p} < 50 then 'known' when {p} < 75 then 'popular'
            when {p} <= 100 then 'mainstream' end"""
    )


def pair_rollup(plays: DataFrame) -> DataFrame:
    """Plays and milliseconds per raw pair, under the normalised key; NULL keys are left out."""
    counted = plays.dropna(subset=PAIR).groupBy(*PAIR).agg(F.expr("count(1) as n"), F.expr(f"{SUM_MS} as ms"))
    return with_keys(counted, "sql", no_nulls=True)


def with_meta(plays: DataFrame, meta: DataFrame, columns: list[str]) -> DataFrame:
    """Counted pairs with columns of the stored metadata, covered pairs only."""
    return pair_rollup(plays).join(dedup(meta).select(*KEYS, *columns), KEYS)


def mainstream_bands(covered: DataFrame) -> DataFrame:
    """Plays and minutes per popularity band."""
    by = covered.groupBy(popularity_band("track_popularity").alias("band")).agg(
        F.expr("sum(n) as plays"), F.expr("sum(ms) as ms")
    )
    return by.select("band", "plays", numbers.minutes("ms").alias("minutes"))


def mood_correlation(rolled: DataFrame) -> DataFrame:
    """Correlation of valence and energy over the plays of each year.

    ``rolled`` counts plays, so the sums are weighted by ``n``; values are centred on 0.5,
    the middle of the scale, which keeps the sums of squares small.
    """
    s = (
        rolled.dropna(subset=["valence", "energy"])
        .selectExpr("year", "n", "valence - 0.5D as x", "energy - 0.5D as y")
        .groupBy("year")
        .agg(
            F.expr("sum(n) as plays"),
            F.expr("sum(n * x) as x"),
            F.expr("sum(n * y) as y"),
            F.expr("sum(n * x * x) as xx"),
            F.expr("sum(n * y * y) as yy"),
            F.expr("sum(n * x * y) as xy"),
        )
    )
    cov = "(xy * plays - x * y)"
    var = "(xx * plays - x * x) * (yy * plays - y * y)"
    return s.selectExpr("year", "plays", f"round(try_divide({cov}, sqrt({var})), 6) as correlation")


def acoustic_trend(rolled: DataFrame) -> DataFrame:
    """Mean acousticness and the share of acoustic plays (above one half) per year."""
    return rolled.dropna(subset=["acousticness"]).groupBy("year").agg(
        F.expr("sum(n) as plays"),
        F.expr("round(sum(acousticness * n) / sum(n), 6) as mean_acousticness"),
        numbers.percent("sum(if(acousticness > 0.5D, n, 0))", "sum(n)").alias("acoustic_pct"),
    )


def release_year_plays(covered: DataFrame) -> DataFrame:
    """Plays, minutes and earliest release day per release year."""
    day = temporal.release_date("album_release_date", "album_release_date_precision")
    by = covered.groupBy(temporal.release_year("album_release_date").alias("release_year")).agg(
        F.expr("sum(n) as plays"), F.expr("sum(ms) as ms"), F.min(day).alias("first_release")
    )
    return by.select("release_year", "plays", numbers.minutes("ms").alias("minutes"), "first_release")


def validation(catalog: DataFrame) -> DataFrame:
    """Values out of range per rule: features in [0, 1], popularity 0 to 100, duration and tempo above 0."""
    columns = catalog.columns
    unit = ["danceability", "energy", "valence", "acousticness", "instrumentalness", "liveness", "speechiness"]
    rules = {f"{f}_range": f"{f} not between 0 and 1" for f in unit if f in columns}
    if "popularity" in columns:
        rules["popularity_range"] = "popularity not between 0 and 100"
    rules |= {f"{f}_positive": f"not ({f} > 0)" for f in ["duration_ms", "tempo"] if f in columns}
    one = catalog.agg(
        F.expr("count(1) as rows"), *[F.expr(f"count_if({broken}) as {name}") for name, broken in rules.items()]
    )
    return one.unpivot("rows", list(rules), "rule", "violations").select("rule", "rows", "violations")
