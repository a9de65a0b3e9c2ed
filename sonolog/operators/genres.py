"""Genre counts, shares and their change over the years.

Plays are counted per pair before the genre lists are attached and exploded. A play counts
once for each of its genres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.numbers import SUM_MS
from ..schemas import KEYS, PAIR
from .cleaning import with_keys
from .metadata import dedup


def rollup_genres(plays: DataFrame, meta: DataFrame, period: list[str] | None = None) -> DataFrame:
    """Plays, milliseconds and first play per period and raw pair, with the key's ``api_genres``."""
    counted = plays.groupBy(*(period or []), *PAIR).agg(
        F.expr("count(1) as n"), F.expr(f"{SUM_MS} as ms"), F.expr("min(ts) as first_ts")
    )
    keyed = with_keys(counted, "sql", no_nulls=True).drop(*PAIR)
    return keyed.join(dedup(meta).select(*KEYS, "api_genres"), KEYS, "left")


def play_counts(rolled: DataFrame, period: list[str] | None = None) -> DataFrame:
    """Plays per genre token, case kept; keys without a genre list do not count."""
    period = period or []
    tokens = rolled.where("api_genres is not null").select(
        *period, "n", F.explode(text.genre_tokens("api_genres")).alias("genre")
    )
    return tokens.groupBy(*period, "genre").agg(F.expr("sum(n) as plays"))


def top_genres(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` genres with most plays overall."""
    total = counts.groupBy("genre").agg(F.expr("sum(plays) as plays"))
    return total.orderBy(F.desc("plays"), "genre").limit(n)


def by_year_top(counts: DataFrame, n: int = 5) -> DataFrame:
    """Plays per year of the top genres, long form; at most ``n`` genres are broadcast."""
    top = top_genres(counts, n).select("genre")
    return counts.join(F.broadcast(top), "genre", "left_semi").where("plays > 0")


def by_year_matrix(counts: DataFrame, genres: list[str]) -> DataFrame:
    """Year x genre table for the named genres, zero where a genre was not played."""
    kept = counts.where(F.col("genre").isin(genres))
    return kept.groupBy("year").pivot("genre", genres).agg(F.sum("plays")).fillna(0, genres)


def by_year_wide(counts: DataFrame, n: int = 5) -> DataFrame:
    """Year x the ``n`` genres with most plays overall: ``genre_1, plays_1``, ..., the most played first.

    Zero where a genre was not played; years without any of them are left out.
    """
    best = top_genres(counts, n).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("plays")).alias("less"), "genre")))["genre"].alias("names")
    )
    ranked = counts.withColumn("names", best.scalar())
    placed = ranked.withColumn("rank", F.array_position("names", F.col("genre"))).where("rank > 0")
    columns = []
    for i in range(1, n + 1):
        columns.append(F.first(F.get("names", F.lit(i - 1))).alias(f"genre_{i}"))
        columns.append(F.sum(F.when(F.col("rank") == i, F.col("plays")).otherwise(0)).alias(f"plays_{i}"))
    return placed.groupBy("year").agg(*columns)


def minutes(rolled: DataFrame) -> DataFrame:
    """Minutes per Title Case genre, blanks dropped.

    Tokens are grouped in lower case and only the groups are title-cased, then grouped again
    because two spellings can share a title.
    """
    tokens = rolled.select("ms", F.explode(text.genre_tokens_folded("api_genres")).alias("folded"))
    folded = tokens.groupBy("folded").agg(F.expr("sum(ms) as ms"))
    titled = folded.groupBy(text.title_case("folded").alias("genre")).agg(F.expr("sum(ms) as ms"))
    return titled.select("genre", numbers.minutes("ms").alias("minutes"))
