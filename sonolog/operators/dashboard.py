"""Aggregates behind the dashboards, on cleaned plays or on the canonical view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, temporal, text
from ..functions.numbers import SUM_MS
from ..functions.temporal import WEEKDAYS

ROLLING_DAYS = 30
ROLLING_MIN = 7


def kpis(plays: DataFrame, track: str, artist: str, ts: str = "ts") -> DataFrame:
    """Total minutes, listening days and distinct (track, artist) pairs, out of counted days and pairs."""
    counted = plays.groupBy(F.expr(f"to_date({ts}) as day"), track, artist).agg(F.expr(f"{SUM_MS} as ms"))
    days = counted.groupBy("day").agg(F.expr("sum(ms) as ms")).agg(
        F.expr("sum(ms) as ms"), F.expr("count(day) as days"), F.expr("0L as pairs")
    )
    pairs = counted.where(f"{track} is not null and {artist} is not null").select(track, artist).distinct().agg(
        F.expr("cast(null as bigint) as ms"), F.expr("0L as days"), F.expr("count(1) as pairs")
    )
    return days.unionAll(pairs).agg(
        numbers.minutes("coalesce(sum(ms), 0)").alias("total_minutes"),
        F.expr("sum(days) as listening_days"),
        F.expr("sum(pairs) as unique_tracks"),
    )


def daily_minutes(plays: DataFrame, ts: str = "ts") -> DataFrame:
    by = plays.groupBy(F.expr(f"to_date({ts}) as day")).agg(F.expr(f"{SUM_MS} as ms"))
    return by.select("day", numbers.minutes("ms").alias("minutes"))


def monthly_minutes(plays: DataFrame, ts: str = "ts") -> DataFrame:
    by = plays.groupBy(temporal.month_start(ts).alias("month")).agg(F.expr(f"{SUM_MS} as ms"))
    return by.select("month", numbers.minutes("ms").alias("minutes"))


def heatmap_sparse(plays: DataFrame, ts: str = "ts") -> DataFrame:
    """Minutes per weekday and hour that occur."""
    groups = plays.groupBy(F.expr(f"weekday({ts}) as dow"), F.expr(f"hour({ts}) as hour"))
    by = groups.agg(F.expr(f"{SUM_MS} as ms"))
    return by.select(
        "dow", temporal.weekday_short("dow").alias("weekday"), "hour", numbers.minutes("ms").alias("minutes")
    )


def heatmap_dense(plays: DataFrame, ts: str = "ts") -> DataFrame:
    """Minutes per weekday and hour with zeros: all seven weekdays for every hour that occurs.

    One conditional sum per weekday and hour row gives the full grid in a single aggregation.
    """
    sums = [
        F.expr(f"coalesce(sum(if(weekday({ts}) = {i}, ms_played, 0)), 0) as {name}") for i, name in enumerate(WEEKDAYS)
    ]
    wide = plays.where(f"{ts} is not null").groupBy(F.expr(f"hour({ts}) as hour")).agg(*sums)
    grid = ", ".join(f"{i}, '{name}', {name}" for i, name in enumerate(WEEKDAYS))
    return wide.selectExpr("hour", f"stack(7, {grid}) as (dow, weekday, ms)").select(
        "dow", "weekday", "hour", numbers.minutes("ms").alias("minutes")
    )


def monthly_by_top_genre(by_month: DataFrame, n: int = 8) -> DataFrame:
    """Minutes per month and genre for the ``n`` genres with most minutes overall.

    ``by_month`` has ``month, genre, ms``. The list of top genres has at most ``n`` rows.
    """
    top = (
        by_month.groupBy("genre")
        .agg(F.expr("sum(ms) as total"))
        .orderBy(F.desc("total"), "genre")
        .limit(n)
        .select("genre")
    )
    return by_month.join(F.broadcast(top), "genre", "left_semi").select(
        "month", "genre", numbers.minutes("ms").alias("minutes")
    )


def rolling(daily: DataFrame, features: list[str], by: str = "rows") -> DataFrame:
    """Trailing mean of daily feature means, long form ``day, feature, value``.

    ``rows`` looks back over 30 listening days, ``days`` over 30 calendar days; below 7 days
    with a value the result is NULL. The windows run over one row per day and feature, a
    number set by the calendar and not by the number of plays.
    """
    frames = {
        "rows": f"order by day rows between {ROLLING_DAYS - 1} preceding and current row",
        "days": f"order by unix_date(day) range between {ROLLING_DAYS - 1} preceding and current row",
    }
    if by not in frames:
        raise ValueError(f"unknown window {by!r}")
    wide = daily.selectExpr("day", *[f"{f} as {f}_roll" for f in features])
    long = wide.unpivot("day", [f + "_roll" for f in features], "feature", "mean")
    long = long.select("day", text.drop_suffix("feature", "_roll").alias("feature"), "mean")
    over = f"over (partition by feature {frames[by]})"
    value = f"if(count(mean) {over} >= {ROLLING_MIN}, round(avg(mean) {over}, 6), null)"
    return long.selectExpr("day", "feature", f"{value} as value")


def genre_options(canonical: DataFrame, limit: int | None = None) -> DataFrame:
    """Sorted distinct genres to choose from, the first ``limit`` of them if given."""
    known = canonical.where("genre_std not in ('', 'nan')").select("genre_std").distinct()
    known = known.orderBy("genre_std")
    return known if limit is None else known.limit(limit)
