"""Timestamps, calendar fields and partial dates; arguments are SQL expressions.

Everything ends as ``timestamp_ntz`` in UTC, so results do not depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English weekday names in ISO order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAYS_SHORT = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def _names(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def to_utc_sql(ts: str) -> str:
    return f"timestampadd(MICROSECOND, unix_micros({ts}), timestamp_ntz'1970-01-01')"


def to_utc(ts: str) -> Column:
    """Instant -> zone-free UTC timestamp.

    Counted from the epoch, because a way through local time is ambiguous when clocks go back.
    """
    return F.expr(to_utc_sql(ts))


def epoch_micros_sql(utc: str) -> str:
    minute = f"(unix_date(to_date({utc})) * 1440L + hour({utc}) * 60 + minute({utc}))"
    return f"({minute} * 60000000 + cast(extract(SECOND FROM {utc}) * 1000000 as bigint))"


def instant(utc: str) -> Column:
    """Zone-free UTC timestamp -> instant, the type event-time operators ask for."""
    return F.expr(f"timestamp_micros({epoch_micros_sql(utc)})")


def parse_utc(e: str) -> Column:
    """ISO text -> UTC timestamp; text that is no timestamp becomes NULL.

    Text without an offset is already UTC by definition of the export.
    """
    zoned = rf"trim({e}) rlike ':.*(Z|[+-]\\d{{2}}:?\\d{{2}})$'"
    return F.expr(f"if({zoned}, {to_utc_sql(f'try_to_timestamp(trim({e}))')}, try_cast(trim({e}) as timestamp_ntz))")


def parse_utc_strict(e: str) -> Column:
    """As ``parse_utc`` but a bad value fails the job, with or without ANSI mode."""
    bad = F.expr(f"if({e} is null, null, cast(raise_error(concat('not a timestamp: ', {e})) as timestamp_ntz))")
    return F.coalesce(parse_utc(e), bad)


def weekday_number(ts: str) -> Column:
    """Monday = 0."""
    return F.expr(f"weekday({ts})")


def weekday_name(ts: str) -> Column:
    return F.expr(f"element_at({_names(WEEKDAYS)}, weekday({ts}) + 1)")


def weekday_short(number: str) -> Column:
    return F.expr(f"element_at({_names(WEEKDAYS_SHORT)}, {number} + 1)")


def month_start(ts: str) -> Column:
    return F.expr(f"trunc(to_date({ts}), 'month')")


def season(month: str) -> Column:
    """Season of the northern hemisphere; December to February is winter."""
    return F.expr(f"element_at(array('winter', 'spring', 'summer', 'autumn'), cast({month} % 12 div 3 as int) + 1)")


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add year, month, day, weekday, hour."""
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "weekday": weekday_name(ts),
            "hour": F.hour(ts),
        }
    )


def release_date(text: str, precision: str) -> Column:
    """Partial date + precision -> first day it can mean; unusable text and year 0000 -> NULL."""
    return F.expr(
        f"""try_cast(case when left({text}, 4) = '0000' then null when {precision} = 'day' then {text}
            when {precision} = 'month' then concat({text}, '-01')
            when {precision} = 'year' then concat({text}, '-01-01') end as date)"""
    )


def release_year(text: str) -> Column:
    return F.expr(f"nullif(try_cast(left({text}, 4) as int), 0)")
