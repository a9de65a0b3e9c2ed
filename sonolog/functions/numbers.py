"""Units, coercions and percentages; arguments are SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums of integers, zero for no rows.
SUM_MS = "coalesce(sum(ms_played), 0)"


def minutes(ms: str) -> Column:
    """Milliseconds -> minutes as double; sum the integers first, divide once."""
    return F.expr(f"{ms} / 60000")


def hours(ms: str) -> Column:
    return F.expr(f"{ms} / 3600000")


def number_or_null(e: str) -> Column:
    return F.expr(f"try_cast({e} as double)")


def number_or_zero(e: str) -> Column:
    return F.expr(f"coalesce(try_cast({e} as double), 0D)")


def percent(part: str, whole: str) -> Column:
    """``100 * part / whole``; NULL on an empty whole."""
    return F.expr(f"try_divide(({part}) * 100D, {whole})")


def legacy_hours(ms: str) -> Column:
    """Minutes rounded to 2 digits (half-even) and only then divided by 60."""
    return F.expr(f"bround({ms} / 60000, 2) / 60")


def is_present(e: str) -> Column:
    """Non-NULL and non-blank."""
    return F.expr(f"coalesce(trim(cast({e} as string)) <> '', false)")


def any_present(*columns: str) -> Column:
    """At least one of the columns is non-NULL."""
    return F.expr(" or ".join(f"{c} is not null" for c in columns))
