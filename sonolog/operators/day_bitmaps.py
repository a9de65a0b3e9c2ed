"""Exact distinct counts over any range of days, without the plays.

Tracks, artists and (track, artist) pairs get dense numbers from a dictionary. For each day a bitmap of each kind says which numbers were
played; bitmaps of several days are combined by OR, and their bits are the distinct values. A day's bitmaps do not
depend on other days, so days can be added or computed again, and a dictionary grows at its end.

A bitmap is kept in parts of 32,768 numbers, of which only those with a bit exist. NULL names are in no bitmap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..schemas import ARTIST, PAIR, TRACK
from .numbering import number_rows

KINDS = ["track", "artist", "pair"]
PART_BITS = 32_768
_KIND_ROWS = f"""stack(3, 'track', {TRACK}, cast(null as string), 'artist', cast(null as string), {ARTIST},
    'pair', {TRACK}, {ARTIST}) as (kind, track, artist)"""
_NO_NULLS = """(kind = 'artist' or track is not null) and (kind = 'track' or artist is not null)"""
_NAME = "to_json(struct(kind, track, artist))"


def _values(pairs: DataFrame, *also: str) -> DataFrame:
    """A row per kind for (track, artist) rows, without NULL names."""
    return pairs.selectExpr(*also, _KIND_ROWS).where(_NO_NULLS)


def dictionary(plays: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``kind, track, artist, id``: a number from 0 on for every value of a kind; ``known`` ones keep theirs.

    Store it: the numbers of new values follow the largest known one.
    """
    columns = ["kind", "track", "artist"]
    values = _values(plays.select(*PAIR).distinct()).distinct()
    if known is None:
        parts = [number_rows(values.where(F.col("kind") == k), _NAME, "id") for k in KINDS]
    else:
        same = [F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns]
        new = values.alias("v").join(known.alias("k"), same, "left_anti")
        first = {r["kind"]: r["n"] for r in known.groupBy("kind").agg((F.max("id") + 1).alias("n")).collect()}
        parts = [
            number_rows(new.where(F.col("kind") == k), _NAME, "id").withColumn("id", F.col("id") + first.get(k, 0)) for k in KINDS
        ]
    made = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return made if known is None else known.select(*made.columns).unionAll(made)


def daily_bitmaps(plays: DataFrame, ids: DataFrame, ts: str = "ts") -> DataFrame:
    """``day, kind, part, bits``; plays are counted per day and pair before they meet the dictionary."""
    days = plays.select(F.to_date(ts).alias("day"), *PAIR).where("day is not null").distinct()
    named = _values(days, "day").distinct().withColumn("name", F.expr(_NAME)).select("day", "kind", "name")
    keyed = named.join(ids.selectExpr(f"{_NAME} as name", "id"), "name")
    placed = keyed.selectExpr("day", "kind", f"id div {PART_BITS} as part", f"id % {PART_BITS} as place")
    return placed.groupBy("day", "kind", "part").agg(F.bitmap_construct_agg("place").alias("bits"))


def daily_sums(plays: DataFrame, ts: str = "ts") -> DataFrame:
    """``day, plays, ms`` of every day."""
    by = plays.select(F.to_date(ts).alias("day"), "ms_played").where("day is not null").groupBy("day")
    return by.agg(F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms"))


def range_summary(bitmaps: DataFrame, sums: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Plays, minutes, days and distinct tracks, artists and pairs of the days from ``start`` to ``end``, both included."""
    inside = [F.col("day") >= F.lit(start).cast("date")] if start else []
    inside += [F.col("day") <= F.lit(end).cast("date")] if end else []
    for test in inside:
        bitmaps, sums = bitmaps.where(test), sums.where(test)
    parts = bitmaps.groupBy("kind", "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    counts = [F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"{k}s") for k in KINDS]
    none = {name: F.lit(None).cast("bigint") for name in ("plays", "ms", "days")}
    distinct = parts.agg(*counts).withColumns(none)
    totals = sums.agg(F.sum("plays").alias("plays"), F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("days"))
    totals = totals.withColumns({f"{k}s": F.lit(None).cast("bigint") for k in KINDS})
    # Two rows of which each knows a part.
    one = distinct.unionByName(totals).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in totals.columns])
    return one.select("plays", numbers.minutes("ms").alias("minutes"), "days", *[f"{k}s" for k in KINDS])
