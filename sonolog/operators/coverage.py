"""How much of the history each metadata source covers.

Plays are first counted per raw pair, so the joins work on unique pairs and a pair that makes
up much of the history weighs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..schemas import KEYS, PAIR
from .catalog import keyed_catalog
from .cleaning import with_keys
from .metadata import dedup

# The four features that tell a catalogue match.
SIGNAL_FEATURES = ["acousticness", "danceability", "energy", "valence"]
# Fixed value: share of the summed source rows the published estimate keeps.
OVERLAP_FACTOR = 0.9


def pair_counts(plays: DataFrame) -> DataFrame:
    """Plays per raw pair, NULL pairs included."""
    return plays.groupBy(*PAIR).agg(F.expr("count(1) as plays"))


def pair_flags(plays: DataFrame, catalog: DataFrame, meta: DataFrame) -> DataFrame:
    """Raw pairs with their play count and whether each source has metadata for them."""
    cat = (
        keyed_catalog(catalog)
        .where(numbers.any_present(*[c for c in SIGNAL_FEATURES if c in catalog.columns]))
        .selectExpr(*KEYS, "true as __cat")
    )
    api = (
        dedup(meta.select(*PAIR, "spotify_id"))
        .where("spotify_id is not null")
        .selectExpr(*KEYS, "true as __api")
    )
    flagged = with_keys(pair_counts(plays), "unquoted", no_nulls=True).join(cat, KEYS, "left").drop(*KEYS)
    flagged = with_keys(flagged, "sql", no_nulls=True).join(api, KEYS, "left")
    return flagged.selectExpr(
        *PAIR,
        "plays",
        "coalesce(__cat, false) as has_catalog",
        "coalesce(__api, false) as has_api",
        f"{PAIR[0]} is not null and {PAIR[1]} is not null as is_pair",
    )


def totals(flags: DataFrame) -> DataFrame:
    """One row with every count the coverage reports need."""
    return flags.agg(
        F.expr("coalesce(sum(plays), 0) as total_records"),
        F.expr("count_if(is_pair) as total_unique"),
        F.expr("coalesce(sum(if(has_catalog, plays, 0)), 0) as catalog_records"),
        F.expr("count_if(has_catalog) as catalog_unique"),
        F.expr("coalesce(sum(if(has_api, plays, 0)), 0) as api_records"),
        F.expr("count_if(has_api) as api_unique"),
        F.expr("count_if(has_catalog and has_api) as overlap_unique"),
        F.expr("count_if(has_catalog or has_api) as union_unique"),
        F.expr("coalesce(sum(if(has_catalog or has_api, plays, 0)), 0) as union_records"),
    )


def by_source(one: DataFrame) -> DataFrame:
    """A row per source: covered records and unique pairs with percentages."""
    sources = """stack(2, 'catalog', catalog_records, catalog_unique, 'api', api_records, api_unique)
        as (source, records, unique_tracks)"""
    return one.selectExpr("total_records", "total_unique", sources).select(
        "source",
        "records",
        numbers.percent("records", "total_records").alias("record_pct"),
        "unique_tracks",
        numbers.percent("unique_tracks", "total_unique").alias("unique_pct"),
    )


def combined(one: DataFrame) -> DataFrame:
    """Overlap and union of the sources; records exactly and by the published estimate."""
    estimate = f"((catalog_records + api_records) * {OVERLAP_FACTOR}D)"
    return one.select(
        F.col("overlap_unique").alias("overlap"),
        F.col("union_unique").alias("combined_unique"),
        numbers.percent("union_unique", "total_unique").alias("combined_unique_pct"),
        F.col("union_records").alias("combined_records"),
        numbers.percent("union_records", "total_records").alias("combined_record_pct"),
        F.expr(f"round({estimate}, 3) as estimated_records"),
        F.expr(f"round(try_divide(100D * {estimate}, total_records), 6) as estimated_record_pct"),
    )


def remaining(one: DataFrame) -> DataFrame:
    """Unique pairs without metadata from any source."""
    left = "total_unique - catalog_unique - api_unique + overlap_unique"
    return one.select(
        "total_unique",
        F.col("union_unique").alias("covered_unique"),
        F.expr(f"{left} as remaining"),
        numbers.percent(left, "total_unique").alias("remaining_pct"),
    )


def covered_pairs(flags: DataFrame, source: str) -> DataFrame:
    """The pairs a source covers, as a set for ``intersect`` and ``union``."""
    return flags.where(F.col(source)).select(*PAIR)


def fields(enriched: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Per column: non-NULL rows and their percentage; one pass over the table.

    ``weight`` names a column with the number of plays a row stands for.
    """
    w = weight or "1"
    one = enriched.agg(
        F.expr(f"coalesce(sum({w}), 0) as total"),
        *[F.expr(f"coalesce(sum(if({c} is null, 0, {w})), 0) as {c}") for c in columns],
    )
    return one.unpivot("total", columns, "field", "non_null").select(
        "field", "non_null", numbers.percent("non_null", "total").alias("pct")
    )
