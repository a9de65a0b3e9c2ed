"""Matching plays against an external audio-feature catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..schemas import CATALOG_FIELDS, KEYS
from .cleaning import unique_pairs, with_keys
from .lookup import left_lookup


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by an explicit source order; NULL keys are left out.

    Spark cuts each map task's output to one row per key before the shuffle, so a key that
    occurs very often costs no more than any other.
    """
    rank = f"row_number() over (partition by {', '.join(keys)} order by {', '.join(order)}) as __rn"
    return df.dropna(subset=keys).selectExpr("*", rank).where("__rn = 1").drop("__rn")


def keyed_catalog(catalog: DataFrame, normaliser: str = "unquoted", order: list[str] | None = None) -> DataFrame:
    """Catalogue with one row per normalised key, the first occurrence."""
    keyed = with_keys(catalog, normaliser, "track_name", "artist_name")
    return keep_first(keyed, KEYS, order or ["src_order"])


def match_pairs(plays: DataFrame, catalog: DataFrame, normaliser: str = "unquoted") -> DataFrame:
    """Every unique raw pair of the plays with its catalogue row, if it has one, and ``matched``."""
    pairs = with_keys(unique_pairs(plays), normaliser, no_nulls=True)
    firsts = keyed_catalog(catalog, normaliser).selectExpr("*", "true as __hit")
    out = pairs.join(firsts, KEYS, "left").selectExpr("*", "coalesce(__hit, false) as matched")
    return out.drop(*KEYS, "__hit")


def match_rate(matches: DataFrame) -> DataFrame:
    """Unique pairs, matched pairs, percentage."""
    return matches.agg(
        F.expr("count(1) as unique_pairs"),
        F.expr("count_if(matched) as matched_pairs"),
    ).withColumn("matched_pct", numbers.percent("matched_pairs", "unique_pairs"))


def catalog_columns(catalog: DataFrame) -> list[str]:
    """The catalogue's metadata fields that are there, in the fixed output order."""
    return [c for c in CATALOG_FIELDS if c in catalog.columns]


def attach_catalog(
    plays: DataFrame, catalog: DataFrame, normaliser: str = "unquoted", strategy: str = "auto"
) -> DataFrame:
    """All plays with the catalogue's fields; plays without a match keep NULLs.

    The reference matches unique raw pairs and joins them back on the raw pair; joining the
    plays on the normalised key gives the same rows with one join less.
    """
    fields = catalog_columns(catalog)
    firsts = keyed_catalog(catalog, normaliser).select(*KEYS, *fields)
    overlap = {f: f + "_k" for f in fields if f in plays.columns}
    firsts = firsts.withColumnsRenamed(overlap)
    held = {k: f"__own_{k}" for k in KEYS if k in plays.columns}
    joined = left_lookup(with_keys(plays.withColumnsRenamed(held), normaliser), firsts, KEYS, strategy)
    return joined.drop(*KEYS).withColumnsRenamed({v: k for k, v in held.items()})


def value_counts(df: DataFrame, column: str, n: int = 10, weight: str | None = None) -> DataFrame:
    """The ``n`` most frequent non-NULL values; ties in value order.

    ``weight`` names a column with the number of plays a row stands for.
    """
    return (
        df.dropna(subset=[column])
        .groupBy(column)
        .agg(F.expr(f"sum({weight or 1}) as plays"))
        .orderBy(F.desc("plays"), column)
        .limit(n)
    )
