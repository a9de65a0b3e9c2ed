"""The whole flow, from stored inputs to enriched plays and reports, as one function.

``build`` only declares: every value is a lazy DataFrame. ``publish`` stores the tables that
are used more than once, each built from the stored one before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..operators import backlog, catalog, cleaning, coverage, dashboard, ledger, metadata, trends
from ..schemas import ARTIST, CATALOG, LEDGER, TRACK
from ..sources import readers, writers

# Published tables, the most complete first.
FINAL, API, CATALOGUE, CLEANED = "final", "api_enriched", "catalog_enriched", "cleaned"
PREFERENCE = [FINAL, API, CATALOGUE, CLEANED]


@dataclass(frozen=True)
class Inputs:
    """Where the inputs lie; ``metadata`` and ``ledger`` are Parquet tables."""

    history: str
    catalog: str
    metadata: str
    ledger: str


def build(spark: SparkSession, inputs: Inputs) -> dict[str, DataFrame]:
    """All tables and reports by name."""
    history = cleaning.combine(readers.read_history_json(spark, inputs.history))
    plays = cleaning.clean(history)
    source = readers.read_catalog(spark, inputs.catalog, CATALOG)
    order = readers.SOURCE_ORDER
    stored = spark.read.parquet(inputs.metadata)
    return tables_and_reports(plays, source, order, stored, spark.read.schema(LEDGER).parquet(inputs.ledger))


def tables_and_reports(
    plays: DataFrame, source: DataFrame, order: list[str], stored: DataFrame, done: DataFrame
) -> dict[str, DataFrame]:
    """The same from tables at hand."""
    source = source.withColumn("src_order", F.struct(*order))
    flags = coverage.totals(coverage.pair_flags(plays, source, stored))
    matches = catalog.match_pairs(plays, source)
    return {
        CLEANED: plays,
        CATALOGUE: catalog.attach_catalog(plays, source),
        API: metadata.enrich(plays, stored),
        FINAL: metadata.enrich_final(plays, source, stored).withColumn("media_type", media.by_episode_fields()),
        "matches": matches,
        "match_rate": catalog.match_rate(matches),
        "work_queue": backlog.work_queue(plays, backlog.external_keys(matches), backlog.completed_keys(done)),
        "ledger": ledger.completed_count(done),
        "coverage_by_source": coverage.by_source(flags),
        "coverage_combined": coverage.combined(flags),
        "coverage_remaining": coverage.remaining(flags),
        "yearly": trends.yearly(plays),
        "top_artists": trends.top_n(trends.artists(plays), "minutes", [ARTIST], 20),
        "kpis": dashboard.kpis(plays, TRACK, ARTIST),
        "daily_minutes": dashboard.daily_minutes(plays),
    }


def publish(spark: SparkSession, inputs: Inputs, out: str) -> dict[str, int]:
    """Store the cleaned, both enriched and the final plays below ``out`` and return the rows written.

    Everything after the cleaning reads the stored plays, so the history files are parsed
    once; the final table has a folder per media type.
    """
    rows = {CLEANED: writers.overwrite_counted(build(spark, inputs)[CLEANED], f"{out}/{CLEANED}")}
    plays = spark.read.parquet(f"{out}/{CLEANED}")
    source = readers.read_catalog(spark, inputs.catalog, CATALOG)
    done = spark.read.schema(LEDGER).parquet(inputs.ledger)
    made = tables_and_reports(plays, source, readers.SOURCE_ORDER, spark.read.parquet(inputs.metadata), done)
    return rows | store_enriched(made, out)


def store_enriched(made: dict[str, DataFrame], out: str) -> dict[str, int]:
    """Store the catalogue-enriched, lookup-enriched and final tables; the rows of each, of the last by media type."""
    rows = {name: writers.overwrite_counted(made[name], f"{out}/{name}") for name in (CATALOGUE, API)}
    return rows | writers.write_by_media(made[FINAL], f"{out}/{FINAL}")


def load(spark: SparkSession, out: str) -> DataFrame:
    """The most complete published table."""
    return readers.load_first_available(spark, [f"{out}/{name}" for name in PREFERENCE])


def refresh(spark: SparkSession, out: str, metadata_path: str) -> DataFrame:
    """Merge-only run: the stored plays with whatever metadata is stored by now."""
    return metadata.enrich(spark.read.parquet(f"{out}/{CLEANED}"), spark.read.parquet(metadata_path))
