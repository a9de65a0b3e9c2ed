"""Which keys still need a lookup, in batches, and how a batch went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import composite_key_sql
from ..schemas import KEYS, PAIR
from .cleaning import unique_pairs, with_keys
from .numbering import number_rows

BATCH_SIZE = 50


def enriched_signal(df: DataFrame):
    """The test for a row that really was matched by the catalogue.

    ``track_id`` decides when the column is there, else ``popularity``, else nothing counts.
    """
    if "track_id" in df.columns:
        return numbers.is_present("track_id")
    if "popularity" in df.columns:
        return F.expr("popularity is not null")
    return F.lit(False)


def external_keys(enriched: DataFrame, normaliser: str = "full") -> DataFrame:
    """Distinct keys of the rows the catalogue matched."""
    rows = enriched.where(enriched_signal(enriched)).select(*PAIR).dropna().dropDuplicates()
    return with_keys(rows, normaliser, no_nulls=True).selectExpr(f"{composite_key_sql(*KEYS)} as key").distinct()


def completed_keys(ledger: DataFrame) -> DataFrame:
    """Keys whose ledger entry holds metadata."""
    return ledger.where("meta_json is not null").select("key").distinct()


def work_queue(plays: DataFrame, external: DataFrame, completed: DataFrame, normaliser: str = "full") -> DataFrame:
    """Unique raw pairs of the plays that neither source covers, with their key."""
    keyed = with_keys(unique_pairs(plays), normaliser, no_nulls=True).selectExpr(*PAIR, f"{composite_key_sql(*KEYS)} as key")
    return keyed.join(external, "key", "left_anti").join(completed, "key", "left_anti")


def unmatched_queue(matches: DataFrame, completed: DataFrame, normaliser: str = "full") -> DataFrame:
    """``work_queue`` out of the catalogue's matches, which hold every unique pair of the plays already.

    The pairs are neither collected nor joined with the catalogue's keys again. The catalogue's normaliser must be at least as
    coarse as ``normaliser``, so that pairs with one key are matched alike.
    """
    left = matches.where(~enriched_signal(matches)).select(*PAIR)
    keyed = with_keys(left, normaliser, no_nulls=True).selectExpr(*PAIR, f"{composite_key_sql(*KEYS)} as key")
    return keyed.join(completed, "key", "left_anti")


def batches(queue: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Cut a queue into batches of ``size`` rows; only the last may be smaller."""
    row = f"to_json(struct({', '.join(PAIR)}))"
    return number_rows(queue, row).selectExpr("*", f"row_no div {size} as batch_id").drop("row_no")


def batch_metrics(batched: DataFrame, results: DataFrame) -> DataFrame:
    """Per batch: attempted, processed (a result is stored), skipped; ``results`` is unique on ``key``."""
    found = results.selectExpr("key", "true as __found")
    by = batched.join(found, "key", "left").groupBy("batch_id")
    counted = by.agg(F.expr("count(1) as attempted"), F.expr("count(__found) as processed"))
    return counted.selectExpr("*", "attempted - processed as skipped")
