"""Song or podcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EPISODE_COLUMNS

SONG, PODCAST, UNKNOWN = "song", "podcast", "unknown"
# Column names that already tell the type, in order of preference.
MEDIA_COLUMNS = ["media_type", "type", "content_type", "is_podcast"]
# Spellings of a boolean, and the ones that mean true.
BOOLEAN_TEXT = ["True", "False", "0", "1", "true", "false"]
TRUE_TEXT = ["true", "1", "yes"]


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _podcast_if(terms: list[str]) -> Column:
    return F.expr(f"if({' or '.join(terms) or 'false'}, '{PODCAST}', '{SONG}')")


def by_episode_fields(columns: list[str] | None = None) -> Column:
    """Podcast when any episode column holds text."""
    return _podcast_if([f"coalesce({c}, '') <> ''" for c in columns or EPISODE_COLUMNS])


def by_inference(columns: list[str]) -> Column:
    """Podcast when any ``*episode*`` column is non-NULL or any ``*uri*`` names an episode."""
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in columns}
    episode = [f"{quoted[c]} is not null" for c in columns if "episode" in c.lower()]
    uris = [
        f"coalesce(contains(cast({quoted[c]} as string), 'spotify:episode:'), false)" for c in columns if "uri" in c.lower()
    ]
    return _podcast_if(episode + uris)


def from_flag(column: str) -> Column:
    """Boolean spelling -> type."""
    return F.expr(f"if(lower(cast({column} as string)) in {_list(TRUE_TEXT)}, '{PODCAST}', '{SONG}')")


def from_label(column: str) -> Column:
    """Type label -> type; anything else is unknown."""
    known = f"lower(cast({column} as string)) in ('{PODCAST}', '{SONG}')"
    return F.expr(f"if({known}, lower(cast({column} as string)), '{UNKNOWN}')")


def with_media(df: DataFrame, boolean_like: bool | None = None) -> DataFrame:
    """Add ``media`` from an explicit column when there is one, else by inference.

    A column counts as boolean-like when any of its values is a boolean spelling; that is a
    property of the data, so it is read through a scalar subquery unless the caller knows it.
    """
    columns = df.columns
    named = next((c for c in MEDIA_COLUMNS if c in columns), None)
    if named is None:
        return df.withColumn("media", by_inference(columns))
    if boolean_like is None:
        seen = df.agg(
            F.expr(f"coalesce(bool_or(cast({named} as string) in {_list(BOOLEAN_TEXT)}), false)")
        ).scalar()
        return df.withColumn("media", F.when(seen, from_flag(named)).otherwise(from_label(named)))
    return df.withColumn("media", from_flag(named) if boolean_like else from_label(named))
