"""Stored lookup metadata: flatten, deduplicate, merge onto the plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ARTIST_RESPONSE, KEYS, LOOKUP_FIELDS, PAIR, SEARCH_RESPONSE
from .catalog import attach_catalog, catalog_columns, keep_first, keyed_catalog
from .cleaning import unique_pairs, with_keys
from .lookup import left_lookup, left_to_spark

API_FIELDS = LOOKUP_FIELDS.fieldNames()
# Provenance texts written with every lookup result.
FEATURES_NOTE = "Skipped due to Spotify API limitations"
SOURCE_API = "spotify_api"


def dedup(meta: DataFrame, normaliser: str = "sql") -> DataFrame:
    """One row per normalised key: highest ``spotify_id``, NULL ids last.

    Remaining columns break ties, so the choice does not depend on row order.
    """
    keyed = with_keys(meta, normaliser)
    order = ["spotify_id desc nulls last"]
    order += [f"{c} asc nulls last" for c in meta.columns if c != "spotify_id"]
    return keep_first(keyed, KEYS, order)


def duplicate_keys(meta: DataFrame, normaliser: str = "sql") -> DataFrame:
    """Keys stored more than once, with how often."""
    return (
        with_keys(meta, normaliser)
        .groupBy(*KEYS)
        .agg(F.expr("count(1) as rows"))
        .where("rows > 1")
    )


def duplicate_summary(meta: DataFrame, normaliser: str = "sql") -> DataFrame:
    """Metadata rows, distinct keys and keys stored more than once."""
    per_key = with_keys(meta, normaliser).groupBy(*KEYS).agg(F.expr("count(1) as rows"))
    return per_key.agg(
        F.expr("coalesce(sum(rows), 0) as meta_rows"),
        F.expr("count(1) as distinct_keys"),
        F.expr("count_if(rows > 1) as duplicate_keys"),
    )


def api_columns(meta: DataFrame) -> list[str]:
    return [c for c in API_FIELDS if c in meta.columns]


def enrich(plays: DataFrame, meta: DataFrame, normaliser: str = "sql", strategy: str = "auto") -> DataFrame:
    """Plays LEFT JOIN deduplicated metadata on the two normalised keys.

    The number of plays never changes; NULL keys match nothing.
    """
    fields = api_columns(meta)
    single = dedup(meta, normaliser).select(*KEYS, *fields)
    single = single.withColumnsRenamed({f: f + "_api" for f in fields if f in plays.columns})
    held = {k: f"__own_{k}" for k in KEYS if k in plays.columns}
    joined = left_lookup(with_keys(plays.withColumnsRenamed(held), normaliser), single, KEYS, strategy)
    return joined.drop(*KEYS).withColumnsRenamed({v: k for k, v in held.items()})


def _suffixed(df: DataFrame, taken: list[str], suffix: str) -> DataFrame:
    """Rename the columns whose names are taken."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in taken and c not in KEYS})


def enriched_pairs(
    pairs: DataFrame,
    catalog: DataFrame,
    meta: DataFrame,
    taken: list[str],
    catalog_normaliser: str = "unquoted",
    api_normaliser: str = "sql",
) -> DataFrame:
    """Unique pairs with the fields of both sources; names already taken get ``_k`` and ``_api``."""
    cat = keyed_catalog(catalog, catalog_normaliser).select(*KEYS, *catalog_columns(catalog))
    cat = _suffixed(cat, taken, "_k")
    api = dedup(meta, api_normaliser).select(*KEYS, *api_columns(meta))
    api = _suffixed(api, [*taken, *cat.columns], "_api")
    first = with_keys(pairs, catalog_normaliser, no_nulls=True).join(cat, KEYS, "left").drop(*KEYS)
    return with_keys(first, api_normaliser, no_nulls=True).join(api, KEYS, "left").drop(*KEYS)


def enrich_final(plays: DataFrame, catalog: DataFrame, meta: DataFrame, strategy: str = "auto") -> DataFrame:
    """Plays with both sources, one row per play.

    Every right side has one row per key, so nothing fans out. Where Spark adapts its joins the
    sources are joined to the plays one after the other. Otherwise they are put together on the unique
    raw pairs, which are few, so that the plays are shuffled once and not once per source.
    """
    if strategy == "plain" or (strategy == "auto" and left_to_spark(plays)):
        out = enrich(attach_catalog(plays, catalog, strategy=strategy), meta, strategy=strategy)
    else:
        fields = enriched_pairs(unique_pairs(plays), catalog, meta, plays.columns)
        out = left_lookup(plays, fields, PAIR, "salted")
    source = """case when track_id is not null and spotify_id is not null then 'both'
        when track_id is not null then 'catalog' when spotify_id is not null then 'api' else 'none' end"""
    return out.selectExpr("*", f"{source} as metadata_source")


def parse_search(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add ``hit``: the first track of a stored search document, NULL when there is none."""
    doc = F.from_json(body, SEARCH_RESPONSE)
    return responses.withColumn("hit", F.try_element_at(doc["tracks"]["items"], F.lit(1)))


def parse_artists(responses: DataFrame, body: str = "body", order: list[str] | None = None) -> DataFrame:
    """Stored artist documents as ``artist_id`` and the struct ``artist``; the first per id.

    ``order`` names columns that say which one is first, as rows have no order; of equals, and without it, the
    smallest text is taken, so that the choice never depends on how the rows lie.
    """
    docs = responses.groupBy("artist_id").agg(F.min_by(body, F.struct(*(order or []), body)).alias(body))
    return docs.select("artist_id", F.from_json(body, ARTIST_RESPONSE).alias("artist"))


def flatten(
    searches: DataFrame, artists: DataFrame, legacy_genres: bool = False, artist_order: list[str] | None = None
) -> DataFrame:
    """Stored responses -> metadata rows; documents without a track drop out.

    The artist document is found by the id of the track's first artist. Without one, genres
    are ``''``, or NULL with ``legacy_genres``.
    """
    keep = [c for c in searches.columns if c != "body"]
    hits = parse_search(searches).where("hit is not null")
    hits = hits.selectExpr("*", "try_element_at(hit.artists, 1).id as artist_id")
    joined = left_lookup(hits, parse_artists(artists, order=artist_order), ["artist_id"])
    genres = "array_join(coalesce(artist.genres, array()), ', ')"
    if legacy_genres:
        genres = f"if(artist is null, null, {genres})"
    return joined.selectExpr(
        *keep,
        "hit.id as spotify_id",
        "hit.uri as spotify_uri",
        "hit.popularity as track_popularity",
        "hit.duration_ms as track_duration_ms",
        "hit.explicit as track_explicit",
        "hit.preview_url as track_preview_url",
        "hit.album.name as album_name",
        "hit.album.release_date as album_release_date",
        "hit.album.release_date_precision as album_release_date_precision",
        "hit.album.total_tracks as album_total_tracks",
        "hit.album.album_type as album_type",
        "artist.popularity as artist_popularity",
        "artist.followers.total as artist_followers",
        f"{genres} as api_genres",
        f"'{FEATURES_NOTE}' as audio_features_note",
        f"'{SOURCE_API}' as enrichment_source",
    )
