"""The registered queries: every operator applied to the given tables.

Each entry takes a session and the folder of the tables and returns a lazy DataFrame. Queries
whose answer is an aggregate work on counted keys; only those that return plays join plays.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import media, numbers, temporal, text
from ..operators import (
    backlog,
    catalog,
    cleaning,
    coverage,
    dashboard,
    fuzzy,
    genres,
    insights,
    ledger,
    metadata,
    trends,
)
from ..schemas import ARTIST, EPISODE_COLUMNS, KEYS, PAIR, TRACK
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MIN_MS = cleaning.MIN_PLAY_MS


def query(fn: Query) -> Query:
    """Register a query; its dates leave as midnight timestamps, which every client compares alike."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        days = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in days}) if days else df

    QUERIES[fn.__name__] = run
    return run


def _plays(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean(tables.plays(s, d, MIN_MS), MIN_MS)


def _long(s: SparkSession, d: str) -> DataFrame:
    return cleaning.clean(tables.plays_long(s, d, MIN_MS), MIN_MS)


def _ledger(s: SparkSession, d: str) -> DataFrame:
    """A ledger holding every key the stored metadata covers."""
    meta = cleaning.with_keys(tables.api_meta(s, d), "full")
    keyed = metadata.dedup(meta.drop(*KEYS), "full").withColumn("key", text.composite_key(*KEYS))
    return ledger.entries(keyed, F.lit("2025-01-01").cast("timestamp_ntz"), ["spotify_id"])


# --- cleaning and keys ---------------------------------------------------------------------


@query
def clean_plays(s, d):
    return _plays(s, d).select(
        "play_id", "ts", "ms_played", *PAIR, "year", "month", "day", "weekday", "hour", "minutes_played"
    )


@query
def canonical_plays(s, d):
    raw = tables.plays(s, d).withColumns(
        {
            "ts": F.when(F.col("play_id") % 97 == 0, "garbage").otherwise(F.col("ts").cast("string")),
            "ms_played": F.when(F.col("play_id") % 89 == 0, "n/a").otherwise(F.col("ms_played").cast("string")),
        }
    )
    return cleaning.canonicalise(cleaning.blank_to_null(raw.drop("platform")), null_label="nan")


@query
def canonical_from_parts(s, d):
    parts = _long(s, d).select("year", "month", "day", "minutes_played", *PAIR)
    view = cleaning.canonicalise(parts)
    return view.groupBy("day", "dow", "month", "genre_std").agg(F.count(F.lit(1)).alias("plays"))


@query
def unique_track_keys(s, d):
    return cleaning.unique_pairs(_plays(s, d))


@query
def unique_normalised_keys(s, d):
    return cleaning.unique_keys(_plays(s, d))


@query
def normaliser_comparison(s, d):
    """Keys under the three normalisers, for padded and quoted names."""
    names = tables.table(s, d, "part").select(
        F.concat(F.lit("\t  Don't \""), "p_name", F.lit("\"\u00a0")).alias("raw")
    )
    keyed = names.select(
        text.norm_full("raw").alias("key_full"),
        text.norm_unquoted("raw").alias("key_unquoted"),
        text.norm_sql("raw").alias("key_sql"),
    )
    return keyed.groupBy("key_full", "key_unquoted", "key_sql").agg(F.count(F.lit(1)).alias("names"))


@query
def duplicate_play_suppression(s, d):
    """Two overlapping exports: the second repeats every play of the evening."""
    p = tables.plays(s, d).select("ts", "ms_played", *PAIR, "spotify_episode_uri")
    both = cleaning.combine(p, p.where(F.hour("ts") >= 18))
    return cleaning.drop_repeats(both).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("plays"), F.sum("ms_played").alias("ms")
    )


@query
def combined_history(s, d):
    """UNION ALL of two histories whose columns differ."""
    both = cleaning.combine(
        tables.plays(s, d).select("ts", "ms_played", *PAIR, "episode_name"),
        tables.plays_long(s, d),
    )
    return both.groupBy(F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("plays"),
        F.count(TRACK).alias("tracks"),
        F.count("episode_name").alias("episodes"),
        F.sum("ms_played").alias("ms"),
    )


# --- catalogue match -----------------------------------------------------------------------


@query
def catalog_keep_first(s, d):
    return catalog.keyed_catalog(tables.catalog(s, d)).select(
        *KEYS, "src_order", "track_id", "genre", "popularity", "tempo"
    )


@query
def catalog_match(s, d):
    return catalog.match_pairs(_plays(s, d), tables.catalog(s, d)).select(
        *PAIR, "matched", "track_id", "genre", "popularity", "energy", "valence", "danceability", "acousticness", "tempo"
    )


@query
def catalog_match_rate(s, d):
    return catalog.match_rate(catalog.match_pairs(_plays(s, d), tables.catalog(s, d)))


@query
def catalog_match_quote_normaliser(s, d):
    """Quoted play names against an unquoted catalogue: a match only when quotes are removed."""
    parts = tables.table(s, d, "part")
    raw = parts.select(
        F.concat(F.lit(' "'), F.initcap("p_name"), F.lit("'s\"")).alias(TRACK), F.col("p_brand").alias(ARTIST)
    )
    title = F.concat(F.upper("p_name"), F.lit("S"))
    cat = parts.select(
        F.col("p_partkey").alias("src_order"),
        F.when(F.col("p_size") <= 25, title).otherwise(F.concat(F.lit("Unplayed "), "p_partkey")).alias("track_name"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_partkey").cast("string").alias("track_id"),
    )
    unquoted = catalog.match_pairs(raw, cat, "unquoted").select(
        *PAIR, "track_id", F.col("matched").alias("matched_unquoted")
    )
    full = catalog.match_pairs(raw, cat, "full").select(*PAIR, F.col("matched").alias("matched_full"))
    return unquoted.join(full, PAIR)


@query
def catalog_enriched_plays(s, d):
    return catalog.attach_catalog(_plays(s, d), tables.catalog(s, d)).select(
        "play_id", "ms_played", *PAIR, "track_id", "genre", "popularity", "energy"
    )


@query
def catalog_enriched_count(s, d):
    """Plays that carry catalogue data, out of counted pairs."""
    rolled = trends.rollup_features(_plays(s, d), tables.catalog(s, d), [], ["track_id"])
    return rolled.agg(F.expr("sum(n) as plays"), F.expr("sum(if(track_id is null, 0, n)) as enriched"))


@query
def catalog_genre_value_counts(s, d):
    rolled = trends.rollup_features(_plays(s, d), tables.catalog(s, d), [], ["genre"])
    return catalog.value_counts(rolled, "genre", weight="n")


@query
def field_coverage(s, d):
    fields = ["genre", "popularity", "danceability", "energy", "valence", "tempo", "acousticness"]
    rolled = trends.rollup_features(_plays(s, d), tables.catalog(s, d), [], fields)
    return coverage.fields(rolled, fields, "n")


@query
def fuzzy_second_pass(s, d):
    keys = cleaning.unique_keys(_plays(s, d)).drop("key")
    firsts = catalog.keyed_catalog(tables.catalog(s, d), "sql").select(*KEYS)
    return fuzzy.second_pass(keys, firsts, 1)


@query
def fuzzy_token_pass(s, d):
    """Titles of which words are in another order, added or left out, against the catalogue of the same brand."""
    parts = tables.table(s, d, "part")
    played = parts.selectExpr("concat(p_name, ' - ', lower(p_type)) as track_key", "lower(p_brand) as artist_key").distinct()
    title = "concat(lower(p_type), ' ', p_name, if(p_size % 3 = 0, '', concat(' (', p_size % 3, ' mix)')))"
    listed = parts.selectExpr(f"{title} as track_key", "lower(p_brand) as artist_key").distinct()
    return fuzzy.token_pass(played, listed, 0.6)


# --- stored metadata -----------------------------------------------------------------------


@query
def metadata_dedup(s, d):
    return metadata.dedup(tables.api_meta(s, d))


@query
def metadata_duplicate_keys(s, d):
    return metadata.duplicate_keys(tables.api_meta(s, d))


@query
def metadata_duplicate_summary(s, d):
    return metadata.duplicate_summary(tables.api_meta(s, d))


@query
def enriched_plays(s, d):
    return metadata.enrich(_plays(s, d), tables.api_meta(s, d)).select(
        "play_id",
        "ts",
        "ms_played",
        *PAIR,
        "spotify_id",
        "track_popularity",
        "album_release_date",
        "album_release_date_precision",
        "api_genres",
    )


@query
def enriched_plays_long(s, d):
    """The merge over the larger history, as counts per year."""
    merged = metadata.enrich(_long(s, d), tables.api_meta(s, d))
    return merged.groupBy("year").agg(
        F.count(F.lit(1)).alias("plays"),
        F.count("spotify_id").alias("enriched"),
        F.sum("track_popularity").alias("popularity_sum"),
    )


@query
def enriched_many_keys(s, d):
    """The merge with a metadata table that grows with the plays, and a track with a third of them."""
    merged = metadata.enrich(cleaning.clean(tables.plays_many_keys(s, d), MIN_MS), tables.meta_many_keys(s, d))
    return merged.groupBy("year").agg(
        F.count(F.lit(1)).alias("plays"),
        F.count("spotify_id").alias("enriched"),
        F.sum("track_popularity").alias("popularity_sum"),
    )


@query
def unique_many_keys(s, d):
    keys = cleaning.unique_keys(cleaning.clean(tables.plays_many_keys(s, d), MIN_MS))
    return keys.groupBy("artist_key").agg(F.count(F.lit(1)).alias("tracks"))


@query
def final_enriched(s, d):
    return metadata.enrich_final(_plays(s, d), tables.catalog(s, d), tables.api_meta(s, d)).select(
        "play_id",
        "ms_played",
        *PAIR,
        "track_id",
        "popularity",
        "genre",
        "energy",
        "spotify_id",
        "track_popularity",
        "api_genres",
        "metadata_source",
    )


@query
def final_with_collisions(s, d):
    """Columns both sides have: the right side's gets a suffix, the play's own stays."""
    own = _plays(s, d).select("play_id", *PAIR, F.lit("own").alias("genre"), F.lit("own").alias("spotify_id"))
    both = metadata.enrich_final(own, tables.catalog(s, d), tables.api_meta(s, d))
    return both.select("play_id", "genre", "genre_k", "spotify_id", "spotify_id_api")


@query
def api_flatten(s, d):
    return metadata.flatten(tables.search_responses(s, d), tables.artist_responses(s, d))


@query
def api_flatten_legacy_genres(s, d):
    rows = metadata.flatten(tables.search_responses(s, d), tables.artist_responses(s, d), legacy_genres=True)
    return rows.groupBy("api_genres").agg(F.count(F.lit(1)).alias("rows"))


@query
def top_artists_enriched(s, d):
    """Flagship: the 20 artists with most minutes, and how many of their plays have metadata."""
    meta = metadata.dedup(tables.api_meta(s, d)).select(*KEYS, "spotify_id")
    by = (
        insights.pair_rollup(_plays(s, d))
        .join(meta, KEYS, "left")
        .groupBy("artist_key")
        .agg(
            F.expr("sum(ms) as ms"),
            F.expr("sum(n) as plays"),
            F.expr("sum(if(spotify_id is null, 0, n)) as enriched_plays"),
        )
        .orderBy(F.desc("ms"), "artist_key")
        .limit(20)
    )
    return by.select(
        "artist_key",
        numbers.minutes("ms").alias("minutes"),
        "plays",
        "enriched_plays",
        numbers.percent("enriched_plays", "plays").alias("coverage_pct"),
    )


# --- media ---------------------------------------------------------------------------------


@query
def media_split(s, d):
    return _plays(s, d).select("play_id", "ms_played", media.by_episode_fields().alias("media_type"))


@query
def media_split_songs(s, d):
    tagged = _plays(s, d).withColumn("media_type", media.by_episode_fields())
    return tagged.where(F.col("media_type") == "song").select("play_id", *PAIR)


@query
def media_inferred(s, d):
    p = cleaning.blank_to_null(_plays(s, d).drop("platform"), EPISODE_COLUMNS)
    return media.with_media(p).select("play_id", "media")


@query
def media_from_flag(s, d):
    flagged = _plays(s, d).selectExpr("play_id", "if(platform = 'error', 'True', 'False') as is_podcast")
    return media.with_media(flagged).select("play_id", "media")


@query
def media_from_label(s, d):
    label = "case platform when 'error' then 'Podcast' when 'click' then 'SONG' else platform end as content_type"
    return media.with_media(_plays(s, d).selectExpr("play_id", label)).select("play_id", "media")


# --- backlog and ledger --------------------------------------------------------------------


def _queue(s, d):
    matches = catalog.match_pairs(_plays(s, d), tables.catalog(s, d))
    return backlog.unmatched_queue(matches, backlog.completed_keys(_ledger(s, d)))


@query
def work_queue(s, d):
    return _queue(s, d)


@query
def work_queue_batches(s, d):
    return backlog.batches(_queue(s, d))


@query
def batch_metrics(s, d):
    """How the batches of the whole backlog went against the stored responses."""
    p = _plays(s, d)
    nothing = _ledger(s, d).select("key").where(F.lit(False))
    batched = backlog.batches(backlog.work_queue(p, nothing, nothing))
    hits = metadata.parse_search(tables.search_responses(s, d)).where(F.col("hit").isNotNull())
    return backlog.batch_metrics(batched, hits.select("key").distinct())


def _ledger_entries(s, d):
    old = tables.table(s, d, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("key"),
        F.when(F.col("c_custkey") % 4 != 0, F.to_json(F.struct(F.col("c_mktsegment").alias("segment")))).alias("meta_json"),
        F.lit("1996-06-01").cast("timestamp_ntz").alias("updated_at"),
    )
    o = tables.table(s, d, "orders")
    new = o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"))),
        ).alias("meta_json"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"),
    )
    return old, new


@query
def ledger_upsert(s, d):
    old, new = _ledger_entries(s, d)
    return ledger.upsert(old.where(F.col("meta_json").isNotNull()), new)


@query
def ledger_upsert_remember_misses(s, d):
    old, new = _ledger_entries(s, d)
    return ledger.upsert(old, new, remember_misses=True)


@query
def ledger_completed(s, d):
    old, new = _ledger_entries(s, d)
    return ledger.completed_count(ledger.upsert(old, new, remember_misses=True))


@query
def ledger_recall(s, d):
    keys = cleaning.unique_keys(_plays(s, d), "full").select("key")
    return ledger.recall(keys, _ledger(s, d))


# --- coverage ------------------------------------------------------------------------------


def _totals(s, d):
    return coverage.totals(coverage.pair_flags(_plays(s, d), tables.catalog(s, d), tables.api_meta(s, d)))


@query
def coverage_by_source(s, d):
    return coverage.by_source(_totals(s, d))


@query
def coverage_combined(s, d):
    return coverage.combined(_totals(s, d))


@query
def coverage_remaining(s, d):
    return coverage.remaining(_totals(s, d))


@query
def coverage_overlap_pairs(s, d):
    flags = coverage.pair_flags(_plays(s, d), tables.catalog(s, d), tables.api_meta(s, d))
    return coverage.covered_pairs(flags, "has_catalog").intersect(coverage.covered_pairs(flags, "has_api"))


@query
def coverage_union_pairs(s, d):
    flags = coverage.pair_flags(_plays(s, d), tables.catalog(s, d), tables.api_meta(s, d))
    return coverage.covered_pairs(flags, "has_catalog").union(coverage.covered_pairs(flags, "has_api")).distinct()


@query
def coverage_catalog_only_pairs(s, d):
    flags = coverage.pair_flags(_plays(s, d), tables.catalog(s, d), tables.api_meta(s, d))
    return coverage.covered_pairs(flags, "has_catalog").exceptAll(coverage.covered_pairs(flags, "has_api"))


# --- volume and top lists ------------------------------------------------------------------


@query
def yearly_stats(s, d):
    return trends.yearly(_long(s, d))


@query
def yearly_stats_legacy_rounding(s, d):
    return trends.yearly(_long(s, d), legacy_rounding=True)


@query
def hourly_minutes(s, d):
    return trends.minutes_by(_plays(s, d), "hour")


@query
def peak_hour(s, d):
    return trends.peak(trends.minutes_by(_plays(s, d), "hour"), "hour")


@query
def weekday_minutes(s, d):
    return trends.minutes_by(_plays(s, d), "weekday")


@query
def top_weekday(s, d):
    return trends.peak(trends.minutes_by(_plays(s, d), "weekday"), "weekday")


@query
def top_artists(s, d):
    return trends.top_n(trends.artists(_long(s, d)), "minutes", [ARTIST], 20).select(ARTIST, "minutes")


@query
def top_artists_labelled(s, d):
    return trends.top_n(trends.artists(_plays(s, d), null_label=""), "minutes", [ARTIST], 20).select(ARTIST, "minutes")


@query
def top_artists_hours(s, d):
    best = trends.top_n(trends.artists(_long(s, d)), "hours", [ARTIST], 10, ascending_display=True)
    return best.select(ARTIST, text.shorten(f"concat('The artist named ', {ARTIST})").alias("label"), "hours", "play_count")


@query
def top_tracks(s, d):
    return trends.top_n(trends.tracks(_plays(s, d)), "minutes", PAIR, 20).select(*PAIR, "minutes", "play_count", "label")


@query
def top_tracks_hours(s, d):
    return trends.top_n(trends.tracks(_long(s, d)), "hours", PAIR, 10).select(*PAIR, "hours", "play_count")


@query
def library_summary(s, d):
    return trends.library_summary(_long(s, d))


@query
def dashboard_kpis(s, d):
    return dashboard.kpis(_plays(s, d), TRACK, ARTIST)


@query
def daily_minutes(s, d):
    return dashboard.daily_minutes(_long(s, d))


@query
def monthly_minutes(s, d):
    return dashboard.monthly_minutes(_long(s, d))


@query
def heatmap_sparse(s, d):
    return dashboard.heatmap_sparse(_plays(s, d))


@query
def heatmap_dense(s, d):
    return dashboard.heatmap_dense(_plays(s, d))


# --- features ------------------------------------------------------------------------------


@query
def yearly_features(s, d):
    rolled = trends.rollup_features(_long(s, d), tables.catalog(s, d), ["year"], [*trends.MOOD, "tempo"])
    return trends.yearly_features(rolled)


@query
def feature_extremes(s, d):
    rolled = trends.rollup_features(_long(s, d), tables.catalog(s, d), ["year"], [*trends.MOOD, "tempo"])
    return trends.feature_extremes(trends.yearly_features(rolled))


ROLLED = ["energy", "valence", "danceability", "acousticness"]


def _daily_features(s, d):
    p = _long(s, d).withColumn("day", F.to_date("ts"))
    rolled = trends.rollup_features(p, tables.catalog(s, d), ["day"], ROLLED)
    return rolled.groupBy("day").agg(*[trends.weighted_mean(f, None) for f in ROLLED])


@query
def daily_features(s, d):
    means = _daily_features(s, d)
    return means.select("day", *[F.round(f, 6).alias(f) for f in ROLLED])


@query
def rolling_features_rows(s, d):
    return dashboard.rolling(_daily_features(s, d), ROLLED, "rows")


@query
def rolling_features_days(s, d):
    return dashboard.rolling(_daily_features(s, d), ROLLED, "days")


# --- genres --------------------------------------------------------------------------------


@query
def genre_play_counts(s, d):
    counts = genres.play_counts(genres.rollup_genres(_long(s, d), tables.api_meta(s, d)))
    return counts.orderBy(F.desc("plays"), "genre").limit(10)


@query
def genre_by_year(s, d):
    rolled = genres.rollup_genres(_long(s, d), tables.api_meta(s, d), ["year"])
    return genres.by_year_top(genres.play_counts(rolled, ["year"]))


@query
def genre_by_year_pivot(s, d):
    rolled = genres.rollup_genres(_long(s, d), tables.api_meta(s, d), ["year"])
    return genres.by_year_wide(genres.play_counts(rolled, ["year"]))


@query
def genre_minutes(s, d):
    m = genres.minutes(genres.rollup_genres(_long(s, d), tables.api_meta(s, d)))
    return m.orderBy(F.desc("minutes"), "genre").limit(15)


@query
def monthly_by_top_genre(s, d):
    p = _long(s, d).withColumn("month", temporal.month_start("ts"))
    rolled = trends.rollup_features(p, tables.catalog(s, d), ["month"], ["genre"])
    by_month = (
        rolled.select("month", text.primary_genre("genre", None).alias("genre"), "ms")
        .dropna(subset=["genre"])
        .groupBy("month", "genre")
        .agg(F.sum("ms").alias("ms"))
    )
    return dashboard.monthly_by_top_genre(by_month, 3)


def _canonical(s, d):
    plays = _plays(s, d).drop("platform", "year", "month", "day", "weekday", "hour")
    enriched = catalog.attach_catalog(plays, tables.catalog(s, d))
    return cleaning.canonicalise(cleaning.blank_to_null(enriched, EPISODE_COLUMNS))


@query
def genre_options(s, d):
    p = _plays(s, d)
    matched = catalog.match_pairs(p, tables.catalog(s, d))
    return dashboard.genre_options(matched.select(text.primary_genre("genre", "Unknown").alias("genre_std")))


@query
def dashboard_filtered(s, d):
    chosen = cleaning.DashboardFilter(
        start=date(2024, 1, 5),
        end=date(2024, 1, 20),
        media="song",
        genres=["economy", "small", "standard"],
        artist="artist [1-4]",
    )
    return chosen.apply(_canonical(s, d)).select("play_id", "date", "minutes", "genre_std", "artist", "track", "energy")


@query
def dashboard_filtered_literal(s, d):
    chosen = cleaning.DashboardFilter(end=date(2024, 1, 10), artist="ARTIST 1", literal=True)
    return chosen.apply(_canonical(s, d)).groupBy("artist").agg(F.count(F.lit(1)).alias("plays"))


# --- documented analyses -------------------------------------------------------------------


@query
def season_stats(s, d):
    return insights.season_stats(_long(s, d))


@query
def volume_delta(s, d):
    return insights.volume_delta(dashboard.monthly_minutes(_long(s, d)), "month", "minutes")


@query
def yearly_delta(s, d):
    """Hours per year and the change against the year before it."""
    return insights.volume_delta(trends.yearly(_long(s, d)).selectExpr("year", "total_hours as hours"), "year", "hours")


@query
def season_top_genre(s, d):
    rolled = genres.rollup_genres(_long(s, d), tables.api_meta(s, d), ["month"])
    return insights.season_top_genre(genres.play_counts(rolled, ["month"]))


@query
def genre_diversity(s, d):
    rolled = genres.rollup_genres(_long(s, d), tables.api_meta(s, d), ["year"])
    return insights.genre_diversity(genres.play_counts(rolled, ["year"]))


@query
def genre_discovery(s, d):
    rolled = genres.rollup_genres(_long(s, d), tables.api_meta(s, d))
    return insights.genre_discovery(rolled, text.genre_tokens("api_genres"))


@query
def genre_discovery_per_year(s, d):
    rolled = genres.rollup_genres(_long(s, d), tables.api_meta(s, d))
    return insights.new_per_year(insights.genre_discovery(rolled, text.genre_tokens("api_genres")))


@query
def artist_loyalty(s, d):
    return insights.artist_loyalty(_long(s, d))


@query
def discovery_rate(s, d):
    return insights.first_plays(_long(s, d), [ARTIST])


@query
def repeat_listening(s, d):
    return insights.first_plays(_long(s, d), PAIR)


@query
def repeat_gaps(s, d):
    return insights.repeat_gaps(_plays(s, d))


@query
def popularity_vs_plays(s, d):
    return insights.popularity_vs_plays(trends.rollup_features(_long(s, d), tables.catalog(s, d), [], ["popularity"]))


@query
def mainstream_bands(s, d):
    return insights.mainstream_bands(insights.with_meta(_long(s, d), tables.api_meta(s, d), ["track_popularity"]))


@query
def mood_correlation(s, d):
    rolled = trends.rollup_features(_long(s, d), tables.catalog(s, d), ["year"], ["valence", "energy"])
    return insights.mood_correlation(rolled)


@query
def acoustic_trend(s, d):
    rolled = trends.rollup_features(_long(s, d), tables.catalog(s, d), ["year"], ["acousticness"])
    return insights.acoustic_trend(rolled)


@query
def release_year_plays(s, d):
    covered = insights.with_meta(
        _long(s, d), tables.api_meta(s, d), ["album_release_date", "album_release_date_precision"]
    )
    return insights.release_year_plays(covered)


@query
def metadata_validation(s, d):
    return insights.validation(tables.catalog(s, d))
