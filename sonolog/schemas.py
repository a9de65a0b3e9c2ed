"""Explicit schemas: nothing in the engine relies on inference."""

from __future__ import annotations

from pyspark.sql import types as T

TRACK = "master_metadata_track_name"
ARTIST = "master_metadata_album_artist_name"
PAIR = [TRACK, ARTIST]
KEYS = ["track_key", "artist_key"]

EPISODE_COLUMNS = ["episode_name", "episode_show_name", "spotify_episode_uri"]

PLAYS_RAW = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("ms_played", T.LongType()),
        T.StructField(TRACK, T.StringType()),
        T.StructField(ARTIST, T.StringType()),
        T.StructField("spotify_track_uri", T.StringType()),
        T.StructField("episode_name", T.StringType()),
        T.StructField("episode_show_name", T.StringType()),
        T.StructField("spotify_episode_uri", T.StringType()),
    ]
)

# The catalogue's feature columns.
AUDIO_FEATURES = [
    "danceability",
    "energy",
    "valence",
    "tempo",
    "acousticness",
    "instrumentalness",
    "liveness",
    "loudness",
    "speechiness",
]

# Fields the catalogue contributes to the final table, in output order.
# The catalogue's columns in output order.
CATALOG_FIELDS = [
    "track_id",
    "popularity",
    "acousticness",
    "danceability",
    "duration_ms",
    "energy",
    "instrumentalness",
    "key",
    "liveness",
    "loudness",
    "mode",
    "speechiness",
    "tempo",
    "time_signature",
    "valence",
    "genre",
]

CATALOG = T.StructType(
    [
        T.StructField("track_name", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("track_id", T.StringType()),
        T.StructField("popularity", T.LongType()),
        T.StructField("genre", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        *[T.StructField(f, T.DoubleType()) for f in AUDIO_FEATURES],
        T.StructField("key", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("time_signature", T.StringType()),
    ]
)

# Fields one stored lookup response flattens into, in output order.
# The columns of a lookup result in output order.
LOOKUP_FIELDS = T.StructType(
    [
        T.StructField("spotify_id", T.StringType()),
        T.StructField("spotify_uri", T.StringType()),
        T.StructField("track_popularity", T.LongType()),
        T.StructField("track_duration_ms", T.LongType()),
        T.StructField("track_explicit", T.BooleanType()),
        T.StructField("track_preview_url", T.StringType()),
        T.StructField("album_name", T.StringType()),
        T.StructField("album_release_date", T.StringType()),
        T.StructField("album_release_date_precision", T.StringType()),
        T.StructField("album_total_tracks", T.LongType()),
        T.StructField("album_type", T.StringType()),
        T.StructField("artist_popularity", T.LongType()),
        T.StructField("artist_followers", T.LongType()),
        T.StructField("api_genres", T.StringType()),
        T.StructField("audio_features_note", T.StringType()),
        T.StructField("enrichment_source", T.StringType()),
    ]
)

API_META = T.StructType(
    [
        T.StructField(TRACK, T.StringType()),
        T.StructField(ARTIST, T.StringType()),
        *LOOKUP_FIELDS.fields,
        T.StructField("key", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("meta_json", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

SEARCH_RESPONSE = T.StructType(
    [
        T.StructField(
            "tracks",
            T.StructType(
                [
                    T.StructField(
                        "items",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("id", T.StringType()),
                                    T.StructField("uri", T.StringType()),
                                    T.StructField("popularity", T.LongType()),
                                    T.StructField("duration_ms", T.LongType()),
                                    T.StructField("explicit", T.BooleanType()),
                                    T.StructField("preview_url", T.StringType()),
                                    T.StructField(
                                        "artists",
                                        T.ArrayType(T.StructType([T.StructField("id", T.StringType())])),
                                    ),
                                    T.StructField(
                                        "album",
                                        T.StructType(
                                            [
                                                T.StructField("name", T.StringType()),
                                                T.StructField("release_date", T.StringType()),
                                                T.StructField("release_date_precision", T.StringType()),
                                                T.StructField("total_tracks", T.LongType()),
                                                T.StructField("album_type", T.StringType()),
                                            ]
                                        ),
                                    ),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)

ARTIST_RESPONSE = T.StructType(
    [
        T.StructField("popularity", T.LongType()),
        T.StructField("followers", T.StructType([T.StructField("total", T.LongType())])),
        T.StructField("genres", T.ArrayType(T.StringType())),
    ]
)
