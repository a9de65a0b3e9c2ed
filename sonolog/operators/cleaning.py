"""From raw plays to the canonical plays table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import media, numbers, temporal, text
from ..schemas import ARTIST, KEYS, PAIR, TRACK

MIN_PLAY_MS = 30000
# A character that names do not hold, as SQL.
NO_KEY = r"'\u0000'"

# Candidate columns of the dashboard view, in order of preference.
DATE_CANDIDATES = ["ts", "end_time", "timestamp"]
MINUTES_CANDIDATES = ["minutes_played", "ms_played"]
GENRE_CANDIDATES = ["primary_genre", "genre", "genres", "catalog_genre", "api_genres"]
ARTIST_CANDIDATES = [ARTIST, "artist_name"]
TRACK_CANDIDATES = [TRACK, "track_name"]
FEATURES = ["energy", "valence", "danceability", "tempo", "acousticness"]


def combine(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; columns missing in a part are NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def blank_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty text becomes NULL, the one spelling of a missing value; ``NA`` or ``None`` stay text."""
    text_columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(c, F.lit("")) for c in columns or text_columns})


def clean(plays: DataFrame, min_ms: int | None = MIN_PLAY_MS) -> DataFrame:
    """Parse ``ts`` (a bad value fails), add calendar fields and minutes, drop short plays.

    The length test comes first so that it reaches the scan; a NULL length drops the row.
    """
    df = plays if min_ms is None else plays.where(f"ms_played >= {min_ms}")
    kind = dict(df.dtypes)["ts"]
    if kind == "string":
        df = df.withColumn("ts", temporal.parse_utc_strict("ts"))
    elif kind == "timestamp":
        df = df.withColumn("ts", temporal.to_utc("ts"))
    return temporal.with_calendar(df).withColumn("minutes_played", numbers.minutes("ms_played"))


def with_keys(
    df: DataFrame, normaliser: str = "sql", track: str = TRACK, artist: str = ARTIST, no_nulls: bool = False
) -> DataFrame:
    """Add ``track_key`` and ``artist_key``.

    With ``no_nulls`` a missing name gets a key that no row of a keyed table has. For counted
    pairs that keeps the optimiser from moving a NULL test of the normalised name, which an
    inner join implies, below the count and onto every single play.
    """
    plain = text.NORMALISERS[normaliser]

    def norm(column: str) -> str:
        return f"coalesce({plain(column)}, {NO_KEY})" if no_nulls else plain(column)

    return df.selectExpr("*", f"{norm(track)} as {KEYS[0]}", f"{norm(artist)} as {KEYS[1]}")


def unique_pairs(df: DataFrame) -> DataFrame:
    """Distinct raw (track, artist) pairs without NULLs."""
    return df.select(*PAIR).dropna().dropDuplicates()


def unique_keys(df: DataFrame, normaliser: str = "sql") -> DataFrame:
    """Distinct normalised pairs and their one-column key; names are normalised once per raw pair."""
    pairs = with_keys(unique_pairs(df), normaliser, no_nulls=True).select(*KEYS).dropDuplicates()
    return pairs.withColumn("key", text.composite_key(*KEYS))


def drop_repeats(plays: DataFrame) -> DataFrame:
    """Suppress plays that overlapping exports hold twice: same instant, length and content."""
    identity = [c for c in ["ts", "ms_played", *PAIR, "spotify_track_uri", "spotify_episode_uri"] if c in plays.columns]
    return plays.dropDuplicates(identity)


def first_of(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that is a column of ``df``."""
    return next((c for c in candidates if c in df.columns), None)


def _label(df: DataFrame, candidates: list[str], null_label: str | None) -> Column:
    name = first_of(df, candidates)
    if name is None:
        return F.lit("")
    c = F.col(name).cast("string")
    return c if null_label is None else F.coalesce(c, F.lit(null_label))


def canonicalise(
    df: DataFrame,
    null_label: str | None = None,
    default_genre: str = "Unknown",
    boolean_media: bool | None = None,
) -> DataFrame:
    """The dashboard view of any enriched table, whatever its column names.

    Bad timestamps drop the row, bad minutes count as zero, bad features are NULL. Missing
    names stay NULL unless ``null_label`` gives them a text.
    """
    when = first_of(df, DATE_CANDIDATES)
    if when is not None:
        kind = df.schema[when].dataType
        if isinstance(kind, T.StringType):
            instant = temporal.parse_utc(when)
        elif isinstance(kind, T.TimestampType):
            instant = temporal.to_utc(when)
        else:
            instant = F.col(when).cast("timestamp_ntz")
    elif {"year", "month", "day"} <= set(df.columns):
        instant = F.make_date("year", "month", "day").cast("timestamp_ntz")
    else:
        raise ValueError("no timestamp column and no year/month/day columns")

    length = first_of(df, MINUTES_CANDIDATES)
    minutes = F.lit(0.0) if length is None else numbers.number_or_zero(length)
    if length == "ms_played":
        minutes = minutes / F.lit(60000)

    genre = first_of(df, GENRE_CANDIDATES)
    genre_std = F.lit(default_genre) if genre is None else text.primary_genre(genre, null_label)

    tagged = media.with_media(df, boolean_media)
    dated = tagged.withColumn("date", instant).dropna(subset=["date"])
    return dated.select(
        *([F.col("play_id")] if "play_id" in df.columns else []),
        "date",
        minutes.alias("minutes"),
        genre_std.alias("genre_std"),
        _label(df, ARTIST_CANDIDATES, null_label).alias("artist"),
        _label(df, TRACK_CANDIDATES, null_label).alias("track"),
        temporal.weekday_name("date").alias("weekday"),
        temporal.weekday_number("date").alias("dow"),
        F.hour("date").alias("hour"),
        F.to_date("date").alias("day"),
        temporal.month_start("date").alias("month"),
        *[numbers.number_or_null(c).alias(c) for c in FEATURES if c in df.columns],
        "media",
    )


@dataclass(frozen=True)
class DashboardFilter:
    """What the dashboard can narrow the canonical view by; defaults keep everything."""

    start: date | None = None
    end: date | None = None
    media: str | None = None
    genres: list[str] = field(default_factory=list)
    artist: str | None = None
    literal: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        """Both dates are inclusive; ``artist`` is a case-insensitive regular expression unless literal."""
        if self.start is not None:
            df = df.where(F.col("date") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            df = df.where(F.col("date") < F.date_add(F.lit(self.end), 1).cast("timestamp_ntz"))
        if self.media is not None:
            df = df.where(F.col("media") == self.media)
        if self.genres:
            df = df.where(F.col("genre_std").isin(self.genres))
        if self.artist:
            if self.literal:
                df = df.where(F.lower("artist").contains(self.artist.lower()))
            else:
                df = df.where(F.col("artist").rlike(f"(?i){self.artist}"))
        return df
