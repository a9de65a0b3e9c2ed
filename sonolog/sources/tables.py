"""The test tables seen through the listening-history data model.

Each view is a projection (the catalogue also a join) over one base table, so column pruning
and filters reach the Parquet scan. Schemas are given, which saves a job per table to infer
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import composite_key_sql, norm_plain_sql
from ..schemas import ARTIST, TRACK

TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _artist_number(k: str, spread: str) -> str:
    return f"(({k}) % 20) * 5 + ({spread}) % 5"


def _whole(x: str) -> str:
    """Nearest whole number of a length, which is never negative; ``round`` goes through decimals."""
    return f"floor({x} + 0.5D)"


def plays(spark: SparkSession, sf_dir: str, min_ms: int | None = None) -> DataFrame:
    """Plays out of ``events``."""
    return plays_from_events(table(spark, sf_dir, "events"), min_ms)


def plays_from_events(e: DataFrame, min_ms: int | None = None) -> DataFrame:
    """Events, batch or stream, as plays.

    ``min_ms`` keeps plays of at least that length. Next to the exact test on ``ms_played`` a
    slightly wider one on the stored column goes along, which the Parquet reader can use.
    """
    ms = _whole("value * 1000")
    if min_ms is not None:
        e = e.where(f"value >= {(min_ms - 1) / 1000.0}D and {ms} >= {min_ms}")
    return e.selectExpr(
        "*", f"{ms} as ms_played", r"try_cast(regexp_extract(props, '(\\d+)', 1) as int) as k"
    ).selectExpr(
        "event_id as play_id",
        "ts",
        "ms_played",
        "event_type as platform",
        f"""case when event_type <> 'error' then case event_id % 3 when 0 then concat(' TRACK ', k, ' ')
            when 1 then concat('Track ', k) else concat('track ', k) end end as {TRACK}""",
        f"if(event_type <> 'error', concat('Artist ', {_artist_number('k', 'user_id')}), null) as {ARTIST}",
        "if(event_type = 'error', concat('Episode ', k), null) as episode_name",
        "if(event_type = 'error' and event_id % 5 = 0, concat('Show ', k % 10), null) as episode_show_name",
        "if(event_type = 'error' and event_id % 2 = 0, concat('spotify:episode:', k), '') as spotify_episode_uri",
    )


def plays_long(spark: SparkSession, sf_dir: str, min_ms: int | None = None) -> DataFrame:
    """Plays spread over several years, out of ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    ms = _whole("l_quantity * 6000")
    if min_ms is not None:
        li = li.where(f"l_quantity >= {(min_ms - 1) / 6000.0}D and {ms} >= {min_ms}")
    return li.selectExpr(
        "l_shipdate as ts",
        f"{ms} as ms_played",
        f"concat('Track ', l_partkey % 100) as {TRACK}",
        f"concat('Artist ', {_artist_number('l_partkey % 100', 'l_suppkey')}) as {ARTIST}",
    )


def plays_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays out of ``lineitem`` with as many distinct tracks as there are parts, one of which holds a third of all plays."""
    part = "if(l_linenumber <= 2 and l_orderkey % 2 = 0, 0, l_partkey)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_shipdate as ts",
        f"{_whole('l_quantity * 6000')} as ms_played",
        f"concat('Track ', {part}) as {TRACK}",
        f"concat('Artist ', {part} % 997) as {ARTIST}",
    )


def meta_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata out of ``part``: a row per track, for most of the tracks, with two more for some."""
    rows = table(spark, sf_dir, "part").where("p_size <= 40").selectExpr("*", "explode(sequence(0, if(p_size < 10, 2, 0))) as copy")
    return rows.selectExpr(
        "concat('P', p_partkey, '-', copy) as spotify_id",
        f"concat(' track ', p_partkey) as {TRACK}",
        f"concat('ARTIST ', p_partkey % 997, ' ') as {ARTIST}",
        "cast(p_size + copy as bigint) as track_popularity",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio-feature catalogue out of ``part`` and ``embeddings``; ``src_order`` is file order.

    Every part is a row, with one of all the vectors. Some have a track that no play has, so that the
    catalogue covers the plays in part only.
    """
    vectors = table(spark, sf_dir, "embeddings")
    count = vectors.agg(F.count(F.lit(1))).scalar()
    parts = table(spark, sf_dir, "part").withColumn("vec_id", F.col("p_partkey") % count)
    known = "p_partkey % 100 % 5 < 3 and p_size <= 40"
    return parts.join(vectors, "vec_id").selectExpr(
        "p_partkey as src_order",
        "concat('K', p_partkey) as track_id",
        f"if({known}, concat('Track ', p_partkey % 100), concat('Unplayed ', p_partkey)) as track_name",
        f"concat('Artist ', {_artist_number('p_partkey % 100', 'p_partkey div 100')}) as artist_name",
        "lower(p_type) as genre",
        "cast(p_size as bigint) as popularity",
        "abs(cast(embedding[0] as double)) as energy",
        "abs(cast(embedding[1] as double)) as valence",
        "abs(cast(embedding[2] as double)) as danceability",
        "abs(cast(embedding[3] as double)) as acousticness",
        "p_retailprice / 10 as tempo",
    )


_META = {
    "spotify_id": "concat('S', c_custkey)",
    TRACK: "if(c_custkey % 100 % 7 < 4 and c_acctbal > 0, concat('track ', c_custkey % 100), concat('unplayed ', c_custkey))",
    ARTIST: f"concat('ARTIST ', {_artist_number('c_custkey % 100', 'c_custkey div 100')})",
    "track_popularity": "c_custkey % 101",
    "api_genres": """concat(lower(c_mktsegment), if(c_custkey % 2 = 0, ', r&b', ''), if(c_custkey % 3 = 0, ',k-pop', ''))""",
    "album_release_date": """left(concat_ws('-', 1995 + c_custkey % 7, lpad(1 + c_custkey % 12, 2, '0'),
        lpad(1 + c_custkey % 28, 2, '0')), element_at(array(10, 7, 4), cast(c_custkey % 3 as int) + 1))""",
    "album_release_date_precision": "element_at(array('day', 'month', 'year'), cast(c_custkey % 3 as int) + 1)",
}


def api_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lookup metadata out of ``customer``; keys repeat, as in an append-only table."""
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {name}" for name, e in _META.items()])


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw search documents, one per customer; an empty ``items`` list is a miss."""
    item = f"""named_struct('id', {_META["spotify_id"]}, 'uri', concat('spotify:track:S', c_custkey),
        'popularity', c_custkey % 101, 'duration_ms', 180000 + c_custkey % 1000, 'explicit', c_custkey % 4 = 0,
        'preview_url', cast(null as string), 'artists', array(named_struct('id', concat('A', c_custkey))),
        'album', named_struct('name', c_name, 'release_date', {_META["album_release_date"]},
          'release_date_precision', {_META["album_release_date_precision"]}, 'total_tracks', 1 + c_custkey % 15,
          'album_type', if(c_custkey % 2 = 0, 'album', 'single')))"""
    hit = f"to_json(named_struct('tracks', named_struct('items', array({item}))))"
    track = "concat('track ', c_custkey % 100)"
    key = composite_key_sql(norm_plain_sql(track), norm_plain_sql(_META[ARTIST]))
    return table(spark, sf_dir, "customer").selectExpr(
        f"{track} as {TRACK}",
        f"{_META[ARTIST]} as {ARTIST}",
        "c_custkey as request_id",
        f"{key} as key",
        f"""if(c_acctbal > 0, {hit}, '{{"tracks":{{"items":[]}}}}') as body""",
    )


def artist_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw artist documents, one per supplier; artists of other numbers have none stored."""
    genres = "if(s_suppkey % 5 = 0, cast(array() as array<string>), array('r&b', concat('genre ', s_suppkey % 7)))"
    body = f"""to_json(named_struct('popularity', s_suppkey % 100,
        'followers', named_struct('total', s_suppkey * 1000), 'genres', {genres}))"""
    return table(spark, sf_dir, "supplier").selectExpr("concat('A', s_suppkey) as artist_id", f"{body} as body")
