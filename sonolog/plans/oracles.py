"""The same queries as SQL on the raw tables, written independently of the operators.

They work play by play where the Spark side counts keys first.
"""

from __future__ import annotations

from ..schemas import ARTIST, TRACK

_CTES: dict[str, tuple[str, list[str]]] = {
    "ev": ("SELECT *, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events", []),
    "plays_all": (
        f"""SELECT event_id AS play_id, ts, CAST(round(value * 1000) AS BIGINT) AS ms_played, event_type AS platform,
            CASE WHEN event_type <> 'error' THEN
              CASE event_id % 3 WHEN 0 THEN ' TRACK ' || k || ' ' WHEN 1 THEN 'Track ' || k ELSE 'track ' || k END
            END AS {TRACK},
            CASE WHEN event_type <> 'error' THEN 'Artist ' || ((k % 20) * 5 + user_id % 5) END AS {ARTIST},
            CASE WHEN event_type = 'error' THEN 'Episode ' || k END AS episode_name,
            CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Show ' || (k % 10) END AS episode_show_name,
            CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'spotify:episode:' || k ELSE '' END
              AS spotify_episode_uri
            FROM ev""",
        ["ev"],
    ),
    "plays": (
        f"""SELECT *, lower(trim({TRACK})) AS tk, lower(trim({ARTIST})) AS ak,
            CAST(hour(ts) AS INTEGER) AS hr, CAST(isodow(ts) - 1 AS INTEGER) AS dow
            FROM plays_all WHERE ms_played >= 30000""",
        ["plays_all"],
    ),
    "long_all": (
        f"""SELECT l_shipdate AS ts, CAST(round(l_quantity * 6000) AS BIGINT) AS ms_played,
            'Track ' || (l_partkey % 100) AS {TRACK},
            'Artist ' || (((l_partkey % 100) % 20) * 5 + l_suppkey % 5) AS {ARTIST} FROM lineitem""",
        [],
    ),
    "longs": (
        f"""SELECT *, lower(trim({TRACK})) AS tk, lower(trim({ARTIST})) AS ak,
            CAST(year(ts) AS INTEGER) AS yr, CAST(month(ts) AS INTEGER) AS mo,
            CAST(ts AS DATE) AS dt, CAST(date_trunc('month', ts) AS DATE) AS mon
            FROM long_all WHERE ms_played >= 30000""",
        ["long_all"],
    ),
    "wide": (
        """SELECT l_shipdate AS ts, CASE WHEN l_linenumber <= 2 AND l_orderkey % 2 = 0 THEN 0 ELSE l_partkey END AS part
            FROM lineitem WHERE CAST(round(l_quantity * 6000) AS BIGINT) >= 30000""",
        [],
    ),
    "cat": (
        """SELECT p_partkey AS src_order, 'K' || p_partkey AS track_id,
            CASE WHEN (p_partkey % 100) % 5 < 3 AND p_size <= 40 THEN 'Track ' || (p_partkey % 100)
              ELSE 'Unplayed ' || p_partkey END AS track_name,
            'Artist ' || (((p_partkey % 100) % 20) * 5 + (p_partkey // 100) % 5) AS artist_name,
            lower(p_type) AS genre, CAST(p_size AS BIGINT) AS popularity,
            abs(CAST(embedding[1] AS DOUBLE)) AS energy, abs(CAST(embedding[2] AS DOUBLE)) AS valence,
            abs(CAST(embedding[3] AS DOUBLE)) AS danceability, abs(CAST(embedding[4] AS DOUBLE)) AS acousticness,
            p_retailprice / 10 AS tempo
            FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)""",
        [],
    ),
    "cat1": (
        """SELECT * EXCLUDE (rn) FROM (SELECT *, lower(trim(track_name)) AS tk, lower(trim(artist_name)) AS ak,
            row_number() OVER (PARTITION BY lower(trim(track_name)), lower(trim(artist_name)) ORDER BY src_order) AS rn
            FROM cat) WHERE rn = 1""",
        ["cat"],
    ),
    "meta": (
        f"""SELECT 'S' || c_custkey AS spotify_id,
            CASE WHEN (c_custkey % 100) % 7 < 4 AND c_acctbal > 0 THEN 'track ' || (c_custkey % 100)
              ELSE 'unplayed ' || c_custkey END AS {TRACK},
            'ARTIST ' || (((c_custkey % 100) % 20) * 5 + (c_custkey // 100) % 5) AS {ARTIST},
            c_custkey % 101 AS track_popularity,
            lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ', r&b' ELSE '' END
              || CASE WHEN c_custkey % 3 = 0 THEN ',k-pop' ELSE '' END AS api_genres,
            CASE c_custkey % 3
              WHEN 0 THEN printf('%d-%02d-%02d', 1995 + c_custkey % 7, 1 + c_custkey % 12, 1 + c_custkey % 28)
              WHEN 1 THEN printf('%d-%02d', 1995 + c_custkey % 7, 1 + c_custkey % 12)
              ELSE printf('%d', 1995 + c_custkey % 7) END AS album_release_date,
            CASE c_custkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS album_release_date_precision
            FROM customer""",
        [],
    ),
    "meta1": (
        f"""SELECT * EXCLUDE (rn) FROM (SELECT *, lower(trim({TRACK})) AS tk, lower(trim({ARTIST})) AS ak,
            row_number() OVER (PARTITION BY lower(trim({TRACK})), lower(trim({ARTIST}))
                               ORDER BY spotify_id DESC NULLS LAST) AS rn FROM meta) WHERE rn = 1""",
        ["meta"],
    ),
    "pairs": (
        f"""SELECT DISTINCT {TRACK}, {ARTIST}, tk, ak FROM plays
            WHERE {TRACK} IS NOT NULL AND {ARTIST} IS NOT NULL""",
        ["plays"],
    ),
    "flags": (
        f"""SELECT p.*, c.tk IS NOT NULL AS has_cat, m.tk IS NOT NULL AS has_api,
            p.{TRACK} IS NOT NULL AND p.{ARTIST} IS NOT NULL AS is_pair
            FROM plays p LEFT JOIN cat1 c ON p.tk = c.tk AND p.ak = c.ak
            LEFT JOIN meta1 m ON p.tk = m.tk AND p.ak = m.ak""",
        ["plays", "cat1", "meta1"],
    ),
    "flag_pairs": (
        f"SELECT DISTINCT {TRACK}, {ARTIST}, has_cat, has_api FROM flags WHERE is_pair",
        ["flags"],
    ),
    "long_cat": (
        "SELECT l.*, c.* EXCLUDE (tk, ak) FROM longs l LEFT JOIN cat1 c ON l.tk = c.tk AND l.ak = c.ak",
        ["longs", "cat1"],
    ),
    "long_meta": (
        f"""SELECT l.*, m.* EXCLUDE (tk, ak, {TRACK}, {ARTIST}), m.tk IS NOT NULL AS has_api
            FROM longs l LEFT JOIN meta1 m ON l.tk = m.tk AND l.ak = m.ak""",
        ["longs", "meta1"],
    ),
    "long_genres": (
        """SELECT * EXCLUDE (g), trim(g) AS genre FROM
            (SELECT *, unnest(string_split(api_genres, ',')) AS g FROM long_meta WHERE api_genres IS NOT NULL)""",
        ["long_meta"],
    ),
    "play_cat": (
        "SELECT p.*, c.* EXCLUDE (tk, ak) FROM plays p LEFT JOIN cat1 c ON p.tk = c.tk AND p.ak = c.ak",
        ["plays", "cat1"],
    ),
    "ledger_meta": (
        """SELECT tk || '|||' || ak AS key, '{"spotify_id":"' || spotify_id || '"}' AS meta_json FROM meta1""",
        ["meta1"],
    ),
    "queue": (
        f"""SELECT tk || '|||' || ak AS key, {TRACK}, {ARTIST} FROM pairs p
            WHERE NOT EXISTS (SELECT 1 FROM cat1 c WHERE c.tk = p.tk AND c.ak = p.ak)
              AND NOT EXISTS (SELECT 1 FROM meta1 m WHERE m.tk = p.tk AND m.ak = p.ak)""",
        ["pairs", "cat1", "meta1"],
    ),
    "old_entries": (
        """SELECT 'C' || c_custkey AS key,
            CASE WHEN c_custkey % 4 <> 0 THEN '{"segment":"' || c_mktsegment || '"}' END AS meta_json,
            TIMESTAMP '1996-06-01' AS updated_at FROM customer""",
        [],
    ),
    "new_entries": (
        """SELECT 'C' || o_custkey AS key, CASE WHEN o_orderstatus <> 'P' THEN
            '{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' END AS meta_json,
            CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders""",
        [],
    ),
    "all_entries": (
        """SELECT key, meta_json, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY key
            ORDER BY meta_json IS NOT NULL DESC, updated_at DESC NULLS LAST, meta_json DESC NULLS LAST) AS rn
            FROM (SELECT * FROM old_entries UNION ALL SELECT * FROM new_entries)) WHERE rn = 1""",
        ["old_entries", "new_entries"],
    ),
    "hit_entries": (
        """SELECT key, meta_json, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY key
            ORDER BY updated_at DESC NULLS LAST, meta_json DESC) AS rn
            FROM (SELECT * FROM old_entries UNION ALL SELECT * FROM new_entries) WHERE meta_json IS NOT NULL)
            WHERE rn = 1""",
        ["old_entries", "new_entries"],
    ),
    "flat": (
        f"""SELECT 'track ' || (c_custkey % 100) AS {TRACK},
            'ARTIST ' || (((c_custkey % 100) % 20) * 5 + (c_custkey // 100) % 5) AS {ARTIST},
            c_custkey AS request_id,
            'track ' || (c_custkey % 100) || '|||artist ' || (((c_custkey % 100) % 20) * 5 + (c_custkey // 100) % 5)
              AS key,
            'S' || c_custkey AS spotify_id, 'spotify:track:S' || c_custkey AS spotify_uri,
            c_custkey % 101 AS track_popularity, 180000 + c_custkey % 1000 AS track_duration_ms,
            c_custkey % 4 = 0 AS track_explicit, CAST(NULL AS VARCHAR) AS track_preview_url,
            c_name AS album_name,
            CASE c_custkey % 3
              WHEN 0 THEN printf('%d-%02d-%02d', 1995 + c_custkey % 7, 1 + c_custkey % 12, 1 + c_custkey % 28)
              WHEN 1 THEN printf('%d-%02d', 1995 + c_custkey % 7, 1 + c_custkey % 12)
              ELSE printf('%d', 1995 + c_custkey % 7) END AS album_release_date,
            CASE c_custkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS album_release_date_precision,
            1 + c_custkey % 15 AS album_total_tracks,
            CASE WHEN c_custkey % 2 = 0 THEN 'album' ELSE 'single' END AS album_type,
            s_suppkey % 100 AS artist_popularity, s_suppkey * 1000 AS artist_followers,
            CASE WHEN s_suppkey % 5 <> 0 THEN 'r&b, genre ' || (s_suppkey % 7) WHEN s_suppkey IS NOT NULL THEN '' END
              AS legacy_genres
            FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
            WHERE c_acctbal > 0""",
        [],
    ),
    "genre_ranks": (
        """SELECT genre, row_number() OVER (ORDER BY count(*) DESC, genre) AS r FROM long_genres GROUP BY genre""",
        ["long_genres"],
    ),
    "daily": (
        """SELECT dt AS day, avg(energy) AS energy, avg(valence) AS valence, avg(danceability) AS danceability,
            avg(acousticness) AS acousticness FROM long_cat GROUP BY dt""",
        ["long_cat"],
    ),
    "daily_tall": (
        """SELECT day, 'energy' AS feature, energy AS mean FROM daily
            UNION ALL SELECT day, 'valence', valence FROM daily
            UNION ALL SELECT day, 'danceability', danceability FROM daily
            UNION ALL SELECT day, 'acousticness', acousticness FROM daily""",
        ["daily"],
    ),
    "year_feat": (
        """SELECT yr AS year, CAST(count(*) AS BIGINT) AS plays, round(avg(danceability), 6) AS danceability,
            round(avg(energy), 6) AS energy, round(avg(valence), 6) AS valence, round(avg(tempo), 6) AS tempo
            FROM long_cat WHERE danceability IS NOT NULL AND energy IS NOT NULL AND valence IS NOT NULL GROUP BY yr""",
        ["long_cat"],
    ),
    "by_month_genre": (
        """SELECT mon AS month, trim(string_split(genre, ',')[1]) AS genre, CAST(sum(ms_played) AS BIGINT) AS ms
            FROM long_cat WHERE genre IS NOT NULL GROUP BY 1, 2""",
        ["long_cat"],
    ),
    "canon": (
        f"""SELECT play_id, ts AS date, ms_played / 60000 AS minutes, trim(string_split(genre, ',')[1]) AS genre_std,
            {ARTIST} AS artist, {TRACK} AS track, energy,
            CASE WHEN episode_name IS NOT NULL OR episode_show_name IS NOT NULL OR spotify_episode_uri <> ''
              THEN 'podcast' ELSE 'song' END AS media
            FROM play_cat""",
        ["play_cat"],
    ),
}


def _with(body: str, *needs: str) -> str:
    """Put the named CTEs, and those they need, in front of a query."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _CTES[name][1]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    ctes = ", ".join(f"{n} AS ({_CTES[n][0]})" for n in order)
    return f"WITH {ctes} {body}" if order else body


_SEASON = """CASE WHEN mo IN (12, 1, 2) THEN 'winter' WHEN mo IN (3, 4, 5) THEN 'spring'
 WHEN mo IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""
_TITLE = {
    "automobile": "Automobile",
    "building": "Building",
    "furniture": "Furniture",
    "household": "Household",
    "machinery": "Machinery",
    "r&b": "R&B",
    "k-pop": "K-Pop",
}
_TITLE_SQL = "CASE lower(genre) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLE.items()) + " ELSE genre END"
_PAIR = f"{TRACK}, {ARTIST}"
_PAIRJSON = f"""md5('{{"{TRACK}":"' || {TRACK} || '","{ARTIST}":"' || {ARTIST} || '"}}')"""
_COV = """SELECT CAST(count(*) AS BIGINT) AS total_records,
 CAST(count(DISTINCT CASE WHEN is_pair THEN (master_metadata_track_name, master_metadata_album_artist_name) END) AS BIGINT) AS total_unique,
 count(*) FILTER (has_cat) AS cr, count(*) FILTER (has_api) AS ar, count(*) FILTER (has_cat OR has_api) AS ur FROM flags"""
_COVU = """SELECT count(*) FILTER (has_cat) AS cu, count(*) FILTER (has_api) AS au,
 count(*) FILTER (has_cat AND has_api) AS ou, count(*) FILTER (has_cat OR has_api) AS uu FROM flag_pairs"""

_FIRST_PLAYS = """SELECT month, CAST(sum(n) AS BIGINT) AS plays, CAST(sum(is_first) AS BIGINT) AS new_plays,
 CAST(sum(n) - sum(is_first) AS BIGINT) AS repeat_plays, 100.0::DOUBLE * sum(is_first) / sum(n) AS new_pct
 FROM (SELECT mon AS month, 1 AS n,
   CASE WHEN row_number() OVER (PARTITION BY {keys} ORDER BY ts) = 1 THEN 1 ELSE 0 END AS is_first FROM longs)
 GROUP BY month"""

ORACLES: dict[str, str] = {
    "clean_plays": _with(
        f"""SELECT play_id, ts, ms_played, {_PAIR}, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
        CAST(day(ts) AS INTEGER) AS day, dayname(ts) AS weekday, hr AS hour, ms_played / 60000 AS minutes_played FROM plays""",
        "plays",
    ),
    "canonical_plays": _with(
        f"""SELECT play_id, ts AS date, CASE WHEN play_id % 89 = 0 THEN 0.0::DOUBLE ELSE ms_played / 60000 END AS minutes,
        'Unknown' AS genre_std, coalesce({ARTIST}, 'nan') AS artist, coalesce({TRACK}, 'nan') AS track,
        dayname(ts) AS weekday, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour,
        CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month,
        CASE WHEN platform = 'error' THEN 'podcast' ELSE 'song' END AS media FROM plays_all WHERE play_id % 97 <> 0""",
        "plays_all",
    ),
    "canonical_from_parts": _with(
        """SELECT dt AS day, CAST(isodow(ts) - 1 AS INTEGER) AS dow, mon AS month, 'Unknown' AS genre_std,
        count(*) AS plays FROM longs GROUP BY ALL""",
        "longs",
    ),
    "unique_track_keys": _with(f"SELECT {_PAIR} FROM pairs", "pairs"),
    "unique_normalised_keys": _with(
        "SELECT DISTINCT tk AS track_key, ak AS artist_key, tk || '|||' || ak AS key FROM pairs", "pairs"
    ),
    "normaliser_comparison": """SELECT 'don''t "' || lower(p_name) || '"' AS key_full, 'dont ' || lower(p_name) AS key_unquoted,
        chr(9) || '  don''t "' || lower(p_name) || '"' || chr(160) AS key_sql, count(*) AS names FROM part GROUP BY ALL""",
    "duplicate_play_suppression": _with(
        f"""SELECT CAST(ts AS DATE) AS day, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms FROM
        (SELECT DISTINCT ts, ms_played, {_PAIR}, spotify_episode_uri FROM plays_all) GROUP BY 1""",
        "plays_all",
    ),
    "combined_history": _with(
        f"""SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS plays, count({TRACK}) AS tracks, count(episode_name) AS episodes,
        CAST(sum(ms_played) AS BIGINT) AS ms FROM (
        SELECT ts, ms_played, {_PAIR}, episode_name FROM plays_all
        UNION ALL SELECT ts, ms_played, {_PAIR}, NULL FROM long_all) GROUP BY 1""",
        "plays_all",
        "long_all",
    ),
    "catalog_keep_first": _with(
        "SELECT tk AS track_key, ak AS artist_key, src_order, track_id, genre, popularity, tempo FROM cat1", "cat1"
    ),
    "catalog_match": _with(
        f"""SELECT {_PAIR}, track_id IS NOT NULL AS matched, track_id, genre, popularity, energy, valence,
        danceability, acousticness, tempo FROM pairs LEFT JOIN cat1 USING (tk, ak)""",
        "pairs",
        "cat1",
    ),
    "catalog_match_rate": _with(
        """SELECT count(*) AS unique_pairs, count(track_id) AS matched_pairs,
        100.0::DOUBLE * count(track_id) / count(*) AS matched_pct FROM pairs LEFT JOIN cat1 USING (tk, ak)""",
        "pairs",
        "cat1",
    ),
    "catalog_match_quote_normaliser": f"""WITH raw AS (SELECT DISTINCT p_name, p_brand,
          ' "' || upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' '
            || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) || '''s"' AS {TRACK},
          p_brand AS {ARTIST} FROM part),
        c AS (SELECT lower(p_name) AS nm, lower(p_brand) AS b, min(p_partkey) AS k FROM part WHERE p_size <= 25 GROUP BY 1, 2)
        SELECT DISTINCT {_PAIR}, CAST(k AS VARCHAR) AS track_id, k IS NOT NULL AS matched_unquoted, false AS matched_full
        FROM raw LEFT JOIN c ON nm = lower(p_name) AND b = lower(p_brand)""",
    "catalog_enriched_plays": _with(
        f"SELECT play_id, ms_played, {_PAIR}, track_id, genre, popularity, energy FROM play_cat", "play_cat"
    ),
    "catalog_enriched_count": _with(
        "SELECT count(*) AS plays, count(track_id) AS enriched FROM play_cat", "play_cat"
    ),
    "catalog_genre_value_counts": _with(
        """SELECT genre, count(*) AS plays FROM play_cat WHERE genre IS NOT NULL GROUP BY genre
        ORDER BY plays DESC, genre LIMIT 10""",
        "play_cat",
    ),
    "field_coverage": _with(
        " UNION ALL ".join(
            f"""SELECT '{f}' AS field, count({f}) AS non_null, 100.0::DOUBLE * count({f}) / count(*) AS pct FROM play_cat"""
            for f in ["genre", "popularity", "danceability", "energy", "valence", "tempo", "acousticness"]
        ),
        "play_cat",
    ),
    "fuzzy_second_pass": _with(
        """SELECT track_key, artist_key, candidate, CAST(distance AS INTEGER) AS distance FROM (
        SELECT u.tk AS track_key, u.ak AS artist_key, c.tk AS candidate, levenshtein(u.tk, c.tk) AS distance,
          row_number() OVER (PARTITION BY u.tk, u.ak ORDER BY levenshtein(u.tk, c.tk), c.tk) AS rn
        FROM (SELECT DISTINCT tk, ak FROM pairs) u JOIN cat1 c ON u.ak = c.ak
        WHERE levenshtein(u.tk, c.tk) <= 1
          AND NOT EXISTS (SELECT 1 FROM cat1 x WHERE x.tk = u.tk AND x.ak = u.ak)) WHERE rn = 1""",
        "pairs",
        "cat1",
    ),
    "fuzzy_token_pass": """WITH played AS (SELECT DISTINCT p_name || ' - ' || lower(p_type) AS t, lower(p_brand) AS a FROM part),
        listed AS (SELECT DISTINCT lower(p_type) || ' ' || p_name || CASE WHEN p_size % 3 = 0 THEN ''
          ELSE ' (' || (p_size % 3) || ' mix)' END AS t, lower(p_brand) AS a FROM part),
        l AS (SELECT *, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS w FROM played p
          WHERE NOT EXISTS (SELECT 1 FROM listed x WHERE x.t = p.t AND x.a = p.a)),
        r AS (SELECT *, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS w FROM listed),
        pairs AS (SELECT l.t AS track_key, l.a AS artist_key, r.t AS candidate, len(list_intersect(l.w, r.w))
          / (len(l.w) + len(r.w) - len(list_intersect(l.w, r.w))) AS similarity FROM l JOIN r ON l.a = r.a)
        SELECT * FROM pairs WHERE similarity >= 0.6
        QUALIFY row_number() OVER (PARTITION BY track_key, artist_key ORDER BY similarity DESC, candidate) = 1""",
    "metadata_dedup": _with(
        f"""SELECT spotify_id, {_PAIR}, track_popularity, api_genres, album_release_date, album_release_date_precision,
        tk AS track_key, ak AS artist_key FROM meta1""",
        "meta1",
    ),
    "metadata_duplicate_keys": _with(
        f"""SELECT lower(trim({TRACK})) AS track_key, lower(trim({ARTIST})) AS artist_key, count(*) AS rows
        FROM meta GROUP BY 1, 2 HAVING count(*) > 1""",
        "meta",
    ),
    "metadata_duplicate_summary": _with(
        f"""SELECT CAST(sum(c) AS BIGINT) AS meta_rows, count(*) AS distinct_keys, count(*) FILTER (c > 1) AS duplicate_keys
        FROM (SELECT count(*) AS c FROM meta GROUP BY lower(trim({TRACK})), lower(trim({ARTIST})))""",
        "meta",
    ),
    "enriched_plays": _with(
        f"""SELECT p.play_id, p.ts, p.ms_played, p.{TRACK}, p.{ARTIST}, m.spotify_id, m.track_popularity,
        m.album_release_date, m.album_release_date_precision, m.api_genres
        FROM plays p LEFT JOIN meta1 m ON p.tk = m.tk AND p.ak = m.ak""",
        "plays",
        "meta1",
    ),
    "enriched_plays_long": _with(
        """SELECT yr AS year, count(*) AS plays, count(spotify_id) AS enriched,
        CAST(sum(track_popularity) AS BIGINT) AS popularity_sum FROM long_meta GROUP BY yr""",
        "long_meta",
    ),
    "enriched_many_keys": _with(
        """SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS plays, count(spotify_id) AS enriched,
        CAST(sum(popularity) AS BIGINT) AS popularity_sum FROM wide LEFT JOIN (
          SELECT p_partkey AS part, 'P' || p_partkey || CASE WHEN p_size < 10 THEN '-2' ELSE '-0' END AS spotify_id,
            p_size + CASE WHEN p_size < 10 THEN 2 ELSE 0 END AS popularity FROM part WHERE p_size <= 40) USING (part) GROUP BY 1""",
        "wide",
    ),
    "unique_many_keys": _with(
        "SELECT 'artist ' || (part % 997) AS artist_key, count(DISTINCT part) AS tracks FROM wide GROUP BY 1", "wide"
    ),
    "final_enriched": _with(
        f"""SELECT p.play_id, p.ms_played, p.{TRACK}, p.{ARTIST}, p.track_id, p.popularity, p.genre, p.energy, m.spotify_id,
        m.track_popularity, m.api_genres,
        CASE WHEN p.track_id IS NOT NULL AND m.spotify_id IS NOT NULL THEN 'both' WHEN p.track_id IS NOT NULL THEN 'catalog'
          WHEN m.spotify_id IS NOT NULL THEN 'api' ELSE 'none' END AS metadata_source
        FROM play_cat p LEFT JOIN meta1 m ON p.tk = m.tk AND p.ak = m.ak""",
        "play_cat",
        "meta1",
    ),
    "final_with_collisions": _with(
        """SELECT p.play_id, 'own' AS genre, p.genre AS genre_k, 'own' AS spotify_id, m.spotify_id AS spotify_id_api
        FROM play_cat p LEFT JOIN meta1 m ON p.tk = m.tk AND p.ak = m.ak""",
        "play_cat",
        "meta1",
    ),
    "api_flatten": _with(
        """SELECT * EXCLUDE (legacy_genres), coalesce(legacy_genres, '') AS api_genres,
        'Skipped due to Spotify API limitations' AS audio_features_note, 'spotify_api' AS enrichment_source FROM flat""",
        "flat",
    ),
    "api_flatten_legacy_genres": _with(
        "SELECT legacy_genres AS api_genres, count(*) AS rows FROM flat GROUP BY 1", "flat"
    ),
    "top_artists_enriched": _with(
        """SELECT p.ak AS artist_key, sum(p.ms_played)::BIGINT / 60000 AS minutes, count(*) AS plays,
        count(m.spotify_id) AS enriched_plays, 100.0::DOUBLE * count(m.spotify_id) / count(*) AS coverage_pct
        FROM plays p LEFT JOIN meta1 m ON p.tk = m.tk AND p.ak = m.ak
        WHERE p.tk IS NOT NULL AND p.ak IS NOT NULL GROUP BY 1 ORDER BY sum(p.ms_played) DESC, 1 LIMIT 20""",
        "plays",
        "meta1",
    ),
    "media_split": _with(
        """SELECT play_id, ms_played, CASE WHEN coalesce(spotify_episode_uri, '') <> '' OR coalesce(episode_name, '') <> ''
        OR coalesce(episode_show_name, '') <> '' THEN 'podcast' ELSE 'song' END AS media_type FROM plays""",
        "plays",
    ),
    "media_split_songs": _with(
        f"""SELECT play_id, {_PAIR} FROM plays WHERE NOT (coalesce(spotify_episode_uri, '') <> ''
        OR coalesce(episode_name, '') <> '' OR coalesce(episode_show_name, '') <> '')""",
        "plays",
    ),
    "media_inferred": _with(
        """SELECT play_id, CASE WHEN episode_name IS NOT NULL OR episode_show_name IS NOT NULL
        OR spotify_episode_uri <> ''
        THEN 'podcast' ELSE 'song' END AS media FROM plays""",
        "plays",
    ),
    "media_from_flag": _with(
        "SELECT play_id, CASE WHEN platform = 'error' THEN 'podcast' ELSE 'song' END AS media FROM plays", "plays"
    ),
    "media_from_label": _with(
        """SELECT play_id, CASE platform WHEN 'error' THEN 'podcast' WHEN 'click' THEN 'song' ELSE 'unknown' END AS media
        FROM plays""",
        "plays",
    ),
    "work_queue": _with("SELECT * FROM queue", "queue"),
    "work_queue_batches": _with(
        f"""SELECT key, {_PAIR}, CAST((row_number() OVER (ORDER BY {_PAIRJSON}) - 1) // 50 AS BIGINT) AS batch_id FROM queue""",
        "queue",
    ),
    "batch_metrics": _with(
        f"""SELECT batch_id, count(*) AS attempted, count(*) FILTER (key IN (SELECT key FROM flat)) AS processed,
        count(*) FILTER (key NOT IN (SELECT key FROM flat)) AS skipped FROM (
        SELECT tk || '|||' || ak AS key, CAST((row_number() OVER (ORDER BY {_PAIRJSON}) - 1) // 50 AS BIGINT) AS batch_id
        FROM pairs) GROUP BY 1""",
        "pairs",
        "flat",
    ),
    "ledger_upsert": _with("SELECT * FROM hit_entries", "hit_entries"),
    "ledger_upsert_remember_misses": _with("SELECT * FROM all_entries", "all_entries"),
    "ledger_stored_versions": _with("SELECT * FROM all_entries", "all_entries"),
    "ledger_completed": _with("SELECT count(*) AS entries, count(meta_json) AS completed FROM all_entries", "all_entries"),
    "ledger_recall": _with(
        """SELECT p.key, l.meta_json, l.key IS NOT NULL AS known FROM
        (SELECT DISTINCT tk || '|||' || ak AS key FROM pairs) p LEFT JOIN ledger_meta l ON p.key = l.key""",
        "pairs",
        "ledger_meta",
    ),
    "coverage_by_source": _with(
        f"""SELECT 'catalog' AS source, cr AS records, 100.0::DOUBLE * cr / total_records AS record_pct, cu AS unique_tracks,
          100.0::DOUBLE * cu / total_unique AS unique_pct FROM ({_COV}), ({_COVU})
        UNION ALL SELECT 'api', ar, 100.0::DOUBLE * ar / total_records, au, 100.0::DOUBLE * au / total_unique
        FROM ({_COV}), ({_COVU})""",
        "flags",
        "flag_pairs",
    ),
    "coverage_combined": _with(
        f"""SELECT ou AS overlap, uu AS combined_unique, 100.0::DOUBLE * uu / total_unique AS combined_unique_pct,
        ur AS combined_records, 100.0::DOUBLE * ur / total_records AS combined_record_pct,
        round(0.9::DOUBLE * (cr + ar), 3) AS estimated_records,
        round(100.0::DOUBLE * (0.9::DOUBLE * (cr + ar)) / total_records, 6) AS estimated_record_pct
        FROM ({_COV}), ({_COVU})""",
        "flags",
        "flag_pairs",
    ),
    "coverage_remaining": _with(
        f"""SELECT total_unique, uu AS covered_unique, total_unique - uu AS remaining,
        100.0::DOUBLE * (total_unique - uu) / total_unique AS remaining_pct FROM ({_COV}), ({_COVU})""",
        "flags",
        "flag_pairs",
    ),
    "coverage_overlap_pairs": _with(f"SELECT {_PAIR} FROM flag_pairs WHERE has_cat AND has_api", "flag_pairs"),
    "coverage_union_pairs": _with(f"SELECT {_PAIR} FROM flag_pairs WHERE has_cat OR has_api", "flag_pairs"),
    "coverage_catalog_only_pairs": _with(f"SELECT {_PAIR} FROM flag_pairs WHERE has_cat AND NOT has_api", "flag_pairs"),
    "yearly_stats": _with(
        f"""SELECT yr AS year, sum(ms_played)::BIGINT / 3600000 AS total_hours, count({TRACK}) AS total_plays
        FROM longs GROUP BY yr""",
        "longs",
    ),
    "yearly_stats_legacy_rounding": _with(
        f"""SELECT yr AS year, round_even(sum(ms_played)::BIGINT / 60000, 2) / 60 AS total_hours, count({TRACK}) AS total_plays
        FROM longs GROUP BY yr""",
        "longs",
    ),
    "hourly_minutes": _with("SELECT hr AS hour, sum(ms_played)::BIGINT / 60000 AS minutes FROM plays GROUP BY hr", "plays"),
    "peak_hour": _with(
        """SELECT hr AS hour, sum(ms_played)::BIGINT / 60000 AS minutes FROM plays GROUP BY hr
        ORDER BY sum(ms_played) DESC, hr LIMIT 1""",
        "plays",
    ),
    "weekday_minutes": _with(
        "SELECT dayname(ts) AS weekday, sum(ms_played)::BIGINT / 60000 AS minutes FROM plays GROUP BY 1", "plays"
    ),
    "top_weekday": _with(
        """SELECT dayname(ts) AS weekday, sum(ms_played)::BIGINT / 60000 AS minutes FROM plays GROUP BY 1
        ORDER BY sum(ms_played) DESC, 1 LIMIT 1""",
        "plays",
    ),
    "top_artists": _with(
        f"""SELECT {ARTIST}, sum(ms_played)::BIGINT / 60000 AS minutes FROM longs WHERE {ARTIST} IS NOT NULL GROUP BY 1
        ORDER BY sum(ms_played) DESC, 1 LIMIT 20""",
        "longs",
    ),
    "top_artists_labelled": _with(
        f"""SELECT coalesce({ARTIST}, '') AS {ARTIST}, sum(ms_played)::BIGINT / 60000 AS minutes FROM plays GROUP BY 1
        ORDER BY sum(ms_played) DESC, 1 LIMIT 20""",
        "plays",
    ),
    "top_artists_hours": _with(
        f"""SELECT {ARTIST}, left('The artist named ' || {ARTIST}, 20) || '...' AS label,
        sum(ms_played)::BIGINT / 3600000 AS hours, count({TRACK}) AS play_count FROM longs
        WHERE {ARTIST} IS NOT NULL GROUP BY {ARTIST} ORDER BY sum(ms_played) DESC, 1 LIMIT 10""",
        "longs",
    ),
    "top_tracks": _with(
        f"""SELECT {_PAIR}, sum(ms_played)::BIGINT / 60000 AS minutes, count({TRACK}) AS play_count,
        {TRACK} || ' — ' || {ARTIST} AS label FROM plays WHERE {TRACK} IS NOT NULL AND {ARTIST} IS NOT NULL
        GROUP BY {_PAIR} ORDER BY sum(ms_played) DESC, {_PAIR} LIMIT 20""",
        "plays",
    ),
    "top_tracks_hours": _with(
        f"""SELECT {_PAIR}, sum(ms_played)::BIGINT / 3600000 AS hours, count({TRACK}) AS play_count FROM longs
        GROUP BY {_PAIR} ORDER BY sum(ms_played) DESC, {_PAIR} LIMIT 10""",
        "longs",
    ),
    "library_summary": _with(
        f"""SELECT count(*) AS records, min(yr) AS first_year, max(yr) AS last_year,
        sum(ms_played)::BIGINT / 3600000 AS total_hours, count(DISTINCT {TRACK}) AS unique_tracks,
        count(DISTINCT {ARTIST}) AS unique_artists FROM longs""",
        "longs",
    ),
    "dashboard_kpis": _with(
        f"""SELECT sum(ms_played)::BIGINT / 60000 AS total_minutes, count(DISTINCT CAST(ts AS DATE)) AS listening_days,
        (SELECT count(*) FROM (SELECT DISTINCT {_PAIR} FROM pairs)) AS unique_tracks FROM plays""",
        "plays",
        "pairs",
    ),
    "daily_minutes": _with("SELECT dt AS day, sum(ms_played)::BIGINT / 60000 AS minutes FROM longs GROUP BY 1", "longs"),
    "monthly_minutes": _with("SELECT mon AS month, sum(ms_played)::BIGINT / 60000 AS minutes FROM longs GROUP BY 1", "longs"),
    "heatmap_sparse": _with(
        """SELECT dow, left(dayname(ts), 3) AS weekday, hr AS hour, sum(ms_played)::BIGINT / 60000 AS minutes
        FROM plays GROUP BY ALL""",
        "plays",
    ),
    "heatmap_dense": _with(
        """SELECT CAST(d.dow AS INTEGER) AS dow, d.name AS weekday, h.hr AS hour,
        coalesce(m.ms, 0)::BIGINT / 60000 AS minutes
        FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'),
          (6, 'Sunday')) d(dow, name) CROSS JOIN (SELECT DISTINCT hr FROM plays) h
        LEFT JOIN (SELECT dow, hr, sum(ms_played) AS ms FROM plays GROUP BY 1, 2) m ON m.dow = d.dow AND m.hr = h.hr""",
        "plays",
    ),
    "yearly_features": _with("SELECT * FROM year_feat", "year_feat"),
    "feature_extremes": _with(
        " UNION ALL ".join(
            f"""SELECT '{f.title()}' AS feature,
            (SELECT printf('%d (%.3f)', year, {f}) FROM year_feat ORDER BY {f} DESC, year LIMIT 1) AS highest_year,
            (SELECT printf('%d (%.3f)', year, {f}) FROM year_feat ORDER BY {f}, year LIMIT 1) AS lowest_year"""
            for f in ["danceability", "energy", "valence"]
        ),
        "year_feat",
    ),
    "daily_features": _with(
        """SELECT day, round(energy, 6) AS energy, round(valence, 6) AS valence, round(danceability, 6) AS danceability,
        round(acousticness, 6) AS acousticness FROM daily""",
        "daily",
    ),
    "rolling_features_rows": _with(
        """SELECT day, feature, CASE WHEN count(mean) OVER w >= 7 THEN round(avg(mean) OVER w, 6) END AS value FROM daily_tall
        WINDOW w AS (PARTITION BY feature ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
        "daily_tall",
    ),
    "rolling_features_days": _with(
        """SELECT day, feature, CASE WHEN count(mean) OVER w >= 7 THEN round(avg(mean) OVER w, 6) END AS value FROM daily_tall
        WINDOW w AS (PARTITION BY feature ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""",
        "daily_tall",
    ),
    "genre_play_counts": _with(
        "SELECT genre, count(*) AS plays FROM long_genres GROUP BY genre ORDER BY plays DESC, genre LIMIT 10", "long_genres"
    ),
    "genre_by_year": _with(
        """SELECT yr AS year, genre, count(*) AS plays FROM long_genres WHERE genre IN
        (SELECT genre FROM long_genres GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 5) GROUP BY yr, genre""",
        "long_genres",
    ),
    "genre_by_year_pivot": _with(
        "SELECT yr AS year, "
        + ", ".join(
            f"(SELECT genre FROM genre_ranks WHERE r = {i}) AS genre_{i}, count(*) FILTER (r = {i}) AS plays_{i}" for i in range(1, 6)
        )
        + " FROM long_genres JOIN genre_ranks USING (genre) WHERE r <= 5 GROUP BY yr",
        "genre_ranks",
    ),
    "genre_minutes": _with(
        f"""SELECT {_TITLE_SQL} AS genre, sum(ms_played)::BIGINT / 60000 AS minutes FROM long_genres WHERE genre <> ''
        GROUP BY 1 ORDER BY sum(ms_played) DESC, 1 LIMIT 15""",
        "long_genres",
    ),
    "monthly_by_top_genre": _with(
        """SELECT month, genre, ms / 60000 AS minutes FROM by_month_genre WHERE genre IN
        (SELECT genre FROM by_month_genre GROUP BY genre ORDER BY sum(ms) DESC, genre LIMIT 3)""",
        "by_month_genre",
    ),
    "genre_options": _with(
        """SELECT DISTINCT coalesce(trim(string_split(genre, ',')[1]), 'Unknown') AS genre_std
        FROM pairs LEFT JOIN cat1 USING (tk, ak) ORDER BY 1""",
        "pairs",
        "cat1",
    ),
    "dashboard_filtered": _with(
        """SELECT play_id, date, minutes, genre_std, artist, track, energy FROM canon
        WHERE date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-01-21' AND media = 'song'
          AND genre_std IN ('economy', 'small', 'standard') AND regexp_matches(artist, 'artist [1-4]', 'i')""",
        "canon",
    ),
    "dashboard_filtered_literal": _with(
        """SELECT artist, count(*) AS plays FROM canon WHERE date < TIMESTAMP '2024-01-11'
        AND contains(lower(artist), 'artist 1') GROUP BY artist""",
        "canon",
    ),
    "season_stats": _with(
        f"SELECT {_SEASON} AS season, sum(ms_played)::BIGINT / 3600000 AS hours, count(*) AS plays FROM longs GROUP BY 1", "longs"
    ),
    "volume_delta": _with(
        """SELECT month, minutes, minutes - lag(minutes) OVER (ORDER BY month) AS delta FROM
        (SELECT mon AS month, sum(ms_played)::BIGINT / 60000 AS minutes FROM longs GROUP BY 1)""",
        "longs",
    ),
    "yearly_delta": _with(
        """SELECT year, hours, hours - lag(hours) OVER (ORDER BY year) AS delta FROM
        (SELECT yr AS year, sum(ms_played)::BIGINT / 3600000 AS hours FROM longs GROUP BY 1)""",
        "longs",
    ),
    "season_top_genre": _with(
        f"""SELECT season, genre, plays FROM (SELECT season, genre, plays,
        row_number() OVER (PARTITION BY season ORDER BY plays DESC, genre) AS rn FROM
        (SELECT {_SEASON} AS season, genre, count(*) AS plays FROM long_genres GROUP BY 1, 2)) WHERE rn = 1""",
        "long_genres",
    ),
    "genre_diversity": _with(
        """SELECT year, count(*) AS genres, round(-sum(p * ln(p)), 6) AS entropy FROM
        (SELECT yr AS year, genre, count(*) / sum(count(*)) OVER (PARTITION BY yr) AS p FROM long_genres GROUP BY yr, genre)
        GROUP BY year""",
        "long_genres",
    ),
    "genre_discovery": _with("SELECT genre, CAST(min(ts) AS DATE) AS first_day FROM long_genres GROUP BY genre", "long_genres"),
    "genre_discovery_per_year": _with(
        """SELECT CAST(year(f) AS INTEGER) AS year, count(*) AS new_genres FROM
        (SELECT genre, min(ts) AS f FROM long_genres GROUP BY genre) GROUP BY 1""",
        "long_genres",
    ),
    "artist_loyalty": _with(
        f"""SELECT {ARTIST}, count(*) AS plays, count(DISTINCT mon) AS active_months,
        100.0::DOUBLE * count(*) / (SELECT count(*) FROM longs WHERE {ARTIST} IS NOT NULL) AS share_pct
        FROM longs WHERE {ARTIST} IS NOT NULL GROUP BY 1 ORDER BY plays DESC, 1 LIMIT 20""",
        "longs",
    ),
    "discovery_rate": _with(_FIRST_PLAYS.format(keys=ARTIST), "longs"),
    "repeat_listening": _with(_FIRST_PLAYS.format(keys=_PAIR), "longs"),
    "repeat_gaps": _with(
        f"""SELECT {_PAIR}, count(*) AS plays, round(avg(gap), 6) AS mean_gap_hours FROM
        (SELECT {_PAIR}, date_diff('microsecond', lag(ts) OVER (PARTITION BY {_PAIR} ORDER BY ts), ts) / 3600000000 AS gap
         FROM plays WHERE {TRACK} IS NOT NULL AND {ARTIST} IS NOT NULL)
        GROUP BY {_PAIR} HAVING count(*) > 1 ORDER BY plays DESC, {_PAIR} LIMIT 20""",
        "plays",
    ),
    "popularity_vs_plays": _with(
        """SELECT count(*) AS keys, round(corr(n, popularity), 6) AS correlation FROM
        (SELECT tk, ak, count(*)::DOUBLE AS n, any_value(popularity)::DOUBLE AS popularity FROM long_cat
         WHERE popularity IS NOT NULL GROUP BY tk, ak)""",
        "long_cat",
    ),
    "mainstream_bands": _with(
        """SELECT CASE WHEN track_popularity < 25 THEN 'niche' WHEN track_popularity < 50 THEN 'known'
          WHEN track_popularity < 75 THEN 'popular' WHEN track_popularity <= 100 THEN 'mainstream' END AS band,
        count(*) AS plays, sum(ms_played)::BIGINT / 60000 AS minutes FROM long_meta WHERE has_api GROUP BY 1""",
        "long_meta",
    ),
    "mood_correlation": _with(
        """SELECT yr AS year, count(*) AS plays, round(corr(valence, energy), 6) AS correlation FROM long_cat
        WHERE valence IS NOT NULL AND energy IS NOT NULL GROUP BY yr""",
        "long_cat",
    ),
    "acoustic_trend": _with(
        """SELECT yr AS year, count(*) AS plays, round(avg(acousticness), 6) AS mean_acousticness,
        100.0::DOUBLE * count(*) FILTER (acousticness > 0.5) / count(*) AS acoustic_pct FROM long_cat
        WHERE acousticness IS NOT NULL GROUP BY yr""",
        "long_cat",
    ),
    "release_year_plays": _with(
        """SELECT CAST(left(album_release_date, 4) AS INTEGER) AS release_year, count(*) AS plays,
        sum(ms_played)::BIGINT / 60000 AS minutes,
        min(CAST(album_release_date || CASE album_release_date_precision WHEN 'day' THEN '' WHEN 'month' THEN '-01'
          ELSE '-01-01' END AS DATE)) AS first_release FROM long_meta WHERE has_api GROUP BY 1""",
        "long_meta",
    ),
    "metadata_validation": _with(
        " UNION ALL ".join(
            f"SELECT '{f}_range' AS rule, count(*) AS rows, count(*) FILTER (NOT ({f} BETWEEN 0 AND {hi})) AS violations FROM cat"
            for f, hi in [("danceability", 1), ("energy", 1), ("valence", 1), ("acousticness", 1), ("popularity", 100)]
        )
        + " UNION ALL SELECT 'tempo_positive', count(*), count(*) FILTER (NOT (tempo > 0)) FROM cat",
        "cat",
    ),
}

ORACLES.update(
    {
        "json_history_ingest": _with(
            f"""SELECT ts, ms_played, {_PAIR}, dayname(ts) AS weekday, hr AS hour, ms_played / 60000 AS minutes_played
            FROM plays""",
            "plays",
        ),
        "json_history_ordered": _with(
            f"""SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS plays,
            count({TRACK}) AS tracks, count(*) AS positions FROM plays GROUP BY 1, 2""",
            "plays",
        ),
        "csv_history_scan": _with(f"SELECT play_id, ts, ms_played, {_PAIR} FROM plays", "plays"),
        "media_split_written": _with(
            """SELECT CASE WHEN platform = 'error' THEN 'podcast' ELSE 'song' END AS media_type, count(*) AS plays
            FROM plays GROUP BY 1""",
            "plays",
        ),
        "catalog_csv_by_name": _with(
            """SELECT genre, count(*) AS tracks, count(DISTINCT artist_name) AS artists,
            sum(popularity)::BIGINT AS popularity, round(sum(tempo), 3) AS tempo, 0::BIGINT AS valences
            FROM cat GROUP BY genre""",
            "cat",
        ),
        "catalog_csv_legacy": _with(
            """SELECT genre, count(*) AS tracks, count(DISTINCT artist_name) AS artists,
            sum(popularity)::BIGINT AS popularity, round(sum(tempo), 3) AS tempo, 0::BIGINT AS valences
            FROM cat GROUP BY genre""",
            "cat",
        ),
        "csv_strict_by_name": _with("SELECT track_id, track_name, artist_name FROM cat", "cat"),
        "csv_lenient_counted": """SELECT p_size > 40 AS malformed, count(*) AS n,
            CAST(sum(p_size) FILTER (p_size <= 40) AS BIGINT) AS sizes, 0::BIGINT AS absent FROM part GROUP BY 1""",
        "stream_daily_minutes": _with(
            "SELECT CAST(ts AS DATE) AS day, sum(ms_played)::BIGINT / 60000 AS minutes FROM plays GROUP BY 1", "plays"
        ),
        "stream_enrich": _with(
            f"""SELECT p.play_id, p.ms_played, p.{TRACK}, p.{ARTIST}, m.spotify_id, m.track_popularity
            FROM plays p LEFT JOIN meta1 m ON p.tk = m.tk AND p.ak = m.ak""",
            "plays",
            "meta1",
        ),
        "stream_suppress_repeats": _with(
            f"""SELECT CAST(ts AS DATE) AS day, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms FROM
            (SELECT DISTINCT ts, ms_played, {_PAIR}, spotify_episode_uri FROM plays_all) GROUP BY 1""",
            "plays_all",
        ),
        "stream_late_metadata": _with(
            f"""SELECT p.play_id, p.ms_played, p.{TRACK}, p.{ARTIST}, m.spotify_id, m.track_popularity
            FROM plays p LEFT JOIN meta1 m ON p.tk = m.tk AND p.ak = m.ak""",
            "plays",
            "meta1",
        ),
        "stream_windows_late": _with(
            """SELECT width, CASE WHEN late THEN NULL ELSE start END AS start, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms
            FROM (SELECT *, day(ts) < 20 AND start + span <= w AS late FROM (
              SELECT ts, ms_played, '1 hour' AS width, INTERVAL 1 HOUR AS span, date_trunc('hour', ts) AS start FROM plays
              UNION ALL SELECT ts, ms_played, '1 day', INTERVAL 1 DAY, CAST(CAST(ts AS DATE) AS TIMESTAMP) FROM plays),
              (SELECT max(ts) - INTERVAL 12 DAY AS w FROM plays WHERE day(ts) >= 20)) GROUP BY 1, 2""",
            "plays",
        ),
        "json_history_drifting": _with(
            """SELECT way, CAST(ts AS DATE) AS day, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN play_id % 2 = 0 END AS shuffle,
            count(*) AS plays, count(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 END) AS offline,
            CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN play_id END) AS BIGINT) AS at
            FROM plays, (VALUES ('stream'), ('batch')) w(way) GROUP BY 1, 2, 3""",
            "plays",
        ),
        "csv_headers_differ": """SELECT p_partkey, p_size, CASE WHEN p_size <= 25 THEN p_brand END AS p_brand,
            CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part""",
        "csv_bad_bytes": "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN chr(65533) ELSE '' END AS name FROM part",
        "columns_that_exist": _with(
            f"""SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count({TRACK}) AS tracks,
            CAST(sum(ms_played) AS BIGINT) AS ms FROM plays GROUP BY 1, 2""",
            "plays",
        ),
        "published_first_available": _with(
            """SELECT t.name AS published, count(*) AS plays,
            count(CASE WHEN t.name = 'cleaned' OR t.name = 'catalog_enriched' AND has_cat
              OR t.name IN ('api_enriched', 'final') AND has_api THEN 1 END) AS enriched
            FROM flags, (VALUES ('cleaned'), ('catalog_enriched'), ('api_enriched'), ('final')) t(name) GROUP BY 1""",
            "flags",
        ),
        "metadata_checked_append": _with(
            """SELECT CASE WHEN track_popularity >= 50 THEN track_popularity % 3 END AS mood, count(*) AS rows,
            CAST(sum(track_popularity) AS BIGINT) AS popularity, 0::BIGINT AS albums, 20 AS columns, 2 AS refused
            FROM meta GROUP BY 1""",
            "meta",
        ),
        "day_bitmap_summary": _with(
            f"""SELECT r.start, count(ts) AS plays, CAST(coalesce(sum(ms_played), 0) AS BIGINT) / 60000 AS minutes,
            count(DISTINCT dt) AS days, count(DISTINCT {TRACK}) AS tracks, count(DISTINCT {ARTIST}) AS artists,
            count(DISTINCT CASE WHEN {TRACK} IS NOT NULL AND {ARTIST} IS NOT NULL THEN ({TRACK}, {ARTIST}) END) AS pairs
            FROM (VALUES ('all', DATE '1900-01-01', DATE '2100-01-01'), ('1996-03-05', DATE '1996-03-05', DATE '1996-03-11'),
              ('1997-12-01', DATE '1997-12-01', DATE '1998-01-31'), ('2030-01-01', DATE '2030-01-01', DATE '2100-01-01'))
              r(start, a, b) LEFT JOIN longs ON dt BETWEEN a AND b GROUP BY 1""",
            "longs",
        ),
        "refreshed_plays": ORACLES["enriched_plays"],
        "stored_enriched_plays": ORACLES["enriched_plays"],
        "stored_unique_keys": _with("SELECT DISTINCT tk AS track_key, ak AS artist_key FROM pairs", "pairs"),
        "stream_ledger": _with("SELECT * FROM hit_entries", "hit_entries"),
        "ledger_rebuilt_from_metadata": _with(
            """SELECT key, max('{"spotify_id":"' || spotify_id || '","track_popularity":' || track_popularity
            || ',"track_preview_url":null}') AS meta_json FROM flat GROUP BY key""",
            "flat",
        ),
    }
)

# Date columns leave as midnight timestamps, as on the Spark side.
_DAYS: dict[str, list[str]] = {
    "canonical_plays": ["day", "month"],
    "canonical_from_parts": ["day", "month"],
    "duplicate_play_suppression": ["day"],
    "daily_minutes": ["day"],
    "monthly_minutes": ["month"],
    "daily_features": ["day"],
    "rolling_features_rows": ["day"],
    "rolling_features_days": ["day"],
    "monthly_by_top_genre": ["month"],
    "volume_delta": ["month"],
    "genre_discovery": ["first_day"],
    "discovery_rate": ["month"],
    "repeat_listening": ["month"],
    "release_year_plays": ["first_release"],
    "json_history_drifting": ["day"],
    "stream_daily_minutes": ["day"],
    "stream_suppress_repeats": ["day"],
}
for _name, _columns in _DAYS.items():
    _casts = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
