"""Operators on small hand-written tables: edge rows, invariants and brute force."""

import datetime as dt
import itertools
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonolog.functions import text
from sonolog.operators import (
    backlog,
    bitfilter,
    catalog,
    cleaning,
    coverage,
    dashboard,
    day_bitmaps,
    fuzzy,
    genres,
    insights,
    ledger,
    lookup,
    metadata,
    numbering,
    token_join,
    trends,
)
from sonolog.schemas import ARTIST, KEYS, PAIR, TRACK

NTZ = "timestamp_ntz"


def plays(spark, rows):
    """(ts, ms, track, artist) rows."""
    df = spark.createDataFrame(rows, f"ts string, ms_played long, {TRACK} string, {ARTIST} string")
    return df.withColumn("ts", F.col("ts").cast(NTZ))


def test_clean_boundaries(spark):
    rows = [("2024-01-01T00:00:00Z", ms, "t", "a") for ms in (29999, 30000, None)]
    df = spark.createDataFrame(rows, f"ts string, ms_played long, {TRACK} string, {ARTIST} string")
    got = cleaning.clean(df).collect()
    assert [r.ms_played for r in got] == [30000]
    assert got[0].minutes_played == 0.5 and got[0].weekday == "Monday"


def test_null_keys_never_match(spark):
    p = plays(spark, [("2024-01-01", 60000, None, None), ("2024-01-01", 60000, "T", "A")])
    m = spark.createDataFrame([(None, None, "x"), ("t", "a ", "y")], f"{TRACK} string, {ARTIST} string, spotify_id string")
    for strategy in ("plain", "salted", "auto"):
        got = {r[TRACK]: r.spotify_id for r in metadata.enrich(p, m, strategy=strategy).collect()}
        assert got == {None: None, "T": "y"}


def test_dedup_takes_highest_id_and_breaks_ties(spark):
    rows = [("k", "a", "b", 1), ("K ", "A", "z", 2), ("k", "a", None, 3), ("n", "a", None, 9), ("n", "a", None, 4)]
    m = spark.createDataFrame(rows, f"{TRACK} string, {ARTIST} string, spotify_id string, track_popularity long")
    got = {r.track_key: (r.spotify_id, r.track_popularity) for r in metadata.dedup(m).collect()}
    assert got == {"k": ("z", 2), "n": (None, 4)}
    summary = metadata.duplicate_summary(m).first()
    assert (summary.meta_rows, summary.distinct_keys, summary.duplicate_keys) == (5, 2, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_salted_join_equals_plain_join(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["hot"] * 6 + [f"t{j}" for j in range(8)] + [None]), rng.choice(["a", "b", None]))
        for i in range(600)
    ]
    facts = spark.createDataFrame(rows, "id long, track_key string, artist_key string").repartition(5)
    dims = [("hot", "a", 1), ("t1", "a", 2), ("t2", "b", 3), (None, None, 4), ("t1", "b", None)]
    dim = spark.createDataFrame(dims, "track_key string, artist_key string, v int")
    plain = sorted(map(tuple, lookup.left_lookup(facts, dim, KEYS, "plain").collect()))
    for share in (1 / 1000, 0.1, 1.0):
        got = lookup.salted_left_join(facts, dim, KEYS, share=share, salts=7, null_salts=11)
        assert sorted(map(tuple, got.select(*facts.columns, "v").collect())) == plain
    assert len(plain) == len(rows)


def test_salted_join_with_exact_copies(spark):
    facts = spark.range(0, 1000, 1, 6).select(F.lit("k").alias("track_key"), F.lit("a").alias("artist_key"))
    dim = spark.createDataFrame([("k", "a", 1)], "track_key string, artist_key string, v int")
    spread = facts.select(lookup.spread(facts.columns, 64).alias("s")).distinct().count()
    assert spread > 1
    assert lookup.salted_left_join(facts, dim, KEYS).agg(F.sum("v")).first()[0] == 1000


def test_hot_keys_are_bounded(spark):
    facts = spark.range(10000).select((F.col("id") % 50).cast("string").alias("track_key"), F.lit("a").alias("artist_key"))
    assert lookup.hot_keys(facts, KEYS, share=0.02).count() == 50
    assert lookup.hot_keys(facts, KEYS, share=0.03).count() == 0


def test_quotes_match_only_without_them(spark):
    p = plays(spark, [("2024-01-01", 60000, "Don't \"Stop\"", "A")])
    c = spark.createDataFrame([(1, "dont stop", "a", "id1"), (2, "DONT STOP", "A", "id2")], "src_order int, track_name string, artist_name string, track_id string")
    assert [r.track_id for r in catalog.match_pairs(p, c, "unquoted").collect()] == ["id1"]
    assert [r.track_id for r in catalog.match_pairs(p, c, "full").collect()] == [None]
    rate = catalog.match_rate(catalog.match_pairs(p, c, "unquoted")).first()
    assert (rate.unique_pairs, rate.matched_pairs, rate.matched_pct) == (1, 1, 100.0)


def test_merge_keeps_the_number_of_plays(spark, sf_dir):
    from sonolog.sources import tables

    p = cleaning.clean(tables.plays(spark, sf_dir, 30000))
    n = p.count()
    c, m = tables.catalog(spark, sf_dir), tables.api_meta(spark, sf_dir)
    assert metadata.enrich(p, m).count() == n
    final = {s: metadata.enrich_final(p, c, m, s) for s in ("plain", "salted")}
    cols = ["play_id", "track_id", "spotify_id", "metadata_source"]
    assert sorted(map(str, final["plain"].select(cols).collect())) == sorted(map(str, final["salted"].select(cols).collect()))
    assert final["plain"].columns == final["salted"].columns


def test_enriched_signal(spark):
    row = spark.createDataFrame([(" ", 5, "a", "b")], f"track_id string, popularity int, {TRACK} string, {ARTIST} string")
    assert backlog.external_keys(row).count() == 0
    assert backlog.external_keys(row.drop("track_id")).first().key == "a|||b"
    assert backlog.external_keys(row.drop("track_id", "popularity")).count() == 0


def test_work_queue_is_the_complement(spark):
    p = plays(spark, [("2024-01-01", 1, t, "A") for t in ["x", "X ", "y", "z", None]])
    external = spark.createDataFrame([("y|||a",)], "key string")
    done = backlog.completed_keys(spark.createDataFrame([("z|||a", "{}"), ("x|||a", None)], "key string, meta_json string"))
    queue = backlog.work_queue(p, external, done)
    assert sorted(r[TRACK] for r in queue.collect()) == ["X ", "x"]


@pytest.mark.parametrize("n, size", [(0, 50), (1, 50), (50, 50), (137, 50), (200, 7)])
def test_batches_are_dense(spark, n, size):
    q = spark.range(n).select(F.concat(F.lit("t"), "id").alias(TRACK), F.lit("a").alias(ARTIST), F.col("id").cast("string").alias("key"))
    got = backlog.batches(q, size).groupBy("batch_id").count().collect()
    counts = {r.batch_id: r["count"] for r in got}
    assert sorted(counts) == list(range(-(-n // size)))
    assert all(c == size for b, c in counts.items() if b != max(counts))
    assert sum(counts.values()) == n


@pytest.mark.parametrize("per_bucket", [50_000, 10])
def test_number_rows_is_a_permutation(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(numbering, "ROWS_PER_BUCKET", per_bucket)
    got = numbering.number_rows(spark.range(1000).withColumnRenamed("id", "an id"), "cast(`an id` as string)").collect()
    assert sorted(r.row_no for r in got) == list(range(1000)) and got[0].asDict().keys() == {"an id", "row_no"}


def test_quotes_and_blanks_in_names(spark):
    from sonolog.functions import media

    df = spark.createDataFrame([("a", "spotify:episode:1", None), ("x, it's", "", "e")], "g string, `uri link` string, `my episode` string")
    got = df.select(
        text.primary_genre("g", "it's").alias("p"), text.drop_suffix("g", ", it's").alias("s"), media.by_inference(df.columns).alias("m")
    )
    assert [tuple(r) for r in got.collect()] == [("a", "a", "podcast"), ("x", "x", "podcast")]
    assert spark.sql("select null as g").select(text.primary_genre("g", "it's").alias("p")).first().p == "it's"


def test_first_artist_document_by_a_given_order(spark):
    rows = [("A", '{"popularity":1}', 2), ("A", '{"popularity":9}', 1), ("A", '{"popularity":5}', 3)]
    df = spark.createDataFrame(rows, "artist_id string, body string, row_no int")
    assert metadata.parse_artists(df, order=["row_no"]).first().artist.popularity == 9
    assert metadata.parse_artists(df).first().artist.popularity == 1


def test_queue_of_matches_is_the_queue(spark):
    df = plays(spark, [("2024-01-01T00:00:00", 1, t, a) for t in ("One", " one ", "Don't", "Dont", "Two", None) for a in ("A", "a ")])
    source = spark.createDataFrame([(0, "one", "a", "k"), (1, "dont", "A", "")], "src_order int, track_name string, artist_name string, track_id string")
    matches = catalog.match_pairs(df, source)
    done = spark.createDataFrame([("two|||a",)], "key string")
    full = backlog.work_queue(df, backlog.external_keys(matches), done)
    columns = full.columns
    assert sorted(map(tuple, backlog.unmatched_queue(matches, done).select(columns).collect())) == sorted(map(tuple, full.collect()))


def test_batch_metrics_identity(spark):
    q = spark.range(120).select(F.concat(F.lit("t"), "id").alias(TRACK), F.lit("a").alias(ARTIST), F.col("id").cast("string").alias("key"))
    hits = spark.range(0, 120, 3).select(F.col("id").cast("string").alias("key"))
    rows = backlog.batch_metrics(backlog.batches(q, 50), hits).collect()
    assert all(r.attempted == r.processed + r.skipped for r in rows)
    assert sum(r.processed for r in rows) == 40


def entry_rows(spark, rows):
    return spark.createDataFrame(rows, "key string, meta_json string, updated_at string").withColumn("updated_at", F.col("updated_at").cast(NTZ))


def test_ledger_replay_and_misses(spark):
    old = entry_rows(spark, [("a", "1", "2024-01-01"), ("b", "1", "2024-01-01")])
    new = entry_rows(spark, [("a", "2", "2024-01-02"), ("b", None, "2024-01-03"), ("c", None, "2024-01-03")])
    once = ledger.upsert(old, new)
    assert {r.key: r.meta_json for r in once.collect()} == {"a": "2", "b": "1"}
    twice = ledger.upsert(once, new)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    remembered = ledger.upsert(old, new, remember_misses=True)
    assert {r.key: r.meta_json for r in remembered.collect()} == {"a": "2", "b": "1", "c": None}
    keys = spark.createDataFrame([("a",), ("c",), ("d",)], "key string")
    assert {r.key: r.known for r in ledger.recall(keys, remembered).collect()} == {"a": True, "c": True, "d": False}
    done = ledger.completed_count(remembered).first()
    assert (done.entries, done.completed) == (3, 2)


def test_ledger_documents_keep_nulls_and_unicode(spark):
    r = spark.createDataFrame([("k", "é", None)], "key string, album_name string, track_preview_url string")
    got = ledger.entries(r, F.lit("2024-01-01").cast(NTZ)).first()
    assert got.meta_json == '{"album_name":"é","track_preview_url":null}'


def test_flatten_misses_and_defaults(spark):
    searches = spark.createDataFrame(
        [
            ("k1", '{"tracks":{"items":[]}}'),
            ("k2", '{"tracks":{"items":[{"id":"i2","artists":[{"id":"a1"}]},{"id":"other"}]}}'),
            ("k3", '{"tracks":{"items":[{"id":"i3","artists":[]}]}}'),
            ("k4", "{}"),
        ],
        "key string, body string",
    )
    artists = spark.createDataFrame([("a1", '{"popularity":7,"followers":{"total":9},"genres":["r&b","pop"]}')], "artist_id string, body string")
    got = {r.key: r for r in metadata.flatten(searches, artists).collect()}
    assert sorted(got) == ["k2", "k3"]
    assert (got["k2"].spotify_id, got["k2"].api_genres, got["k2"].artist_followers) == ("i2", "r&b, pop", 9)
    assert (got["k3"].api_genres, got["k3"].artist_popularity) == ("", None)
    legacy = {r.key: r.api_genres for r in metadata.flatten(searches, artists, legacy_genres=True).collect()}
    assert legacy == {"k2": "r&b, pop", "k3": None}


def test_coverage_identities(spark, sf_dir):
    from sonolog.sources import tables

    p = cleaning.clean(tables.plays(spark, sf_dir, 30000))
    flags = coverage.pair_flags(p, tables.catalog(spark, sf_dir), tables.api_meta(spark, sf_dir))
    one = coverage.totals(flags).first()
    assert one.total_records == p.count()
    assert one.union_unique == one.catalog_unique + one.api_unique - one.overlap_unique
    left = coverage.remaining(coverage.totals(flags)).first()
    assert left.remaining == one.total_unique - one.union_unique
    assert (one.total_records, one.catalog_records, one.api_records, one.union_records) == (551, 81, 60, 112)


def test_genre_minutes_edge_row(spark):
    p = plays(spark, [("2024-01-01", 60000, "t", "a")])
    m = spark.createDataFrame([("t", "a", "1", "r&b, k-pop,,R&B")], f"{TRACK} string, {ARTIST} string, spotify_id string, api_genres string")
    got = {r.genre: r.minutes for r in genres.minutes(genres.rollup_genres(p, m)).collect()}
    assert got == {"R&B": 2.0, "K-Pop": 1.0}


def test_rolling_needs_seven_days_and_matches_pandas(spark):
    rng = random.Random(3)
    start = dt.date(2024, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(80) if rng.random() > 0.2]
    rows = [(d, None if rng.random() < 0.3 else rng.random()) for d in days]
    df = spark.createDataFrame(rows, "day date, energy double")
    s = pd.Series([v for _, v in rows], index=pd.to_datetime(days), dtype=float)
    for by, window in (("rows", 30), ("days", "30D")):
        want = s.rolling(window, min_periods=7).mean().round(6)
        got = {r.day: r.value for r in dashboard.rolling(df, ["energy"], by).collect()}
        for d, v in zip(days, want):
            assert (got[d] is None) == pd.isna(v)
            assert got[d] is None or abs(got[d] - v) < 2e-6


def canonical(spark):
    rows = [
        ("2024-01-05 23:59:00", 60000, "t1", "abc", None, "pop, rock"),
        ("2024-01-06 00:00:00", 60000, "t2", "a.c", None, "jazz"),
        ("2024-01-04 10:00:00", 60000, "t3", "xyz", "Ep", None),
        ("garbage", 60000, "t4", "abc", None, None),
    ]
    df = spark.createDataFrame(rows, f"ts string, ms_played long, {TRACK} string, {ARTIST} string, episode_name string, genre string")
    return cleaning.canonicalise(df)


def test_canonical_view_and_filters(spark):
    view = canonical(spark)
    assert view.count() == 3
    assert {r.track: (r.genre_std, r.media) for r in view.collect()} == {
        "t1": ("pop", "song"), "t2": ("jazz", "song"), "t3": (None, "podcast")
    }
    keep = lambda **k: sorted(r.track for r in cleaning.DashboardFilter(**k).apply(view).collect())
    assert keep(end=dt.date(2024, 1, 5)) == ["t1", "t3"]
    assert keep(start=dt.date(2024, 1, 6)) == ["t2"]
    assert keep(artist="A.C") == ["t1", "t2"]
    assert keep(artist="A.C", literal=True) == ["t2"]
    assert keep(genres=["jazz"]) == ["t2"] and keep(genres=[]) == ["t1", "t2", "t3"]
    assert keep(media="podcast") == ["t3"]
    assert [r.genre_std for r in dashboard.genre_options(view).collect()] == ["jazz", "pop"]


def test_canonical_without_optional_columns(spark):
    view = cleaning.canonicalise(spark.createDataFrame([(2024, 2, 3)], "year int, month int, day int")).first()
    assert (view.date, view.minutes, view.genre_std, view.artist) == (dt.datetime(2024, 2, 3), 0.0, "Unknown", "")
    with pytest.raises(ValueError):
        cleaning.canonicalise(spark.createDataFrame([(1,)], "x int"))


def test_dense_heatmap_has_all_weekdays(spark):
    p = plays(spark, [("2024-01-01 05:00:00", 60000, "t", "a"), ("2024-01-03 07:00:00", 120000, "t", "a")])
    got = {(r.weekday, r.hour): r.minutes for r in dashboard.heatmap_dense(p).collect()}
    assert len(got) == 14
    assert got[("Monday", 5)] == 1.0 and got[("Wednesday", 7)] == 2.0 and sum(got.values()) == 3.0


def test_first_plays_and_gaps_match_brute_force(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = sorted({(base + dt.timedelta(hours=rng.randrange(5000)), rng.choice("abcdef")) for _ in range(300)})
    p = plays(spark, [(str(t), 60000, a, a) for t, a in rows])
    seen, want = set(), {}
    for t, a in rows:
        n, new = want.get((t.year, t.month), (0, 0))
        want[(t.year, t.month)] = (n + 1, new + (a not in seen))
        seen.add(a)
    got = {(r.month.year, r.month.month): (r.plays, r.new_plays) for r in insights.first_plays(p, [ARTIST]).collect()}
    assert got == want
    for r in insights.repeat_gaps(p).collect():
        times = [t for t, a in rows if a == r[ARTIST]]
        gaps = [(b - a).total_seconds() / 3600 for a, b in itertools.pairwise(times)]
        assert abs(r.mean_gap_hours - sum(gaps) / len(gaps)) < 1e-5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2])
def test_fuzzy_candidates_match_brute_force(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 6)))
    left = {(rng.choice("xy"), word()) for _ in range(60)}
    right = {(rng.choice("xy"), word()) for _ in range(60)}
    schema = "artist_key string, track_key string"
    got = fuzzy.candidates(spark.createDataFrame(sorted(left), schema), spark.createDataFrame(sorted(right), schema), k)
    want = {(t, a, c, distance(t, c)) for a, t in left for b, c in right if a == b and distance(t, c) <= k}
    assert {(r.track_key, r.artist_key, r.candidate, r.distance) for r in got.collect()} == want


def test_top_n_display_order(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 3.0)], "k string, m double")
    assert [r.k for r in trends.top_n(df, "m", ["k"], 2).collect()] == ["b", "d"]
    assert [r.k for r in trends.top_n(df, "m", ["k"], 3, ascending_display=True).collect()] == ["c", "d", "b"]


def test_null_label_policies(spark):
    p = plays(spark, [("2024-01-01", 60000, None, None), ("2024-01-01", 60000, "t", "a")])
    assert {r[ARTIST] for r in trends.artists(p).collect()} == {"a"}
    assert {r[ARTIST] for r in trends.artists(p, null_label="").collect()} == {"a", ""}
    assert {r["label"] for r in trends.tracks(p, null_label="").collect()} == {"t — a", " — "}


def test_validation_counts(spark):
    c = spark.createDataFrame([(0.5, 50, 0), (1.5, 101, 10), (None, None, None)], "energy double, popularity int, duration_ms int")
    got = {r.rule: r.violations for r in insights.validation(c).collect()}
    assert got == {"energy_range": 1, "popularity_range": 1, "duration_ms_positive": 1}


def test_repeats_are_suppressed(spark):
    p = plays(spark, [("2024-01-01", 1, "t", "a")] * 3 + [("2024-01-02", 1, "t", "a")])
    assert cleaning.drop_repeats(p).count() == 2


def test_approximate_summary(spark):
    p = plays(spark, [(f"2024-01-01 00:{i:02d}:00", 1, f"t{i}", "a") for i in range(50)])
    one = trends.library_summary(p.withColumn("year", F.year("ts")), approximate=True).first()
    assert 45 <= one.unique_tracks <= 55


def test_empty_history(spark):
    p = cleaning.clean(plays(spark, [("2024-01-01", 1, "t", "a")]))
    assert trends.library_summary(p).first().records == 0
    assert insights.first_plays(p, [ARTIST]).count() == 0
    assert text.KEY_SEPARATOR == "|||"
    assert p.select(*PAIR).count() == 0


@pytest.mark.parametrize("threshold", [0.34, 0.6, 0.8, 1.0])
def test_similar_titles_against_all_pairs(spark, threshold):
    """One artist holds most titles; some are long, some have no word, most share a very common word."""
    rng = random.Random(int(threshold * 100))
    vocabulary = [f"w{i}" for i in range(12)]

    def title():
        n = rng.choice([0, 1, 2, 2, 3, 3, 4, 6, 10, 18, 40])
        words = [rng.choice(vocabulary) if n < 12 else f"v{rng.randrange(45)}" for _ in range(n)]
        return rng.choice([" ", "-", ", "]).join(["the", *words] if rng.random() < 0.8 else words) + rng.choice(["", "!"])

    def side(n):
        return sorted({(title(), "hot" if rng.random() < 0.7 else f"a{rng.randrange(3)}") for _ in range(n)})

    left, right = side(150), side(200)
    made = [spark.createDataFrame(x + [(None, "hot"), ("w1 w2", None)], "track_key string, artist_key string") for x in (left, right)]
    got = {(r.track_key, r.artist_key, r.candidate, r.similarity) for r in token_join.similar_titles(*made, threshold).collect()}
    words = lambda t: set(re.findall(r"[a-z0-9]+", t))
    expect = set()
    for (t, a), (c, b) in itertools.product(left, right):
        both, either = words(t) & words(c), words(t) | words(c)
        if a == b and either and len(both) / len(either) >= threshold:
            expect.add((t, a, c, len(both) / len(either)))
    assert got == expect and len(token_join.similar_titles(*made, threshold).collect()) == len(expect)
    with pytest.raises(ValueError):
        token_join.similar_titles(*made, 0)


def test_words_of_titles_in_any_script(spark):
    rows = [("Ça va — ça VA!", "a"), ("夜 に駆ける", "a"), ("naïve é", "a"), ("...", "a")]
    df = spark.createDataFrame(rows, "track_key string, artist_key string")
    got = [r.w for r in df.selectExpr(f"{token_join.words_sql('track_key')} as w").collect()]
    assert got == [["ça", "va"], ["夜", "に駆ける"], ["naïve", "é"], []]


def test_bitmap_loses_no_member_and_drops_most_others(spark):
    ids = spark.range(0, 200_000, 9).selectExpr("id as k", "cast(id as string) as name")
    rows = spark.range(200_000).selectExpr("id as k", "cast(id as string) as name", "'own' as part")
    for columns in (["k"], ["k", "name"]):
        near = bitfilter.maybe_in(rows, ids, columns, ids.count())
        assert near.columns == rows.columns
        assert near.join(ids, columns, "left_semi").count() == ids.count()
        assert near.count() < 1.7 * ids.count()
    assert bitfilter.maybe_in(rows, ids.where("false"), ["k"], 0).count() == 0
    assert bitfilter.bits_for(10**12) == bitfilter.MOST_BITS and bitfilter.bits_for(0) == bitfilter.ROW_BITS


def test_day_bitmaps_count_like_distinct(spark, tmp_path, monkeypatch):
    """NULL names, many numbers, days added later; every range of days."""
    monkeypatch.setattr(day_bitmaps, "PART_BITS", 64)
    rng = random.Random(8)
    names = [None, "", "it's", *[f"n{i}" for i in range(60)]]
    rows = [(f"2024-01-{rng.randrange(1, 9):02}T10:00:00", 1000, rng.choice(names), rng.choice(names[:9])) for _ in range(500)]
    rows += [(None, 5, "x", "y")]
    df = plays(spark, rows)
    early = df.where("ts < '2024-01-05'")
    first = day_bitmaps.dictionary(early).checkpoint()
    ids = day_bitmaps.dictionary(df, first).checkpoint()
    assert ids.join(first, ["kind", "track", "artist", "id"], "left_semi").count() == first.where("track is not null and artist is not null").count()
    for kind, n in ids.groupBy("kind").count().collect():
        assert sorted(r.id for r in ids.where(F.col("kind") == kind).collect()) == list(range(n))
    late = df.where("ts >= '2024-01-05'")
    bits = day_bitmaps.daily_bitmaps(early, ids).unionAll(day_bitmaps.daily_bitmaps(late, ids)).checkpoint()
    sums = day_bitmaps.daily_sums(df)
    for a, b in ((1, 8), (4, 5), (6, 6), (9, 9)):
        got = day_bitmaps.range_summary(bits, sums, f"2024-01-{a:02}", f"2024-01-{b:02}").first()
        own = [r for r in rows if r[0] and a <= int(r[0][8:10]) <= b]
        assert tuple(got) == (
            len(own), sum(r[1] for r in own) / 60000, len({r[0][:10] for r in own}), len({r[2] for r in own} - {None}),
            len({r[3] for r in own} - {None}), len({r[2:] for r in own if None not in r[2:]}),
        )


def test_summaries_of_nothing_and_of_missing_names(spark):
    none = cleaning.clean(plays(spark, [("2024-01-01T00:00:00", 1, "t", "a")]))
    assert tuple(trends.library_summary(none).first()) == (0, None, None, 0.0, 0, 0)
    assert tuple(dashboard.kpis(none, TRACK, ARTIST).first()) == (0.0, 0, 0)
    some = [("2024-01-01T00:00:00", 60000, "t", None), ("2023-01-01T00:00:00", 60000, None, None), ("2024-01-01T05:00:00", 60000, "t", "a")]
    df = cleaning.clean(plays(spark, some))
    assert tuple(trends.library_summary(df).first()) == (3, 2023, 2024, 0.05, 1, 1)
    assert tuple(dashboard.kpis(df, TRACK, ARTIST).first()) == (3.0, 2, 1)
