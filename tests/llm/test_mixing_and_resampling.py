"""Resampling, mixing and hard negatives against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonolog.llm import hard_negatives, mixing, queries, resample
from sonolog.llm.common import ranked, table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "a"), (None, "no id " * 30), (4, "same word " * 12), (4, "same word " * 12)]
    rows += [(5, "Ab-ß 7 " * 60000), (6, "\U0001f642 x"), (4, "other text " * 15), (7, "x" * 3_000_000 + " y")]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    return odd.withColumns({"score": F.lit("clash"), "weight": F.lit(1), "body": F.lit(2), "m": F.create_map(F.lit(1), F.lit(2))})


# Resampling


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain_resampling(docs, target):
    """``doc_id, n_features, weight, score, rank`` of (doc_id, text) rows."""
    found = [(i, *plain_features(t)) for i, t in docs]
    raw, goal = Counter(), Counter()
    for _, _, f in found:
        raw.update(f)
    for t in target:
        goal.update(plain_features(t)[1])
    s, t = sum(raw.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in range(10_000)}
    out, enough = [], []
    for i, n, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= 20:
            enough.append(out[-1])
    enough.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for rank, row in enumerate(enough[: 5 * len(enough) // 100], 1):
        row[4] = rank
    return sorted(map(str, out))


def test_resampling_query_against_plain_python(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, d, "benchmark").collect()]
    got = sorted(str(list(r)) for r in queries.op12_resampling(spark, d).collect())
    assert got == plain_resampling(docs, target)


@pytest.mark.parametrize("piece", [2_000_000, 40, 7])
def test_resampling_odd_rows(spark, odd_docs, monkeypatch, piece):
    """Also with pieces so small that most texts are cut; several texts are drawn at a share of half."""
    monkeypatch.setattr(resample, "PIECE_BYTES", piece)
    docs = odd_docs if piece > 40 else odd_docs.where("doc_id is null or doc_id not in (5, 7)")
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    texts = [t or b"" for t in [None if t is None else t.encode() for _, t in plain]]
    hasher = resample.NgramHasher()
    got = Counter()
    for _, group, carried in resample.pieces(texts):
        got.update(hasher(group, carried)[0].tolist())
    expect = Counter(b for _, t in plain for b in plain_features(t)[1])
    assert got == expect
    target = docs.where("doc_id = 6")
    scored = resample.scores(docs, target)
    result = sorted(str(list(r)) for r in resample.draw_ranks(scored, 5).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert result == plain_resampling(plain, [r.text for r in target.collect()])


def test_resampling_draws_whole_rows(spark, odd_docs):
    drawn = resample.draw(odd_docs, odd_docs.where("doc_id = 6"), 100)
    assert drawn.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in drawn.collect()) == ["4", "4", "4", "5", "None"]
    none = odd_docs.where("false")
    assert resample.draw(none, none).count() == 0
    assert resample.scores(odd_docs, none).count() == odd_docs.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6), st.integers(1, 60))
def test_ngrams_of_any_texts_in_any_pieces(texts, size):
    before, resample.PIECE_BYTES = resample.PIECE_BYTES, size
    try:
        raw = [t.encode("utf-8", "replace") for t in texts]
        hasher, got, words = resample.NgramHasher(), [Counter() for _ in raw], [0] * len(raw)
        for numbers, group, carried in resample.pieces(raw):
            bucket, owner, count = hasher(group, carried)
            for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
                got[numbers[o]][b] += 1
            for i, n in zip(numbers, count.tolist(), strict=True):
                words[i] += n
    finally:
        resample.PIECE_BYTES = before
    expect = [plain_features(r.decode()) for r in raw]
    assert words == [n for n, _ in expect]
    assert got == [Counter(f) for _, f in expect]


def test_gains_follow_the_ratio_of_shares():
    gain = resample.gains(np.array([9, 1, 0]), np.array([1, 9, 0]))
    assert gain.tolist() == [math.floor(1000 * math.log(2 / 10)), math.floor(1000 * math.log(10 / 2)), 0]


def test_ranks_are_gapless_over_many_tasks(spark, monkeypatch):
    from sonolog.llm import common

    monkeypatch.setattr(common, "ROWS_PER_RANGE", 50)
    df = spark.range(1000).select((F.col("id") % 7).alias("x"), F.col("id").alias("place"))
    got = ranked(df, [F.desc("x"), F.asc("place")], "rank", 1000).collect()
    rows = sorted(got, key=lambda r: (-r.x, r.place))
    assert [r["rank"] for r in rows] == list(range(1, 1001))


# Mixing


def plain_targets(sizes, weights, share, cap):
    """The excess over ``cap`` is reshared by weight among the others, round by round, as the rule says."""
    budget = share * sum(sizes)
    got, full = [0.0] * len(sizes), set()
    while len(full) < len(sizes):
        free = [i for i in range(len(sizes)) if i not in full]
        left = budget - sum(cap * sizes[i] for i in full)
        for i in free:
            got[i] = left * weights[i] / sum(weights[j] for j in free)
        above = {i for i in free if got[i] >= cap * sizes[i]}
        for i in above:
            got[i] = cap * sizes[i]
        full |= above
        if not above:
            break
    return got


def plain_mix(docs):
    """``doc_id, source, size, source_size, target, taken`` of (doc_id, source, text) rows."""
    rows = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in docs]
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(names, plain_targets([total[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True))
    seen, out = Counter(), []
    for i, s, n in rows:
        seen[i, s, n] += 1
        rate = goal[s] / total[s] if total[s] else 0.0
        digest = hashlib.md5(f"mix:{'null' if i is None else i}:{seen[i, s, n]}".encode()).hexdigest()
        extra = (int(digest[:13], 16) + 0.5) / 2**52 < rate - math.floor(rate)
        out.append((i, s, n, total[s], pytest.approx(goal[s], rel=1e-12), n * (math.floor(rate) + extra)))
    return sorted(out, key=lambda r: str(r[:4]) + str(r[5]))


def taken_rows(df):
    rows = df.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    return sorted(map(tuple, rows), key=lambda r: str(r[:4]) + str(r[5]))


def test_mixing_query_against_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.source, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = taken_rows(queries.op11_mixing(spark, sf_dir))
    assert got == plain_mix(docs)
    assert all(taken <= 2 * size for _, _, size, _, _, taken in got)


@pytest.mark.parametrize("per_task", [10_000, 3])
def test_mixing_odd_rows(spark, monkeypatch, per_task):
    """NULLs, empty and long texts, and one row that makes up a third of the table."""
    monkeypatch.setattr(mixing, "EQUAL_ROWS", per_task)
    rows = [(1, "b", None), (2, "b", ""), (3, None, "some words \t\v\f here"), (None, "a", "x"), (None, None, " \n ")]
    rows += [(4, "hot", "same row here")] * 40 + [(i, "hot", "y " * i) for i in range(5, 60)]
    rows += [(60, "é", "\u00a0 \u3000z"), (61, "z", "word " * 300_000), (62, "Z", "\x00 \x1f")]
    docs = spark.createDataFrame([(i, t, None, s, None) for i, s, t in rows], SCHEMA)
    docs = docs.withColumns({c: F.lit(c) for c in ("key", "size", "n", "rate", "own", "copy", "target")})
    assert taken_rows(mixing.take(docs)) == plain_mix(rows)
    assert mixing.take(docs.where("false")).count() == 0
    nothing = docs.where("doc_id = 2")
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.take(nothing).collect()] == [(0, 0, 0.0, 0)]


def test_the_mix_holds_whole_documents_as_often_as_taken(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"rate": F.lit(1), "own": F.lit(2), "m": F.create_map(F.lit(1), F.lit(2))})
    got = mixing.emit(docs)
    assert got.columns == docs.columns
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    expect = {r.doc_id: r.copies for r in mixing.take(docs).collect() if r.copies}
    assert times == expect
    assert all(text[r.doc_id] == r.text for r in got.collect())


def test_targets_are_those_of_resharing_round_by_round(spark, monkeypatch):
    from sonolog.llm import common

    monkeypatch.setattr(common, "ROWS_PER_RANGE", 5)
    rng = np.random.default_rng(5)
    for n in (1, 2, 17, 60):
        for spread in (1.0, 8.0):
            sizes = [int(x) for x in np.exp(rng.uniform(0, spread, n)) * 3]
            rows = spark.createDataFrame([(i, f"s{i:03}", m, 1) for i, m in enumerate(sizes)], "key int, source string, size long, n long")
            got = {r.source: r.target for r in mixing.targets(rows).collect()}
            expect = plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(n)], 1.5, 2.0)
            assert [got[f"s{i:03}"] for i in range(n)] == pytest.approx(expect, rel=1e-9)
            assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))
    rows = spark.createDataFrame([(1, "a", 10, 1)], "key int, source string, size long, n long")
    assert mixing.targets(rows, share=3.0).first().target == 20.0
    with pytest.raises(ValueError):
        mixing.targets(rows, weights=(1, 0))


def test_every_source_comes_near_its_target(spark):
    d = "/root/testdata/sf0.1"
    by = queries.op11_mixing(spark, d).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"))
    off = [(r.taken - r.target) / r.target for r in by.collect()]
    assert max(map(abs, off)) < 0.06 and abs(sum(off)) / len(off) < 0.01


# Hard negatives


def plain_negatives(rows, positives=5, negatives=10):
    """All results for (vec_id, label, vector) rows, told apart by their place."""
    out = []
    for at, (a, label, v) in enumerate(rows):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for p, (i, lab, w) in enumerate(rows) if p != at]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            own = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(a, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(own[:negatives], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())


def test_negatives_query_against_plain_python(spark, sf_dir):
    rows = []
    for r in table(spark, sf_dir, "embeddings").orderBy("vec_id").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [math.floor(256 * float(x)) for x in r.embedding]))
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf_dir).collect())
    assert got == plain_negatives(rows)


@pytest.mark.parametrize("per_block", [8_192, 40])
def test_negatives_with_ties_repeats_and_hot_labels(spark, monkeypatch, per_block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", per_block)
    rng = np.random.default_rng(per_block)
    rows = [(i, int(i % 3 and rng.integers(0, 4)), rng.integers(-3, 4, 5).tolist()) for i in range(401)]
    rows += [(100, 0, [1, 1, 1, 1, 1]), (100, 0, [1, 1, 1, 1, 1]), (7, 1, [0] * 5), (200, 9, [3] * 5), (500, 2, [0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, v array<bigint>").withColumn("rid", F.lit("clash"))
    assert mined(df) == plain_negatives(rows)


def test_negatives_of_odd_tables(spark):
    rows = [(0, 1, [1, 2]), (None, 1, [1, 2]), (100, None, [1, 2]), (1, 1, None), (2, 1, [3]), (3, 2, []), (200, 2, [1]), (4, 2, [0, 1])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, v array<bigint>")
    plain = [(0, 1, [1, 2]), (2, 1, [3, 0]), (3, 2, [0, 0]), (200, 2, [1, 0]), (4, 2, [0, 1])]
    assert mined(df) == plain_negatives(plain)
    assert mined(df.where("false")) == [] and mined(df.where("vec_id = 0")) == []
    large = spark.createDataFrame([(0, 1, [2**40]), (1, 1, [2**40])], "vec_id bigint, label int, v array<bigint>")
    with pytest.raises(Exception, match="OverflowError"):
        mined(large)


def test_windows_hold_whole_scores():
    for p in (-7, -1, 0, 1, 3, 10, 33):
        low, high = hard_negatives.window(p, 30, 90)
        assert [s for s in range(-20, 60) if 30 * p <= 100 * s <= 90 * p] == list(range(low, high + 1))


def test_threshold_stops_before_all_rows_are_met():
    """On vectors with falling components far fewer rows are looked up than there are, and none is missed."""
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((4000, 16)) * 300 / np.arange(1, 17) ** 2).astype(np.int64)
    lists = hard_negatives.SortedLists(x, np.arange(4000), np.arange(4000))
    met = []
    for i in range(0, 4000, 200):
        best, n = hard_negatives._Best(5), 0
        for rows, scores, threshold in lists.stretches(x[i]):
            n += len(rows)
            best.add(scores[rows != i], rows[rows != i])
            if best.done(threshold):
                break
        met.append(n)
        expect = sorted((-int(x[j] @ x[i]), j) for j in range(4000) if j != i)[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == expect
    assert np.median(met) < 2000
