"""Exact and near deduplication, sharding: SQL, brute force, odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

from sonolog.llm import exact_dedup, near_dedup, queries, sharding
from sonolog.llm.common import hot_join, table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql(spark, con, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    verdict = compare(got, con.execute(queries.ORACLES[name]).fetchdf())
    assert verdict.startswith("ok"), verdict


@pytest.fixture(scope="module")
def odd_docs(spark):
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    near = " ".join([*words[:58], "x", "y"])
    far = " ".join([*words[:30], *[f"z{i}" for i in range(30)]])
    rows = [
        (1, None), (2, ""), (3, "Abc É"), (4, "abc É"), (4, "abc É"), (None, "abc É"), (None, "only null"), (5, "abc é"),
        (10, base), (11, base.upper()), (12, near), (13, far), (14, "two words"), (15, "two  WORDS"), (16, "w " * 30000),
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("winner", "__key", "__id", "row", "node")})
    return docs.withColumn("a map", F.create_map(F.lit("x"), F.col("doc_id")))


def test_exact_verdicts_on_odd_rows(spark, odd_docs):
    got = Counter(tuple(r) for r in exact_dedup.verdicts(odd_docs).collect())
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[(r.text or "").translate(low)].append(r.doc_id)
    expect = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        for i in ids:
            expect[i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == expect
    kept = exact_dedup.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, None, 5, 10, 11, 12, 13, 14, 15, 16]) - Counter([10])


def test_exact_all_of_one_text(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("Same").alias("text"))
    got = exact_dedup.verdicts(rows)
    assert got.where("kept").collect()[0].doc_id == 499
    assert got.where("keep_id = 499 and group_size = 500").count() == 500
    assert exact_dedup.keep(rows).count() == 1


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 4), dtype=np.int64).astype(np.uint64)
    sizes, bits = exact_dedup.build_levels(keys)
    assert sorted(exact_dedup.slots_of(keys, sizes, bits)) == list(range(5000))
    others = rng.integers(0, 1 << 63, (5000, 4), dtype=np.int64).astype(np.uint64)
    held = np.empty_like(keys)
    held[exact_dedup.slots_of(keys, sizes, bits)] = keys
    slot = exact_dedup.slots_of(others, sizes, bits)
    assert (slot >= 0).any() and not ((slot >= 0) & (held[slot] == others).all(axis=1)).any()


def test_history_of_any_size_gives_the_same_groups(spark, odd_docs):
    rows = odd_docs.select("doc_id", exact_dedup.digest().alias("digest")).checkpoint()
    expect = None
    for history in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))):
        found = exact_dedup.groups_of(rows, history).select("digest", "winner", "n").collect()
        now = Counter((bytes(r.digest), r.winner, r.n) for r in found)
        expect = expect or now
        assert now == expect


def test_hot_join_keeps_all_rows(spark):
    left = spark.range(9000).select("id", F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 1500).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    assert hot_join(left, right, "k", counted="n").count() == 9000
    assert hot_join(left, right.drop("n"), "k").count() == 9000


def brute_classes(docs):
    """Smallest id of each connected class of texts with overlap of 0.8 or more, by comparing all pairs."""
    sets = [(i, Counter(map(int, np.repeat(*near_dedup.shingles(near_dedup.word_hashes(t or "")))))) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            either = sum((a | b).values())
            if (sum((a & b).values()) / either if either else 1) >= near_dedup.SIMILARITY:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_near_classes_against_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r.class_id for r in queries.op4_near_dedup(spark, sf_dir).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_near_on_odd_rows(spark, odd_docs):
    got = near_dedup.find(odd_docs).collect()
    assert len(got) == odd_docs.count()
    classes = defaultdict(Counter)
    for r in got:
        classes[r.class_id][r.doc_id] += 1
    assert set(classes[10]) == {10, 11, 12} and set(classes[13]) == {13} and set(classes[14]) == {14, 15}
    assert set(classes[1]) == {1, 2} and classes[3] == Counter({3: 1, 4: 2, None: 1, 5: 1})
    kept = near_dedup.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 10, 13, 14, 16, None])


def test_links_are_named_as_what_was_verified(spark):
    rows = [(1, "a b c d e f g"), (2, "other words")]
    got = near_dedup.find(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.columns == ["doc_id", "class_id", "class_size", "verified_links", "kept"]


def test_near_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, f"tail{i}"])) for i in range(300)] + [(1000 + i, f"own{i} " * 9) for i in range(50)]
    got = near_dedup.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0}
    assert all(r.class_id == r.doc_id for r in got if r.doc_id >= 1000)


def test_chain_of_links_is_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)]
    got = {r.doc_id: r.class_id for r in near_dedup.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows) and set(got.values()) == {0}


def test_points_of_an_element_are_bit_equal_in_all_bags():
    rng = np.random.default_rng(5)
    unlike = lost = 0
    for light, high, low in ((300, 2000, 1620), (40, 1000, 820), (60, 500, 405), (3, 9000, 9000)):
        for _ in range(15):
            elements = rng.integers(0, 1 << 63, light + 5).astype(np.uint64)
            a = near_dedup.bag_minhash(elements[: light + 1], np.r_[high, np.ones(light, np.int64)])
            b = near_dedup.bag_minhash(elements, np.r_[low, np.ones(light + 4, np.int64)])
            close = np.isclose(a, b, rtol=1e-11, atol=0)
            assert close.any()
            unlike += int((a[close] != b[close]).sum())
            lost += not (near_dedup.bands(a) == near_dedup.bands(b)).any()
    assert (unlike, lost) == (0, 0)


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(7)
    elements = rng.integers(0, 1 << 62, 120, dtype=np.int64).astype(np.uint64)
    agree, expect = [], []
    for trial in range(20):
        a = rng.integers(0, 9, 120)
        b = np.where(rng.random(120) < 0.5, a, rng.integers(0, 9, 120))
        shift = np.uint64(trial + 1)
        sa = near_dedup.bag_minhash(near_dedup.mix(elements[a > 0] + shift), a[a > 0])
        sb = near_dedup.bag_minhash(near_dedup.mix(elements[b > 0] + shift), b[b > 0])
        agree.append((sa == sb).mean())
        expect.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(expect)) < 0.02


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.verdicts(empty).count() == 0 and exact_dedup.keep(empty).count() == 0
    assert near_dedup.find(empty).count() == 0 and near_dedup.keep(empty).count() == 0
    assert sharding.shard_documents(empty, [1.0] * 4).count() == 0


def test_shards_follow_weights_and_growth(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"))
    weights = [1.0, 2.0, 1.0, 0.0]
    before = {r.doc_id: r.shard for r in sharding.assign(keys, "doc_id", weights).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(keys, "doc_id", [*weights, 1.0]).collect()}
    sizes = Counter(before.values())
    assert sizes[3] == 0 and abs(sizes[1] - 2000) < 150 and abs(sizes[0] - 1000) < 150
    assert {after[k] for k in after if after[k] != before[k]} == {4}
    with pytest.raises(ValueError):
        sharding.best_shard(F.lit("k"), [0.0])


def test_sharding_odd_rows(spark, odd_docs):
    repeated = odd_docs.unionByName(odd_docs)
    got = sharding.shard_documents(repeated, [1.0] * 3).collect()
    assert len(got) == repeated.count()
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1


def test_sharding_runs_no_python(spark, sf_dir):
    text = queries.op7_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_marks_never_prove_a_link_apart(spark):
    """The bound from marked classes against true overlaps, also where the numbers of classes differ."""
    import numpy as np

    from sonolog.llm import near_dedup

    rng = np.random.default_rng(3)
    rows, truth = [], []
    for size in (3, 127, 129, 260, 1030, 3000):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for change in (0.0, 0.05, 0.11, 0.3, 0.6):
            n = int(size * change)
            b = np.concatenate([a[n:], rng.integers(0, 1 << 63, n + int(size * change / 4)).astype(np.uint64)])
            bags = [np.unique(x, return_counts=True) for x in (a, b)]
            sizes = [int(x[1].sum()) for x in bags]
            marked = [near_dedup.marks(x[0], n).tolist() for x, n in zip(bags, sizes, strict=True)]
            rows.append((len(rows), sizes[0], marked[0], sizes[1], marked[1]))
            truth.append(near_dedup.overlap(*bags))
    df = spark.createDataFrame(rows, "i int, size int, marks array<bigint>, size_ int, marks_ array<bigint>")
    got = {r.i: r.room for r in df.select("i", near_dedup.room("size", "marks", "size_", "marks_").alias("room")).collect()}
    assert all(got[i] for i, t in enumerate(truth) if t >= 0.8)
    assert not any(got[i] for i, t in enumerate(truth) if t < 0.5 and rows[i][1] > 100)
    assert len({(len(r[2]), len(r[4])) for r in rows if len(r[2]) != len(r[4])}) > 0


def test_components_do_not_carry_ever_larger_estimates(spark, capsys):
    """The size that Spark expects of the classes stays that of a table, however many rounds and calls there were."""
    steps = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in steps], "a binary, b binary")
    for _ in range(3):
        roots = near_dedup.components(edges)
        more = roots.join(roots.toDF("other", "root"), "root").select(F.col("node").alias("a"), F.col("other").alias("b"))
        edges = edges.unionByName(more.where("a < b"))
    assert {(r.node, r.root) for r in roots.collect()} == {(bytes([i]), bytes([0])) for i in range(41)}
    capsys.readouterr()
    roots.explain("cost")
    powers = [int(x) for x in re.findall(r"sizeInBytes=[\d.]+E\+(\d+)", capsys.readouterr().out)]
    assert max(powers, default=0) < 40


def test_a_worker_keeps_the_store_of_one_step_only(spark):
    """Workers are used again by later steps; words and their ids of earlier ones must not stay in them."""
    from sonolog.llm import common, toxicity

    near_dedup.word_hashes("some words of a text")
    assert len(common.kept("word hashes", dict)) == 5
    common.kept("another step", dict)["x"] = 1
    near_dedup.word_hashes("some words")
    assert len(common.kept("word hashes", dict)) == 2
    assert common.kept("another step", dict) == {}
    common.kept("another step", dict)["x"] = 1
    list(toxicity._counts(iter([])))
    assert common.kept("another step", dict) == {}


def test_near_dedup_drops_the_results_of_its_steps(spark, tmp_path, monkeypatch):
    """Signatures, marks, texts, edges and labels go; ids, nodes and classes stay."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:38], f"x{i % 3}", f"y{i % 3}"] if i % 2 else [f"z{i}{w}" for w in words])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "scratch_path", lambda _, name: str(tmp_path / name))
    assert {r.doc_id for r in near_dedup.keep(docs).collect()} == {1, *range(0, 20, 2)}
    assert {p.parent.name for p in tmp_path.rglob("part-*.parquet")} == {"rows", "classes"}


def test_a_bucket_has_a_pivot_with_its_own_size_and_root(spark):
    rows = [(1, b"a", 10, b"a"), (1, b"b", 11, b"a"), (1, b"c", 12, b"a"), (2, b"a", 10, b"a"), (2, b"b", 11, b"a")]
    members = spark.createDataFrame(rows, "band bigint, node binary, size bigint, first binary")
    roots = spark.createDataFrame([(b"a", b"a"), (b"b", b"a")], "node binary, root binary")
    got = near_dedup.mixed(members, roots).collect()
    assert {(r.band, bytes(r.node)) for r in got} == {(1, b"a"), (1, b"b"), (1, b"c")}
    assert len({bytes(r.pivot) for r in got}) == 1
    assert {(r.size_, bytes(r.root_)) for r in got} <= {(10, b"a"), (11, b"a"), (12, b"c")}
