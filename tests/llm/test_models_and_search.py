"""Classifiers, language models, search, licence scans and the pipeline against brute force and held-out labels."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonolog.llm import grams, langid, licenses, packing, quality, queries, topk, toxicity
from sonolog.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "a"), (None, "some words here"), (4, "same"), (4, "same"), (5, "ab " * 60000), (6, "\U0001f642 x")]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    names = ("key", "__key", "__id", "__toxic", "row", "toxic_score", "__part", "__position", "__bits", "n", "loss", "gram")
    odd = odd.withColumn("score", F.lit("clash")).withColumns({c: F.lit(f"own {c}") for c in names})
    return odd.withColumn("a map", F.create_map(F.lit("x"), F.col("doc_id")))


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


# Search


def plain_search(rows, k):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_search_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in table(spark, sf_dir, "embeddings").collect()]
    got = sorted(tuple(r) for r in queries.op1_exact_topk(spark, sf_dir).collect())
    assert got == plain_search(rows, 5)


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    return df.where(topk.usable()).select("vec_id", topk.quantised().alias("v"))


def plain_rows(rows, k):
    """Like ``plain_search``, but rows are told apart by their place."""
    out = []
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for p, (i, w) in enumerate(rows) if p != at)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_search_ties_repeats_and_bad_vectors(spark):
    """Rows with the same id, and the same content, are all candidates; only a query's own row is not."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (50, [0.5, 0.5]), (7, [1.0, -1.0]), (3, [1.0, -1.0]), (3, [1.0, -1.0]), (9, [0.0, 0.0]), (0, [2.0])]
    rows += [(100, None), (11, [nan, 1.0]), (12, [inf, 1.0]), (13, [None, 1.0]), (None, [1.0, 1.0]), (50, []), (3, [-1.0, 1.0])]
    vectors = vectors_of(spark, rows)
    got = sorted(tuple(r) for r in topk.search(vectors, F.col("vec_id") % 50 == 0, 5).collect())
    plain = [(0, [256, -256]), (50, [128, 128]), (7, [256, -256]), (3, [256, -256]), (3, [256, -256]), (9, [0, 0]), (0, [512, 0])]
    plain += [(50, [0, 0]), (3, [-256, 256])]
    assert got == plain_rows(plain, 5)
    assert topk.search(vectors.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-4, 5, 6).tolist()) for i in range(150)] + [(50, [9, 9, 9, 9, 9, 9])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 7).collect())
    assert got == plain_rows(rows, 7)


def test_search_is_exact_for_large_components_and_refuses_larger_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-(2**29), 2**29, 8)]) for i in range(200)]
    rows += [(1000 + i, [x + (d == i) for d, x in enumerate(rows[0][1])]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == plain_rows(rows, 5)
    large = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 1])], "vec_id bigint, v array<bigint>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.search(large, F.col("vec_id") % 50 == 0, 5).collect()


def index_of(x):
    return topk.ImpactIndex(x, np.arange(len(x)), np.arange(len(x)))


def test_search_stops_early_on_vectors_of_unequal_impact():
    """Few large components decide: most queries stop before the last segments, with the right rows."""
    rng = np.random.default_rng(3)
    heavy = rng.integers(-3, 4, (900, 64))
    heavy[np.arange(900), rng.integers(0, 64, 900)] = 120 + rng.integers(0, 9, 900)
    falling = (rng.standard_normal((900, 64)) * 400 / np.arange(1, 65) ** 1.5).astype(np.int64)
    for x in (heavy, falling):
        places, scores, read = index_of(x).search(x[::50], np.arange(0, 900, 50), 5)
        expect = plain_search([(i, x[i].tolist()) for i in range(900)], 5)
        got = [(50 * q, r, p, s) for q in range(18) for r, (p, s) in enumerate(zip(places[q].tolist(), scores[q].tolist(), strict=True), 1)]
        assert sorted(got) == expect
        assert (read < 0.99).mean() > 0.8


def test_search_of_any_vectors_in_any_number_of_levels(monkeypatch):
    rng = np.random.default_rng(4)
    for levels in (1, 3, 8):
        monkeypatch.setattr(topk, "LEVELS", levels)
        for n, dims, top in ((1, 3, 2), (4, 1, 1), (60, 5, 2), (300, 9, 50), (40, 4, 0)):
            x = rng.integers(-top, top + 1, (n, dims))
            places, scores, _ = index_of(x).search(x, np.arange(n), 4)
            for i in range(n):
                own = sorted((-int(x[j] @ x[i]), j) for j in range(n) if j != i)[:4]
                assert list(zip((-scores[i]).tolist(), places[i].tolist(), strict=True)) == own


# Toxicity


def test_toxicity_on_held_out_documents(spark):
    got = queries.op6_toxicity(spark, LARGER).join(table(spark, LARGER, "labels"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * n[0, 0]


def test_labels_of_held_out_rows_are_not_learned(spark, sf_dir, labels):
    docs = table(spark, sf_dir, "documents")
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_scores_are_the_sums_of_the_features():
    model = toxicity.Model({"bad.": 1.0, "badw": 0.5, "badw2": 0.25, "badwo3": 2.0, "badword": -0.5}, -1.0, 0.1)
    for text in ("bad", "badwolf badword", "badwoa badwob badwoc Bad", "", "nothing", None):
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(text or ""))
        assert toxicity._score_texts(model, [text])[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_odd_rows(spark, odd_docs, labels):
    none = labels.where("false")
    model = toxicity.train(odd_docs, none)
    got = toxicity.score(odd_docs, model, name="found").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.found <= 1 for r in got)
    kept = toxicity.keep(odd_docs, none)
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    assert toxicity.keep(odd_docs.where("false"), labels).count() == 0
    strange = spark.createDataFrame([(3, 1), (3, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    assert toxicity.keep(odd_docs, strange).columns == odd_docs.columns


def test_risk_takes_the_hidden_positives_off():
    """Half of the unlabelled texts with the feature are positives; the model must not learn them as negatives."""
    positive = np.array([True] * 50 + [False] * 500)
    present = np.r_[np.arange(50), np.arange(50, 150)]
    w, bias = toxicity.fit_nnpu(present, np.zeros(150, int), positive, 1, 0.2)
    assert w[0] + bias > 0 > bias


def test_fit_against_a_plain_gradient_run():
    """The risk's gradient taken by differences of a plain sum over examples, and the same steps by hand."""
    rng = np.random.default_rng(7)
    texts = [sorted(set(rng.integers(0, 4, rng.integers(0, 4)).tolist())) for _ in range(30)]
    positive = np.array([i < 8 for i in range(30)])
    prior, decay, rate = 0.3, 3e-4, 0.1

    def parts(w):
        z = [w[4] + sum(w[f] for f in own) for own in texts]
        plus = sum(math.log1p(math.exp(-z[i])) for i in range(8)) / 8
        minus_p = sum(math.log1p(math.exp(z[i])) for i in range(8)) / 8
        minus_u = sum(math.log1p(math.exp(z[i])) for i in range(8, 30)) / 22
        return prior * plus, minus_u - prior * minus_p

    def slope(f, w):
        h = 1e-6
        return np.array([(f(w + h * e) - f(w - h * e)) / (2 * h) for e in np.eye(5)])

    w, m, v = np.array([0, 0, 0, 0, math.log(prior / (1 - prior))]), np.zeros(5), np.zeros(5)
    turned = 0
    for t in range(1, 61):
        if parts(w)[1] >= 0:
            g = slope(lambda x: sum(parts(x)), w)
        else:
            g, turned = -slope(lambda x: parts(x)[1], w), turned + 1
        g[:4] += decay * w[:4]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    rows = np.repeat(np.arange(30), [len(x) for x in texts])
    columns = np.array([f for x in texts for f in x])
    got, bias = toxicity.fit_nnpu(rows, columns, positive, 4, prior, steps=60, rate=rate, decay=decay)
    assert np.append(got, bias) == pytest.approx(w, abs=1e-3)


def test_one_text_to_a_sampled_id(spark, labels):
    """An id that holds most rows is fitted with one text, so that it outweighs no other."""
    rows = [(1, "vile awful")] * 500 + [(1, f"other {i}") for i in range(100)] + [(i, f"kind words {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(1, 60)], "doc_id bigint, toxic int")
    once = docs.where("doc_id > 1").union(docs.where("doc_id = 1").orderBy(F.sha2("text", 256)).limit(1))
    assert toxicity.train(docs, marks) == toxicity.train(once, marks)


# Quality


def plain_kn(trusted, texts):
    """Interpolated modified Kneser-Ney over dictionaries; mean negative log probabilities."""
    pad = chr(grams.START) * 3
    counts = [Counter() for _ in range(5)]
    for t in trusted:
        t = pad + t
        counts[4].update(t[i - 3 : i + 1] for i in range(3, len(t)))
    for order in (3, 2, 1):
        counts[order].update(g[1:] for g in counts[order + 1])
    d, back, total = {}, defaultdict(float), defaultdict(int)
    for order in (4, 3, 2, 1):
        n = [sum(c == i for c in counts[order].values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d[order] = []
        for i in (1, 2, 3):
            x = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else i * y
            d[order].append(min(max(x, 0.05), i - 0.05))
        for g, c in counts[order].items():
            total[order, g[:-1]] += c
            back[order, g[:-1]] += d[order][min(c, 3) - 1]
    uniform = 1 / (len(counts[1]) + 1)

    def p(g):
        order = len(g)
        lower = p(g[1:]) if order > 1 else uniform
        s = total.get((order, g[:-1]))
        if not s:
            return lower
        c = counts[order].get(g, 0)
        return max(0, c - d[order][min(c, 3) - 1] if c else 0) / s + back[order, g[:-1]] / s * lower

    out = []
    for t in texts:
        t = pad + t
        out.append(-sum(math.log(p(t[i - 3 : i + 1])) for i in range(3, len(t))) / (len(t) - 3) if len(t) > 3 else None)
    return out


def test_perplexity_against_plain_model(spark, sf_dir, labels):
    docs = table(spark, sf_dir, "documents")
    trusted = {r.doc_id for r in quality.trusted_ids(labels).where("not held_out").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expect = dict(zip([i for i, _ in rows], plain_kn([t for i, t in rows if i in trusted], [t for _, t in rows]), strict=True))
    for r in queries.op3_quality(spark, sf_dir).collect():
        assert math.log(r.perplexity) == pytest.approx(expect[r.doc_id], abs=1e-9)


def test_quality_agrees_with_labels(spark):
    got = queries.op3_quality(spark, LARGER).join(table(spark, LARGER, "labels"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.85 * (n[0, False] + n.get((0, True), 0))


def test_quality_odd_rows(spark, odd_docs, labels):
    none = labels.where("false")
    got = quality.assess(odd_docs, none).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_docs.collect())
    assert {r.doc_id for r in got if not r.kept} == {1, 2}
    kept = quality.keep(odd_docs, none)
    whole = odd_docs.where("doc_id is null or doc_id > 2")
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))
    some = spark.createDataFrame([(4, 1), (5, 1), (3, 0), (6, None), (None, 1)], "doc_id bigint, quality int")
    assert quality.assess(odd_docs, some).count() == odd_docs.count()
    assert quality.keep(odd_docs.where("false"), labels).count() == 0


def known_losses(monkeypatch, spark, rows, more=None, wanted="true"):
    """``assess`` over rows of ``doc_id, lang, n, loss``, all trusted but those with a negative id."""
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, size int, given double")
    docs = docs.union(more) if more else docs
    found = docs.select(grams.row_identity(docs).alias("key"), F.col("size").alias("n"), F.col("given").alias("loss"))
    monkeypatch.setattr(quality, "perplexities", lambda *args: found)
    labels = docs.where("doc_id > 0").select("doc_id", F.lit(1).alias("quality"))
    return {r.doc_id: r for r in quality.assess(docs, labels).where(wanted).collect()}


def test_small_language_has_its_own_bounds(spark, monkeypatch):
    """Held out: about 50,000 texts in one language and 40 in another, whose clean texts are all less likely."""
    rng = np.random.default_rng(2)
    rows = [(300000 + i, "small", 500, float(rng.normal(3.0, 0.05))) for i in range(200)]
    rows += [(-1, "small", 500, 3.0), (-2, "small", 500, 1.5), (-3, "big", 500, 3.0), (-4, "big", 500, 1.5), (-5, None, 500, 1.5)]
    big = spark.range(1, 250001).select("id", F.lit("big"), F.lit(500), 1.5 + 0.05 * F.randn(1)).checkpoint()
    got = known_losses(monkeypatch, spark, rows, big, "doc_id < 0")
    assert [got[-i].kept for i in range(1, 6)] == [True, False, False, True, True]


def test_short_junk_is_judged_by_short_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "en", 2000, float(rng.normal(1.6, 0.05))) for i in range(1, 3001)]
    rows += [(5000 + i, "en", 50, float(rng.normal(1.8, 0.1))) for i in range(600)]
    rows += [(-1, "en", 50, 1.9), (-2, "en", 50, 2.4), (-3, "en", 2000, 1.9), (-4, "en", 2000, 1.65)]
    got = known_losses(monkeypatch, spark, rows)
    assert [got[-i].kept for i in range(1, 5)] == [True, False, False, True]
    clean = [r.kept for i, r in got.items() if i > 0]
    assert sum(clean) >= 0.98 * len(clean)


# Language


def test_pages_have_the_language_of_their_address(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]+/(en|de|fr|es)/", 1).alias("path"))
    got = queries.op5_language(spark, sf_dir)
    assert got.count() == pages.count()
    joined = got.join(pages, "page_id").where("path <> ''")
    assert joined.where("lang = path").count() >= 0.97 * joined.count()


def plain_language(pages, docs):
    """Language and posterior of every page, from dictionaries."""
    import re

    pad = chr(grams.START) * 3

    def units(text):
        raw = (pad + text).encode("utf-16-le")
        return [raw[i : i + 8] for i in range(0, len(raw) - 6, 2)]

    names = sorted(x for x, n in Counter(lang for _, lang in docs).items() if x is not None and n >= 5)
    counts = {x: Counter() for x in names}
    for text, lang in docs:
        if lang in counts:
            counts[lang].update(units(text or ""))
    seen, totals = len(set().union(*counts.values())), {x: sum(c.values()) for x, c in counts.items()}

    def best(scores):
        return max(names, key=lambda x: (scores[x], -names.index(x)))

    rows = []
    for page, url, html in pages:
        html, url = html or "", url or ""
        body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
        text = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", body), flags=re.ASCII).strip(" ")
        tag = re.search(r"""<html\b[^>]*?\slang\s*=\s*["']?([a-z]+)""", html, re.I | re.S)
        place = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url, re.I)
        host = place.group(1).lower() if place else ""
        like = {
            x: sum(math.log((counts[x][g] + 0.1) / (totals[x] + 0.1 * (seen + 1))) for g in units(text)) for x in names
        }
        labels = host.split(".")
        rows.append((page, like, best(like), tag.group(1).lower() if tag else "", labels[-1], host, ".".join(labels[-2:])))
    of = {i: defaultdict(Counter) for i in (3, 4, 5, 6)}
    for r in rows:
        for i in of:
            of[i][r[i]][r[2]] += 1
    whole = Counter(r[2] for r in rows)
    everywhere = {x: (whole[x] + 1) / (len(rows) + len(names)) for x in names}
    out = {}
    for r in rows:
        score = {}
        for x in names:
            host, domain = of[5][r[5]], of[6][r[6]]
            up = (domain[x] + 5 * everywhere[x]) / (sum(domain.values()) + 5)
            prior = math.log((host[x] + 5 * up) / (sum(host.values()) + 5))
            marks = [math.log((of[i][r[i]][x] + 0.1) / (whole[x] + 0.1 * (len(of[i]) + 1))) for i in (3, 4)]
            score[x] = 0.25 * r[1][x] + sum(marks) + prior
        top = best(score)
        out[r[0]] = (top, 1 / sum(math.exp(s - score[top]) for s in score.values()), r[2], r[3], r[4], r[5])
    return out


def test_languages_against_a_plain_version(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in table(spark, sf_dir, "pages").collect()]
    docs = [(r.text, r.lang) for r in table(spark, sf_dir, "documents").collect()]
    expect = plain_language(pages, docs)
    got = queries.op5_language(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        lang, posterior, *rest = expect[r.page_id]
        assert (r.lang, r.text_lang, r.declared, r.suffix, r.host) == (lang, *rest)
        assert r.posterior == pytest.approx(posterior, rel=1e-6)


def test_gram_sums_against_plain_likelihoods(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = langid.language_names(docs)
    counts = {x: Counter() for x in names}
    pad = chr(grams.START) * 3
    for r in docs.collect():
        t = pad + r.text
        counts[r.lang].update(t[i - 3 : i + 1] for i in range(3, len(t)))
    seen = len(set().union(*counts.values()))
    texts = spark.createDataFrame([("1", "the and of"), ("2", ""), ("3", "ñandú \U0001f642")], "key string, text string")
    wanted = grams.block_grams(texts).select("gram").distinct()
    got = {r.key: r for r in grams.sums(texts, langid.gram_likelihoods(docs, names, wanted), len(names)).collect()}
    units = [pad[0]] * 3 + list("the and of")
    for k, name in enumerate(names):
        own = counts[name]
        total = sum(own.values())
        expect = sum(
            math.log((own["".join(units[i - 3 : i + 1])] + langid.ALPHA) / (total + langid.ALPHA * (seen + 1)))
            for i in range(3, len(units))
        )
        assert got["1"].total[k] == pytest.approx(expect)
    assert got["2"].n == 0 and list(got["2"].total) == [0.0] * len(names) and got["3"].n == 8


def test_language_odd_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(1, None, None), (None, "x", "<html lang='DE-at'>"), (2, "http://a.de/x", ""), (2, "http://a.de/x", "")]
    rows += [(3, "https://u@h.example.fr:80/?q", '<HTML class=a LANG="fr"><script>en</script><p>le la de et en que</p>')]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("lang", F.lit("clash"))
    got = langid.identify(pages, docs).collect()
    assert Counter(r.page_id for r in got) == Counter([1, None, 2, 2, 3])
    three = next(r for r in got if r.page_id == 3)
    assert (three.lang, three.declared, three.suffix, three.host) == ("fr", "fr", "fr", "h.example.fr")
    assert all(0 < r.posterior <= 1 + 1e-9 for r in got)
    assert next(r for r in got if r.page_id is None).declared == "de"
    assert langid.identify(pages.where("false"), docs).count() == 0
    assert {r.lang for r in langid.identify(pages, docs.where("false")).collect()} == {None}


def test_a_language_beside_a_thousand_times_larger_one_is_known(spark):
    small = [(i, f"zyx wvu qpo zyx{i} tsr wvu qpo", "xx") for i in range(8)]
    docs = spark.range(9000).select("id", F.concat(F.lit("the and of some words "), F.col("id").cast("string")), F.lit("en"))
    docs = docs.union(spark.createDataFrame(small, "id bigint, text string, lang string")).toDF("doc_id", "text", "lang")
    pages = [(1, "http://a.example/", "<p>tsr wvu qpo zyx wvu</p>"), (2, "http://b.example/", "<p>some of the words and</p>")]
    got = langid.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), docs)
    assert {r.page_id: r.lang for r in got.collect()} == {1: "xx", 2: "en"}


# Licences


def test_licences_in_the_documents(spark, sf_dir):
    got = {(r.doc_id, r.template) for r in queries.op9_licenses(spark, LARGER).collect()}
    low = {r.doc_id: " ".join(licenses.WORD.findall(r.text.lower())) for r in table(spark, LARGER, "documents").collect()}
    whole = {(i, n) for n, t in licenses.TEMPLATES.items() for i, x in low.items() if " ".join(licenses.WORD.findall(t.lower())) in x}
    assert whole and whole <= got
    assert len(got - whole) <= 0.02 * len(got) + 2


def test_patience_alignment():
    assert licenses.longest_increasing([3, 1, 2, 9, 4]) == [1, 2, 4]
    assert licenses.aligned("a b c d e".split(), "a b c d e".split()) == 5
    assert licenses.aligned("a x b y c".split(), "a b c".split()) == 3
    assert licenses.aligned("c b a".split(), "a b c".split()) == 1
    assert licenses.aligned("a a b b".split(), "a b a b".split()) == 3
    assert licenses.aligned([], ["a"]) == 0


def test_licences_odd_rows(spark, odd_docs):
    assert licenses.scan(odd_docs).count() == 0
    notice = licenses.TEMPLATES["mit"]
    near = "x " * 5000 + "Released now under the MIT License. " + "y " * 5000 + notice
    rows = [(1, f"{notice}\n{notice}"), (None, near), (2, "released under the"), (3, notice.upper()), (3, notice.upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("template", F.lit("clash"))
    got = [(r.doc_id, r.template, r.coverage, r.stretches) for r in licenses.scan(df).collect()]
    assert Counter(got) == Counter([(1, "mit", 1.0, 1), (None, "mit", 1.0, 2), (3, "mit", 1.0, 1), (3, "mit", 1.0, 1)])
    assert licenses.scan(df, {"none": "..."}).count() == 0


# Written independently of the templates: reworded, cut and broken up.
INDEPENDENT = {
    "mit text": """Permission is granted hereby, free of charge, to any person who obtains a copy of this library and associated
        documentation files, to deal in the Software with no restriction, including the rights to use, copy, modify, merge,
        publish, distribute, sublicense and/or sell copies of it, and to permit persons to whom the Software is
        furnished to do so, subject to the following: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NON-INFRINGEMENT. IN NO EVENT SHALL JANE DOE BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR ITS USE.""",
    "isc text": """Permission to use, copy, modify, and/or distribute this code for any purpose with or without fee is hereby
        granted, provided that the above notice and this permission notice appear in all copies. # THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. # IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OF THIS SOFTWARE.""",
    "gpl-2.0 header": """# This file is free software; you can redistribute it and/or modify
        # it under the terms of the GNU General Public License as published by
        # the Free Software Foundation; version 2 of the License, or any later version.
        # It is distributed in the hope that it will be useful, WITHOUT ANY WARRANTY; without even
        # the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License.""",
    "apache-2.0 header": """Licensed under the Apache License, Version 2.0; you may not use this module except in compliance with the
        License. You may get a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 . Unless required by law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, express or implied. See the License for the language governing permissions and limitations.""",
    "mpl-2.0": "All code here is released under the Mozilla Public Licence, version 2.0, unless stated.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License (LGPL), version 2.1 only.",
    "agpl-3.0": "The server is licensed under the GNU Affero General Public License, version 3.",
    "bsd-3-clause": "Released under the 3-clause BSD license: released under the BSD 3 clause licence.",
    "unlicense": "Everything is released under the Unlicense, really.",
    "spdx:bsd-2-clause": "// SPDX-License-Identifier: (BSD-2-Clause OR GPL-2.0-only WITH Classpath-exception-2.0) and prose",
}


def test_licences_of_general_wordings(spark):
    rows = list(enumerate(f"Intro words. {t} Last words." for t in INDEPENDENT.values()))
    found = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        found[r.doc_id].add(r.template)
    for i, name in enumerate(INDEPENDENT):
        assert name in found[i], (name, found[i])
    assert found[2] <= {"gpl-2.0 header", "gpl-2.0"} and found[5] == {"lgpl-2.1"} and found[6] == {"agpl-3.0"}
    assert found[9] == {"spdx:bsd-2-clause", "spdx:gpl-2.0-only"}


def test_near_wordings_are_told_apart():
    finder = licenses.Finder(licenses.WORDINGS, licenses.COVERAGE)

    def names(text):
        return {m[0] for m in finder.find(text)}

    assert names("Released under the BSD License.") == {"bsd"}
    assert names("Licensed under CC BY 4.0.") == {"cc-by-4.0"}
    assert names("This work is licensed under the GNU General Public License, version 2.") == {"gpl-2.0"}
    for name, _, text in licenses.WORDINGS:
        extra = {x.split()[0] for x in names(f"a b c. {text} d e f.")} - {name.split()[0]}
        assert not extra or name.startswith("bsd-") and extra <= {"bsd", "bsd-2-clause"}, (name, extra)


# Pipeline


def test_pipeline_against_its_stages_done_plainly(spark, sf_dir):
    """Every stage's decisions, taken anew from the operators' own verdicts on plain rows."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    for i, s in zip(rows, toxicity._score_texts(model, [r.text for r in rows.values()]), strict=True):
        rows[i] = None if s >= toxicity.THRESHOLD else rows[i]
    rows = {i: r for i, r in rows.items() if r is not None}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    verdict = {r.doc_id: r.kept for r in quality.assess(left, labels).collect()}
    rows = {i: r for i, r in rows.items() if verdict[i]}
    last = {}
    for i, r in rows.items():
        last[r.text.lower() if r.text.isascii() else r.text] = i
    rows = {i: r for i, r in rows.items() if i in set(last.values())}
    from test_dedup_and_sharding import brute_classes

    roots = brute_classes([(i, r.text) for i, r in rows.items()])
    expect = {i for i in rows if roots[i] == i}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == expect and 0 < len(expect) < docs.count()
    assert max(Counter(r.sequence_id for r in got).values()) > 1
    lengths = Counter()
    for r in got:
        lengths[r.sequence_id] += r.length
    assert max(lengths.values()) <= packing.CAPACITY


def test_stages_return_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality classifier", "exact dedup", "near dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema
