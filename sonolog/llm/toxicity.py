"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; all other training text is unlabelled, whatever its label. A
logistic model minimises ``prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))``: what toxic text
adds to the unlabelled risk is taken off, and where that would go below zero the step is turned
round. The features are the distinct words of a text, in lower case, and their beginnings, once, and again
where two or three words share one; those that tell positives from unlabelled best are kept. Scoring reads every whole text.

The model is fitted on a bounded sample of the labelled rows (``Bounds``, the smallest id hashes of each
kind, one text to an id); only features and examples within these bounds are brought together in one task.

Defined results: NULL and empty texts have no features and score what the bias gives; NULL ids have
no label; repeated labels count as toxic if one says so, NULL labels do not count; without any
positive, or any feature that tells them apart, the score is the prior's for all; an empty table gives no rows; other columns, whatever
their names, are not looked at and pass through ``keep`` as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, text_or_empty, unused

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
# A beginning that two or three of a text's words share is a feature of its own.
REPEATS = (2, 3)
# A feature must be this many times likelier among positives than among negatives, by this many deviations.
RATIO, DEVIATIONS = 10, 2
FOLDS = 5
THRESHOLD = 0.5
DEFAULT_PRIOR = 0.05


@dataclass(frozen=True)
class Bounds:
    """Most positives, unlabelled texts and features that the model is fitted on."""

    positives: int = 10_000
    unlabelled: int = 20_000
    features: int = 2_000
    least_texts: int = 5


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    prior: float


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % FOLDS


def features(text: str) -> set[str]:
    """Words (``word.``), beginnings, and beginnings shared by several words (``begin2``, ``begin3``)."""
    words = set(LETTERS.findall(text.lower()))
    found = {w + "." for w in words}
    for n in BEGINNINGS:
        for begin, times in Counter([w[:n] for w in words if len(w) >= n]).items():
            found.add(begin)
            found.update([f"{begin}{r}" for r in REPEATS if times >= r])
    return found


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forget()
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, positive in zip(batch["text"], batch["positive"], strict=True):
            seen[int(positive)].update(features(text))
    names = list(seen[0].keys() | seen[1].keys())
    if names:
        yield pd.DataFrame({"feature": names, "u": [seen[0][x] for x in names], "p": [seen[1][x] for x in names]})


def _chosen(sample: DataFrame, prior: float, positives: int, unlabelled: int, bounds: Bounds) -> list[str]:
    """The features whose share among positives is most clearly above that among the negatives.

    The negatives' share follows from the unlabelled one by taking off the prior's part.
    """
    counts = sample.mapInPandas(_counts, "feature string, u bigint, p bigint").groupBy("feature").agg(
        F.sum("u").alias("u"), F.sum("p").alias("p")
    )
    unlabelled = max(unlabelled, 1)
    a = F.col("p") / positives
    b = F.col("u") / unlabelled
    negative = F.greatest(F.lit(0.0), (b - prior * a) / (1 - prior))
    z = (a - negative) / F.sqrt(a / positives + negative / unlabelled + 1 / positives**2)
    least = a - DEVIATIONS * F.sqrt("p") / positives
    most = F.greatest(F.lit(0.0), (b + DEVIATIONS * F.sqrt(F.col("u") + 1) / unlabelled - prior * a) / (1 - prior))
    best = counts.where((F.col("p") >= bounds.least_texts) & (least > RATIO * most)).select("feature", z.alias("z"))
    return [r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(bounds.features).collect()]


def fit_nnpu(
    rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, width: int, prior: float,
    steps: int = 300, rate: float = 0.1, decay: float = 3e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model; ``rows`` and ``columns`` list the features present."""
    p, u = positive, ~positive
    np_, nu = max(p.sum(), 1), max(u.sum(), 1)
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns], minlength=len(positive)) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        minus = np.logaddexp(0, z)  # loss as a negative
        excess = minus[u].sum() / nu - prior * minus[p].sum() / np_
        g = np.zeros(len(positive))
        if excess >= 0:
            g[p] = prior * (s[p] - 1) / np_ - prior * s[p] / np_
            g[u] = s[u] / nu
        else:
            g[p] = prior * s[p] / np_
            g[u] = -s[u] / nu
        grad = np.append(np.bincount(columns, weights=g[rows], minlength=width) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), key: str = "doc_id", text: str = "text") -> Model:
    """Fit on rows outside fold 0; ``labels`` has ``key`` and ``toxic``."""
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (fold(key) != 0))
        .groupBy(key)
        .agg(F.max("toxic").alias("toxic"))
    )
    ids = docs.where(F.col(key).isNotNull() & (fold(key) != 0)).select(key).distinct()
    known = ids.join(marks, key, "left")
    n, toxic = known.where("toxic is not null").agg(F.count("toxic"), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / n, 1e-3), 0.5) if n else DEFAULT_PRIOR
    if not toxic:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    by_hash = [F.xxhash64(key), key]
    some = cut(
        known.where("toxic = 1").orderBy(*by_hash).limit(bounds.positives).select(key, F.lit(True).alias("positive"))
        .unionByName(
            known.where("toxic is null or toxic <> 1").orderBy(*by_hash).limit(bounds.unlabelled)
            .select(key, F.lit(False).alias("positive"))
        )
    )
    # At most positives + unlabelled ids, with one text each: the first by digest of those that share an id.
    texts = docs.select(key, text_or_empty(text).alias("text")).join(F.broadcast(some), key)
    texts = texts.groupBy(key, "positive").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    spread = cut(texts.select("positive", "text").repartition(24))
    sizes = {r["positive"]: r["count"] for r in spread.groupBy("positive").count().collect()}
    names = _chosen(spread, prior, sizes.get(True, 1), sizes.get(False, 0), bounds)
    if not names:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    place = {x: i for i, x in enumerate(names)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [[place[x] for x in features(t) if x in place] for t in batch["text"]]
            yield pd.DataFrame({"positive": batch["positive"], "own": own})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        lengths = rows["own"].map(len).to_numpy()
        at = np.repeat(np.arange(len(rows)), lengths)
        columns = np.concatenate([np.asarray(x, np.int64) for x in rows["own"]])
        w, bias = fit_nnpu(at, columns, rows["positive"].to_numpy(bool), len(names), prior)
        yield pd.DataFrame({"w": [*w, bias]})

    fitted = spread.mapInPandas(present, "positive boolean, own array<int>").coalesce(1).mapInPandas(fit, "w double")
    numbers = [r["w"] for r in fitted.collect()]
    return Model(dict(zip(names, numbers, strict=False)), numbers[-1], prior)


def _score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """The same sums as over ``features``, looking at the model's own features only."""
    whole = {x[:-1]: w for x, w in model.weights.items() if x[-1] == "."}
    rest = {x: w for x, w in model.weights.items() if x[-1] != "."}
    stems = {n: {x.rstrip("23") for x in rest if len(x.rstrip("23")) == n} for n in BEGINNINGS}
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        words = set(LETTERS.findall((text or "").lower()))
        z = model.bias + sum([whole[w] for w in words if w in whole])
        for n, known in stems.items():
            found = [x for x in [w[:n] for w in words] if x in known]
            for begin, times in Counter(found).items() if found else ():
                z += rest.get(begin, 0.0) + sum([rest.get(f"{begin}{r}", 0.0) for r in REPEATS if times >= r])
        out[i] = z
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = _score_texts(shared.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents scored below the threshold, in their own columns."""
    name = unused(docs.columns, "toxic_score")
    scored = score(docs, train(docs, labels, key=key, text=text), text, name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)
