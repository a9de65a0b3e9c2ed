"""Perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted text is what ``labels`` mark as good. Its character four-grams are counted in every block of
documents and summed by gram; the lower orders count the distinct units seen before a gram, each order
has its three discounts from its counts of counts, and what they take off goes to the next lower order,
down to a uniform share for unseen units. The distinct grams of all documents get their
probabilities by joins sharded by gram, by context and by the shorter grams; ``grams.sums`` brings them to the
documents. Bounds come from trusted documents that were not counted (fold 0). A loss is taken as its distance to the
median of its language, in units of the language's distance from the median to its 5 % or 95 % quantile; junk can
be less likely than clean text or, as endless repetition, more likely. The bounds are the quantiles ``LEVEL`` and
``1 - LEVEL`` of that distance among the held-out texts of about the same length (by powers of four, joined until a
class has ``LEAST``), so clean loss should be ``2 * LEVEL``, or two texts of a class smaller than that can tell. Counted
texts are likelier than others of their kind and have bounds from each other.

Defined results: NULL and empty texts have no perplexity and are not kept; a language with less
than ``LEAST`` held-out trusted documents, or NULL, gets the quantiles of all languages together;
without trusted text every text that is not empty is kept; equal rows get equal results; an empty table
gives no rows; extra columns pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bitfilter
from . import grams
from .common import cut, hot_join, text_or_empty, unused

FOLDS = 5
LEVEL = 0.005
LEAST = 30
# Ranks are exact up to so many documents, and off by no more than their number over this beyond.
ACCURACY = 10_000
# Lengths up to 4 ** 16.
CLASSES = 16
UNIT = 16


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % FOLDS


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids marked good and never bad, once each, and whether they are held out."""
    marks = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key)
    good = marks.agg(F.min("quality").alias("q")).where("q = 1").select(key)
    return good.withColumn("held_out", fold(key) == 0)


def trusted_counts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``gram, c`` over all trusted documents that are not held out.

    A bitmap drops most other texts at the scan. What it lets through goes to blocks, whose texts are shuffled compressed; the
    exact join of the ids then says which texts of a block count.
    """
    ids = trusted.where("not held_out").select(F.col(key).cast("string").alias("key"))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), text_or_empty(text).alias("text"))
    near = bitfilter.maybe_in(texts, ids, ["key"], ids.count())

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, keys, _ in grams._blocks(batches):
            yield pd.DataFrame({"block": block, "place": np.arange(len(keys), dtype=np.int32), "key": keys})

    places_of = near.mapInPandas(places, "block bigint, place int, key string")
    wanted = places_of.join(ids, "key", "left_semi").select("block", "place")

    def count(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        places = set(own["place"])
        found, c = grams.count_units(u for i, u in enumerate(grams.open_block(block.iloc[0])) if i in places)
        return pd.DataFrame({"gram": found, "c": c})

    counted = grams.blocks(near).groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(count, "gram bigint, c bigint")
    return counted.groupBy("gram").agg(F.sum("c").alias("c"))


def _suffix(units: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (UNIT * units)) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, UNIT)


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the numbers of grams counted once to four times."""
    row = counts.agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = [x or 0 for x in row]
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a and b else i * y
        found.append(min(max(d, 0.05), i - 0.05))
    return found


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def levels(counts: DataFrame) -> list[tuple[DataFrame, DataFrame, list[float]]]:
    """Counts (``gram, c``), contexts (``context, total, back``) and discounts of the orders 4 to 1."""
    found = []
    for order in range(grams.ORDER, 0, -1):
        if order < grams.ORDER:
            counts = cut(counts.groupBy(_suffix(order).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
        d = discounts(counts)
        off = F.sum(_discount(F.col("c"), d))
        contexts = counts.groupBy(_context(F.col("gram")).alias("context")).agg(
            F.sum("c").alias("total"), (off / F.sum("c")).alias("back")
        )
        found.append((counts, contexts, d))
    return found


def probabilities(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """``gram, value``: the log probability of a gram's last unit after the others.

    ``counts`` is read several times and should be stored. All grams meet the one context of order 1 and the at most 65,536 of
    order 2, so these are broadcast; longer contexts and the grams themselves are left to adaptive execution.
    """
    found = levels(counts)
    alphabet = found[-1][0].count() + 1
    out = distinct.withColumn("p0", F.lit(1.0 / alphabet))
    for order, (seen, contexts, d) in zip(range(1, grams.ORDER + 1), reversed(found), strict=True):
        own = _suffix(order) if order < grams.ORDER else F.col("gram")
        left = out.withColumn("__g", own).withColumn("__h", _context(own))
        units, contexts = seen.select(F.col("gram").alias("__g"), "c"), contexts.withColumnRenamed("context", "__h")
        left = left.join(F.broadcast(units) if order == 1 else units, "__g", "left")
        left = left.join(F.broadcast(contexts) if order <= 2 else contexts, "__h", "left")
        c = F.coalesce(F.col("c"), F.lit(0))
        share = F.greatest(F.lit(0.0), c - _discount(c, d)) / F.col("total")
        lower = F.col(f"p{order - 1}")
        p = F.when(F.col("total").isNull(), lower).otherwise(share + F.col("back") * lower)
        out = left.select("gram", p.alias(f"p{order}"))
    return out.select("gram", F.log(f"p{grams.ORDER}").alias("value"))


def perplexities(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (128 bits of all columns), ``n`` and ``loss``, the mean negative log probability; equal rows once."""
    counts = cut(trusted_counts(docs, trusted_ids(labels, key), key, text))
    texts = docs.select(grams.row_identity(docs).alias("key"), text_or_empty(text).alias("text"))
    distinct = grams.block_grams(texts).select("gram").distinct()
    found = grams.sums(texts, probabilities(distinct, counts), 1)
    loss = F.when(F.col("n") > 0, -F.col("total") / F.col("n"))
    return found.groupBy("key").agg(F.first("n").alias("n"), F.first(loss).alias("loss"))


def _quantiles(column: str, shares: list[float]) -> list[Column]:
    q = F.percentile_approx(column, F.array(*[F.lit(x) for x in shares]), F.lit(ACCURACY))
    return [q.alias("q"), F.count(column).alias("m")]


def joined_classes(sizes: dict[int, int]) -> list[int]:
    """For each length class, the number of the joined class: neighbours until each has ``LEAST``."""
    found, number, m = [], 0, 0
    for c in range(CLASSES + 1):
        found.append(number)
        m += sizes.get(c, 0)
        if m >= LEAST and sum(n for x, n in sizes.items() if x > c) >= LEAST:
            number, m = number + 1, 0
    return found


def _class_bounds(sample: DataFrame) -> list[Column]:
    """Lowest and highest distance to the median for a row's length class."""
    sizes = {r["class"]: r["count"] for r in sample.groupBy("class").count().collect()}
    into = joined_classes(sizes)
    number = F.get(F.array(*[F.lit(x) for x in into]), F.col("class"))
    q = {r["g"]: r["q"] for r in sample.groupBy(number.alias("g")).agg(*_quantiles("z", [LEVEL, 1 - LEVEL])).collect()}
    return [F.get(F.array(*[F.lit(q[g][i]) for g in into]), F.col("class")) for i in (0, 1)]


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: its row key, id, language, size, perplexity, bounds and whether it stays."""
    light = docs.select(grams.row_identity(docs).alias("key"), F.col(key).alias(key), F.col(lang).alias(lang))
    scored = cut(light.join(perplexities(docs, labels, key, text), "key"))
    known = cut(scored.where("loss is not null").join(trusted_ids(labels, key), key).select("key", lang, "loss", "held_out"))
    sample = known.where("held_out")
    overall = sample.agg(*_quantiles("loss", [0.05, 0.5, 0.95])).first()
    if not overall["m"]:
        flags = [F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")]
        return scored.select("*", F.exp("loss").alias("perplexity"), *flags, F.col("loss").isNotNull().alias("kept"))
    # The language as a key that is never NULL; every language of the rows has its quantiles.
    tag = F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))
    own = sample.groupBy(tag.alias("__lang")).agg(*_quantiles("loss", [0.05, 0.5, 0.95]))
    own = own.where((F.col("m") >= LEAST) & (F.col("__lang") != ""))
    q = F.coalesce("q", F.array(*[F.lit(x) for x in overall["q"]])).alias("q")
    rows = scored.groupBy(tag.alias("__lang")).agg(F.count(F.lit(1)).alias("__rows"))
    table = cut(rows.join(own, "__lang", "left").select("__lang", "__rows", q))
    marked = known.groupBy("key").agg((~F.max("held_out")).alias("__counted"))
    placed = hot_join(scored.withColumn("__lang", tag), table, "__lang", counted="__rows").join(marked, "key", "left")
    d = F.col("loss") - F.col("q")[1]
    below = F.greatest(F.lit(1e-9), F.col("q")[1] - F.col("q")[0])
    above = F.greatest(F.lit(1e-9), F.col("q")[2] - F.col("q")[1])
    length = F.least(F.lit(CLASSES), F.floor(F.log(4.0, F.greatest(F.lit(1), "n")))).cast("int")
    placed = cut(placed.select("*", F.when(d < 0, d / below).otherwise(d / above).alias("z"), length.alias("class")))
    others = _class_bounds(placed.where("loss is not null and not __counted"))
    counted = placed.where("loss is not null and __counted")
    bounds = list(zip(_class_bounds(counted), others, strict=True)) if counted.limit(1).count() else [(x, x) for x in others]
    limits = [F.when(F.col("__counted"), mine).otherwise(theirs) for mine, theirs in bounds]

    def loss_at(z: Column) -> Column:
        return F.col("q")[1] + F.when(z < 0, z * below).otherwise(z * above)

    kept = F.coalesce((F.col("z") >= limits[0]) & (F.col("z") <= limits[1]), F.lit(False))
    return placed.select(
        *scored.columns, F.exp("loss").alias("perplexity"), F.exp(loss_at(limits[0])).alias("low"),
        F.exp(loss_at(limits[1])).alias("high"), kept.alias("kept"),
    )


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that stay, in their own columns."""
    name = unused(docs.columns, "row")
    out = assess(docs, labels, key, text, lang).where("not kept").select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, grams.row_identity(docs)).join(out, name, "left_anti").drop(name)
