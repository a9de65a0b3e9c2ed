"""Language of web pages by Bayesian fusion of text, markup, address suffix and host.

The text likelihoods are naive Bayes over character four-grams counted in documents of known language,
tempered because neighbouring grams overlap. A first pass gives every page its most likely language
by text alone. Grouped aggregation of that pass gives how often each language goes with a declared markup
language and with an address suffix, and the priors of hosts, smoothed towards their domain's, which are
smoothed towards those of all pages. The second pass adds the logarithms up.

Defined results: without text the priors and the markup decide; NULL or broken markup or addresses
count as the value ``''``; equal scores go to the first language of the alphabet; repeated rows each
get a row; without training text no language is known and the result is NULL; an empty table gives no
rows. Languages with less than ``LEAST`` training documents, at any size of the others, are not told apart; their pages
get another language.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import cut, hot_join, text_or_empty

TEMPER = 0.25
ALPHA = 0.1
KAPPA = 5.0
# Fewest documents that make a language known.
LEAST = 5


def page_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))


def declared(html: Column) -> Column:
    """Primary tag of the ``lang`` of the ``html`` element, in lower case."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]+)""", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def language_names(docs: DataFrame, lang: str = "lang") -> list[str]:
    """Languages with at least ``LEAST`` documents, or all if none has as many."""
    counts = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).count()
    known = counts.where(F.col("count") >= LEAST).collect()  # values with fewer documents stay on the executors
    return sorted(r["l"] for r in known) or sorted(r["l"] for r in counts.limit(LEAST**3).collect())


def gram_likelihoods(docs: DataFrame, names: list[str], wanted: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``gram, value``: log likelihood of each wanted gram in every language."""
    place = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("lang"):
                if name in place:
                    found, c = grams.count_units(grams.text_units(t) for t in own["text"])
                    yield pd.DataFrame({"gram": found, "l": place[name], "c": c})

    flat = docs.select(F.col(lang).alias("lang"), text_or_empty(text).alias("text")).where("lang is not null")
    counted = flat.mapInPandas(count, "gram bigint, l int, c bigint")
    columns = [F.sum(F.when(F.col("l") == i, F.col("c"))).alias(f"c{i}") for i in range(len(names))]
    counts = cut(counted.groupBy("gram").agg(*columns))
    seen = counts.agg(F.count(F.lit(1)), *[F.sum(f"c{i}") for i in range(len(names))]).first()
    total = [x or 0 for x in seen[1:]]

    def value(i: int) -> Column:
        return F.log((F.coalesce(F.col(f"c{i}"), F.lit(0)) + ALPHA) / (total[i] + ALPHA * (seen[0] + 1)))

    return wanted.join(counts, "gram", "left").select("gram", F.array(*[value(i) for i in range(len(names))]).alias("value"))


def _best(scores: Column, names: list[str]) -> Column:
    """First language with the highest score."""
    known = F.array(*[F.lit(x) for x in names])
    return F.element_at(known, F.array_position(scores, F.array_max(scores)).cast("int"))


def _evidence(pages: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``column``, ``__like``: log of how likely the value is under each language of the first pass."""
    counts = pages.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum((F.col("text_lang") == x).cast("long")) for x in names]).alias("by"),
    )
    counts = cut(counts)
    total = counts.agg(F.count(F.lit(1)), *[F.sum(F.col("by")[i]) for i in range(len(names))]).first()
    like = [F.log((F.col("by")[i] + ALPHA) / ((total[i + 1] or 0) + ALPHA * (total[0] + 1))) for i in range(len(names))]
    return cut(counts.select(column, "n", F.array(*like).alias("__like")))


def _prior(pages: DataFrame, names: list[str]) -> DataFrame:
    """``host``, ``__prior``: log priors, smoothed towards the domain's and those of all pages."""
    by = [F.sum((F.col("text_lang") == x).cast("long")).alias(f"h{i}") for i, x in enumerate(names)]
    hosts = cut(pages.groupBy("host", "domain").agg(F.count(F.lit(1)).alias("n"), *by))
    whole = hosts.agg(F.sum("n"), *[F.sum(f"h{i}") for i in range(len(names))]).first()
    everywhere = [((whole[i + 1] or 0) + 1) / ((whole[0] or 0) + len(names)) for i in range(len(names))]
    domains = hosts.groupBy("domain").agg(
        F.sum("n").alias("dn"), *[F.sum(f"h{i}").alias(f"d{i}") for i in range(len(names))]
    )

    def log_prior(i: int) -> Column:
        domain = (F.col(f"d{i}") + KAPPA * everywhere[i]) / (F.col("dn") + KAPPA)
        return F.log((F.col(f"h{i}") + KAPPA * domain) / (F.col("n") + KAPPA))

    joined = hosts.join(domains, "domain")
    return cut(joined.select("host", "n", F.array(*[log_prior(i) for i in range(len(names))]).alias("__prior")))


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: language, its posterior probability, and the evidence."""
    names = language_names(docs)
    address = host(F.col(url))
    light = pages.select(
        grams.row_identity(pages).alias("key"),
        F.col(key).alias(key),
        declared(F.col(html)).alias("declared"),
        address.alias("host"),
        F.substring_index(address, ".", -1).alias("suffix"),
        F.substring_index(address, ".", -2).alias("domain"),
    )
    if not names:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"))]
        return light.select(key, *nothing, "declared", "suffix", "host")
    texts = pages.select(grams.row_identity(pages).alias("key"), page_text(F.col(html)).alias("text"))
    wanted = grams.block_grams(texts).select("gram").distinct()
    sums = grams.sums(texts, gram_likelihoods(docs, names, wanted), len(names))
    once = sums.groupBy("key").agg(F.first("total").alias("total"))
    scored = light.join(once, "key").withColumn("text_lang", _best(F.col("total"), names))
    scored = cut(scored.withColumn("__text", F.transform("total", lambda x: x * TEMPER)).drop("total"))
    out = scored
    for column in ("declared", "suffix"):
        table = _evidence(scored, column, names).withColumnRenamed("__like", f"__{column}")
        out = hot_join(out, table, column, counted="n").drop("n")
    out = hot_join(out, _prior(scored, names), "host", counted="n").drop("n")
    parts = ["__text", "__declared", "__suffix", "__prior"]
    fused = F.transform(F.arrays_zip(*parts), lambda x: x["__text"] + x["__declared"] + x["__suffix"] + x["__prior"])
    top = F.array_max("__all")
    mass = F.aggregate("__all", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return out.withColumn("__all", fused).select(
        key, _best(F.col("__all"), names).alias("lang"), (1 / mass).alias("posterior"), "text_lang", "declared", "suffix", "host"
    )
