"""Similarity join of titles as sets of words, within one artist.

Two titles are similar when their words' Jaccard similarity is at least a threshold. Comparing all titles of an artist with each
other would be quadratic in the artist's titles. Instead the words of all titles are put in one order, the rarest first.
Titles of ``n`` and ``m`` words that are similar share at least ``a = ceil(t / (1 + t) * (n + m))`` words, so the first
word they share is among the first ``n - a + 1`` of the one and the first ``m - a + 1`` of the other. Only these
prefixes are joined, on artist, word and both lengths; lengths that cannot be similar never meet. Each pair is verified
exactly, at its first common word, so it comes out once without a ``distinct``.

Lengths above ``EXACT`` form classes of nearly equal lengths, which keeps the prefixes of very long titles few; a class counts with its
shortest length, so no pair is lost. Titles without a word match nothing; NULL titles or artists neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS

EXACT = 16
GROWTH = 1.25
# Guards the rounding of products that should be whole numbers; a prefix may only come out too long.
EPS = 1e-9


def words_sql(title: str) -> str:
    """The distinct words of a title: runs of letters and digits of any script, in lower case."""
    return f"filter(array_distinct(split(lower({title}), '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+')), w -> w <> '')"


def _class(n: str) -> str:
    return f"int(if({n} <= {EXACT}, {n}, {EXACT} + floor(log({GROWTH}, {n} / {EXACT}.0D) + {EPS})))"


def _shortest(c: str) -> str:
    return f"if({c} <= {EXACT}, {c}, floor({EXACT} * pow({GROWTH}, {c} - {EXACT}) - {EPS}))"


def _shared(n: str, m: str, t: float) -> str:
    """Words that similar titles of these lengths have in common, at least."""
    return f"ceil({t / (1 + t)}D * ({n} + {m}) - {EPS})"


def rare_first(titles: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables (unique on the two keys) with ``words``: each title's words, the rarest over both tables first."""
    listed = [t.selectExpr(*KEYS, f"explode({words_sql(KEYS[0])}) as word") for t in (titles, others)]
    counts = listed[0].select("word").unionAll(listed[1].select("word")).groupBy("word").count()
    words = F.expr("transform(array_sort(collect_list(struct(count, word))), x -> x.word)").alias("words")
    left, right = (t.join(counts, "word").groupBy(*KEYS).agg(words) for t in listed)
    return left, right


def prefixes(titles: DataFrame, t: float, own: str, other: str) -> DataFrame:
    """A row per title, class of the partner's length and word of the prefix; ``own`` and ``other`` name the classes."""
    shortest = f"greatest({_shortest(other)}, ceil({t}D * n - {EPS}))"
    partners = f"sequence({_class(f'ceil({t}D * n - {EPS})')}, {_class(f'floor(n / {t}D + {EPS})')})"
    sized = titles.selectExpr("*", "size(words) as n")
    classed = sized.selectExpr("*", f"{_class('n')} as {own}", f"explode({partners}) as {other}")
    cut = f"slice(words, 1, int(greatest(0, n - {_shared('n', shortest, t)} + 1)))"
    return classed.selectExpr("*", f"posexplode({cut}) as (place, word)")


def similar_titles(titles: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """``track_key, artist_key, candidate, similarity`` of all pairs with one artist and at least the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    left, right = rare_first(titles, others)
    a = prefixes(left, threshold, "size_l", "size_r")
    b = prefixes(right, threshold, "size_r", "size_l").withColumnsRenamed(
        {KEYS[0]: "candidate", "words": "words_r", "n": "m", "place": "place_r"}
    )
    met = a.join(b, [KEYS[1], "word", "size_l", "size_r"])
    # Of all words of both prefixes that meet, the first common one decides; what comes after it bounds the overlap.
    open_ = met.where(f"1 + least(n - place, m - place_r) - 1 >= {_shared('n', 'm', threshold)}")
    common = open_.selectExpr("*", "array_intersect(words, words_r) as common").where("common[0] = word")
    scored = common.selectExpr(*KEYS, "candidate", "size(common) / (n + m - size(common)) as similarity")
    return scored.where(f"similarity >= {threshold}D")
