"""Second matching pass for keys that matched nothing exactly: by edit distance, or by the words of the title.

Candidates share the artist key and lie within a small edit distance. Comparing all tracks of
an artist with each other would be quadratic in the artist's tracks. Instead each name is
listed under its deletion variants: two names within ``k`` edits always share a name obtained
from both by at most ``k`` deletions, so an equi-join on the variants finds every candidate
and the exact distance is only computed for those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schemas import KEYS
from .token_join import similar_titles


def deletion_variants(name: str, k: int) -> str:
    """SQL for the name and everything up to ``k`` deletions away, without repeats."""
    out = f"array({name})"
    for _ in range(k):
        shorter = """if(length(s) > 0,
            transform(sequence(1, length(s)), i -> concat(substr(s, 1, i - 1), substr(s, i + 1))), array())"""
        out = f"array_distinct(concat({out}, flatten(transform({out}, s -> {shorter}))))"
    return out


def candidates(unmatched: DataFrame, catalog_keys: DataFrame, k: int = 1) -> DataFrame:
    """Pairs of keys with one artist and track names at most ``k`` edits apart; both sides unique."""
    variant = f"explode({deletion_variants('track_key', k)}) as variant"
    u = unmatched.selectExpr("artist_key", "track_key", variant)
    c = catalog_keys.selectExpr("artist_key", "track_key as candidate", variant)
    near = u.join(c, ["artist_key", "variant"]).select("track_key", "artist_key", "candidate").distinct()
    return near.selectExpr("*", "levenshtein(track_key, candidate) as distance").where(f"distance <= {k}")


def best_match(near: DataFrame, order: str = "distance") -> DataFrame:
    """The closest candidate of every key; of equals the first by name."""
    rank = f"row_number() over (partition by {', '.join(KEYS)} order by {order}, candidate) as rn"
    return near.selectExpr("*", rank).where("rn = 1").drop("rn")


def second_pass(keys: DataFrame, catalog_keys: DataFrame, k: int = 1) -> DataFrame:
    """Best fuzzy match of the keys that have no exact one."""
    left = keys.select(*KEYS).join(catalog_keys.select(*KEYS), KEYS, "left_anti")
    return best_match(candidates(left, catalog_keys, k))


def token_pass(keys: DataFrame, catalog_keys: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The candidate with the most similar words for the keys that have no exact match."""
    left = keys.select(*KEYS).join(catalog_keys.select(*KEYS), KEYS, "left_anti")
    return best_match(similar_titles(left, catalog_keys.select(*KEYS), threshold), "similarity desc")
