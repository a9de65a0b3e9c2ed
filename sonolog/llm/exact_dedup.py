"""Exact deduplication against a minimal perfect hash of the digests already held.

The history's distinct digests are dealt out to buckets by their first bytes. Each bucket becomes one
index row: a minimal perfect hash (levels of bits; a key is placed at the first level where no other
key shares its bit, and its slot is the number of set bits before it) and, by slot, the full digests,
the winners and the numbers of rows. New digests are grouped first (combined before the shuffle, so a
text that makes up a third of the rows costs one row per task), meet their bucket's index, and
count as repeats only if all 32 bytes at their slot are equal; the others form groups of their own.

Defined results: NULL text equals empty text; of equal texts the largest id stays, ids that are NULL
rank last; a repeated row with the winner's id stays once in ``keep`` and is marked on every
copy in ``verdicts``; empty history or empty batch is fine; other columns pass through ``keep``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, text_or_empty, unused

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYS_PER_BUCKET = 20_000
BITS_PER_KEY = 2
INDEX = "bucket int, level_bits array<int>, bits binary, digests binary, winners array<bigint>, sizes array<bigint>"
FOUND = "digest binary, winner bigint, n bigint, in_history boolean"


def normalised(text: str = "text") -> Column:
    """A-Z in lower case, all else as it is; for ASCII texts that is what ``lower`` does, faster."""
    body = text_or_empty(text)
    ascii_only = F.octet_length(body) == F.char_length(body)
    return F.when(ascii_only, F.lower(body)).otherwise(F.translate(body, UPPER, UPPER.lower()))


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def _mix(digests: np.ndarray, level: int) -> np.ndarray:
    """64 pseudo-random bits of each digest (rows of four words) for a level."""
    x = digests[:, level % 4] ^ (digests[:, (level + 1) % 4] * np.uint64(2 * level + 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_levels(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and all levels' bits, one after the other, for distinct digests."""
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    left = digests
    while len(left):
        m = max(8, BITS_PER_KEY * len(left))
        at = (_mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 where no level takes it. A slot found proves nothing by itself."""
    rank = np.cumsum(bits) - 1
    slot = np.full(len(digests), -1, np.int64)
    start, rest = 0, np.arange(len(digests))
    for level, m in enumerate(sizes):
        at = start + (_mix(digests[rest], level) % np.uint64(m)).astype(np.int64)
        hit = bits[at]
        slot[rest[hit]] = rank[at[hit]]
        rest, start = rest[~hit], start + m
    return slot


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _build(part: pd.DataFrame) -> pd.DataFrame:
    keys = _words(part["digest"])
    sizes, bits = build_levels(keys)
    order = np.argsort(slots_of(keys, sizes, bits))
    row = {
        "bucket": int(part["bucket"].iloc[0]),
        "level_bits": sizes,
        "bits": np.packbits(bits).tobytes(),
        "digests": keys[order].tobytes(),
        "winners": [None if pd.isna(x) else int(x) for x in part["winner"].iloc[order]],
        "sizes": part["n"].to_numpy()[order].tolist(),
    }
    return pd.DataFrame([row])


def _lookup(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """All digests of a bucket, the history's updated by the batch; first the repeats, then the rest."""
    out = []
    fresh = np.ones(len(batch), bool)
    if len(index):
        row = index.iloc[0]
        sizes = [int(x) for x in row["level_bits"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        winners = pd.Series(list(row["winners"]), dtype="Int64")
        n = np.array(row["sizes"], np.int64)
        if len(batch):
            keys = _words(batch["digest"])
            slot = slots_of(keys, sizes, bits)
            same = (slot >= 0) & (held[slot] == keys).all(axis=1)
            fresh = ~same
            np.add.at(n, slot[same], batch["n"].to_numpy()[same])
            later = batch["winner"].astype("Int64")[same].reset_index(drop=True)
            mine = winners.iloc[slot[same]].reset_index(drop=True)
            winners.iloc[slot[same]] = pd.concat([later, mine], axis=1).max(axis=1).astype("Int64").array
        digests = [held[i].tobytes() for i in range(len(held))]
        out.append(pd.DataFrame({"digest": digests, "winner": winners, "n": n, "in_history": True}))
    rest = batch[fresh]
    out.append(
        pd.DataFrame(
            {"digest": rest["digest"], "winner": rest["winner"].astype("Int64"), "n": rest["n"], "in_history": False}
        )
    )
    return pd.concat(out, ignore_index=True)


def grouped(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per distinct digest: the largest id and the number of rows."""
    return rows.groupBy("digest").agg(F.max(key).alias("winner"), F.count(F.lit(1)).alias("n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    head = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return groups.withColumn("bucket", F.pmod(head, F.lit(buckets)).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The history's digests (``digest, winner, n``, one row each) as one index row per bucket."""
    return _bucketed(history, buckets).groupBy("bucket").applyInPandas(_build, INDEX)


def lookup(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """History updated by the batch's groups, and the groups that the history does not hold."""
    new = _bucketed(batch, buckets).groupBy("bucket")
    return index.groupBy("bucket").cogroup(new).applyInPandas(_lookup, FOUND)


def groups_of(rows: DataFrame, is_history: Column, key: str = "doc_id") -> DataFrame:
    """All groups of equal digests of ``rows`` (``key``, ``digest``), a part of which is history."""
    old = grouped(rows.where(is_history), key)
    new = grouped(rows.where(~is_history), key)
    total = rows.count()
    buckets = max(8, total // KEYS_PER_BUCKET + 1)
    return lookup(build_index(old, buckets), new, buckets)


def earlier_half(rows: DataFrame, key: str) -> Column:
    """Rows up to the middle of the id range came first; NULL ids are new."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    middle = 0 if low is None else (low + high) // 2
    return F.coalesce(F.col(key) <= F.lit(middle), F.lit(False))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its group's winner and size, and whether it stays."""
    rows = cut(docs.select(F.col(key).alias(key), digest(text).alias("digest")))
    groups = cut(groups_of(rows, earlier_half(rows, key), key))
    found = hot_join(rows, groups, "digest", counted="n")
    return found.select(
        key,
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col(key).eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, in their own columns: one row per group of equal texts.

    Documents meet the winners on id and digest together, so copies of one text are spread.
    """
    label = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    name = unused(docs.columns, "row")
    inner = docs.withColumn(name, F.concat(label, F.lit(":"), F.hex(digest(text))))
    rows = cut(docs.select(F.col(key).alias(key), digest(text).alias("digest")))
    winner = F.coalesce(F.col("winner").cast("string"), F.lit("null"))
    groups = groups_of(rows, earlier_half(rows, key), key)
    ids = groups.select(F.concat(winner, F.lit(":"), F.hex("digest")).alias(name))
    once = inner.join(ids, name, "left_semi").dropDuplicates([name])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
