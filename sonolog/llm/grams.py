"""Sums over the character n-grams of whole texts, with the values in a sharded table.

A gram is four UTF-16 units packed into one long; a text begins with three units of ``START``. Texts
form blocks, kept compressed. A block's distinct grams are joined with the table of values, and go
back to the block as an array, where every position of every text looks its value up. Neither the
table nor a text's grams are ever sent row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget

ORDER = 4
START = 2
BLOCK_CHARS = 8_000_000
CHUNK_UNITS = 500_000
BLOCKS = "block bigint, keys array<string>, sizes array<int>, texts binary"


def text_units(text: str) -> np.ndarray:
    """``START`` three times, then the text's UTF-16 units."""
    body = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return np.concatenate([np.full(ORDER - 1, START, np.uint16), body])


def pack(units: np.ndarray) -> np.ndarray:
    """The gram that ends at each unit from the fourth on; the last unit is in the lowest bits."""
    u = units.astype(np.uint64)
    n = len(u) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    gram = u[:n] << np.uint64(48)
    for i in range(1, ORDER):
        gram |= u[i : n + i] << np.uint64(16 * (ORDER - 1 - i))
    return gram.view(np.int64)


def _whole(units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of texts that stand one after the other, and how many each text has."""
    grams = pack(units)
    ends = np.cumsum(sizes)
    inside = np.ones(len(units), bool)
    for i in range(ORDER - 1):
        inside[ends[:-1] + i] = False
    return grams[inside[ORDER - 1 :]], sizes - (ORDER - 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def count_units(chunks: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts over texts given as unit arrays."""
    total = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    waiting: list[np.ndarray] = []
    size = 0
    for units in chunks:
        waiting.append(pack(units))
        size += len(units)
        if size >= CHUNK_UNITS:
            total = _merge([total, np.unique(np.concatenate(waiting), return_counts=True)])
            waiting, size = [], 0
    if waiting:
        total = _merge([total, np.unique(np.concatenate(waiting), return_counts=True)])
    return total


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[str], list[str]]]:
    """Number, keys and texts of blocks of consecutive rows."""
    from pyspark import TaskContext

    forget()
    number = TaskContext.get().partitionId() << 32
    keys: list[str] = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        for key, text in zip(batch["key"], batch["text"], strict=True):
            if chars and chars + len(text) > BLOCK_CHARS:
                yield number, keys, texts
                keys, texts, chars, number = [], [], 0, number + 1
            keys.append(key)
            texts.append(text)
            chars += len(text)
    if keys:
        yield number, keys, texts


def blocks(texts: DataFrame) -> DataFrame:
    """``key`` (a text that is never NULL) and ``text`` as blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, keys, own in _blocks(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in own]
            packed = zstandard.compress(b"".join(raw), 6)
            yield pd.DataFrame([{"block": block, "keys": keys, "sizes": [len(r) for r in raw], "texts": packed}])

    return texts.mapInPandas(run, BLOCKS)


def open_block(row) -> Iterator[np.ndarray]:
    """The units of each text of a block, one text at a time."""
    raw, end = zstandard.decompress(row["texts"]), 0
    for size in row["sizes"]:
        yield text_units(raw[end : end + size].decode("utf-8", "surrogatepass"))
        end += size


def block_grams(texts: DataFrame) -> DataFrame:
    """``block, gram``: the distinct grams of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, _, own in _blocks(batches):
            grams, _ = count_units(text_units(t) for t in own)
            for i in range(0, len(grams), 100_000):
                yield pd.DataFrame({"block": block, "gram": grams[i : i + 100_000]})

    return texts.mapInPandas(run, "block bigint, gram bigint")


def sums(texts: DataFrame, values: DataFrame, width: int) -> DataFrame:
    """``key, n, total``: number of grams and sums of ``values.value`` per text.

    ``values`` has a row for every gram of the texts; its value is a double, or ``width`` doubles as an array.
    """
    single = dict(values.dtypes)["value"] == "double"
    valued = block_grams(texts).join(values, "gram").select("block", "gram", "value")

    def run(block: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        order = np.argsort(table["gram"].to_numpy())
        known = table["gram"].to_numpy()[order]
        if single:
            value = table["value"].to_numpy()[order][:, None]
        else:
            value = np.vstack(table["value"].to_numpy())[order] if len(known) else np.zeros((0, width))
        counts = np.zeros(len(row["sizes"]), np.int64)
        total = np.zeros((len(counts), width))
        waiting: list[np.ndarray] = []
        first = size = 0

        def add(last: int) -> None:
            own = np.array([len(u) for u in waiting])
            grams, n = _whole(np.concatenate(waiting), own)
            at, upto = np.searchsorted(known, grams), np.cumsum(n)
            counts[first:last] = n
            for k in range(width if len(grams) else 0):
                summed = np.concatenate([[0.0], np.cumsum(value[:, k][at])])
                total[first:last, k] = summed[upto] - summed[upto - n]

        for number, units in enumerate(open_block(row), 1):  # some texts at a time
            waiting.append(units)
            size += len(units)
            if size >= CHUNK_UNITS:
                add(number)
                waiting, first, size = [], number, 0
        if waiting:
            add(len(counts))
        return pd.DataFrame({"key": list(row["keys"]), "n": counts, "total": list(total[:, 0] if single else total)})

    grouped = blocks(texts).groupBy("block").cogroup(valued.groupBy("block"))
    kind = "double" if single else "array<double>"
    return grouped.applyInPandas(run, f"key string, n bigint, total {kind}")


def _hashable(df: DataFrame) -> list[F.Column]:
    """All columns; those that hold a map or another type without a hash as JSON."""

    def plain(kind: str) -> bool:
        return not any(word in kind for word in ("map<", "variant"))

    columns = [(F.col(f"`{name}`"), kind) for name, kind in df.dtypes]
    return [c if plain(kind) else F.to_json(F.struct(c.alias("m"))) for c, kind in columns]


def row_key(df: DataFrame) -> F.Column:
    """A long of all columns: equal rows share it and get equal results."""
    return F.xxhash64(*_hashable(df))


def row_identity(df: DataFrame) -> F.Column:
    """A text of 128 bits of all columns, which at no size of a table two different rows will share."""
    own = _hashable(df)
    return F.concat_ws(" ", F.xxhash64(F.lit(1), *own), F.xxhash64(F.lit(2), *own))
