"""Vectors of whole numbers, dealt out to blocks, and queries that meet every block once.

A block's rows are sent to their task once, where an index over them is built and never leaves it; the
queries, which are far fewer, are sent to each block and stream past the index in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
# Scores, and all sums on the way to them, must stay below this; anything larger is refused.
LARGEST = 2.0**62


def quantised(embedding: str = "embedding", scale: int = SCALE) -> Column:
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: str = "embedding") -> Column:
    limit = F.lit(float("inf"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.coalesce(F.col(embedding).isNotNull() & fine, F.lit(False))


def with_row_id(vectors: DataFrame) -> DataFrame:
    """Add ``rid``, which tells rows apart even where all else is equal; stored, so it stays the same."""
    return cut(vectors.withColumn("rid", F.monotonically_increasing_id()))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as whole numbers, shorter ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths())
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def check_range(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The largest score each query could have, after making sure that it fits."""
    if not len(rows):
        return np.zeros(len(queries))
    most = np.abs(queries.astype(np.float64)) @ np.abs(rows.astype(np.float64)).max(axis=0)
    if most.max(initial=0.0) >= LARGEST:
        raise OverflowError(f"scores of these vectors may exceed {LARGEST:.0f}")
    return most


def _runs(block: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
    yield from zip(np.r_[0, edges].tolist(), np.r_[edges, len(block)].tolist(), strict=True)


def meet(
    rows: DataFrame,
    asked: DataFrame,
    blocks: int,
    build: Callable[[pa.Table], object],
    ask: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``ask(index, queries)`` for every block of ``rows`` (with ``rid``) and all queries, some at a time.

    ``rows`` and ``asked`` have the same columns.
    """
    deal = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    here = rows.select("*", deal.alias("block"), F.lit(0).alias("kind"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    there = asked.select("*", every.alias("block"), F.lit(1).alias("kind"))
    placed = here.unionByName(there).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "kind"))
            for start, stop in _runs(block, kind):
                if block[start] != current:
                    current, parts, index = block[start], [], None
                own = batch.slice(start, stop - start)
                if kind[start] == 0:
                    parts.append(own)
                elif parts:
                    index = build(pa.Table.from_batches(parts)) if index is None else index
                    yield from ask(index, own)

    return placed.mapInArrow(run, schema)
