"""Exact top-k by inner product over an impact-ordered index, score at a time.

A block's index holds its postings (row and value, by dimension) in segments by descending impact, which is the
absolute value quantised to ``LEVELS`` bands of equally many postings. A batch of queries takes the segments one after the
other and adds the postings' products up, in whole numbers. What the segments below may still change is bounded, for each row and
query, by the query's length times that of the row's rest, and by the sum of the query's absolute components
times the largest impact left. The ``k``-th best lower bound is thus a proof against all rows whose upper bound is smaller.
A query stops when so few possible members are left that looking them up costs less than the next segment; these are
then scored exactly from their vectors. The blocks' results are merged.

Defined results: vectors that are NULL, or hold NULL or non-finite components, and rows without an id take
no part; every other row is a candidate for all queries but itself, also if its id or its whole content is there twice; vectors of
another length than the longest are filled up with zeros; ties go to the smaller id; fewer than ``k`` candidates
give all; where a score could reach ``LARGEST``, the job fails with an ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vector_blocks import check_range, matrix, meet, quantised, same_width, usable, with_row_id

__all__ = ["ImpactIndex", "quantised", "search", "usable"]

LEVELS = 8
BLOCK_ROWS = 8_192
QUERY_ROWS = 128
FEW = 0.05
HITS = "query_rid bigint, query_id bigint, vec_id bigint, score bigint"


class ImpactIndex:
    """Postings of a block in segments by descending impact."""

    def __init__(self, x: np.ndarray, vec_ids: np.ndarray, rids: np.ndarray):
        self.x, self.vec_ids, self.rids = x, vec_ids, rids
        self.place = {r: i for i, r in enumerate(rids.tolist())}
        impact = np.abs(x.astype(np.float64))
        held = np.sort(impact[impact > 0])
        # Lower edges of the bands; equal impacts stay in one band.
        cuts = [held[len(held) * (LEVELS - i) // LEVELS] for i in range(1, LEVELS)] if len(held) else []
        self.levels: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.rest: list[np.ndarray] = []
        self.edge: list[float] = []
        above = np.inf
        for low in [*cuts, 0.0]:
            if low >= above:
                continue
            band = (impact >= low) & (impact < above) & (impact > 0)
            segments = []
            for d in np.flatnonzero(band.any(axis=0)).tolist():
                rows = np.flatnonzero(band[:, d])
                segments.append((d, rows, x[rows, d]))
            self.levels.append(segments)
            left = np.where(impact < low, impact, 0.0)
            self.rest.append(np.sqrt((left**2).sum(axis=1)))
            self.edge.append(float(left.max(initial=0.0)))
            above = low

    def search(self, q: np.ndarray, rids: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each query the places of its best rows, their scores, and the share of postings read."""
        q, x = same_width(q, self.x)
        n, m = len(x), len(q)
        most = check_range(q, x)
        size = np.abs(q.astype(np.float64))
        norm, sum_ = np.sqrt((size**2).sum(axis=1)), size.sum(axis=1)
        own = np.array([self.place.get(r, -1) for r in rids.tolist()])
        places, scores = [np.zeros(0, np.int64)] * m, [np.zeros(0, np.int64)] * m
        read = np.zeros(m)
        total = max(sum(len(rows) for level in self.levels for _, rows, _ in level), 1)
        score = np.zeros((n, m), np.int64)
        open_ = np.arange(m)
        for number, level in enumerate(self.levels):
            for d, rows, values in level:
                score[rows] += values[:, None] * q[open_, d][None, :]
            read[open_] += sum(len(rows) for _, rows, _ in level) / total
            slack = np.minimum(self.rest[number][:, None] * norm[None, open_], (self.edge[number] * sum_[open_])[None, :])
            # Roundings of doubles are far below this share of the largest possible score.
            slack = slack * (1 + 1e-9) + 1e-9 * most[None, open_] * (self.edge[number] > 0)
            mine = own[open_]
            low = score - slack
            low[mine[mine >= 0], np.flatnonzero(mine >= 0)] = -np.inf
            bar = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf)
            possible = score + slack >= bar[None, :]
            possible[mine[mine >= 0], np.flatnonzero(mine >= 0)] = False
            last = number == len(self.levels) - 1
            done = np.full(len(open_), True) if last else possible.sum(axis=0) <= max(k, FEW * n)
            for i in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(possible[:, i])
                sure = x[rows] @ q[open_[i]]
                best = np.lexsort((self.vec_ids[rows], -sure))[:k]
                places[open_[i]], scores[open_[i]] = rows[best], sure[best]
            if done.all():
                break
            if done.any():
                open_, score = open_[~done], np.ascontiguousarray(score[:, ~done])
        return places, scores, read


def _column(table: pa.Table | pa.RecordBatch, name: str):
    return table.column(table.schema.get_field_index(name))


def build_index(table: pa.Table) -> ImpactIndex:
    ids, rids = (np.asarray(_column(table, c)) for c in ("vec_id", "rid"))
    return ImpactIndex(matrix(_column(table, "v")), ids, rids)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``vec_id``, ``v``) that ``is_query`` marks."""
    rows = with_row_id(vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "v"))

    def ask(index: ImpactIndex, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, QUERY_ROWS):
            some = batch.slice(start, QUERY_ROWS)
            ids, rids = (_column(some, c).to_numpy() for c in ("vec_id", "rid"))
            places, scores, _ = index.search(matrix(_column(some, "v")), rids, k)
            sizes = [len(p) for p in places]
            found = index.vec_ids[np.concatenate(places)]
            arrays = [np.repeat(rids, sizes), np.repeat(ids, sizes), found, np.concatenate(scores)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [c.split()[0] for c in HITS.split(", ")])

    blocks = rows.count() // BLOCK_ROWS + 1
    hits = meet(rows, rows.where(is_query), blocks, build_index, ask, HITS)
    order = W.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
