"""Hard negatives by Fagin's threshold algorithm.

An anchor's positives are the best rows of its own label. For each of them the negatives are the best rows of other labels whose
score lies in a window relative to the positive's. Both searches run over blocks of rows. A block lists its
rows by value in each dimension. An anchor reads these lists from the end that its component's sign says, a stretch at
a time from all of them; every row met is looked up and scored in whole numbers at once. The sum of the products at the
stretches' ends is the threshold: no row that was not met scores more. A search stops when the threshold is strictly below
the ``k``-th score found (in the window), as ties may still go to a smaller id, or below the window itself. The blocks'
results are merged.

Anchors with their positives, at most ``positives`` each, are sent to every block; rows are sent to one block once.

Defined results: rows whose label, id or vector is NULL, or whose vector holds a NULL or non-finite component, take
no part; ties go to the smaller id; rows with the same id or content are rows of their own, and each is an anchor if its
id says so; vectors of another length than the longest are filled up with zeros; an anchor without another row of its label has no
positives and no result; a window below zero is empty when its upper end lies below its lower one; where a score could reach
``LARGEST``, the job fails with an ``OverflowError``; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .vector_blocks import check_range, matrix, meet, same_width, usable, with_row_id

__all__ = ["mine", "usable"]

BLOCK_ROWS = 8_192
# Rows read from each list in the first stretch; every further one is twice as long.
FIRST = 16
POSITIVES = "anchor_rid bigint, vec_id bigint, score bigint"
NEGATIVES = "anchor_rid bigint, slot int, negative_id bigint, negative_score bigint"


class SortedLists:
    """Rows of a block by value, in each dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rids: np.ndarray):
        self.x, self.ids, self.rids = x, ids, rids
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))

    def stretches(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows met for the first time, their scores, and the threshold; None when all have been met."""
        n = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        depth, size = 0, FIRST
        while depth < n:
            upto = min(n, depth + size) if len(up) + len(down) else n
            met = np.zeros(n, bool)
            met[self.order[up, n - upto : n - depth]] = True
            met[self.order[down, depth:upto]] = True
            if upto == n:
                met[:] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            threshold = None
            if upto < n:
                at_up = self.x[self.order[up, n - upto], up] * anchor[up]
                at_down = self.x[self.order[down, upto - 1], down] * anchor[down]
                threshold = int(at_up.sum() + at_down.sum())
            yield fresh, self.x[fresh] @ anchor, threshold
            depth, size = upto, 2 * size


class _Best:
    """The ``k`` best of the rows handed over whose scores lie between ``low`` and ``high``."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(scores):
            scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]

    def done(self, threshold: int | None) -> bool:
        """Whether no row that was not met can belong to the best."""
        if threshold is None or (self.low is not None and (threshold < self.low or self.low > self.high)):
            return True
        return len(self.scores) == self.k and threshold < self.scores[-1]


class Block:
    """All rows of a block as lists, and those of each label when asked for."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray):
        self.all = SortedLists(x, ids, rids)
        self.labels = labels
        self.by_label: dict[int, SortedLists] = {}

    def of_label(self, label: int) -> SortedLists:
        if label not in self.by_label:
            own = np.flatnonzero(self.labels == label)
            self.by_label[label] = SortedLists(self.all.x[own], self.all.ids[own], self.all.rids[own])
        return self.by_label[label]

    def positives(self, anchor: np.ndarray, rid: int, label: int, k: int) -> _Best:
        lists, best = self.of_label(label), _Best(k)
        for rows, scores, threshold in lists.stretches(anchor):
            other = lists.rids[rows] != rid
            best.add(scores[other], lists.ids[rows[other]])
            if best.done(threshold):
                break
        return best

    def negatives(self, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[_Best]:
        found = [_Best(k, low, high) for low, high in windows]
        open_ = [b for b in found if b.low <= b.high]
        if not open_:
            return found
        for rows, scores, threshold in self.all.stretches(anchor):
            other = self.labels[rows] != label
            scores, ids = scores[other], self.all.ids[rows[other]]
            for b in open_:
                b.add(scores, ids)
            open_ = [b for b in open_ if not b.done(threshold)]
            if not open_:
                break
        return found


def window(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores ``s`` with ``low * positive <= 100 * s <= high * positive``."""
    return -(-low * positive_score // 100), high * positive_score // 100


def _column(table: pa.Table | pa.RecordBatch, name: str):
    return table.column(table.schema.get_field_index(name))


def _block(table: pa.Table) -> Block:
    x = matrix(_column(table, "v"))
    return Block(x, *[np.asarray(_column(table, c)) for c in ("vec_id", "rid", "label")])


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(np.asarray(c, np.int64)).cast(kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _anchors(block: Block, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """Number, vector, row id and label of each anchor; fails where scores may not fit."""
    anchors, rows = same_width(matrix(_column(batch, "v")), block.all.x)
    check_range(anchors, rows)
    if rows.shape[1] > block.all.x.shape[1]:
        # What the block's rows lack is zero and adds nothing.
        anchors = anchors[:, : block.all.x.shape[1]]
    yield from zip(range(len(anchors)), anchors, _column(batch, "rid").to_pylist(), _column(batch, "label").to_pylist(), strict=True)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and ``v``, whole numbers. A negative's score lies between ``low`` and ``high``
    percent of its positive's.
    """
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    rows = with_row_id(vectors.where(there).select("vec_id", F.col("label").cast("long").alias("label"), "v"))
    blocks = rows.count() // BLOCK_ROWS + 1
    anchors = rows.where(is_anchor)

    def ask_positives(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [(rid, block.positives(a, rid, label, positives)) for _, a, rid, label in _anchors(block, batch)]
        owner = np.repeat(np.array([r for r, _ in found], np.int64), [len(b.ids) for _, b in found])
        yield _batch(POSITIVES, [owner, np.concatenate([b.ids for _, b in found]), np.concatenate([b.scores for _, b in found])])

    near = meet(rows, anchors, blocks, _block, ask_positives, POSITIVES)
    order = W.partitionBy("anchor_rid").orderBy(F.desc("score"), "vec_id")
    chosen = near.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= positives)
    chosen = cut(chosen.select("anchor_rid", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # At most ``positives`` to an anchor.
    pair = F.struct("slot", F.col("positive_score").alias("score"))
    own = chosen.groupBy(F.col("anchor_rid").alias("rid")).agg(F.array_sort(F.collect_list(pair)).alias("best"))
    asked = anchors.join(own, "rid").select(*rows.columns, F.col("best.score").alias("best"))
    nothing = F.lit(None).cast("array<bigint>").alias("best")

    def ask_negatives(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        best = _column(batch, "best").to_pylist()
        rids, slots, found = [], [], []
        for i, a, rid, label in _anchors(block, batch):
            for slot, b in enumerate(block.negatives(a, label, [window(s, low, high) for s in best[i]], negatives), 1):
                rids.append(rid)
                slots.append(slot)
                found.append(b)
        sizes = [len(b.ids) for b in found]
        columns = [np.repeat(rids, sizes), np.repeat(slots, sizes)]
        yield _batch(NEGATIVES, [*columns, np.concatenate([b.ids for b in found]), np.concatenate([b.scores for b in found])])

    hits = meet(rows.select("*", nothing), asked, blocks, _block, ask_negatives, NEGATIVES)
    order = W.partitionBy("anchor_rid", "slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("rid").alias("anchor_rid"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(chosen, ["anchor_rid", "slot"]).join(named, "anchor_rid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
