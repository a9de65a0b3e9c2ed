"""Best-fit packing of token sequences.

Lengths are whole numbers up to the capacity, so documents of one length and gaps of one size are
interchangeable and are handled as runs: one row per length with a count, at most ``capacity`` rows
whatever the size of the data. The rounds are bulk-synchronous best fit on these range-sorted runs:
from the longest documents down, a sweep finds the successor (the smallest gap that fits), documents
of one length that want the same gap are told apart by rank, the gaps are updated, and the next round
begins. A round's outcome is a few rank intervals; documents are numbered within their length in
parallel and take their sequence and offset from the interval their rank falls into, so the rows are
shuffled for numbering only and no task sees all documents of a length.

Defined results: NULL and empty texts are documents of the end id alone; longer documents than the
capacity are cut into full pieces and a rest; repeated rows are packed once each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, read_vocabulary
from .common import ROWS_PER_BUCKET, cut, numbered, text_or_empty

CAPACITY = 4096
END_ID = 1
PLAN = "length int, first_rank bigint, n bigint, copies bigint, first_sequence bigint, place int"


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of each piece of a document given as unsigned 32-bit ids."""
    for start in range(0, len(ids) // 4, capacity):
        yield start, ids[4 * start : 4 * (start + capacity)]


def pieces(
    spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32``, on request the ids as bytes."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path))
    schema = f"{key} bigint, piece int, start bigint, length int, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(shared.value)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for k, body in zip(batch["key"], batch["text"], strict=True):
                ids = np.frombuffer(known.text_ids(body), known.dtype).astype("<u4").tobytes() + end
                for i, (start, raw) in enumerate(cut_pieces(ids, capacity)):
                    row = (None if pd.isna(k) else int(k), i, start, len(raw) // 4, zlib.crc32(raw))
                    rows.append((*row, raw) if with_ids else row)
            names = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({key: "Int64"})

    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInPandas(run, schema)


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best fit over runs; rows of ``PLAN``.

    A row says: of the documents of ``length``, those with ranks ``first_rank`` to ``first_rank + n - 1``
    go, ``copies`` to a sequence, to the sequences from ``first_sequence`` on, from ``place`` on.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs of (first sequence, number)
    sizes: list[int] = []  # range-sorted, those that have gaps
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def add(size: int, first: int, number: int) -> None:
        if size and number:
            if not gaps[size]:
                bisect.insort(sizes, size)
            gaps[size].append((first, number))

    for length in sorted((x for x in counts if x), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                copies = capacity // length
                number = -(-left // copies)
                add(capacity, opened, number)
                opened += number
                continue
            size = sizes[at]
            first, number = gaps[size].pop()
            if not gaps[size]:
                sizes.pop(at)
            copies = min(size // length, left)
            used = min(number, left // copies)
            plan.append((length, rank, used * copies, copies, first, capacity - size))
            add(size, first + used, number - used)
            add(size - copies * length, first, used)
            rank += used * copies
            left -= used * copies
    return plan


def plan_rounds(lengths: DataFrame, capacity: int) -> DataFrame:
    """The rounds for a table of ``length``; its runs are at most ``capacity`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for batch in batches:
            counts.update(zip(batch["length"].tolist(), batch["n"].tolist(), strict=True))
        names = [x.split()[0] for x in PLAN.split(", ")]
        yield pd.DataFrame(best_fit_rounds(counts, capacity), columns=names)

    runs = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return runs.coalesce(1).mapInPandas(run, PLAN)


def place(table: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``table`` is read twice and should be stored.
    """
    order = order or [c for c in table.columns if c != "length"]
    buckets = table.count() // ROWS_PER_BUCKET + 1
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    ranked = numbered(table, ["length"], order, bucket, "__rank")
    step = F.struct("first_rank", "copies", "first_sequence", "place")
    plan = plan_rounds(table.select("length"), capacity).groupBy("length").agg(
        F.array_sort(F.collect_list(step)).alias("__steps")
    )
    # One row per length, and as many steps as the runs have splits: bounded by the capacity.
    joined = ranked.join(F.broadcast(plan), "length")
    mine = F.expr("element_at(filter(__steps, s -> s.first_rank <= __rank), -1)")
    inside = F.col("__rank") - F.col("__s.first_rank")
    return joined.withColumn("__s", mine).select(
        *table.columns,
        (F.col("__s.first_sequence") + F.floor(inside / F.col("__s.copies"))).cast("long").alias("sequence_id"),
        (F.col("__s.place") + (inside % F.col("__s.copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(
    spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    table = cut(pieces(spark, docs, path, capacity, end_id, key, text))
    # The table is stored, so the row numbers stay as they are and spread repeated rows as well.
    tagged = table.withColumn("__row", F.monotonically_increasing_id())
    placed = place(tagged, capacity, [key, "piece", "__row"]).drop("__row")
    return placed.withColumn("length", F.col("length").cast("long"))
