"""A bit per hashed key: which rows cannot be among a set of keys.

The set becomes a bitmap of bounded size, whatever the number of keys, kept as rows of 4 KB. Rows whose bit is not set are
certainly not in the set and can be dropped before a shuffle; the exact join behind it removes the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of one row, as the bitmap functions have them.
ROW_BITS = 32_768
BITS_PER_KEY = 16
# 128 MB: the most that is ever broadcast.
MOST_BITS = 1 << 30


def bits_for(keys: int) -> int:
    """A power of two with ``BITS_PER_KEY`` bits a key, at most ``MOST_BITS``."""
    wanted = max(ROW_BITS, keys * BITS_PER_KEY)
    return min(MOST_BITS, 1 << (wanted - 1).bit_length())


def _place(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(bits))


def build(keys: DataFrame, columns: list[str], bits: int, groups: list[str] | None = None) -> DataFrame:
    """``part, bits``: the bitmap of all rows of ``keys``, one for each of ``groups``."""
    groups = groups or []
    placed = keys.select(*groups, _place(columns, bits).alias("place"))
    rows = placed.selectExpr(*groups, f"place div {ROW_BITS} as part", f"place % {ROW_BITS} as position")
    return rows.groupBy(*groups, "part").agg(F.bitmap_construct_agg("position").alias("bits"))


def probe(rows: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Add ``__part`` and ``__position``, where a row's bit is."""
    placed = rows.withColumn("__place", _place(columns, bits))
    return placed.selectExpr("* except (__place)", f"__place div {ROW_BITS} as __part", f"__place % {ROW_BITS} as __position")


def is_set(bitmap: str = "__bits") -> Column:
    """Whether a probed row's bit is set; false where there is no bitmap."""
    byte = f"cast(conv(hex(substring({bitmap}, int(__position div 8) + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce(bit_get({byte}, int(__position % 8)) = 1, false)")


def maybe_in(rows: DataFrame, keys: DataFrame, columns: list[str], count: int) -> DataFrame:
    """The rows that may be among the ``count`` ``keys``, by a broadcast of at most ``MOST_BITS``; none of them is lost."""
    bits = bits_for(count)
    table = build(keys, columns, bits).withColumnsRenamed({"part": "__part", "bits": "__bits"})
    return probe(rows, columns, bits).join(F.broadcast(table), "__part").where(is_set()).select(*rows.columns)
