"""Dense numbering of unique rows without putting them through one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

ROWS_PER_BUCKET = 50_000


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def digits_for(rows: int) -> int:
    """Hex digits that make buckets of about ``ROWS_PER_BUCKET`` rows or fewer."""
    return max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET + 1, 16)))


def number_rows(df: DataFrame, key: str, name: str = "row_no") -> DataFrame:
    """Number rows 0, 1, 2, … in the order of ``md5(key)``.

    ``key`` is an expression, unique and non-NULL. Rows are stored first, because they are needed twice. They are bucketed by
    the leading hex digits of the digest, as many as their number asks for, and numbered inside the bucket; the
    bucket's offset comes from the buckets' sizes. Digests are uniform, so no bucket is larger than the others.
    """
    keyed = stored(df.selectExpr("*", f"md5({key}) as __digest"))
    digits = digits_for(keyed.count())
    keyed = keyed.selectExpr("*", f"left(__digest, {digits}) as __bucket")
    sizes = keyed.groupBy("__bucket").agg(F.expr("count(1) as __n"))
    before = "over (order by __bucket rows between unbounded preceding and 1 preceding)"
    offsets = sizes.selectExpr("__bucket", f"coalesce(sum(__n) {before}, 0) as __offset")
    return (
        keyed.selectExpr("*", "row_number() over (partition by __bucket order by __digest) as __in")
        .join(offsets, "__bucket")
        .selectExpr(*[f"`{c}`" for c in df.columns], f"__offset + __in - 1 as {name}")
    )
