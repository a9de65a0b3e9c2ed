"""Mixing sources to target weights by repetition.

Every source gets a target: its weight's part of ``share`` times all words, but at most ``cap`` times its own
words; what is above goes to the others by weight until none is above. A source's repetition rate is its target over its
words, and a document comes floor(rate) times, and once more if a number drawn from a digest of its
key is below the fraction. Built-in expressions only.

The targets are the smaller of ``cap * size`` and ``weight * level`` for one level. It is found from below by
aggregates over the sources: the next level is that at which the sources below their cap take what the capped ones leave.
Each step caps at least one more source; what is brought to the driver is one row per step.

Documents are reduced to key, source and number of words first. Equal ones are counted before the shuffle, numbered,
and draw one by one, so that a row that makes up a third of the table does not decide by a single draw. Sources meet
their documents by broadcast if they are hot and by shuffle otherwise.

Defined results: NULL text has no words, a NULL source comes last and has its weight, a NULL key counts as the
text ``null``; a source without words has the target 0 and its documents are taken 0 times; an empty table gives no rows.
In ``emit`` rows with the same key share the first draw; other columns, whatever their names, pass through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, ranked, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
BITS = 52
# The characters between words.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
# Equal rows that one task numbers.
EQUAL_ROWS = 10_000


def words(text: str = "text") -> Column:
    """Number of runs of characters that are not blank; no array of the words is made."""
    body = F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(body, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key, source, size, n``: documents by their number of words, equal ones counted."""
    light = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words(text).alias("size"))
    return light.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n"))


def _level(sources: DataFrame, budget: float, cap: float) -> float | None:
    """The level at which the targets add up to the budget; None where every source is at its cap."""
    capped, level = -1, None
    own = F.col("source_size") * cap
    while True:
        at_cap = F.lit(False) if level is None else own <= F.col("weight") * level
        row = sources.agg(
            F.count_if(at_cap), F.sum(F.when(at_cap, F.col("source_size"))), F.sum(F.when(~at_cap, F.col("weight")))
        ).first()
        if row[0] == capped:
            return level
        if not row[2]:
            return None
        capped, level = row[0], (budget - cap * float(row[1] or 0)) / row[2]


def targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``source, rows, source_size, weight, target, rate`` for ``sizes``; stored."""
    found = cut(
        rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    )
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    placed = ranked(found, [F.asc_nulls_last("source")], "place", found.count(), 0)
    turn = F.pmod(F.col("place"), F.lit(len(weights)))
    weighed = cut(placed.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn)).drop("place"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = _level(weighed, share * total, cap)
    most = F.col("source_size") * cap
    target = most if level is None else F.least(most, F.col("weight") * level)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return cut(weighed.withColumn("target", target.cast("double")).withColumn("rate", rate))


def copies(rate: Column, key: Column, number: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more if the draw of the ``number``-th row with this key is below the fraction."""
    label = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), number.cast("string"))
    draw = (F.conv(F.substring(F.md5(label), 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << BITS)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _numbered(rows: DataFrame) -> DataFrame:
    """Every counted row as many times as it was there, with ``number`` 1, 2, 3..."""
    few = rows.where(F.col("n") <= EQUAL_ROWS).withColumn("number", F.explode(F.expr("sequence(1L, n)")))
    many = rows.where(F.col("n") > EQUAL_ROWS)
    many = many.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {EQUAL_ROWS})")))
    many = many.repartition("key", "source", "size", "part")
    last = f"least(n, (part + 1) * {EQUAL_ROWS})"
    many = many.withColumn("number", F.explode(F.expr(f"sequence(part * {EQUAL_ROWS} + 1, {last})"))).drop("part")
    return few.unionByName(many)


def take(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``key, source, size, source_size, target, copies, taken`` for every document."""
    rows = cut(sizes(docs, key, source, text))
    tag = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    known = targets(rows, weights, share, cap).withColumn("tag", tag).drop("source")
    placed = _numbered(hot_join(rows.withColumn("tag", tag), known, "tag", counted="rows"))
    times = copies(F.col("rate"), F.col("key"), F.col("number"))
    made = placed.withColumn("copies", times).withColumn("taken", F.col("copies") * F.col("size"))
    return made.select(F.col("key").alias(key), "source", "size", "source_size", "target", "copies", "taken")


def emit(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """The mix itself: every document in its own columns, as often as it is taken; Spark picks the join with the rates."""
    known = targets(cut(sizes(docs, key, source, text)), weights, share, cap)
    own, rate, copy = (unused(docs.columns, c) for c in ("own", "rate", "copy"))
    rates = known.select(F.col("source").alias(own), F.col("rate").alias(rate))
    joined = docs.join(rates, F.col(f"`{source}`").eqNullSafe(F.col(own)))
    times = copies(F.col(rate), F.col(f"`{key}`"), F.lit(1))
    some = joined.withColumn(copy, times).where(F.col(copy) > 0)
    return some.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
