"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its runs of five words. Texts with the same words in the same order are one node
from the start, whatever the number of copies. The signature of a node is that of a weighted set: every
element has Poisson processes on the weight axis, one for (0, 1] and one for each (2^(k-1), 2^k] that its
weight reaches into; a point lies, bisection by bisection, at one of the whole weights of its stretch and
counts if the element is that heavy. Each component of the signature is the earliest point that fell to
it, so two nodes agree in a component with their weighted Jaccard similarity as probability.

Nodes that share a band form a bucket. No bucket is ever expanded into all its pairs: first each
member is verified against one node only, the one that meets most others over all its buckets, and
components are formed. In ``TURNS`` rounds the members of each bucket of several components are held
against one more member, another one in every bucket, which joins most of the rest.
Then pairs of one bucket that are still in different components are verified, unless
their known similarities to that first node differ by more than the distance allowed, in which case the
triangle inequality of the Jaccard distance proves that they are no link, or too many hash classes hold
elements of only one of them. Every pair that shares a bucket is thus verified, proven apart or
already connected. ``verified_links`` counts the links of a node that were verified on the way to the classes; it is not the
number of all its similar texts, because pairs that are connected already are not verified.

Defined results: NULL text equals empty text, and all empty texts are copies of each other; texts of fewer
than five words are one element; a class is named by its smallest id, NULL if it has none, and the row of
that id stays, once, in ``keep``; an empty table gives no rows; extra columns pass through ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import cycle
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import cut, hot_join, kept, release, text_or_empty, unused
from .grams import row_key

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
COMPONENTS = BANDS * ROWS
# Hash classes of elements: so many for each element, a power of two within these bounds. A class that only one
# of two texts marks holds an element that they do not share; beyond the upper bound that only proves less.
MARKS_EACH, MARKS_MIN, MARKS_MAX = 8, 1024, 8192
# Rounds in which each bucket of several components is held against one more of its members.
TURNS = 2
CACHE_WORDS = 300_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, in order."""
    words = text.lower().split()
    known = kept("word hashes", dict)
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.array([known[w] for w in words], U)


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of words and how often each occurs."""
    if not len(hashes):
        return np.zeros(0, U), np.zeros(0, np.int64)
    width = min(WORDS, len(hashes))
    n = len(hashes) - width + 1
    total = np.zeros(n, U)
    for i in range(width):
        total = total * U(0x9E3779B97F4A7C15) + mix(hashes[i : i + n] + U(i))
    return np.unique(mix(total), return_counts=True)


def bag_minhash(elements: np.ndarray, weights: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """Earliest point of each component; needs at least one element."""
    levels = np.ceil(np.log2(weights.astype(float))).astype(np.int64)  # the last stretch a weight reaches into
    each = np.repeat(np.arange(len(elements)), levels + 1)
    level = np.arange(len(each)) - np.repeat(np.cumsum(levels + 1) - (levels + 1), levels + 1)
    start = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.where(level == 0, 1, start)
    seeds = mix(elements[each] + mix(level.astype(U) + U(1)))
    limit = m * (np.log(m) + 3) / weights.sum()
    while True:
        found = np.full(m, np.inf)
        seed, rate, first, heavy = seeds, length, start, weights[each]
        now = np.zeros(len(seed))
        step = 0
        while len(seed):
            points = int(1.2 * limit * rate.mean()) + 1
            state = mix(seed[:, None] + np.arange(step + 1, step + points + 1, dtype=U) * U(0x9E3779B97F4A7C15))
            gap = -np.log(((state >> U(11)).astype(float) + 0.5) / (1 << 53)) / rate[:, None]
            # One running sum: the bits of a time do not depend on where a step ends.
            time = np.cumsum(np.concatenate([now[:, None], gap], axis=1), axis=1)[:, 1:]
            other = mix(state ^ U(0xD1B54A32D192ED03))
            place = first[:, None] + 1 + ((other >> U(32)) % rate.astype(U)[:, None]).astype(np.int64)
            counts = (time <= limit) & (place <= heavy[:, None])
            np.minimum.at(found, ((other & U(0xFFFFFFFF)) % U(m))[counts].astype(np.int64), time[counts])
            on = time[:, -1] <= limit
            seed, rate, first, heavy, now = seed[on], rate[on], first[on], heavy[on], time[on, -1]
            step += points
        if np.isfinite(found).all():
            return found
        limit *= 2


def bands(signature: np.ndarray) -> np.ndarray:
    """A long for each band."""
    bits = signature.view(U).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=U)
    for i in range(ROWS):
        total = mix(total * U(0x9E3779B97F4A7C15) + bits[:, i])
    return total.view(np.int64)


def marks(elements: np.ndarray, size: int) -> np.ndarray:
    """Bits, as longs, of the hash classes that hold an element."""
    classes = MARKS_MIN
    while classes < min(MARKS_EACH * size, MARKS_MAX):
        classes *= 2
    bits = np.zeros(classes, bool)
    bits[((elements >> U(20)) % U(classes)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def node_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - shared
    return shared / either if either else 1.0


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            hashes = word_hashes(text)
            bag = shingles(hashes)
            size = int(bag[1].sum())
            own = (bands(bag_minhash(*bag)), marks(bag[0], size)) if size else (None, None)
            rows.append((key, node_of(hashes), size, *own))
        yield pd.DataFrame(rows, columns=["key", "node", "size", "bands", "marks"])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        last, mine = None, None
        found = []
        for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if a != last:
                last, mine = a, shingles(word_hashes(ta))
            found.append(overlap(mine, shingles(word_hashes(tb))))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": found})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs of nodes; ``texts`` has ``node, text``."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInPandas(_verify, "a binary, b binary, similarity double")


class Steps:
    """Results of steps as Parquet files in a folder of their own, until they are dropped.

    Unlike checkpoints they are compressed, read by the column and in as many tasks as their size asks for, not in one
    for each task that wrote them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch_path(spark, name)

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written under ``name``, in place of what was there, and read from there."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, steps: Steps | None = None, name: str = "roots") -> DataFrame:
    """``node, root``: the smallest node of each connected component, for all nodes that have an edge.

    A node takes the smallest label around it, hands it on to the node that its old label names, and then takes
    the label of its label, so that long chains shrink by a factor in every step.

    Edges and labels are stored as Parquet files, whose sizes Spark knows. For a checkpoint it goes on with the size it
    estimated, for a join the product of both sides: from step to step and call to call, a number of ever more digits in
    the driver, beyond its memory before long. A step's labels take the place of those before the last; of ``steps`` only
    ``name`` is left in the end.
    """
    steps = steps or Steps(edges.sparkSession, "components")
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = steps.store("edges", edges.select(F.explode(ways).alias("way")).select("way.*").distinct())
    slots = cycle(["odd", "even"])
    labels = steps.store(next(slots), both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        other = labels.select(F.col("node").alias("other"), F.col("root").alias("theirs"))
        near = both.join(other, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        seen = labels.join(near, "node")
        hooks = seen.groupBy(F.col("root").alias("node")).agg(F.min("theirs").alias("hook"))
        hooked = steps.store(
            "hooked",
            seen.join(hooks, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "theirs", "hook").alias("root")),
        )
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        stepped = steps.store(next(slots), hooked.join(jump, "root", "left").select("node", "old", F.least("root", "further").alias("root")))
        labels = stepped.select("node", "root")
        if not stepped.where("root <> old").limit(1).count():
            found = steps.store(name, labels)
            steps.drop("edges", "hooked", "odd", "even")
            return found


def buckets(nodes: DataFrame, steps: Steps) -> DataFrame:
    """``band, node, size, first``: members of all bands that have at least two nodes.

    ``first`` is the member that meets most others over all its bands, as the original of many copies does;
    the smallest node of several.
    """
    members = nodes.where("bands is not null").select(F.explode("bands").alias("band"), "node", "size")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = steps.store("met", members.join(shared, "band"))
    crowd = met.groupBy("node").agg(F.sum("n").alias("crowd"))
    rank = F.struct(-F.col("crowd"), F.col("node"))
    first = met.select("band", "node").join(crowd, "node").groupBy("band").agg(F.min_by("node", rank).alias("first"))
    found = steps.store("members", met.drop("n").join(first, "band"))
    steps.drop("met")
    return found


def room(size: str, marked: str, size_: str, marked_: str) -> Column:
    """Two multisets may be similar enough, going by the classes that only one of them marks."""
    n = F.least(F.size(marked), F.size(marked_))

    def folded(c: str) -> Column:
        # Numbers of classes are powers of two, so the halves of the larger one lie over the smaller one.
        halves = F.zip_with(F.slice(c, 1, n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseOR(y))
        return F.when(F.size(c) > n, halves).otherwise(F.col(c))

    def alone(a: Column, b: Column) -> Column:
        each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.aggregate(each, F.lit(0), lambda total, x: total + x)

    a, b = folded(marked), folded(marked_)
    most = F.least(F.col(size) - alone(a, b), F.col(size_) - alone(b, a))
    return most * (1 + SIMILARITY) >= SIMILARITY * (F.col(size) + F.col(size_)) - 1e-6


def coarse(marked: str) -> Column:
    """Marks put together to ``MARKS_MIN`` classes."""
    words = MARKS_MIN // 64

    def folded(i: Column) -> Column:
        own = F.transform(F.sequence(i, F.size(marked) - 1, F.lit(words)), lambda j: F.get(marked, j))
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total.bitwiseOR(x))

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), folded)


def coarse_room(size: str, marked: str, size_: str, marked_: str) -> Column:
    """As ``room`` for marks of ``MARKS_MIN`` classes: it proves less, but Spark compiles it."""

    def alone(a: str, b: str) -> Column:
        each = [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(MARKS_MIN // 64)]
        return reduce(add, each)

    most = F.least(F.col(size) - alone(marked, marked_), F.col(size_) - alone(marked_, marked))
    return most * (1 + SIMILARITY) >= SIMILARITY * (F.col(size) + F.col(size_)) - 1e-6


def near_sizes(a: str, b: str) -> Column:
    """Multisets of these sizes can be similar enough."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def mixed(members: DataFrame, roots: DataFrame, turn: int = 0) -> DataFrame:
    """``band, node, size, first, root`` of the buckets that have several components, and of each a ``pivot, size_, root_``.

    The pivot is any member, another one in every bucket and turn.
    """
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = F.struct(F.col("node").alias("pivot"), F.col("size").alias("size_"), F.col("root").alias("root_"))
    any_of = F.min_by(own, F.xxhash64("band", "node", F.lit(turn)))
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), any_of.alias("any"))
    return placed.join(several.where("low <> high").select("band", "any.*"), "band")


def pivot_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Every member of a mixed bucket with the bucket's pivot, unless connected or proven apart."""
    met = mixed(members, roots, turn).where((F.col("root") != F.col("root_")) & near_sizes("size", "size_"))
    once = met.select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    ).distinct()
    own = nodes.select("node", "size", "marks")
    both = once.join(own.toDF("b", "size_", "marks_"), "b").join(own.toDF("a", "size", "marks"), "a")
    return both.where(room("size", "marks", "size_", "marks_")).select("a", "b")


def open_pairs(members: DataFrame, nodes: DataFrame, known: DataFrame, roots: DataFrame, steps: Steps) -> DataFrame:
    """Pairs of a bucket that are in different components and not proven apart.

    A pair that shares several mixed bands comes out of the smallest one only.
    """
    placed = steps.store("placed", mixed(members, roots).select("band", "node", "size", "first", "root"))
    shared = placed.groupBy("node").agg(F.collect_list("band").alias("bands"))
    to_first = known.select(F.col("a").alias("first"), F.col("b").alias("node"), "similarity")
    s = F.when(F.col("node") == F.col("first"), 1.0).otherwise(F.col("similarity"))
    left = steps.store(
        "left",
        placed.join(to_first, ["first", "node"], "left")
        .select("band", "node", "size", "root", s.alias("s"))
        .join(shared.join(nodes.select("node", "marks", coarse("marks").alias("coarse")), "node"), "node"),
    )
    right = left.select("band", *[F.col(c).alias(f"{c}_") for c in ("node", "size", "root", "s", "bands", "marks", "coarse")])
    apart = F.coalesce(F.abs(F.col("s") - F.col("s_")) > 1 - SIMILARITY + 1e-9, F.lit(False))
    smallest = F.array_min(F.array_intersect("bands", "bands_")) == F.col("band")
    # The dearer a test, the later.
    cheap = (F.col("node") < F.col("node_")) & (F.col("root") != F.col("root_")) & near_sizes("size", "size_") & ~apart
    cheap = cheap & coarse_room("size", "coarse", "size_", "coarse_")
    paired = left.join(right, "band").where(cheap & smallest & room("size", "marks", "size_", "marks_"))
    return paired.select(F.col("node").alias("a"), F.col("node_").alias("b"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``key, row_key, node`` of all documents, and ``node, root, links`` of all nodes."""
    identity = row_key(docs)
    steps = Steps(docs.sparkSession, "near-dedup")
    flat = docs.select(identity.alias("key"), text_or_empty(text).alias("text"))
    signed = steps.store(
        "signed", flat.mapInPandas(_sign, "key bigint, node binary, size bigint, bands array<bigint>, marks array<bigint>")
    )
    by_key = signed.groupBy("key").agg(F.first("node").alias("node"))
    rows = steps.store("rows", docs.select(F.col(key).alias("id"), identity.alias("key")).join(by_key, "key"))
    nodes = steps.store(
        "nodes",
        signed.groupBy("node").agg(
            F.first("size").alias("size"), F.first("bands").alias("bands"),
            F.first("marks").alias("marks"), F.min("key").alias("key"),
        ),
    )
    steps.drop("signed")
    release(docs.sparkSession)
    members = buckets(nodes, steps)
    first = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    wanted = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    texts = steps.store("texts", flat.join(wanted, "key").select("node", "text").dropDuplicates(["node"]))
    release(docs.sparkSession)
    sizes = members.select("node", "size").distinct()
    fitting = (
        first.join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b").where(near_sizes("sa", "sb")).select("a", "b")
    )
    known = steps.store("known", verified(fitting, texts))
    is_link = F.col("similarity") >= SIMILARITY
    edges = known.where(is_link).select("a", "b")
    roots = components(edges, steps)
    for turn in range(TURNS):
        release(docs.sparkSession)
        joined = steps.store(f"turn-{turn}", verified(pivot_pairs(members, nodes, roots, turn), texts)).where(is_link).select("a", "b")
        if joined.isEmpty():
            break
        edges = edges.unionByName(joined)
        roots = components(edges, steps)
    release(docs.sparkSession)
    more = steps.store("more", verified(open_pairs(members, nodes, known, roots, steps), texts)).where(is_link).select("a", "b")
    steps.drop("members", "texts", "placed", "left")
    release(docs.sparkSession)
    if not more.isEmpty():
        edges = edges.unionByName(more)
        roots = components(edges, steps)
    links = edges.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    grouped = nodes.select("node").join(roots, "node", "left").join(links, "node", "left")
    grouped = grouped.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    found = steps.store("classes", grouped)
    steps.drop("nodes", "known", *[f"turn-{i}" for i in range(TURNS)], "more", "roots")
    return rows, found


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its class, the class's size, its verified links to other texts, whether it stays."""
    rows, grouped = classes(docs, key, text)
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).join(grouped, "node"))
    whole = nodes.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    table = cut(nodes.join(whole, "root").select("node", "n", "class_id", "class_size", "links"))
    return hot_join(rows, table, "node", counted="n").select(
        F.col("id").alias(key), "class_id", "class_size", F.col("links").alias("verified_links"),
        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"),
    )


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, in its own columns."""
    rows, grouped = classes(docs, key, text)
    first = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "key"))
    low = rows.groupBy("node").agg(first.alias("low")).join(grouped, "node")
    name = unused(docs.columns, "row")
    stays = low.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias(name)).distinct()
    inner = docs.withColumn(name, row_key(docs)).join(cut(stays), name, "left_semi")
    return inner.dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])
