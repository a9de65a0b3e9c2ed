"""Importance resampling of documents towards a target distribution of hashed word n-grams.

The features of a text are all runs of one to ``ORDER`` consecutive words, hashed to buckets. One pass counts
the buckets of all documents and of the target texts; a bucket's gain is the logarithm of how much likelier
it is in the target, and a document's weight is the sum of the gains of its features. Documents are drawn
without replacement: weight plus Gumbel noise from a digest of the id, the highest first.

Inside a task the texts of a batch are joined with separators, one regular expression finds all words, and the
documents' offsets tell which n-grams run across a border; these are masked before the buckets are counted.
Every distinct word is hashed once; the checksum of an n-gram comes from those of its words, because a CRC
over joined bytes is a linear map of the first part's, chosen by the second one's length, plus the second's.
Long texts are taken in pieces that end between words and carry the last words over, so memory does not
grow with a text.

What is brought to the driver is one count per bucket. Documents are put in order by one range shuffle of ids and scores.

Defined results: NULL and empty texts have no features, weigh 0 and are never drawn; a NULL id counts
as the text ``null`` for its noise and comes last among ties; rows with the same id share their noise, and
each takes a rank; without target texts all buckets are equally likely there; an empty table gives no
rows; other columns, whatever their names, pass through ``draw`` as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ranked, unused

ORDER = 3
BUCKETS = 10_000
LEAST_WORDS = 20
SCALE = 1000
SEED = "42"
# Digits of the digest that give the noise.
NOISE_DIGITS = 8

SEPARATOR = b"\n"
# Words are runs of digits, letters and everything beyond ASCII, so whole characters stay together as bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_IS_WORD = np.array([WORD.fullmatch(bytes([b])) is not None for b in range(256)])
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PIECE_BYTES = 2_000_000
CACHE_WORDS = 300_000


class CrcShift:
    """What a CRC-32 becomes when so many bytes follow: four table lookups for each length."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.tables = np.zeros((0, 4, 256), np.uint32)

    @staticmethod
    def _table(length: int) -> np.ndarray:
        zeros = bytes(length)
        none = zlib.crc32(zeros, 0)
        bits = np.array([zlib.crc32(zeros, 1 << i) ^ none for i in range(32)], np.uint32)
        bytes_ = np.arange(256, dtype=np.uint32)
        out = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for i in range(8):
                out[k] ^= np.where(bytes_ >> np.uint32(i) & np.uint32(1), bits[8 * k + i], np.uint32(0))
        return out

    def places(self, lengths: list[int]) -> list[int]:
        fresh = [n for n in dict.fromkeys(lengths) if n not in self.place]
        if fresh:
            self.place.update({n: len(self.place) + i for i, n in enumerate(fresh)})
            self.tables = np.concatenate([self.tables, np.array([self._table(n) for n in fresh])])
        return [self.place[n] for n in lengths]

    def __call__(self, crc: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = self.tables[place, 0, crc & np.uint32(255)]
        for k in (1, 2, 3):
            out ^= self.tables[place, k, crc >> np.uint32(8 * k) & np.uint32(255)]
        return out


class NgramHasher:
    """Buckets of the n-grams of joined texts; keeps the distinct words it has met, up to a bound."""

    def __init__(self, buckets: int = BUCKETS, order: int = ORDER):
        self.buckets, self.order = buckets, order
        self.shift = CrcShift()
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        # By word: its CRC, that of a space and the word, and the length of the latter as a place in ``shift``.
        self.own = np.zeros(0, np.uint32)
        self.spaced = np.zeros(0, np.uint32)
        self.place = np.zeros(0, np.int64)

    def _code(self, words: list[bytes]) -> np.ndarray:
        if len(self.codes) > CACHE_WORDS:
            self._forget()
        fresh = list(set(words) - self.codes.keys())
        if fresh:
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh)), strict=True))
            self.own = np.append(self.own, np.array([zlib.crc32(w) for w in fresh], np.uint32))
            self.spaced = np.append(self.spaced, np.array([zlib.crc32(b" " + w) for w in fresh], np.uint32))
            self.place = np.append(self.place, np.array(self.shift.places([len(w) + 1 for w in fresh]), np.int64))
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[bytes], carried: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and text number of every n-gram, and the number of words of every text.

        The first ``carried`` words of a text only continue n-grams; what ends in them is not counted.
        """
        joined = SEPARATOR.join(texts)
        words = WORD.findall(joined)
        is_word = _IS_WORD[np.frombuffer(joined, np.uint8)]
        starts = np.flatnonzero(is_word & ~np.append(False, is_word[:-1])) if words else np.zeros(0, np.int64)
        offsets = np.cumsum([0] + [len(t) + len(SEPARATOR) for t in texts[:-1]])
        text = np.searchsorted(offsets, starts, side="right") - 1
        first = np.searchsorted(text, np.arange(len(texts)))
        place = np.arange(len(words)) - first[text]
        fresh = place >= np.asarray(carried, np.int64)[text]
        code = self._code(words)
        crc = self.own[code]
        found, owner = [crc[fresh]], [text[fresh]]
        for n in range(2, self.order + 1):
            # ``crc`` is that of the n - 1 words up to each word; one more word goes to its end.
            crc = self.shift(crc[:-1], self.place[code[n - 1 :]]) ^ self.spaced[code[n - 1 :]]
            whole = (text[n - 1 :] == text[: len(text) - n + 1]) & fresh[n - 1 :]
            found.append(crc[whole])
            owner.append(text[n - 1 :][whole])
        bucket = (np.concatenate(found) % np.uint32(self.buckets)).astype(np.int64)
        return bucket, np.concatenate(owner), np.bincount(text[fresh], minlength=len(texts))


def _last_words(piece: bytes, n: int) -> list[bytes]:
    """The last ``n`` words of a piece, looking at no more of its end than needed."""
    size = 64
    while True:
        found = WORD.findall(piece[-size:])
        # The first one found may be the end of a longer word.
        if len(found) > n or size >= len(piece):
            return found[-n:]
        size *= 4


def pieces(texts: Iterable[bytes], order: int = ORDER) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Texts in lower case, in groups of about ``PIECE_BYTES``: text numbers, pieces, carried words.

    Only a longer text is cut, between words; the next piece begins with the last words before it.
    """
    numbers: list[int] = []
    group: list[bytes] = []
    size = 0
    for number, raw in enumerate(texts):
        if group and size + len(raw) > PIECE_BYTES:
            yield numbers, group, [0] * len(group)
            numbers, group, size = [], [], 0
        if len(raw) <= PIECE_BYTES:
            numbers.append(number)
            group.append(raw.translate(_LOWER))
            size += len(raw)
            continue
        carry: list[bytes] = []
        start = 0
        while start < len(raw):
            # A piece ends at the first break after its size, never inside a word.
            end = BREAK.search(raw, min(start + PIECE_BYTES, len(raw)))
            stop = end.start() if end else len(raw)
            piece = raw[start:stop].translate(_LOWER)
            start = stop
            body = b" ".join([*carry, piece])
            yield [number], [body], [len(carry)]
            carry = _last_words(body, order - 1)
    if group:
        yield numbers, group, [0] * len(group)


def _raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How often each bucket occurs over all texts; a task sends one count per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = NgramHasher(buckets, order), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, group, carried in pieces(_raw(batch, "t"), order):
                total += np.bincount(hasher(group, carried)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "bucket bigint, n bigint")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row per bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(SCALE * ln)`` of the ratio of the smoothed shares in target and raw texts, per bucket."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    ratios = [(float(t) + 1) * (float(s_all) + n) / ((float(s) + 1) * (float(t_all) + n)) for s, t in zip(raw, target, strict=True)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, columns: list[str], text: str = "text", order: int = ORDER) -> DataFrame:
    """``columns`` of every document with ``n_words, n_features, weight``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    body = unused(columns, "body")
    fields = [docs.schema[c] for c in columns]
    made = [unused(columns, c) for c in ("n_words", "n_features", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        hasher = NgramHasher(len(gain), order)
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for numbers, group, carried in pieces(_raw(batch, body), order):
                bucket, owner, count = hasher(group, carried)
                at = np.asarray(numbers)
                # Sums of whole numbers below 2 ** 53, which doubles hold exactly.
                total = np.bincount(owner, weights=gain[bucket], minlength=len(group)).astype(np.int64)
                np.add.at(words, at, count)
                np.add.at(features, at, np.bincount(owner, minlength=len(group)))
                np.add.at(weight, at, total)
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            arrays = [*own, pa.array(words), pa.array(features), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *made])

    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in made]])
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)


def noise(key: Column) -> Column:
    """Whole-number Gumbel noise, ``SCALE`` to the unit, from a digest of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    unit = (F.conv(F.substring(digest, 1, NOISE_DIGITS), 16, 10).cast("double") + 0.5) / float(16**NOISE_DIGITS)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(unit)))


def scores(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score`` of every document."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    weighed = weigh(docs, gain, [key], text)
    return weighed.withColumn("score", F.col("weight") + noise(F.col(key)))


def draw_ranks(scored: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """Add ``rank`` to ``scores``: 1, 2, 3... for the drawn documents, NULL for all others."""
    scored = cut(scored)
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features")]
    placed = ranked(scored.where(enough), order, "rank", n)
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", drawn).unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn documents in their own columns; ``key`` tells documents apart."""
    own = unused(docs.columns, "drawn")
    drawn = draw_ranks(scores(docs, target, key, text), percent, key=key).where("rank is not null")
    same = F.col(f"`{key}`").eqNullSafe(F.col(own))
    return docs.join(drawn.select(F.col(key).alias(own)).distinct(), same, "left_semi")
