"""Encoding and decoding with a public BPE vocabulary through a table of distinct words.

Texts are cut at white space, which the vocabulary's own rules drop and never join across, so a text's
ids are those of its words one after the other. Documents form blocks; a block keeps its texts as
positions in a list of its own distinct words. These lists are dealt out by word, packed by block; where
all blocks' lists for the same share of words meet, they form the table of distinct words, each
word is encoded once, and the ids go back to the blocks, where they are put together by position. Ids become text again by looking each one up in the id-to-piece table,
which is as large as the vocabulary and therefore broadcast.

Defined results: NULL text equals empty text, which has no ids; text of any length is taken whole;
repeated rows and NULL or repeated ids each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, tasks_for, text_bytes, text_or_empty

# White space of the vocabulary's split rule: the White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = re.compile(f"[^{SPACE}]+")
# Largest code point that takes the short way in ``WordEncoder``; all others go through the library.
SIMPLE = re.compile("[\x21-ɏ]*")
# The split rule of the public vocabulary, and what it comes to for ASCII in lower case without control characters.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PARTS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-`{-~]+").findall
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]").search
# White space to ``str.split`` only.
SEPARATORS = "\x1c\x1d\x1e\x1f"
CACHE_WORDS = 500_000
BLOCK_CHARS = 32_000_000

DOCS = "block string, keys array<bigint>, counts array<int>, codes binary"
WORDS = "share int, block string, codes binary, words binary"
CODED = "block string, codes binary, sizes binary, ids binary"
# About so many bytes of text to a share of the distinct words, up to so many shares: a block sends a row to each of them, which must
# hold many words to be worth it, and a share is streamed, so that only its distinct words are in memory.
SHARE_BYTES = 16_000_000
MOST_SHARES = 4096


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Made(dict):
    """A dict that makes the value of a key it does not have, and begins anew at ``CACHE_WORDS`` keys."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """Ids of words without white space, as little-endian bytes of ``dtype``.

    Words of simple letters are split and lowered here and only merged by the library; that gives
    the same ids as the library's whole way, at half the time. All others take the whole way.
    """

    def __init__(self, vocabulary: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.dtype = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters = dict(enumerate(byte_letters()))
        spec = json.loads(vocabulary)
        self.split = regex.compile(self._pattern(spec)).findall if self._known(spec) else None
        self.plain = bool(self.split) and self._pattern(spec) == RULE
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_in = re.compile("|".join(map(re.escape, self.special))).search if self.special else lambda word: None
        self.parts = _Made(self._part)
        self.words = _Made(self.encode)

    @staticmethod
    def _known(spec: dict) -> bool:
        steps = [x["type"] for x in spec["normalizer"].get("normalizers", [])] if spec.get("normalizer") else []
        cuts = [x["type"] for x in spec["pre_tokenizer"].get("pretokenizers", [])] if spec.get("pre_tokenizer") else []
        return steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]

    @staticmethod
    def _pattern(spec: dict) -> str:
        return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def _part(self, part: str) -> bytes:
        # Below 128, all that a part can hold are their own byte letters, but for U+007F.
        plain = part.isascii() and "\x7f" not in part
        mapped = part if plain else part.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def encode(self, word: str) -> bytes:
        if self.split and SIMPLE.fullmatch(word) and not self.special_in(word):
            word = word.lower()
            if self.plain and word.isalpha():
                return self.parts[word]
            clear = self.plain and word.isascii() and word.isprintable()
            return b"".join([self.parts[p] for p in (ASCII_PARTS if clear else self.split)(word)])
        return self._pack(self.whole.encode(word, add_special_tokens=False).ids)

    def text_ids(self, text: str) -> bytes:
        """Ids of a whole text, with a bounded memory of words seen."""
        if self.plain and text.isascii() and not CONTROL(text):
            # No part reaches across white space, so the whole text is split at once; there are fewer parts than words.
            lower = text.lower()
            if not any([s.lower() in lower for s in self.special]):
                return b"".join(map(self.parts.__getitem__, ASCII_PARTS(lower)))
        words = WORD.findall(text) if any([c in text for c in SEPARATORS]) else text.split()
        return b"".join(map(self.words.__getitem__, words))


def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary, until another step keeps or forgets."""
    return kept(("encoder", hash(vocabulary)), lambda: WordEncoder(vocabulary))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list, list[list[int]], dict[str, int]]]:
    """Consecutive rows up to ``BLOCK_CHARS``: name, ids, texts as word codes, the distinct words."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    keys: list = []
    counts: list[int] = []
    codes: list[np.ndarray] = []
    table: dict[str, int] = {}
    chars = 0
    for batch in batches:
        for key, text in zip(batch["key"], batch["text"], strict=True):
            if chars and chars + len(text) > BLOCK_CHARS:
                yield f"{part}-{number}", keys, counts, codes, table
                keys, counts, codes, table, chars = [], [], [], {}, 0
                number += 1
            found = WORD.findall(text)
            codes.append(np.array([table.setdefault(w, len(table)) for w in found], np.uint32))
            keys.append(None if pd.isna(key) else int(key))
            counts.append(len(found))
            chars += len(text)
    if keys:
        yield f"{part}-{number}", keys, counts, codes, table


def _doc_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block, keys, counts, codes, _ in _blocks(batches):
        row = {"block": block, "keys": keys, "counts": counts, "codes": _packed(np.concatenate(codes))}
        yield pd.DataFrame([row])


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _word_rows(shares: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, _, _, _, table in _blocks(batches):
            words = list(table)
            share = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64) % shares
            order = np.argsort(share, kind="stable")
            edges = np.searchsorted(share[order], np.arange(shares + 1))
            rows = []
            for i in range(shares):
                own = order[edges[i] : edges[i + 1]]
                if len(own):
                    text = " ".join([words[c] for c in own]).encode()
                    rows.append((i, block, _packed(np.diff(own, prepend=0)), zstandard.compress(text, 3)))
            yield pd.DataFrame(rows, columns=["share", "block", "codes", "words"])

    return run


def _encode_share(vocabulary) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(vocabulary.value)
        distinct: dict[str, bytes] = {}
        for part in parts:
            sizes, ids = [], []
            for raw in part["words"]:
                own = zstandard.decompress(raw).decode().split(" ")
                for w in own:
                    if w not in distinct:
                        distinct[w] = known.encode(w)
                found = [distinct[w] for w in own]
                sizes.append(_packed(np.array([len(x) for x in found])))
                ids.append(zstandard.compress(b"".join(found), 3))
            yield pd.DataFrame({"block": part["block"], "codes": part["codes"], "sizes": sizes, "ids": ids})

    return run


def encoded_words(docs: DataFrame, vocabulary, shares: int) -> DataFrame:
    """The ids of the distinct words of every block, each word encoded once in its share."""
    words = docs.mapInPandas(_word_rows(shares), WORDS)
    return words.repartition(shares, "share").groupBy("share").applyInPandas(_encode_share(vocabulary), CODED)


def pieces(vocabulary: str) -> list[str]:
    """The id-to-piece table."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(vocabulary)
    by_id = {i: piece for piece, i in known.get_vocab(with_added_tokens=True).items()}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def encode_blocks(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str,
    emit: Callable[[list, list[bytes], list[str]], pd.DataFrame],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode and decode every text; ``emit`` turns a block's ids, id bytes and texts into rows."""
    shared = spark.sparkContext.broadcast(vocabulary)
    table = spark.sparkContext.broadcast(pieces(vocabulary))
    flat = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    size = text_bytes(flat)
    tasks = tasks_for(spark, size)
    shares = min(MOST_SHARES, tasks_for(spark, size, SHARE_BYTES))
    coded = encoded_words(flat, shared, shares)
    blocks = flat.mapInPandas(_doc_blocks, DOCS)

    def join_back(block: pd.DataFrame, words: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        dtype = encoder(shared.value).dtype
        piece = table.value
        ids: dict[int, bytes] = {}
        shown: dict[int, str] = {}
        for packed in words.itertuples():
            codes = np.cumsum(_unpacked(packed.codes).astype(np.int64)).tolist()
            raw, end = zstandard.decompress(packed.ids), 0
            for code, n in zip(codes, _unpacked(packed.sizes).tolist(), strict=True):
                ids[code] = own = raw[end : end + n]
                shown[code] = " ".join([piece[i] for i in np.frombuffer(own, dtype).tolist()])
                end += n
        nothing = {i for i, own in ids.items() if not own}
        row = block.iloc[0]
        codes = _unpacked(row["codes"])
        ends = np.cumsum(row["counts"])
        keys, raws, texts = [], [], []
        for k, end, n in zip(row["keys"], ends, row["counts"], strict=True):
            own = codes[end - n : end].tolist()
            raws.append(np.frombuffer(b"".join([ids[c] for c in own]), dtype).astype("<u4").tobytes())
            if nothing:
                own = [c for c in own if c not in nothing]
            texts.append(" ".join([shown[c] for c in own]))
            keys.append(None if pd.isna(k) else int(k))
        return emit(keys, raws, texts)

    own, theirs = (side.repartition(tasks, "block").groupBy("block") for side in (blocks, coded))
    return own.cogroup(theirs).applyInPandas(join_back, schema)


def encode(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the ids as an array, and the decoded text of every document."""

    def emit(keys: list, raws: list[bytes], texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                key: pd.Series(keys, dtype="Int64"),
                "ids": [np.frombuffer(r, "<u4").astype(np.int32) for r in raws],
                "decoded": texts,
            }
        )

    vocabulary = read_vocabulary(path)
    return encode_blocks(spark, docs, vocabulary, emit, f"{key} bigint, ids array<int>, decoded string", key, text)


def decode(spark: SparkSession, encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and text of id arrays, by a join of all ids with the id-to-piece table.

    ``key`` must be unique here; ids that the vocabulary does not have are left out.
    """
    rows = list(enumerate(pieces(read_vocabulary(path))))
    table = spark.createDataFrame(rows, "id int, piece string")
    flat = encoded.select(key, F.posexplode_outer(ids).alias("pos", "id"))
    joined = flat.join(F.broadcast(table), "id", "left")
    own = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return joined.groupBy(key).agg(F.array_join(F.transform(own, lambda x: x["piece"]), " ").alias("decoded"))
