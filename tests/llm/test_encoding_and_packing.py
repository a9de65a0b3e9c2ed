"""Encoding, decoding and packing against the library and against plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sonolog.llm import bpe, packing, queries
from sonolog.llm.common import table, tokenizer_path

VOCABULARY = bpe.read_vocabulary(tokenizer_path())
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd_docs(spark):
    """NULLs, empty and long texts, repeated rows, special tokens, and a clashing column."""
    long = "Überlang und STRAẞE 12345 don't " * 4000
    texts = [None, "", " \n\t", "a", "It's <|endoftext|> x<|startoftext|>y", "é é ﬁ ½ ² 中文 🙂🙂", long, "same", "same"]
    rows = [(i if i < 7 else 7, t, None, None, None) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 1)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("x")).withColumn("block", F.lit(1))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_words_have_the_ids_of_the_whole_text(text):
    known = bpe.encoder(VOCABULARY)
    got = np.frombuffer(known.text_ids(text), known.dtype).tolist()
    assert got == known.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("code", range(0x80))
def test_every_ascii_character_alone_and_in_a_word(code):
    known = bpe.encoder(VOCABULARY)
    for text in (chr(code), f"ab{chr(code)}cd", f"{chr(code)}x", f"7{chr(code)}", f"{chr(code)}{chr(code)} é{chr(code)}"):
        assert np.frombuffer(known.text_ids(text), known.dtype).tolist() == known.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", list("\t\n\x0b\x0c\r \x85\xa0        　᠎​\x1c"))
def test_every_kind_of_space(space):
    known = bpe.encoder(VOCABULARY)
    text = f"ab{space}'s{space}{space}cd́{space}"
    assert np.frombuffer(known.text_ids(text), known.dtype).tolist() == known.whole.encode(text, add_special_tokens=False).ids


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    shown = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_query_is_what_the_library_says(spark, sf_dir, library):
    got = queries.op2_bpe(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, docs[r.doc_id])


def test_encode_and_decode_odd_texts(spark, odd_docs, library):
    got = bpe.encode(spark, odd_docs, tokenizer_path())
    rows = got.collect()
    texts = Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    expect = Counter()
    for (key, text), n in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        expect[key, tuple(ids), library.decode(ids, skip_special_tokens=False)] += n
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == expect
    unique = got.where("doc_id is not null").dropDuplicates(["doc_id"])
    joined = {r.doc_id: r.decoded for r in bpe.decode(spark, unique, tokenizer_path()).collect()}
    assert joined == {r.doc_id: r.decoded for r in unique.collect()}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(spark, empty, tokenizer_path()).count() == 0
    assert packing.pack(spark, empty, tokenizer_path()).count() == 0


def check_packed(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pieces_of(library, docs, capacity):
    found = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        for i, start in enumerate(range(0, len(ids), capacity)):
            raw = np.array(ids[start : start + capacity], "<u4").tobytes()
            found[r.doc_id, i, start, len(raw) // 4, zlib.crc32(raw)] += 1
    return found


def test_packing_query(spark, sf_dir, library):
    rows = queries.op10_packing(spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents")
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of(library, docs, 4096)
    lengths = [r.length for r in rows]
    sequences = check_packed(rows, 4096)
    assert sequences == len(plain_best_fit(lengths, 4096))
    assert sequences <= -(-sum(lengths) // 4096) + 1


def test_packing_odd_texts(spark, odd_docs, library):
    rows = packing.pack(spark, odd_docs, tokenizer_path(), capacity=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of(library, odd_docs, 512)
    check_packed(rows, 512)


def plain_best_fit(lengths, capacity):
    """Gaps after placing one document after the other, longest first, into the smallest gap that fits."""
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            gaps.append(capacity - x)
    return gaps


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_rounds_are_best_fit(lengths):
    plan = packing.best_fit_rounds(Counter(lengths), 50)
    used: Counter = Counter()
    placed: Counter = Counter()
    for length, _, n, copies, first, _ in plan:
        placed[length] += n
        for i in range(n // copies):
            used[first + i] += copies * length
    assert placed == Counter(lengths)
    assert sorted(50 - x for x in used.values()) == sorted(plain_best_fit(lengths, 50))


def test_one_length_in_a_third_of_the_rows(spark):
    lengths = [7] * 3000 + list(range(1, 101)) * 60
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id bigint, length int")
    got = packing.place(rows.checkpoint(), 100, ["id"]).collect()
    assert len(got) == len(lengths)
    assert check_packed(got, 100) == len(plain_best_fit(lengths, 100))


def test_plain_texts_are_split_at_once_into_the_librarys_ids():
    """Words that differ in case or in the marks around them cost no entry of their own; other texts take the longer way."""
    known = bpe.WordEncoder(VOCABULARY)

    def same(text: str) -> bool:
        own = np.frombuffer(known.text_ids(text), known.dtype).tolist()
        return own == known.whole.encode(text, add_special_tokens=False).ids

    plain = " ".join([f"{w}{end}" for w in ("Word", "WORD", "word", "it's", "IT'S") for end in ("", ",", ".", "!?", "12", "'s", "'re\n")])
    assert same(plain) and not known.words and len(known.parts) < 20
    odd = ["", "a<|ENDOFTEXT|>b <|endoftext|>C", "\x1cA\x1fb\x7f \x00'S", "é'S \x85 İ\xa0²x", "Ll--'D _a_\t`b`"]
    odd += [f"a{chr(i)}B {chr(i)} 's{chr(i)}'S 1{chr(i)}." for i in range(0x260)]
    assert [x for x in odd if not same(x)] == []
