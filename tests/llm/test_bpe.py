import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ENC = bpe.encoding(RANKS, PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1'\n\tsé汉!-２  　"), max_size=60), st.integers(1, 10))
def test_safe_parts_give_the_same_ids(text, part):
    assert "".join(bpe.split_safe(text, part)) == text
    assert bpe.encode_text(ENC, text, part) == ENC.encode_ordinary(text)


def test_long_texts():
    for text in ("word " * 100_000, "x" * 150_000, "a1" * 80_000, " " * 150_000 + "x", "it's" * 40_000):
        assert bpe.encode_text(ENC, text) == ENC.encode_ordinary(text)


def test_special_strings_are_text():
    assert ENC.decode_bytes(bpe.encode_text(ENC, "<|endoftext|>")) == b"<|endoftext|>"
    assert 50256 not in bpe.encode_text(ENC, "<|endoftext|>")


def test_round_trip(docs, docs_rows):
    rows = bpe.round_trip(docs, RANKS, PATTERN).collect()
    want = []
    for i, text, *_ in docs_rows:
        ids = ENC.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_decode_and_keep(docs, docs_rows):
    decoded = bpe.decode(bpe.encode(docs, RANKS, PATTERN, ("doc_id", "source"), part=16), RANKS, PATTERN, ("doc_id", "source"))
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((r[1] or "").encode() for r in docs_rows)


def test_empty_and_clashing(docs, no_docs):
    from pyspark.sql import functions as F

    assert bpe.round_trip(no_docs, RANKS, PATTERN).collect() == []
    assert bpe.encode(docs.withColumn("ids", F.lit("x")), RANKS, PATTERN).count() == docs.count()


def test_missing_rank_file():
    with pytest.raises(FileNotFoundError):
        bpe.encoding("/nowhere.tiktoken", PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(" \n\t\u2003xé1!"), st.integers(1, 9)), max_size=8), st.integers(2, 5))
def test_runs_of_white_space_give_the_same_ids(parts, least):
    text = "".join(c * n for c, n in parts)
    kept, long = bpe._BLANKS, bpe.LONG_RUN
    bpe._BLANKS, bpe.LONG_RUN = bpe.regex.compile(rf"(?<!\s)\s{{{least},}}"), least
    try:
        assert bpe.encode_text(ENC, text, 3) == ENC.encode_ordinary(text)
    finally:
        bpe._BLANKS, bpe.LONG_RUN = kept, long


def test_runs_just_below_the_length_are_not_searched_again_and_again():
    import time

    text = ("x" + " " * (bpe.LONG_RUN - 1)) * 245  # a million characters
    began = time.perf_counter()
    ids = bpe.encode_text(ENC, text)
    assert time.perf_counter() - began < 2
    assert ids == ENC.encode_ordinary(text)


def test_very_long_runs():
    for n in (1_000_000, 10_000_000):
        for c in (" ", "\n", "x", "!"):
            for text in (c * n, c * n + "y", "a" + c * n + " b"):
                ids = bpe.encode_text(ENC, text)
                assert ENC.decode_bytes(ids) == text.encode()
    for c in (" ", "\n", "\t ", "x", "!"):  # the longest that the library bears whole
        for text in (c * 70_000, c * 70_000 + "y"):
            assert bpe.encode_text(ENC, text) == ENC.encode_ordinary(text)
