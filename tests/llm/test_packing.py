"""Windows: every id once, in order, little padding; the differencing itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainwise.llm import packing
from tests.llm.conftest import FOLDER

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENS = packing.WordTokens(PATH)
TEXTS = [
    "", " ", "a  b", "a   b", "x \n \n y", "\n\n lead", "tail  ", "it's 'll don't's.", "<|endoftext|> a", "word.\nNext line,\nthird", "é ü  wide",
    "\x1cctrl", "!!! ??", "😀 日本", "a\tb\r\nc", "x" * 3000, "many words " * 9000,
]


def ids_of(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, documents: list[tuple]):
    """Pieces cover each document once; offsets are gapless; sequences fit."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for key, text in documents:
        at, ids = 0, ids_of(text)
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    return 1 - sum(r.length for r in rows) / (2048 * len(by_seq))


def test_whole_table(spark, documents):
    assert check(packing.query(spark, FOLDER).collect(), list(documents.items())) < 0.02


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + [(100, None)], "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS start")
    check(packing.pieces(df.coalesce(1), PATH).collect(), [*rows, (100, None)])


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "no key")], "doc_id bigint, text string")
    got = packing.pieces(df.coalesce(1), PATH).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert packing.pieces(df.limit(0), PATH).collect() == []


def test_special_strings_are_ordinary_text():
    tokens = packing.WordTokens(PATH)
    assert np.frombuffer(tokens.encode(["<|endoftext|>"])[0], "<u4").tolist() != [50256]


def test_cached_words_give_the_ids_of_whole_texts():
    tokens = packing.WordTokens(PATH)
    whole = [np.asarray(e.ids, "<u4").tobytes() for e in tokens.encoder.encode_batch(TEXTS, add_special_tokens=False)]
    assert tokens.encode(TEXTS) == whole and tokens.encode(TEXTS) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 900), max_size=80), st.booleans())
def test_windows_hold_every_id_once(lengths, cut):
    windows = packing.windows_of(lengths, 256, cut)
    seen = [np.zeros(n, int) for n in lengths]
    for w in windows:
        assert 0 < sum(p[2] for p in w) <= 256
        for row, start, size in w:
            seen[row][start : start + size] += 1
    assert all((s == 1).all() for s in seen)
    if cut:
        assert len(windows) == -(-sum(lengths) // 256) or sum(n % 256 for n in lengths) <= 256 * len(windows)
        assert 256 * len(windows) - sum(lengths) < 256


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 400, 200)
    sums = [int(sizes[w].sum()) for w in packing.difference(sizes, 10)]
    assert sum(sums) == sizes.sum() and max(sums) - min(sums) <= 3
    assert packing.difference(np.array([8, 7, 6, 5, 4]), 2) and {
        sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    } == {14, 16}  # the classic example


def test_window_count_rises_without_cutting():
    assert len(packing.windows_of([150, 150, 150], 256, cut=False)) == 3
    assert len(packing.windows_of([150, 150, 150], 256, cut=True)) == 2


@pytest.mark.parametrize("k", [1, 3])
def test_more_windows_than_items(k):
    assert sorted(i for w in packing.difference(np.array([5]), k) for i in w) == [0]


def test_cache_is_bounded():
    """Words of either kind and long ones leave the cache; what a worker holds does not follow the input."""
    words = packing.WordTokens(PATH, 250_000)
    for k in range(5):
        words.encode([" ".join(f"w{k}x{i}" for i in range(100_000)), *(f"line{k}x{i}" for i in range(100_000))])
        assert len(words.later) + len(words.first) <= 450_000
    for k in range(4):
        words.encode([f"{k}x{i}".ljust(3000, "y") for i in range(1500)])
    assert sum(map(len, words.first)) + sum(map(len, words.later)) < 13_000_000


def test_new_words_are_encoded_together():
    """Words and closing punctuation are met once each, and the tokenizer gets new words many at a time."""
    tokens, seen = packing.WordTokens(PATH), []
    encode = tokens._encode
    tokens._encode = lambda parts: (seen.extend(parts), encode(parts))[1]
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(6400)]
    texts = [" ".join(words), " ".join(w + "." for w in words), "\n".join(w + ",###" for w in words)]
    whole = [np.asarray(e.ids, "<u4").tobytes() for e in tokens.encoder.encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode(texts) == whole
    assert len(seen) < 300


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\r.'#aZ7", "  ", "\n\n", "ab", "é.", "日", "²", "ǅ!", "'s", "\x1c", "\x85", " ", "\x00", "😀", "é."]), max_size=12).map("".join), max_size=6))
def test_any_text_gives_the_ids_of_the_whole(texts):
    whole = [np.asarray(e.ids, "<u4").tobytes() for e in TOKENS.encoder.encode_batch_fast(texts, add_special_tokens=False)]
    assert TOKENS.encode(texts) == whole
