"""Ids and decoded texts equal the tokenizer library's; the pair table is exact; edges."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainwise.llm import bpe
from tests.llm.conftest import FOLDER

PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "\n", "a  b", "Hello, World!", "it's 'LL don't", "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|end", "é É é", "日本 😀",
    "a\tb\r\nc d", "\x00\x1c", "İΣς", "</w> <w/>", "x" * 5000, "ab" * 4000, "many words " * 3000, "3.14 ⅷ", "́ start",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.Backtracking(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_whole_table(spark, documents, library):
    rows = bpe.query(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {
        k: expected(library, t) for k, t in documents.items()
    }
    assert len(rows) == len(documents)


@pytest.mark.parametrize("text", TEXTS)
def test_texts(model, library, text):
    assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeinorst ABé\n\t'1,<|>/w日́"), max_size=40))
def test_any_text(model, library, text):
    assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_each_token_is_its_own_encoding(model):
    """Only tokens that merging their own text gives back may be used."""
    reachable = set(model.merges.reachable())
    for i in sorted(reachable)[::97]:
        text = model.merges.text[i]
        if ord(text[-1]) >= bpe._END:
            assert model.word(text[:-1] + chr(ord(text[-1]) - bpe._END)) == [i]


def merged_by_rank(merges, text):
    ids = [merges.text.index(c) for c in text]
    while True:
        found = [(merges.rank[w], i, w) for i, p in enumerate(zip(ids, ids[1:])) if (w := merges.joined.get(p)) is not None]
        if not found:
            return ids
        _, i, whole = min(found)
        ids[i : i + 2] = [whole]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_small_vocabularies_against_merging_by_rank(data):
    """Any merge list, unreachable tokens included."""
    vocab, merges = {c: i for i, c in enumerate("abc")}, []
    for _ in range(data.draw(st.integers(1, 9))):
        a, b = (data.draw(st.sampled_from(sorted(vocab))) for _ in "ab")
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
    table = bpe.Merges({"vocab": vocab, "merges": merges})
    model = bpe.Backtracking.__new__(bpe.Backtracking)
    model.fill(table)
    text = data.draw(st.text(st.sampled_from("abc"), min_size=1, max_size=14))
    assert model.word(text) == merged_by_rank(table, text)


def test_decoding_with_a_byte_level_decoder():
    library, table = Tokenizer.from_file(BYTES), bpe.Offsets(BYTES)
    for text in ["", " plain text", "é日本 😀", "<|endoftext|> a"]:
        ids = library.encode(text, add_special_tokens=False).ids
        for own in (ids, ids[:-1], ids[1:]):
            assert table.decode(np.array(own, "<u4").tobytes()).decode() == library.decode(own, skip_special_tokens=False)


def test_edges(spark, frame, library):
    rows = [(i, t, "x", "y", 1, "k") for i, t in enumerate(TEXTS)] + [(50, None, None, None, None, None), (0, "again", "x", "y", 1, "k"), (None, "no key", "x", "y", 1, "k")]
    df = frame(rows).selectExpr("*", "1 AS ids", "2 AS c0")
    out = bpe.encode(df, PATH, carry=("key", "c0")).collect()
    assert len(out) == len(rows) and {r.c0 for r in out} == {2}
    by_id = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in out)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for _, t, *_ in rows]
    assert by_id == sorted((r[0] is None, r[0] or 0, w) for r, w in zip(rows, want))
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, *_ in rows)
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert bpe.decode(nulls, PATH).collect() == [(1, None)]


def test_empty_table(frame):
    assert bpe.decode(bpe.encode(frame([]), PATH), PATH).collect() == []
