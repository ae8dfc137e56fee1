"""Sampled segmentations: exact round trips, reproducibility, the right distribution."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from grainwise.llm import pieces
from grainwise.llm.common import mix64

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a   b ", "plain words, marks.", "line\nfeeds\n\n and\ttabs\r\n", "▁marks▁ of ▁ spaces", pieces.GLUE + "x " + pieces.GLUE + "," + pieces.GLUE,
    "emoji 😀 zero\x00byte 日本語 ﬁ", "it's \"quoted\", (so)…", "x" * 5000, "word, " * 2000, "  odd　spaces",
]


@pytest.fixture(scope="module")
def model():
    return pieces.Lattices(PATH, 1.0)


def test_round_trip_and_nulls(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "no key"), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = pieces.decode(pieces.encode(df, PATH, carry=("text",)).withColumnRenamed("text", "was"), PATH, carry=("was",)).collect()
    assert len(got) == len(rows)
    assert all(r.text == r.was for r in got)


def test_same_row_same_pieces_in_any_partition(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, many = (sorted(map(tuple, pieces.encode(d, PATH).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == many
    by_text = {}
    for key, ids in one:
        by_text.setdefault(TEXTS[key % len(TEXTS)], set()).add(tuple(ids))
    assert len(by_text["word, " * 2000]) == 3  # other keys draw other segmentations


def test_pieces_exist_and_spell_the_text(model):
    spelled = pieces.piece_bytes(PATH)
    nodes, counts = model.ends(["hello there"])
    ids, sizes = model.sample(nodes, mix64(np.array([5], np.uint64)), counts)
    assert b"".join(spelled[i] for i in ids) == b" hello there" and sizes.tolist() == [len(ids)]


def test_distribution_is_that_of_the_lattice(model):
    """Against every segmentation of a word, listed by brute force."""
    word, found = pieces.MARK + "heating", []
    known = pieces.vocabulary(PATH, 1.0)

    def walk(at, ids, p):
        if at == len(word):
            found.append((tuple(ids), p))
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in known:
                i, q = known[word[at:end]]
                walk(end, [*ids, i], p * q)

    walk(0, [], 1.0)
    total, n = sum(p for _, p in found), 40_000
    nodes, counts = model.ends(["heating"] * n)
    ids, sizes = model.sample(nodes, mix64(np.arange(n, dtype=np.uint64)), counts)
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[e - s : e].tolist()) for e, s in zip(ends, sizes))
    assert set(seen) <= {s for s, _ in found}
    for segmentation, p in found:
        p /= total
        assert abs(seen[segmentation] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_large_theta_takes_the_likeliest(spark):
    sure = pieces.Lattices(PATH, 40.0)
    nodes, counts = sure.ends(["heating"] * 50)
    ids, sizes = sure.sample(nodes, mix64(np.arange(50, dtype=np.uint64)), counts)
    assert len({tuple(x) for x in np.split(ids, np.cumsum(sizes)[:-1])}) == 1


def test_long_word_does_not_underflow(model):
    nodes, counts = model.ends(["ab" * 40_000])
    ids, sizes = model.sample(nodes, mix64(np.array([1], np.uint64)), counts)
    spelled = pieces.piece_bytes(PATH)
    assert b"".join(spelled[i] for i in ids) == b" " + b"ab" * 40_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, ids string")
    assert pieces.encode(df, PATH).collect() == []
