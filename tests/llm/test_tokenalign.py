"""Groups, links and corpus counts against a brute force over whole texts; the merge; edges."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainwise.llm import tokenalign
from grainwise.llm.bpe import byte_alphabet
from tests.llm.conftest import FOLDER

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "\n", "a  b", "a   b   ", " lead", "tail ", "x\ny", "x\n\ny", "x \ny", "x\n y", "\nx", "x\n", "word.\nNext line,\nthird", "日本 😀 ゼロ", "▁", "a▁b",
    "<|endoftext|> </s> <unk> <0x41>", "it's 'll don't's.", "\x1cctrl 　wide\xa0", "\x00", "é é", "x" * 3000, "many words " * 2000, "�", "a\tb\r\nc",
]


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.byte = {c: b for b, c in byte_alphabet().items()}

    def groups(self, text):
        text = text or ""
        if not text:
            return []
        raw = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a_bytes = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]
        ]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return []
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        out, i, j = [], 0, 0
        for end in sorted(set(a_ends.tolist()) & set(b_ends.tolist())):
            i2, j2 = int(np.searchsorted(a_ends, end)) + 1, int(np.searchsorted(b_ends, end)) + 1
            out.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        return out

    def rows(self, documents):
        grouped = [self.groups(t) for _, t in documents]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
        count = Counter(p for own in links for p in own)
        most = Counter()
        for (x, _), c in count.items():
            most[x] = max(most[x], c)
        for (key, _), g, own in zip(documents, grouped, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            yield (
                key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
                sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()), text,
            )


@pytest.fixture(scope="module")
def brute():
    return Brute()


def test_whole_table(spark, documents, brute):
    rows = tokenalign.query(spark, FOLDER).collect()
    want = {r[0]: r[1:7] + (hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "",) for r in brute.rows(list(documents.items()))}
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(documents)


def test_many_runs_are_merged_in_turns(spark, documents, brute):
    """Small runs and a fan-in of two: several levels of merging, same result."""
    some = list(documents.items())[:60]
    df = spark.createDataFrame(some, "doc_id bigint, text string").repartition(5)
    out = tokenalign.align(df, A, B, parts=3, fan_in=2, block=4096).collect()
    assert sorted((*r[:7], r.groups.decode()) for r in out) == sorted(brute.rows(some))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aet nE.\n ▁'1日é\t"), max_size=30))
def test_any_text(brute, text):
    model = tokenalign.aligner(A, B)
    run = tokenalign.Run(model, [text])
    assert run.groups[0].decode() == next(brute.rows([(0, text)]))[7]


@given(st.lists(st.dictionaries(st.integers(0, 2**40), st.integers(1, 99), min_size=1), max_size=6))
@settings(max_examples=100, deadline=None)
def test_merge_and_largest(runs):
    packed = []
    for run in runs:
        pairs = sorted(run)
        packed.append((tokenalign.squeeze_sorted(np.array(pairs, np.uint64)), tokenalign.squeeze(np.array([run[p] for p in pairs], np.uint64))))
    total = Counter()
    for run in runs:
        total.update(run)
    most = {}
    for p, c in total.items():
        most[p >> 32] = max(most.get(p >> 32, 0), c)
    assert list(tokenalign.best_of(tokenalign.merged(packed))) == [(p, c, int(c == most[p >> 32])) for p, c in sorted(total.items())]


def test_edges(spark, frame, brute):
    documents = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "no key"), (0, "again"), (0, "again")]
    df = frame([(k, t, "x", "y", 1, "k") for k, t in documents]).selectExpr("*", "1 AS run", "2 AS part", "3 AS n_a", "4 AS pairs")
    out = tokenalign.align(df, A, B).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((*r[:7], r.groups.decode()) for r in out), key=order) == sorted(brute.rows(documents), key=order)


def test_empty_table(frame):
    assert tokenalign.align(frame([]), A, B).collect() == []
    only_empty = frame([(1, "", None, None, 0, None), (2, None, None, None, 0, None)])
    assert sorted(tuple(r) for r in tokenalign.align(only_empty, A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, b""), (2, 0, 0, 0, 0, 0, 0, b"")]
