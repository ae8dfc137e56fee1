"""Words, near pairs, forms and roots against a brute force; common chunks; edges."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from grainwise.llm import spelling
from tests.llm.conftest import FOLDER

UPPER = {c: c + 32 for c in range(65, 91)}


def brute_words(documents, least=5):
    count = Counter()
    for key, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= least}


def brute_near(words):
    """All words with the same text after one deletion, or one a deletion of the other; then compared."""
    by_cut = {}
    for w in words:
        for cut in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_cut.setdefault(cut, set()).add(w)

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    return {(a, b) for own in by_cut.values() for a in own for b in own if one_edit(a, b)}


def brute(documents):
    words = brute_words(documents)
    near = {}
    for a, b in brute_near(words):
        near.setdefault(a, []).append(b)
    form = {}
    for w, own in near.items():
        top = min(own, key=lambda v: (-words[v], v))
        if words[top] >= 5 * words[w]:
            form[w] = top
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near.get(w, ())), words.get(form.get(w))


@pytest.mark.parametrize("folder", [FOLDER, FOLDER.replace("0.001", "0.01")])
def test_whole_table(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = spelling.query(spark, folder).collect()
    want = sorted(brute([tuple(r) for r in documents]))
    assert sorted(tuple(r) for r in rows) == want and len(want) > 50


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text(st.sampled_from("abé"), min_size=1, max_size=8), min_size=1, max_size=60), st.sampled_from([1, 3, 1000]))
def test_any_words(spark, words, most):
    """Short alphabets share nearly all chunks; cutting on finds the same pairs."""
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string").coalesce(1)
    rows = [tuple(r) for r in spelling.near(df, most).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_near(words)


def test_a_common_beginning_does_not_make_all_pairs(spark, monkeypatch):
    """Candidates grow with the words, not with their square, though all share a half."""
    made = []
    met = spelling._met
    monkeypatch.setattr(spelling, "_met", lambda df: made.append(df.count()) or met(df))
    for n in (300, 1200):
        words = ["beginning" + "".join(chr(97 + i // 26**p % 26) for p in range(3)) + "".join(chr(97 + i * p % 26) for p in (3, 7, 11)) for i in range(n)]
        df = spark.createDataFrame([(w,) for w in words], "word string")
        del made[:]
        assert {tuple(r) for r in spelling.near(df).collect()} == brute_near(words)
        assert sum(made) < 60 * n


def test_roots_follow_forms(spark):
    chain = "a>b b>c c>d d>e e>f x>f".split()
    df = spark.createDataFrame([tuple(c.split(">")) for c in chain] + [("f", None)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(df).collect()} == {(w, "f") for w in "abcdex"}


def test_edges(spark, frame):
    long = "z" * 20000
    texts = ["Beauté beautÉ", "", None, "word2word_word", "STRASSE strasse straße strasße", f"{long} {long}y", "日本Letters語letters", "éééééé ééééééé × ÷÷÷÷÷÷÷"]
    rows = [(i % 3 if i % 4 else None, t, "x", "y", 1, "k") for i in range(40) for t in [texts[i % len(texts)]]]
    df = frame(rows).selectExpr("*", "'a' AS word", "1 AS n", "2 AS chunk")
    assert sorted(tuple(r) for r in spelling.variants(df).collect()) == sorted(brute([(r[0], r[1]) for r in rows]))


def test_empty_table(frame):
    assert spelling.variants(frame([])).collect() == []
