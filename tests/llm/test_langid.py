"""Word labels by forward-backward: exact marginals, held-out accuracy, mixed text."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.llm import langid
from tests.llm.conftest import FOLDER


def plain_marginals(emit, transition):
    """The textbook recursion, one chain."""
    psi, step = np.exp(emit), np.exp(transition)
    n, c = psi.shape
    a, b = np.zeros((n, c)), np.ones((n, c))
    a[0] = np.full(c, 1 / c) @ step * psi[0]
    for t in range(1, n):
        a[t] = a[t - 1] @ step * psi[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = step @ (psi[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    return p / p.sum(axis=1, keepdims=True)


def test_marginals_of_runs_are_those_of_chains():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 63, 64, 65, 200, 1000])
    emit = rng.normal(size=(lengths.sum(), 3))
    transition = rng.normal(size=(3, 3))
    got, pairs = langid.marginals(emit, transition, lengths)
    want = np.concatenate([plain_marginals(e, transition) for e in np.split(emit, np.cumsum(lengths)[:-1])])
    assert np.abs(got - want).max() < 1e-9
    assert abs(pairs.sum() - lengths.sum()) < 1e-6


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    emit, transition = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    total, sums = 0.0, np.zeros((5, 2))
    for labels in itertools.product(range(2), repeat=5):
        # the chain starts from an even mixture of states
        p = np.exp(transition[:, labels[0]]).sum() / 2 * np.exp(sum(emit[i, x] for i, x in enumerate(labels)))
        p *= np.exp(sum(transition[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        for i, x in enumerate(labels):
            sums[i, x] += p
    got, _ = langid.marginals(emit, transition, np.array([5]))
    assert np.abs(got - sums / total).max() < 1e-9


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_held_out_accuracy(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in langid.query(spark, FOLDER).collect()}
    assert set(got) == set(true)
    held = [i for i in true if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in true)
    assert np.mean([got[i].lang_pred == true[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixed_text_is_labelled_word_by_word(spark, model):
    rows = [(1, "the of and to in is that was for with der die und das nicht für auf mit ist von the and of to that with")]
    got = langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model, label_words=True).first()
    labels = got.word_langs
    assert labels[:9].count("en") >= 8 and labels[11:19].count("de") >= 7 and labels[-4:].count("en") >= 3


def test_edges(spark, model):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "12 34 !? 5.6"), (5, "— … 😀"), (6, "the"), (None, "the and of"), (8, "der die das und " * 20_000),
        (9, "la maison"), (9, "la maison"), (10, "日本語 の"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    got = langid.predict(df.repartition(3), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3, 4, 5))
    assert by[8].lang_pred == "de" and by[None].lang_pred == "en" and by[10].lang_pred in model.languages
    nines = [tuple(r) for r in got if r.doc_id == 9]
    assert nines[0] == nines[1]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    got = langid.predict(none, langid.learn(none)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)
    assert langid.learn(none.limit(0)).languages == []
    one = spark.createDataFrame([(i, "some words", "xx") for i in range(9)], "doc_id bigint, text string, lang string")
    assert langid.predict(one, langid.learn(one)).first().lang_pred == "xx"


def test_accepted_keeps_rows_whole(spark, model):
    rows = [(1, "the and of to", None, "s", 13, 7), (2, "??", "en", "s", 2, 7), (3, None, "en", "s", None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "the and of to", "en", "s", 13, 7)]
    assert langid.accepted(df.limit(0), model).count() == 0


def test_nothing_learned_rejects_no_text(spark):
    rows = [(1, "clean words", None), (2, "123 !", None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in langid.accepted(docs, langid.learn(docs)).collect()] == [1]


def test_every_language_is_learned(spark):
    rows = [(i, f"word{k % 7} of{k} lang{k}x lang{k}y", f"l{k:03d}") for k in range(80) for i in range(k * 12, k * 12 + 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts, langs = langid.training_sample(docs)
    assert len(set(langs)) == 80 and len(texts) == len(langs)
