"""Counts against brute force, and what the learner finds."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from grainwise.llm import quality as q
from tests.llm.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    return (*counts, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def rows(df):
    return {r.doc_id: tuple(r[c] for c in (*q.BASE, "base_failed")) for r in df.collect()}


def test_whole_table(spark, documents):
    got = q.query(spark, FOLDER).collect()
    assert {r.doc_id: tuple(r[c] for c in (*q.BASE, "base_failed")) for r in got} == {i: brute(t) for i, t in documents.items()}
    assert all(not r.kept for r in got if r.base_failed)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    judged = [(r.kept, labels[r.doc_id]) for r in got if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for k, label in judged if label == 1]) > 0.95
    assert np.mean([k == bool(label) for k, label in judged]) > 0.9


def test_edges(spark):
    texts = [
        None, "", " \n\t ", "a b c a b c", "a a a a", "one", "x y", "dup\ndup\n dup\n\ndup", "é ü\x00z # <b>|", "w\x0bv\x0cu\r\nt", "a b c d " * 30_000,
        "no-break\xa0space stays", "\x1c\x1d", "p q r s p q r s t p q",
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    labels = spark.createDataFrame([(0, None), (1, 1), (1, 0), (None, 1), (99, 0)], "doc_id bigint, quality int")
    out = q.judge(df, labels)
    assert rows(out) == {i: brute(t) for i, t in enumerate(texts)}
    assert all(r.kept == (not r.base_failed) for r in out.collect())
    assert q.judge(df.limit(0), labels.limit(0)).collect() == []


def test_repeated_rows_are_judged_alike(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    got = q.judge(df, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert [r.kept for r in got] == [True] * 3


def test_learner_finds_a_planted_conjunction():
    rng = np.random.default_rng(3)
    table = {n: rng.uniform(0, 1, 3000) for n in q.FEATURES}
    bad = (table["symbol_share"] >= 0.7) & (table["upper_share"] < 0.4) | (table["digit_share"] >= 0.95)
    rules = q.learn(table, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= q._covers(rule, table, 3000)
    assert (hit == bad).mean() > 0.98 and 2 <= len(rules) <= 8
    assert {t.feature for r in rules for t in r} >= {"symbol_share", "upper_share", "digit_share"}


def test_learner_rejects_noise_and_handles_one_class():
    rng = np.random.default_rng(4)
    table = {n: rng.uniform(0, 1, 600) for n in q.FEATURES}
    noise = rng.uniform(0, 1, 600) < 0.3
    covered = np.zeros(600, dtype=bool)
    for rule in q.learn(table, noise):
        covered |= q._covers(rule, table, 600)
    assert covered.mean() < 0.3
    assert q.learn(table, np.zeros(600, dtype=bool)) == [] and q.learn({n: x[:0] for n, x in table.items()}, noise[:0]) == []


def test_rules_become_ordered_conditions(spark):
    rules = [(q.Test("symbol_share", True, 0.5),), (q.Test("n_words", True, 60.0), q.Test("upper_share", False, 0.1))]
    text = " ".join(["word"] * 30 + ["#####"] * 60)
    df = q.text_counts(spark.createDataFrame([(text,), (" ".join(f"w{i}" for i in range(70)),), ("AB " * 70,)], "text string"))
    assert [r[0] for r in df.select(q.rule_expression(rules)).collect()] == [1, 2, None]


def test_no_python_in_the_plan(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    plan = q.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
