"""Repeated strings against brute force over every start."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.llm import suffixdedup as sd
from tests.llm.conftest import FOLDER


def brute(texts: list[str | None], length: int = sd.LENGTH) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(bytes(gone).replace(b"\0", b" ").split())
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def through_query(spark, tmp_path, rows, schema="doc_id bigint, text string, print string, kept string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.query(spark, str(tmp_path)).collect()}


def test_whole_table(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.query(spark, FOLDER).collect()}
    assert got == dict(zip(documents, brute(list(documents.values()))))
    assert any(r[1] for r in got.values())


def test_edges(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda n: " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) for _ in range(n))
    shared, other = word(120), word(300)
    base = shared.encode()[:400].decode(errors="ignore")
    texts = [
        None, "", "short", word(200), shared, word(50) + shared + word(60), shared[:399], "z" + base, "y" + base + "q" * 30,
        "ab" * 700, "x" * 5000, other, other, word(90) + other[100:900] + word(10) + other[100:900], word(3) + other[50:460],
        "é" + other[:600] + "è", word(20_000),
    ]
    rows = [(i, t, "p", "k") for i, t in enumerate(texts)]
    got = through_query(spark, tmp_path, rows)
    assert got == dict(enumerate(brute(texts)))


def test_repeated_rows_are_copies(spark, tmp_path):
    text = "".join(random.Random(1).choices("abcdefgh ", k=900))
    spark.createDataFrame([(1, text), (1, text), (2, "w" + text[:300])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in sd.query(spark, str(tmp_path)).collect())
    assert got == [(1, 900, 1), (1, 900, 1), (2, 0, 0)]


def test_kept_text_is_whole_characters(spark):
    rnd = random.Random(2)
    core = "".join(rnd.choices("abcd ", k=500))
    # both texts share the first byte of the odd characters around the core
    rows = [(1, "one é" + core + "é end"), (2, "two è" + core + "è fin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: (r.text, r.n_chars) for r in sd.without_repeats(docs).collect()}
    assert got[1][0].startswith("one ") and got[1][0].endswith("é end") and "�" not in got[1][0]
    assert len(got[1][0]) == got[1][1] < 20


@pytest.mark.parametrize("length", [127, 256, 700])
def test_other_lengths(spark, documents, length):
    """Passages shorter than the query's strings are found where a shorter length is asked for."""
    rnd = random.Random(length)
    passage = " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(52))  # 52 words, 311 bytes
    texts = [*documents.values(), "first " + passage + " after", "other " + passage + " end", "short"]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    found = {r.print: (sum(r.ends) - sum(r.starts), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in sd.repeated_strings(docs, length=length).collect()}
    for text, (_, gone, runs, kept) in zip(texts, brute(texts, length)):
        assert found.get(hashlib.md5((text or "").encode()).hexdigest(), (0, 0, kept)) == (gone, runs, kept)
    left = {r.doc_id: r.text for r in sd.without_repeats(docs, length).collect()}
    assert (passage in left[len(documents)]) == (length > 311)
    with pytest.raises(ValueError):
        sd.without_repeats(docs, sd.LEAST - 1)


def test_empty_table(spark, tmp_path):
    assert through_query(spark, tmp_path, []) == {}


@pytest.mark.parametrize("seed", range(5))
def test_least_positions(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 40, size=int(rng.integers(1, 700))).astype(np.uint64) << np.uint64(8)
    span = 96
    want = [i + int(np.argmin(values[i : i + span])) for i in range(len(values) - span + 1)]
    assert sd.least_positions(values, span).tolist() == want


def test_packed_runs_come_back():
    rng = np.random.default_rng(3)
    for values in (np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64)), np.array([7], np.uint64), np.array([0, 1 << 60], np.uint64)):
        assert (sd._unpack(sd._pack(values)) == values).all()


def test_groups_of_a_worker_are_small(spark, monkeypatch):
    """A worker is handed a fourth of a partition's texts at a time, and strings in several groups still meet."""
    rnd = random.Random(8)
    shared = "".join(rnd.choices("abcdefgh ", k=500))
    texts = ["".join(rnd.choices("abcdefgh ", k=300)) + shared for _ in range(64)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    seen = []
    monkeypatch.setattr(sd, "stored", lambda df, kind="stage", f=sd.stored: (seen.append(df.select("chunk").distinct().count()) if kind == "texts" else None, f(df, kind))[1])
    try:
        got = {hashlib.sha256(r.kept).hexdigest() for r in sd.repeated_strings(spark.createDataFrame([(t,) for t in texts], "text string"), groups=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {left for *_, left in brute(texts)}
    assert seen == [8]
