"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from grainwise.llm import ann
from tests.llm.conftest import FOLDER


def brute(vectors: dict[int, np.ndarray], query: int, most: int = 20):
    scores = sorted(((-float(v @ vectors[query]), i) for i, v in vectors.items() if i != query))
    return [(i, -s) for s, i in scores[:most]]


def answers(rows, key="vec_id"):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r[key], r.score))
    return out


def test_whole_table(spark):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    vectors = {r["vec_id"]: np.array(np.float32(r["embedding"]), np.float64) for r in table}
    got = answers(ann.query(spark, FOLDER).collect())
    assert set(got) == {i for i in vectors if i % 20 == 0}
    found = []
    for q, hits in got.items():
        want = brute(vectors, q)
        assert len(hits) == 20 and all(abs(s - vectors[i] @ vectors[q]) < 1e-12 for i, s in hits)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        found.append(len({i for i, _ in hits} & {i for i, _ in want}) / 20)
    assert np.mean(found) >= 0.9


def test_norms_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    vectors = {i: (rng.normal(size=8) * rng.uniform(0.2, 5)).astype(np.float32) for i in range(300)}
    for i in range(300, 420):
        vectors[i] = vectors[7]  # a large group of equal vectors
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()]
    rows += [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], "x"),
             (904, [1.0] * 5, "x"), (905, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (3, vectors[3].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = answers(ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    exact = {i: v.astype(np.float64) for i, v in vectors.items()}
    assert set(got) == {i for i in exact if i % 20 == 0}
    found = []
    for q, hits in got.items():
        want = brute(exact, q)
        found.append(len({i for i, _ in hits} & {i for i, _ in want}) / 20)
        assert len({i for i, _ in hits}) == len(hits) == 20 and q not in dict(hits)
    assert np.mean(found) >= 0.9
    # of equal vectors the least ids come first
    own = [i for i, s in got[320] if s == got[320][0][1]]
    assert own == sorted(own)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (5, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = answers(ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert {q: [i for i, _ in h] for q, h in got.items()} == {0: [20, 5], 20: [0, 5]}
    assert ann.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_groups_of_a_worker_do_not_grow_with_the_table(spark, monkeypatch):
    """Vertices that meet and queries that are scored come in groups of bounded size, however many there are."""
    monkeypatch.setattr(ann, "PLACES", 16)
    introduce, score = ann._introduce, ann._score

    def introduced(part):
        assert len(set(part.column("place").to_pylist())) < 60
        return introduce(part)

    def scoring(width):
        scored = score(width)

        def run(part, state):
            assert state.num_rows < 60
            return scored(part, state)

        return run

    monkeypatch.setattr(ann, "_introduce", introduced)
    monkeypatch.setattr(ann, "_score", scoring)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(int(spark.conf.get("spark.sql.shuffle.partitions")) * 120)]
    distinct = ann.stored(ann.vertices(ann.usable(spark.createDataFrame(rows, "k bigint, v array<double>"), "k", "v")))
    leveled = ann.stored(ann.level(distinct))
    graph = ann.neighbour_graph(leveled, rounds=1)
    assert graph.count() == len(rows)
    state = ann.search(leveled, graph, distinct.select("node"), steps=1)
    assert state.count() == len(rows)
