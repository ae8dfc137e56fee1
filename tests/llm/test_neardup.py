"""Near-duplicates against exact similarities and plain graph code."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from grainwise.llm import neardup as nd
from grainwise.llm.components import components
from tests.llm.conftest import FOLDER


def words(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)]


def grams(text: str) -> set[tuple[str, ...]]:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows) -> dict:
    return {r.doc_id: r.class_id for r in rows}


def test_whole_table(spark, documents):
    got = classes(nd.query(spark, FOLDER).collect())
    assert set(got) == set(documents)
    sets = {i: grams(t or "") for i, t in documents.items()}
    ids = list(documents)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            union = len(sets[a] | sets[b])
            j = len(sets[a] & sets[b]) / union if union else float(documents[a] == documents[b])
            if j >= 0.83:
                assert got[a] == got[b], (a, b, j)
            if j < 0.5:
                assert got[a] != got[b] or j == 0, (a, b, j)


def test_groups_and_edges(spark):
    base, lone, big = words(1, 120), words(2, 120), words(3, 30_000)
    near = [*base[:50], "changed", *base[51:]]
    far = [*base[:20], *words(4, 100)]
    rows = [
        (1, " ".join(base), "x"), (2, " ".join(near), "x"), (3, " ".join(base), "x"), (4, " ".join(lone), "x"), (5, " ".join(far), "x"),
        (6, None, "x"), (7, None, "x"), (8, "", "x"), (9, "", "x"), (10, "two words", "x"), (11, "two  words", "x"), (12, " \n ", "x"),
        (13, " ".join(big), "x"), (14, " ".join([*big[:-1], "end"]), "x"), (None, " ".join(base), "x"), (4, " ".join(lone), "x"),
    ]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, class_id string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {i: by[i].class_id for i in range(1, 15)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 10, 12: 12, 13: 13, 14: 13}
    assert by[None].class_id is None


def test_large_near_group_is_one_class(spark):
    base = words(9, 200)
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        w = list(base)
        for at in rnd.sample(range(200), 2):
            w[at] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:60], *words(100 + i, 140)])) for i in range(40)]  # share a passage only
    got = classes(nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert len({got[i] for i in range(150)}) == 1
    assert len({got[1000 + i] for i in range(40)}) == 40


def test_independent_edits_of_one_text_are_one_class(spark):
    rows, n = [], 0
    for group in range(4):
        base = words(500 + group, 200)
        rnd = random.Random(group)
        rows.append((n, " ".join(base)))
        for i in range(150):
            w = list(base)
            for at in rnd.sample(range(200), 3 + i % 2):
                w[at] = f"edit{group}x{i}"
            rows.append((n + 1 + i, " ".join(w)))
        n += 1000
    sets = [grams(t) for _, t in rows]
    found = classes(nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    pairs = [(x, y) for x in range(len(rows)) for y in range(x) if x // 151 == y // 151]
    near = [(x, y) for x, y in pairs if len(sets[x] & sets[y]) >= 0.801 * len(sets[x] | sets[y])]
    assert len(near) < 0.5 * len(pairs)
    assert [(x, y) for x, y in near if found[rows[x][0]] != found[rows[y][0]]] == []


def forest(codes, earlier, comp, left, right, sets):
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    ids = np.array([i for x in sets for i in sorted(x)])
    size = np.array([len(x) for x in sets])
    shingled = (np.cumsum(size) - size, size, ids, np.ones(len(ids)), np.bincount(rows, minlength=len(sets)).astype(float))
    return nd.tile_links(codes, earlier, comp, left, right, shingled)


def test_tile_links_are_a_forest_of_all_similar_pairs():
    rng = np.random.default_rng(2)
    base = rng.choice(4000, 60, replace=False)
    sets = []
    for _ in range(90):
        own = base.copy()
        own[rng.integers(0, 60, rng.integers(2, 9))] = rng.integers(4000, 9000)
        sets.append(set(own.tolist()))
    codes = np.zeros((90, 42), np.uint8)
    start = np.arange(90)
    similar = {(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}

    def parts(links):
        comp = list(range(90))
        for a, b in links:
            x, y = comp[a], comp[b]
            comp = [x if c == y else c for c in comp]
        return {frozenset(i for i in range(90) if comp[i] == c) for c in comp}

    links = forest(codes, np.zeros((90, 0)), start, start, start, sets)
    assert {(max(a, b), min(a, b)) for a, b, _ in links} <= similar and len(links) == 90 - len(parts(similar))
    assert parts([x[:2] for x in links]) == parts(similar)
    left, right = start[:40], start[40:]
    across = forest(codes, np.zeros((90, 0)), start, left, right, sets)
    assert parts([x[:2] for x in across]) == parts([(i, j) for i, j in similar if (i < 40) != (j < 40)])
    assert forest(codes, np.zeros((90, 1)), start, start, start, sets) == []  # an earlier band has them all


def test_links_stay_linear_in_a_group_below_the_threshold(spark, monkeypatch):
    """Edits that leave most pairs unlike: the rows that leave the tasks are fewer than the members' bands."""
    made = []
    inner = nd.group_links
    monkeypatch.setattr(nd, "group_links", lambda *a: made.append(nd.stored(inner(*a))) or made[-1])
    for n in (75, 300):
        base = words(77, 120)
        rows = []
        for i in range(n):
            rnd = random.Random(i)
            w = list(base)
            for at in rnd.sample(range(120), rnd.randint(1, 5)):
                w[at] = f"e{i}x{at}"
            rows.append((i, " ".join(w)))
        sets = [grams(t) for _, t in rows]
        df = Counter(g for s in sets for g in s)
        top = np.log(1 / nd.COMMON)
        idf = {g: 1 + nd.DAMPING * (min(np.log(n / c), top) / top if c >= max(2, np.ceil(n * nd.COMMON)) else 1) for g, c in df.items()}
        mass = lambda s: sum(idf[g] for g in s)  # noqa: B023, E731
        got = classes(nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
        near = [(x, y) for x in range(n) for y in range(x) if mass(sets[x] & sets[y]) >= 0.801 * mass(sets[x] | sets[y])]
        assert near and [(x, y) for x, y in near if got[x] != got[y]] == []
        assert made[-1].count() < 14 * n


def test_blocks_of_a_large_group_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(nd, "PART", 16)
    test_independent_edits_of_one_text_are_one_class(spark)


def test_rows_of_one_key_with_different_texts(spark):
    a, b = " ".join(words(1, 60)), " ".join(words(2, 60))
    rows = [(5, a), (5, b), (7, a), (9, b), (9, b)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == [(5, 5), (5, 5), (7, 5), (9, 5), (9, 5)]


def test_one_of_each(spark):
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (3, "other words entirely here now", 3), (3, "other words entirely here now", 3), (None, "a b c d e f", 4)]
    kept = nd.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"))
    assert kept.columns == ["doc_id", "text", "n_chars"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_samples_agree_with_weighted_similarity():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.uniform(0.5, 3.0, 300).astype(np.float32)
    a, b = np.arange(0, 220), np.arange(60, 300)
    wa, wb = np.zeros(300), np.zeros(300)
    wa[a], wb[b] = w[a], w[b] * 1.3
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    codes = nd.samples(np.concatenate([prints[a], prints[b]]), np.concatenate([wa[a], wb[b]]).astype(np.float32), np.array([0, len(a)]), 4000)
    assert abs((codes[0] == codes[1]).mean() - want) < 0.04


def test_weighted_jaccard_is_exact():
    texts = ["a b c d e f g", "a b c d e f x", "", "one"]
    none = nd.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), 4)
    pairs = [(x, y) for x in texts for y in texts]
    got = nd.weighted_jaccard(pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), none)
    for (x, y), j in zip(pairs, got):
        union = grams(x) | grams(y)
        assert abs(j - (len(grams(x) & grams(y)) / len(union) if union else 0.0)) < 1e-6


def test_common_shingles_are_counted_exactly(spark):
    rows = [(f"s{i % 3} p q r t v",) for i in range(90)] + [(f"u{i} x{i} y{i} z{i} k{i}",) for i in range(500)]
    prints, df, total = nd.common_shingles(spark.createDataFrame(rows, "text string").repartition(5))
    assert total == 590 and sorted(df.tolist()) == [30, 30, 30, 90]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = defaultdict(lambda: None)

    def find(x):
        while parent[x] is not None:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in touched}
