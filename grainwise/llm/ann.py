"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

The graph gives every vector its ``DEGREE`` nearest known ones. It starts from groups
of vectors on the same sides of random planes; then rounds of NN-descent introduce
neighbours of neighbours to each other: every vector sends itself to those it knows
and to those that know it (a sample of each), all that meet at one place compare, and
each keeps what is nearer than what it has. A query walks the graph from its own
place or, for a vector not indexed, from what the plane groups offer: the neighbours
of its best unvisited vectors are scored until none of the best is unvisited, or for
``STEPS`` steps.

Every step is a Spark join or grouping over fixed-size records. Groups of plane sides
are cut into parts of at most ``PART`` vectors, and the vectors that may meet at one
place are sampled, so no task depends on how many vectors are alike. Groups that a
Python worker takes at once hold about ``PLACES`` vertices or ``ASKED`` queries, however
many there are. Equal vectors are
one vertex; their rows come back in the end, the least ids first, which is all that
can enter a result.

Largest inner product becomes nearest neighbour by one more coordinate that gives all
vectors the same norm. The walk scores in single precision; what it found best is
scored anew, by inner products of the original vectors in double precision.

Defined cases: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part; equal scores go to the smaller id; rows of
equal id are one if their vectors are equal; with fewer candidates than asked for all
are returned; an empty table gives no rows; only id and vector are read, so further
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.llm.common import mix64, release, stored

DEGREE, TREES, PART, ROUNDS, SAMPLE = 40, 8, 192, 7, 14
WIDTH, EXPAND, STEPS = 288, 56, 3
#: Of the best found in single precision so many more than asked are scored anew in double.
SPARE = 40
OFFERS = 12
#: Vertices and queries of a group that is handed to a Python worker at once.
PLACES, ASKED = 512, 16
_U64 = np.uint64


# --- records -------------------------------------------------------------------------


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the length of each row; nothing is copied."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)), np.diff(ends)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated numbers of packed rows, and the count of each row."""
    data, lengths = _bytes(column)
    return data.view(kind), lengths // np.dtype(kind).itemsize


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each."""
    data, lengths = _bytes(column)
    return data.view(np.float32).reshape(len(lengths), -1)


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    data, size = values.tobytes(), values.dtype.itemsize
    ends = np.cumsum(counts) * size
    return pa.array([data[e - c * size : e] for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())


def _parts(spark, total: int, most: int) -> int:
    """How many groups of about ``most`` make ``total``; a group for each shuffle partition at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most))


def _bucket(node: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(parts))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): rows that take part, as doubles."""
    vec = F.col(vector).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("bigint").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vec") == (common[0]["n"] if common else 0))


def vertices(rows: DataFrame) -> DataFrame:
    """(node, vec, n): distinct vectors, named by their least id."""
    return rows.groupBy("vec").agg(F.min("id").alias("node"), F.countDistinct("id").alias("n")).select("node", "vec", "n")


def level(vectors: DataFrame) -> DataFrame:
    """(node, x): float32 vectors of equal norm 1, by one more coordinate."""
    most = vectors.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("vec").to_pylist(), np.float64) / np.sqrt(most)
                more = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
                x = np.concatenate([x, more[:, None]], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "x"])

    return vectors.select("node", "vec").mapInArrow(run, "node bigint, x binary")


# --- graph ---------------------------------------------------------------------------


def _first_lists(level_: DataFrame, total: int) -> DataFrame:
    """(node, ids, sims, fresh) from groups of vectors on the same sides of random planes."""
    depth = max(1, int(np.ceil(np.log2(max(2, total / PART)))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            for tree in range(TREES):
                planes = np.random.default_rng(tree + 1).standard_normal((x.shape[1], depth)).astype(np.float32)
                side = ((x @ planes) > 0) @ (1 << np.arange(depth, dtype=np.int64)) + (tree << 48)
                yield pa.RecordBatch.from_arrays([pa.array(side), batch.column("node"), batch.column("x")], names=["side", "node", "x"])

    def near(part: pa.Table) -> pa.Table:
        nodes = part.column("node").to_numpy()
        x = _matrix(part.column("x"))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(DEGREE, len(nodes) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(nodes), 0), np.int64)
        sims = np.take_along_axis(s, best, axis=1).astype(np.float32)
        counts = np.full(len(nodes), k)
        return pa.table({"node": nodes, "ids": _packed(nodes[best].ravel(), counts), "sims": _packed(sims.ravel(), counts), "fresh": _packed(np.ones(sims.size, np.int8), counts)})

    placed = level_.mapInArrow(sides, "side bigint, node bigint, x binary")
    sizes = placed.groupBy("side").agg(F.count("*").alias("n"))
    parts = placed.join(sizes, "side").withColumn("part", F.pmod(F.xxhash64("node", "side"), F.ceil(F.col("n") / PART)))
    return parts.select("side", "part", "node", "x").groupBy("side", "part").applyInArrow(near, "node bigint, ids binary, sims binary, fresh binary")


def _merge(part: pa.Table) -> pa.Table:
    """The best ``DEGREE`` distinct neighbours of each node; one known before is not fresh again."""
    nodes = part.column("node").to_numpy()
    ids, counts = _flat(part.column("ids"), np.int64)
    sims, fresh = _flat(part.column("sims"), np.float32)[0], _flat(part.column("fresh"), np.int8)[0]
    node = np.repeat(nodes, counts)
    kept = node != ids
    node, ids, sims, fresh = node[kept], ids[kept], sims[kept], fresh[kept]
    order = np.lexsort((fresh, ids, node))
    node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
    new = np.ones(len(node), dtype=bool)
    new[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    node, ids, sims, fresh = node[new], ids[new], sims[new], fresh[new]
    order = np.lexsort((ids, -sims, node))
    node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
    names, start, size = np.unique(node, return_index=True, return_counts=True)
    rank = np.arange(len(node)) - np.repeat(start, size)
    top = rank < DEGREE
    counts = np.minimum(size, DEGREE)
    return pa.table({"node": names, "ids": _packed(ids[top], counts), "sims": _packed(sims[top], counts), "fresh": _packed(fresh[top], counts)})


LISTS = "node bigint, ids binary, sims binary, fresh binary"


def _merged(lists: DataFrame, parts: int) -> DataFrame:
    return lists.groupBy(_bucket("node", parts).alias("bucket")).applyInArrow(_merge, LISTS)


def _meetings(graph: DataFrame, turn: int) -> DataFrame:
    """(place, node, fresh): who meets where in a round; a sample each way, fresh ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            ids, counts = _flat(batch.column("ids"), np.int64)
            fresh = _flat(batch.column("fresh"), np.int8)[0]
            node = np.repeat(nodes, counts)
            with np.errstate(over="ignore"):
                lot = mix64(mix64(node.view(_U64)) + ids.view(_U64) + _U64(turn)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(ids), pa.array(fresh), pa.array(lot)], names=["node", "other", "fresh", "lot"]
            )

    edges = graph.mapInArrow(run, "node bigint, other bigint, fresh tinyint, lot bigint")
    out = edges.select(F.col("node").alias("place"), F.col("other").alias("node"), "fresh", "lot", F.lit(0).alias("way"))
    back = edges.select(F.col("other").alias("place"), "node", "fresh", "lot", F.lit(1).alias("way"))
    both = out.union(back)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("place", "way", "fresh").orderBy("lot", "node")))
    return ranked.filter(F.col("rank") <= SAMPLE).groupBy("place", "node").agg(F.max("fresh").alias("fresh"), F.max(F.when(F.col("way") == 0, F.col("fresh"))).alias("sent"))


def _introduce(part: pa.Table) -> pa.Table:
    """Compare all that meet at each place; for each node what is nearer than its worst."""
    place = part.column("place").to_numpy()
    order = np.argsort(place, kind="stable")
    place = place[order]
    nodes, fresh = part.column("node").to_numpy()[order], part.column("fresh").to_numpy()[order].astype(bool)
    floor = part.column("floor").to_numpy()[order]
    x = _matrix(part.column("x"))[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])), len(place)).tolist()
    who, what, sims = [], [], []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        s = x[lo:hi] @ x[lo:hi].T
        f = fresh[lo:hi]
        s[~(f[:, None] | f[None, :])] = -np.inf
        np.fill_diagonal(s, -np.inf)
        if hi - lo > OFFERS:
            worst = np.partition(s, -OFFERS, axis=1)[:, -OFFERS]
            good = (s > floor[lo:hi, None]) & (s >= worst[:, None])
        else:
            good = s > floor[lo:hi, None]
        a, b = np.nonzero(good)
        who.append(nodes[lo:hi][a])
        what.append(nodes[lo:hi][b])
        sims.append(s[a, b])
    who, what, sims = np.concatenate(who), np.concatenate(what), np.concatenate(sims).astype(np.float32)
    order = np.lexsort((what, who))
    who, what, sims = who[order], what[order], sims[order]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    who, what, sims = who[new], what[new], sims[new]
    names, counts = np.unique(who, return_counts=True)
    return pa.table({"node": names, "ids": _packed(what, counts), "sims": _packed(sims, counts), "fresh": _packed(np.ones(len(what), np.int8), counts)})


def neighbour_graph(level_: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, ids, sims, fresh): the nearest known neighbours of every vertex, nearest first."""
    total = level_.count()
    parts = _parts(level_.sparkSession, total, PLACES)
    graph = stored(_merged(_first_lists(level_, total), parts), "graph")
    for turn in range(rounds):
        meet = stored(_meetings(graph, turn), "meetings")
        floors = graph.select("node", "sims").mapInArrow(_floors, "node bigint, floor float")
        known = level_.join(floors, "node")
        met = meet.join(known, "node").select("place", "node", "fresh", "floor", "x")
        news = stored(met.groupBy(_bucket("place", parts).alias("bucket")).applyInArrow(_introduce, LISTS), "news")
        sent = meet.filter("sent = 1").groupBy(F.col("place").alias("node")).agg(F.collect_set("node").alias("sent"))
        aged = graph.join(sent, "node", "left").mapInArrow(_age, LISTS)
        last = graph
        graph = stored(_merged(aged.union(news), parts), "graph")
        release(last, meet, news)
    return graph


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        worst = [np.frombuffer(s, np.float32)[-1] if len(s) >= 4 * DEGREE else np.float32(-2) for s in batch.column("sims").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.array(worst, np.float32))], names=["node", "floor"])


def _age(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours that were sent out are no longer fresh."""
    for batch in batches:
        out = []
        for ids, fresh, sent in zip(*(batch.column(c).to_pylist() for c in ("ids", "fresh", "sent"))):
            f = np.frombuffer(fresh, np.int8).copy()
            if sent:
                f[np.isin(np.frombuffer(ids, np.int64), sent)] = 0
            out.append(f.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("ids"), batch.column("sims"), pa.array(out, pa.binary())], names=["node", "ids", "sims", "fresh"]
        )


# --- search --------------------------------------------------------------------------

STATE = "query bigint, ids binary, scores binary, seen binary"


def _score(width: int):
    """Score a query's new candidates and keep the best ``width``."""

    def run(part: pa.Table, state: pa.Table) -> pa.Table:
        own = {q: (i, s, f) for q, i, s, f in zip(*(state.column(c).to_pylist() for c in ("query", "ids", "scores", "seen")))}
        # the coordinate that levels norms plays no part in a query's inner products
        vecs = {q: np.frombuffer(x, np.float32)[:-1] for q, x in zip(state.column("query").to_pylist(), state.column("x").to_pylist())}
        query = part.column("query").to_numpy()
        order = np.argsort(query, kind="stable")
        query, cand = query[order], part.column("cand").to_numpy()[order]
        x = _matrix(part.column("x")) if len(query) else None
        lo, hi = (dict(zip(*np.unique(query, return_index=True))), dict(zip(*np.unique(query, return_counts=True)))) if len(query) else ({}, {})
        names, ids_out, scores_out, seen_out = [], [], [], []
        for q, (ids, scores, seen) in own.items():
            ids, scores, seen = np.frombuffer(ids, np.int64), np.frombuffer(scores, np.float64), np.frombuffer(seen, np.int8)
            if q in lo:
                a = lo[q]
                b = a + hi[q]
                fresh = ~np.isin(cand[a:b], ids)
                more = cand[a:b][fresh]
                ids = np.concatenate([ids, more])
                scores = np.concatenate([scores, (x[order[a:b][fresh], :-1] @ vecs[q]).astype(np.float64)])
                seen = np.concatenate([seen, np.zeros(len(more), np.int8)])
                best = np.lexsort((ids, -scores))[:width]
                ids, scores, seen = ids[best], scores[best], seen[best]
            names.append(q)
            ids_out.append(ids.tobytes())
            scores_out.append(scores.tobytes())
            seen_out.append(seen.tobytes())
        return pa.table(
            {"query": pa.array(names, pa.int64()), "ids": pa.array(ids_out, pa.binary()), "scores": pa.array(scores_out, pa.binary()), "seen": pa.array(seen_out, pa.binary())}
        )

    return run


def _frontier(expand: int):
    """(query, node) of the best unvisited candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, nodes = [], []
            for q, ids, seen in zip(*(batch.column(c).to_pylist() for c in ("query", "ids", "seen"))):
                open_ = np.flatnonzero(np.frombuffer(seen, np.int8) == 0)[:expand]
                nodes.append(np.frombuffer(ids, np.int64)[open_])
                queries.append(np.full(len(open_), q, np.int64))
            if queries:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), pa.array(np.concatenate(nodes))], names=["query", "node"])

    return run


def _visited(expand: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seen in batch.column("seen").to_pylist():
                s = np.frombuffer(seen, np.int8).copy()
                s[np.flatnonzero(s == 0)[:expand]] = 1
                out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("query", "ids", "scores")] + [pa.array(out, pa.binary())], names=["query", "ids", "scores", "seen"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = _flat(batch.column("ids"), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("query").to_numpy(), counts)), pa.array(ids)], names=["query", "cand"])


def search(leveled: DataFrame, graph: DataFrame, queries: DataFrame, width: int = WIDTH, expand: int = EXPAND, steps: int = STEPS) -> DataFrame:
    """State rows (query, ids, scores, seen) of queries (node) that are vertices, best candidates first."""
    asked = stored(queries.select(F.col("node").alias("query")).join(leveled.select(F.col("node").alias("query"), "x"), "query"), "queries")
    bucket = _bucket("query", _parts(leveled.sparkSession, asked.count(), ASKED)).alias("bucket")
    nothing = F.unhex(F.lit(""))
    state = asked.select("query", nothing.alias("ids"), nothing.alias("scores"), nothing.alias("seen"))
    frontier = asked.select("query", F.col("query").alias("node"))
    for turn in range(steps + 1):
        found = frontier.join(graph.select("node", "ids"), "node").mapInArrow(_neighbours, "query bigint, cand bigint")
        # vertices that know the visited ones are neighbours too
        candidates = found.union(frontier.select("query", F.col("node").alias("cand"))).distinct()
        scored = candidates.join(leveled.select(F.col("node").alias("cand"), "x"), "cand").select("query", "cand", "x")
        state = stored(
            scored.groupBy(bucket)
            .cogroup(state.join(asked, "query").groupBy(bucket))
            .applyInArrow(_score(width), STATE),
            "state",
        )
        if turn < steps:
            frontier = stored(state.mapInArrow(_frontier(expand), "query bigint, node bigint"), "frontier")
            state = state.mapInArrow(_visited(expand), STATE)
            if frontier.isEmpty():
                break
    return state


def _unpack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, n = [], []
            for query, ids in zip(*(batch.column(c).to_pylist() for c in ("query", "ids"))):
                ids = np.frombuffer(ids, np.int64)[:most]
                q.append(np.full(len(ids), query, np.int64))
                n.append(ids)
            if q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, n)], names=["query", "node"])

    return run


def symmetric(graph: DataFrame) -> DataFrame:
    """Neighbour lists for walking: own neighbours and a sample of those that know the vertex."""
    parts = _parts(graph.sparkSession, graph.count(), PLACES)
    edges = graph.mapInArrow(_edges, "node bigint, other bigint, sim float")
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim")
    near = back.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))).filter(F.col("rank") <= DEGREE).select("node", "other")
    return edges.select("node", "other").union(near).distinct().groupBy(_bucket("node", parts).alias("bucket")).applyInArrow(_listed, "node bigint, ids binary")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = _flat(batch.column("ids"), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("node").to_numpy(), counts)), pa.array(ids), pa.array(_flat(batch.column("sims"), np.float32)[0])],
            names=["node", "other", "sim"],
        )


def _listed(part: pa.Table) -> pa.Table:
    node = part.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    names, counts = np.unique(node, return_counts=True)
    return pa.table({"node": names, "ids": _packed(part.column("other").to_numpy()[order], counts)})


# --- operator ------------------------------------------------------------------------


def nearest(df: DataFrame, is_query: Column, most: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): nearest found rows of every row for which ``is_query`` holds."""
    wanted = df.filter(is_query).select(F.col(key).cast("bigint").alias("id")).distinct()
    rows = usable(df, key, vector)
    distinct = stored(vertices(rows), "vertices")
    leveled = stored(level(distinct), "level")
    graph = stored(symmetric(neighbour_graph(leveled)), "lists")
    named = rows.join(distinct.select("vec", "node"), "vec").select("id", "node").distinct()
    asked = stored(named.join(wanted, "id"), "asked")
    state = search(leveled, graph, asked.select("node").distinct())
    found = state.mapInArrow(_unpack(most + 1 + SPARE), "query bigint, node bigint").join(distinct.select("node", "vec"), "node")
    pairs = found.join(distinct.select(F.col("node").alias("query"), F.col("vec").alias("query_vec")), "query")
    product = F.aggregate(F.zip_with("vec", "query_vec", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    hits = pairs.select("query", "node", product.alias("score"))
    # of equal vectors the least ids, by parts first so that no task sorts a whole group
    salted = named.join(distinct.filter("n > 1").select("node"), "node").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("node", "salt").orderBy("id"))).filter(F.col("r") <= most + 1)
    least = some.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= most + 1).select("node", "id")
    single = distinct.filter("n = 1").select("node", F.col("node").alias("id"))
    members = least.union(single)
    spread = hits.join(members, "node").select("query", "id", "score")
    best = spread.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= most + 1)
    answers = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(best.drop("r"), "query").filter("query_id <> id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= most).select("query_id", "rank", F.col("id").alias(key), "score")


def query(spark, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
