"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A document is its five-word shingles, each weighted ``tf * idf``:

* ``tf`` is ``1 + ln(count in the document)``;
* ``idf`` is ``1 + DAMPING * min(ln(N / df), ln(1 / COMMON)) / ln(1 / COMMON)``. Document
  frequencies are counted over all documents. Shingles rarer than ``COMMON`` all have
  the largest idf, so only the others need a lookup; there are at most (mean distinct
  shingles of a document) / ``COMMON`` of those, whatever the size of the corpus.

Consistent weighted samples agree between two documents with the probability of their
weighted Jaccard similarity. ``BANDS`` bands of ``ROWS`` samples are formed, and
documents that agree in a band are a group. Candidates are the pairs of a group that
agree in ``LEAST_AGREEMENT`` of all samples; they are verified by their exact weighted
Jaccard similarity, linked if it reaches ``SIMILARITY``, and linked documents form a
class. Every group is compared with one hub first. A group that this does not make one
class is compared inside tasks: a pair is verified in the first band that holds both, unless
its classes have met, and only links that join two classes leave a task (a spanning
forest, fewer than its rows). No list of pairs is made. Members of one class are not
compared again, so groups of near copies cost little; members that stay below ``SIMILARITY``
are all compared inside their group's tasks, whose arithmetic, not output, may grow with
the square of such a group.

Texts that are equal share a class before any of this, and only one of them is
sampled, so a group of copies costs one document.

Defined cases: a text of one to four words is one shingle; a text without words, or
null, only equals its own copies (null equals null); of rows of one key with different
texts the text of the least MD5 is compared, the others share its class; a row without a
key has class null; an empty table gives no rows. Only the
key and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import Prefix, mix64, slices, stored, utf8, words
from grainwise.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 3
COMMON, DAMPING = 1 / 256, 0.25
#: Pairs that agree in less than this share of samples are not verified; at a
#: similarity of 0.8, 42 samples fall below it with a probability of about 1e-6.
LEAST_AGREEMENT = 0.5
#: Members of a group, and their shingles, that a block of a tile holds.
PART, PART_SHINGLES = 4096, 1_500_000
FLUSH = 1 << 21
_U64 = np.uint64
_ODD = [_U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# --- shingles ------------------------------------------------------------------------


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, fingerprint, count) of the distinct shingles of each row, ordered by both."""
    data, offsets = utf8(column)
    start, end, row = words(data, offsets)
    n = len(offsets) - 1
    if not len(start):
        return row, np.zeros(0, _U64), np.zeros(0, np.int64), n
    w = Prefix(data).of(start, end)
    per_row = np.bincount(row, minlength=n)
    with np.errstate(over="ignore"):
        full = np.zeros(max(len(w) - size + 1, 0), _U64)
        for k in range(size):
            full += w[k : k + len(full)] * _ODD[k % len(_ODD)] + _U64(k)
        whole = row[: len(full)] == row[size - 1 :] if len(full) else np.zeros(0, bool)
        rows, prints = row[: len(full)][whole], mix64(full[whole])
        short = (per_row > 0) & (per_row < size)
        if short.any():
            first = np.concatenate([[0], np.cumsum(per_row)[:-1]])[short]
            total = np.zeros(int(short.sum()), _U64)
            for k in range(size - 1):
                has = per_row[short] > k
                total[has] += w[first[has] + k] * _ODD[k % len(_ODD)] + _U64(k)
            rows = np.concatenate([rows, np.flatnonzero(short)])
            prints = np.concatenate([prints, mix64(total + _U64(977))])
    order = np.lexsort((prints, rows))
    rows, prints = rows[order], prints[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (prints[1:] != prints[:-1])
    at = np.flatnonzero(new)
    return rows[at], prints[at], np.diff(np.append(at, len(rows))), n


def common_shingles(docs: DataFrame, text: str = "text", common: float = COMMON) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted fingerprints of shingles in at least ``common`` of all texts, their frequencies, and N.

    Tasks send each distinct shingle once with a count, as sorted runs of packed
    words, by ranges of the fingerprint; a range is summed by one task.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.filter(F.col(text).isNotNull()).count()
    least = max(2, int(np.ceil(common * total)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(FLUSH, _U64), 0

        def flush() -> pa.RecordBatch:
            run = held[:size]
            run.sort()
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            prints, counts = run[first], np.diff(np.append(first, size))
            edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=_U64)
            cuts = np.concatenate([[0], np.searchsorted(prints, edges), [len(prints)]])
            full = [k for k in range(ranges) if cuts[k + 1] > cuts[k]]
            data = [prints[cuts[k] : cuts[k + 1]].tobytes() for k in full]
            many = []
            for k in full:
                part = counts[cuts[k] : cuts[k + 1]]
                often = np.flatnonzero(part > 1)
                many.append(np.concatenate([often, part[often]]).astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(data, pa.binary()), pa.array(many, pa.binary())],
                names=["range", "prints", "often"],
            )

        for batch in slices(batches, "text", 1 << 18):
            _, prints, _, _ = shingles(batch.column("text"))
            while len(prints):
                taken = prints[: FLUSH - size]
                held[size : size + len(taken)] = taken
                size += len(taken)
                prints = prints[len(taken):]
                if size == FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def total_up(part: pa.Table) -> pa.Table:
        prints, counts = [], []
        for p, o in zip(part.column("prints").to_pylist(), part.column("often").to_pylist()):
            run = np.frombuffer(p, _U64)
            count = np.ones(len(run), np.int64)
            if o:
                at, more = np.frombuffer(o, "<u4").reshape(2, -1)
                count[at] = more
            prints.append(run)
            counts.append(count)
        run, count = np.concatenate(prints), np.concatenate(counts)
        order = np.argsort(run, kind="stable")
        run, count = run[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sums = np.add.reduceat(count, first)
        kept = sums >= least
        return pa.table({"print": run[first][kept].view(np.int64), "df": sums[kept]})

    packed = docs.select(F.col(text).alias("text")).mapInArrow(send, "range int, prints binary, often binary")
    frequent = packed.groupBy("range").applyInArrow(total_up, "print bigint, df bigint").collect()
    prints = np.array([r[0] for r in frequent], np.int64).view(_U64)
    order = np.argsort(prints)
    return prints[order], np.array([r[1] for r in frequent], np.int64)[order], total


class Weights:
    """TF-IDF weight of shingles; carries the bounded table of common ones."""

    def __init__(self, prints: np.ndarray, df: np.ndarray, total: int):
        self.prints = prints
        top = np.log(1 / COMMON)
        self.idf = (1 + DAMPING * np.clip(np.log(total / np.maximum(df, 1)), 0, top) / top).astype(np.float32)

    def of(self, prints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(prints), 1 + DAMPING, np.float32)
        if len(self.prints):
            at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
            idf = np.where(self.prints[at] == prints, self.idf[at], idf)
        return (1 + np.log(counts.astype(np.float32))) * idf


# --- samples -------------------------------------------------------------------------


def samples(prints: np.ndarray, weights: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """Consistent weighted samples of rows whose shingles start at ``first``: rows x count codes.

    For each shingle and sample, r and c are Gamma(2, 1) and b uniform, all functions of
    the shingle; t = floor(ln w / r + b), and the shingle of the least
    ln c - r * (t - b) - r is chosen together with its t.
    """
    out = np.empty((len(first), count), _U64)
    sizes = np.diff(np.append(first, len(prints)))
    log_w = np.log(weights).astype(np.float32)
    low = _U64((1 << 21) - 1)
    tiny, scale = np.float32(0.5 / (1 << 21)), np.float32(1.0 / (1 << 21))
    for k in range(count):
        with np.errstate(over="ignore"):
            a = mix64(prints + _U64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            z = (a ^ (a >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
        part = lambda x, shift: (x >> _U64(shift) & low).astype(np.float32) * scale + tiny
        r = -np.log(part(a, 0) * part(a, 21))
        c = -np.log(part(a, 42) * part(z, 43))
        b = part(z, 22)
        t = np.floor(log_w / r + b)
        cost = np.log(c) - r * (t - b) - r
        least = np.minimum.reduceat(cost, first)
        won = np.flatnonzero(cost == np.repeat(least, sizes))
        with np.errstate(over="ignore"):
            code = mix64(a[won] + t[won].astype(np.int64).view(_U64) * _ODD[1])
        row = np.searchsorted(first, won, side="right") - 1
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[start], k] = np.minimum.reduceat(code, start)
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(print, sample codes folded to a byte each, band keys, number of shingles) of every text with words.

    ``docs`` has the text and its ``print``; of equal texts that a task reads together one is sampled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, "text", 1 << 20):
            once = np.unique(batch.column("print").to_numpy(zero_copy_only=False), return_index=True)[1]
            batch = batch.take(pa.array(np.sort(once)))
            row, prints, counts, _ = shingles(batch.column("text"))
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            codes = samples(prints, w.of(prints, counts), first, BANDS * ROWS)
            bands = np.empty((len(first), BANDS), _U64)
            with np.errstate(over="ignore"):
                for b in range(BANDS):
                    key = np.full(len(first), b + 1, _U64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        key = mix64(key * _ODD[2] + codes[:, k])
                    bands[:, b] = key
            folded = (codes >> _U64(56)).astype(np.uint8)
            names = batch.column("print").take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays(
                [names, _bytes(folded), _lists(bands.view(np.int64), pa.int64()), pa.array(np.diff(np.append(first, len(row))))],
                names=["print", "codes", "bands", "size"],
            )

    return docs.select("print", "text").mapInArrow(run, "print string, codes binary, bands array<bigint>, size bigint")


def _bytes(grid: np.ndarray) -> pa.Array:
    offsets = np.arange(0, grid.size + 1, grid.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(grid), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(grid))])


def _grid(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _lists(grid: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, grid.size + 1, grid.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(grid.ravel(), kind))


# --- candidates ----------------------------------------------------------------------


def groups(sampled: DataFrame) -> DataFrame:
    """(print, node, hub): the members of every band that two nodes share."""
    banded = sampled.select("node", F.explode("bands").alias("print"))
    hubs = banded.groupBy("print").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("hub")
    ).filter("n > 1").select("print", F.col("hub.node").alias("hub"))
    return banded.join(hubs, "print").select("print", "node", "hub")


def hub_pairs(members: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct (node, hub) that agree in enough samples."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_grid(batch.column("codes")) == _grid(batch.column("hub_codes"))).mean(axis=1)
                at = pa.array(np.flatnonzero(same >= LEAST_AGREEMENT))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("hub").take(at)], names=["node", "hub"])

    distinct = members.filter("node <> hub").select("node", "hub").distinct()
    held = distinct.join(codes, "node").join(codes.select(F.col("node").alias("hub"), F.col("codes").alias("hub_codes")), "hub")
    return held.select("node", "hub", "codes", "hub_codes").mapInArrow(alike, "node bigint, hub bigint")


def tile_links(codes: np.ndarray, earlier: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, shingled: tuple, least: float = SIMILARITY) -> list[tuple[int, int, float]]:
    """Links (i, j, similarity) that join different classes, of the pairs of ``left`` and ``right`` rows.

    A pair is looked at if its samples agree in ``LEAST_AGREEMENT`` and no earlier band
    holds both (that band's group has it). Its similarity is exact: the least and total
    weights of one row against those of all its candidates. Rows that are in one class
    already, or get there by links found before, are not compared, so the links are a forest.
    """
    first, size, ids, weight, total = shingled
    comp = comp.copy()
    dense = np.zeros(int(ids.max()) + 1 if len(ids) else 0)
    same_side = left is right
    links: list[tuple[int, int, float]] = []
    for at, i in enumerate(left):
        own = slice(first[i], first[i] + size[i])
        others = right[at + 1 :] if same_side else right
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        others = others[(codes[others] == codes[i]).mean(axis=1) >= LEAST_AGREEMENT]
        others = others[~(earlier[others] == earlier[i]).any(axis=1)]
        if not len(others):
            continue
        dense[ids[own]] = weight[own]
        width = size[others]
        entry = np.arange(width.sum()) + np.repeat(first[others] - (np.cumsum(width) - width), width)
        low = np.add.reduceat(np.minimum(weight[entry], dense[ids[entry]]), np.cumsum(width) - width)
        dense[ids[own]] = 0
        similarity = low / (total[i] + total[others] - low)
        for j, value in zip(others[similarity >= least].tolist(), similarity[similarity >= least].tolist()):
            if comp[j] != comp[i]:
                links.append((int(i), j, value))
                comp[comp == comp[j]] = comp[i]
    return links


def group_links(placed: DataFrame, sampled: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """(a, b, similarity) that join the classes of a group, in all groups of more than one class.

    A group beyond ``PART`` members or ``PART_SHINGLES`` shingles is cut into blocks, and a task
    gets two of them; each link it returns joins two classes, so it returns fewer links than rows.
    """
    shared = placed.sparkSession.sparkContext.broadcast(weights)
    sized = placed.join(sampled.select("node", "codes", "bands", "size"), "node")
    unfinished = sized.groupBy("print").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum("size").alias("s")).filter(
        "x < y AND n > 2"
    ).select("print", F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("s") / PART_SHINGLES)).cast("int").alias("parts"))

    def run(part: pa.Table) -> pa.Table:
        name, part = part.column("print")[0].as_py(), part.combine_chunks().sort_by("node")
        part = part.filter(pa.array(np.diff(part.column("node").to_numpy(), prepend=part.column("node")[0].as_py() - 1) != 0))  # rows of one key
        node, raw = part.column("node").to_numpy(), part.column("comp").to_numpy()
        bands = np.stack([np.asarray(b, np.int64) for b in part.column("bands").to_pylist()])
        row, prints, counts, n = shingles(part.column("text"))
        ids = np.unique(prints, return_inverse=True)[1]
        w = shared.value.of(prints, counts).astype(np.float64)
        size = np.bincount(row, minlength=n)
        shingled = (np.cumsum(size) - size, size, ids, w, np.bincount(row, w, n))
        block = part.column("block").to_numpy()
        left = np.flatnonzero(block == block.min())
        right = np.flatnonzero(block == block.max())
        if part.column("lo")[0].as_py() == part.column("hi")[0].as_py():
            left = right
        band = int(np.flatnonzero(bands[0] == name)[0])
        links = tile_links(_grid(part.column("codes")), bands[:, :band], np.unique(raw, return_inverse=True)[1], left, right, shingled)
        i, j, similarity = (np.array(x) for x in zip(*links)) if links else (np.zeros(0, int),) * 3
        return pa.table({"a": pa.array(node[i]), "b": pa.array(node[j]), "similarity": pa.array(similarity, pa.float64())})

    block = F.pmod(F.xxhash64("node"), "parts").cast("int")
    rows = sized.join(unfinished, "print").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = rows.join(texts, "node").select(
        "print", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "comp", "codes", "bands", "text"
    )
    return tiles.groupBy("print", "lo", "hi").applyInArrow(run, "a bigint, b bigint, similarity double")


def all_roots(sampled: DataFrame, source: DataFrame, weights: Weights) -> DataFrame:
    """(node, root) of linked nodes: every candidate pair of the given similarity is inside one class.

    ``source`` has the texts and their ``print``; only those that share a band are taken along.
    """
    members = stored(groups(sampled), "members")
    wanted = members.select("node").distinct().join(sampled.select("node", "print"), "node")
    texts = stored(source.select("print", "text").join(wanted, "print").select("node", "text").dropDuplicates(["node"]), "texts")
    links = verified(stored(hub_pairs(members, sampled.select("node", "codes")), "pairs"), texts, weights)
    links = stored(links.select("a", "b"), "links")
    roots = stored(components(links), "roots")
    placed = members.join(roots, "node", "left").select("print", "node", F.coalesce("root", "node").alias("comp"))
    more = stored(group_links(placed, sampled, texts, weights).select("a", "b"), "links")
    return roots if more.isEmpty() else stored(components(links.union(more)), "roots")


# --- verification --------------------------------------------------------------------


def weighted_jaccard(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """Sum of least over sum of greatest weights, for each pair of texts."""
    sides = []
    for column in (a, b):
        row, prints, counts, n = shingles(column)
        sides.append((row, prints, weights.of(prints, counts).astype(np.float64)))
    row, prints, w = (np.concatenate([x, y]) for x, y in zip(*sides))
    order = np.lexsort((prints, row))
    row, prints, w = row[order], prints[order], w[order]
    twin = np.flatnonzero((row[1:] == row[:-1]) & (prints[1:] == prints[:-1]))
    low = np.bincount(row[twin], np.minimum(w[twin], w[twin + 1]), n)
    total = np.bincount(row, w, n)
    with np.errstate(invalid="ignore"):
        return np.where(total > 0, low / (total - low), 0.0)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs that reach ``least``."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text", 1 << 20):
                j = weighted_jaccard(part.column("text"), part.column("hub_text"), shared.value)
                kept = np.flatnonzero(j >= least)
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(at), part.column("hub").take(at), pa.array(j[kept])], names=["a", "b", "similarity"]
                )

    joined = pairs.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
    return joined.select("node", "hub", "text", "hub_text").mapInArrow(run, "a bigint, b bigint, similarity double")


# --- operator ------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id): a class is named by its least key."""
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("print", F.coalesce(F.md5("text"), F.lit("null")))
    keyed = source.select("id", "print")
    copies = stored(keyed.filter("id IS NOT NULL").groupBy("print").agg(F.min("id").alias("node")), "copies")
    weights = Weights(*common_shingles(source))
    chosen = copies.groupBy("node").agg(F.min("print").alias("print"))
    sampled = stored(signatures(source, weights).dropDuplicates(["print"]).join(chosen, "print"), "samples")
    roots = all_roots(sampled, source, weights)
    classes = stored(copies.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("class_id")), "classes")
    return keyed.join(classes, "print", "left").select(
        F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Whole rows, one of each class: that of the class's least key. Rows without a key stay."""
    extra = stored(near_duplicates(docs).filter("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    kept = docs.join(extra, "doc_id", "left_anti").select(docs.columns)
    again = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(
        kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    )


def query(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
