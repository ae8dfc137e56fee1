"""Suffix-array dedup: repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of ``LENGTH`` bytes around it also starts anywhere else;
another length, ``LEAST`` at least, can be asked for.

Sorting every suffix is not needed for that. Suffixes are taken at content-defined
anchors: the position of the least q-gram fingerprint in each ``SPAN`` successive
q-grams. Two equal strings of 400 bytes hold the same anchors at the same offsets, and
at least three of them. Bucket-pointer refinement then runs over the anchors:

* the initial bucket of a suffix is its q-gram;
* a round refines buckets by the bucket identifier of the suffix one or more anchors
  later (with the distance to it), reading identifiers as updated by the round before;
* a suffix alone in its bucket is done and leaves, as in the sequential algorithm.

Identifiers are fingerprints of what they stand for, so a round needs one grouping and
no global ranks. What remains after the rounds marks the only places where a repeated
string can start; there every string of 400 bytes is fingerprinted and counted, packed
in sorted runs by fingerprint range, and the answer returns as one bit for each string.

Equal texts are one text throughout and are removed whole if they are long enough, so
a group of copies costs one document. Fingerprints have 64 bits.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` loses nothing;
repeated rows are each other's copies; an empty table gives no rows; only the key and
the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.llm.common import free_name, Prefix, release, slices, stored, utf8

LENGTH, GRAM, SPAN = 400, 32, 96
#: A shorter string need not hold an anchor.
LEAST = GRAM + SPAN - 1
#: Refinements: how many anchors later the identifier is read that refines a bucket.
OFFSETS = (1, 1)
_U64 = np.uint64


def text_id(text: Column) -> Column:
    """60 bits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


# --- anchors -------------------------------------------------------------------------


def least_positions(prints: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the position of the least, the leftmost of equals.

    Minima are accumulated from both ends of blocks of ``span`` values. The low eight
    bits of a value give way to its place, so ties and positions come with the minimum.
    """
    n = len(prints)
    if n < span:
        return np.zeros(0, np.int64)
    blocks = -(-n // span) + 1
    low = np.full(blocks * span, np.iinfo(_U64).max, _U64)
    low[:n] = prints & _U64(0xFFFFFFFFFFFFFF00)
    low = low.reshape(blocks, span)
    place = np.arange(span, dtype=_U64)
    tail = np.minimum.accumulate((low | place)[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(low | (place + _U64(span)), axis=1).ravel()
    start = np.arange(n - span + 1)
    block, at = start // span, start % span
    best = tail[start].copy()
    inner = at > 0
    best[inner] = np.minimum(best[inner], head[(block[inner] + 1) * span + at[inner] - 1])
    return block * span + (best & _U64(255)).astype(np.int64)


def first_anchors(prefix: Prefix, lo: int, hi: int) -> np.ndarray:
    """For each start of a run of q-grams in bytes lo..hi the anchor it selects, counted from lo."""
    starts = np.arange(lo, hi - GRAM + 1)
    return least_positions(prefix.of(starts, starts + GRAM), SPAN)


def shared_anchors(length: int) -> int:
    """How many anchors two equal strings have in common for certain."""
    if length < LEAST:
        raise ValueError(f"strings of {length} bytes need not hold an anchor, of {LEAST} they do")
    return -(-(length - GRAM - SPAN + 2) // SPAN)


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text, ord, pos, bucket): the suffixes at anchors and their initial buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            prefix = Prefix(data)
            ids, orders, places, buckets = [], [], [], []
            whole = data.tobytes()
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if hi - lo < length:
                    continue
                chosen = first_anchors(prefix, lo, hi)
                pos = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
                ids.append(np.full(len(pos), int(hashlib.md5(whole[lo:hi]).hexdigest()[:15], 16), np.int64))
                orders.append(np.arange(len(pos), dtype=np.int32))
                places.append(pos.astype(np.int32))
                buckets.append(prefix.of(lo + pos, lo + pos + GRAM).view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (ids, orders, places, buckets)], names=["text", "ord", "pos", "bucket"]
                )

    return docs.select("text").mapInArrow(run, "text bigint, ord int, pos int, bucket bigint")


# --- refinement ----------------------------------------------------------------------


def shared_buckets(suffixes: DataFrame) -> DataFrame:
    """Stored suffixes whose bucket holds another one; equal places of equal texts are one suffix.

    The shared buckets are written first: a join of two plain exchanges can be split
    where one bucket holds a large part of all suffixes.
    """
    place = F.xxhash64("text", "pos")
    shared = stored(
        suffixes.groupBy("bucket").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a < b").select("bucket"), "shared"
    )
    kept = stored(suffixes.join(shared, "bucket", "left_semi"), "buckets")
    release(shared)
    return kept


def refine(suffixes: DataFrame, offset: int) -> DataFrame:
    """New buckets from the identifiers ``offset`` anchors later; a suffix without one is alone."""
    later = Window.partitionBy("text").orderBy("ord").rangeBetween(offset, offset)
    return (
        suffixes.withColumn("next", F.max("bucket").over(later)).withColumn("next_pos", F.max("pos").over(later))
        .filter("next IS NOT NULL")
        .select("text", "ord", "pos", F.xxhash64("bucket", F.col("next_pos") - F.col("pos"), "next").alias("bucket"))
    )


def repeated_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text, places): anchors that may be the first one of a repeated string."""
    left = stored(anchors(docs, length), "suffixes")
    for offset in (None, *OFFSETS[: shared_anchors(length) - 1]):
        before = left
        left = shared_buckets(before if offset is None else refine(before, offset))
        release(before)
    places = stored(left.groupBy("text").agg(F.sort_array(F.collect_set("pos")).alias("places")), "places")
    release(left)
    return places


# --- strings -------------------------------------------------------------------------


def _strings(texts: list[bytes], places: list[list[int]], length: int = LENGTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Starts of the strings to be counted, by text, and the fingerprints of all."""
    starts, prints = [], []
    for text, chosen in zip(texts, places):
        data = np.frombuffer(text, np.uint8)
        prefix = Prefix(data)
        first = first_anchors(prefix, 0, len(data))[: len(data) - length + 1]
        open_ = np.zeros(len(data) + 1, dtype=bool)
        open_[[p for p in chosen if p <= len(data)]] = True
        at = np.flatnonzero(open_[first])
        starts.append(at)
        prints.append(prefix.of(at, at + length))
    return starts, np.concatenate(prints) if prints else np.zeros(0, _U64)


def _cuts(prints: np.ndarray, ranges: int) -> np.ndarray:
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=_U64)
    return np.concatenate([[0], np.searchsorted(prints, edges), [len(prints)]])


def _pack(run: np.ndarray) -> bytes:
    """Sorted words as their differences; in six bytes if all of them fit."""
    gaps = np.diff(run, prepend=_U64(0))
    wide = bool((gaps[1:] >> _U64(48)).any()) if len(gaps) > 1 else False
    tail = gaps[1:].view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 6]
    return (b"8" if wide else b"6") + gaps[:1].tobytes() + np.ascontiguousarray(tail).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    width = int(data[:1])
    head = np.frombuffer(data[1:9], _U64)
    tail = np.frombuffer(data[9:], np.uint8).reshape(-1, width)
    gaps = np.zeros((len(tail), 8), np.uint8)
    gaps[:, :width] = tail
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([head, gaps.view(_U64).ravel()]), dtype=_U64)


def _forward(text: bytes, at: int) -> int:
    """The next place at which a character starts."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _back(text: bytes, at: int) -> int:
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _group(part: pa.Table) -> tuple[list[str], list[bytes], list[list[int]]]:
    """A chunk's texts in the order of their hash."""
    rows = sorted(zip(part.column("print").to_pylist(), part.column("body").to_pylist(), part.column("places").to_pylist()), key=lambda r: r[0])
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def _send(ranges: int, length: int):
    def run(part: pa.Table) -> pa.Table:
        _, texts, places = _group(part)
        _, prints = _strings(texts, places, length)
        prints, counts = np.unique(prints, return_counts=True)
        cuts = _cuts(prints, ranges)
        full = [k for k in range(ranges) if cuts[k + 1] > cuts[k]]
        chunk = part.column("chunk")[0].as_py()
        return pa.table(
            {
                "range": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()),
                "prints": pa.array([_pack(prints[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
                "often": pa.array([np.packbits(counts[cuts[k] : cuts[k + 1]] > 1).tobytes() for k in full], pa.binary()),
            }
        )

    return run


def _count(part: pa.Table) -> pa.Table:
    runs = [_unpack(p) for p in part.column("prints").to_pylist()]
    often = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(r)) for o, r in zip(part.column("often").to_pylist(), runs)]
    prints, more = np.concatenate(runs), np.concatenate(often)
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(ordered), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    flags = np.zeros(len(ordered), dtype=bool)
    flags[order] = twice
    flags |= more.astype(bool)
    ends = np.cumsum([len(r) for r in runs])
    bits = [np.packbits(flags[e - len(r) : e]).tobytes() for e, r in zip(ends, runs)]
    return pa.table({"range": part.column("range"), "chunk": part.column("chunk"), "bits": pa.array(bits, pa.binary())})


def _apply(ranges: int, characters: bool, length: int):
    def run(part: pa.Table, answer: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"print": pa.array([], pa.string()), "starts": pa.array([], pa.list_(pa.int32())), "ends": pa.array([], pa.list_(pa.int32())), "kept": pa.array([], pa.binary())})
        names, texts, places = _group(part)
        starts, prints = _strings(texts, places, length)
        unique, inverse = np.unique(prints, return_inverse=True)
        cuts = _cuts(unique, ranges)
        flags = np.zeros(len(unique), dtype=bool)
        for k, bits in zip(answer.column("range").to_pylist(), answer.column("bits").to_pylist()):
            n = cuts[k + 1] - cuts[k]
            flags[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        hit = flags[inverse]
        out_s, out_e, kept = [], [], []
        at = 0
        for text, own in zip(texts, starts):
            first = own[hit[at : at + len(own)]]
            at += len(own)
            new = np.flatnonzero(np.concatenate([[True], first[1:] > first[:-1] + length])) if len(first) else first
            begin = first[new]
            end = first[np.append(new[1:], len(first)) - 1] + length if len(first) else first
            out_s.append(begin.astype(np.int32))
            out_e.append(end.astype(np.int32))
            pairs = np.stack([begin, end], 1).tolist()
            if characters:
                pairs = [[_forward(text, a), _back(text, b)] for a, b in pairs]
            edges = [0, *[x for pair in pairs for x in pair], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return pa.table(
            {"print": pa.array(names, pa.string()), "starts": pa.array(out_s, pa.list_(pa.int32())),
             "ends": pa.array(out_e, pa.list_(pa.int32())), "kept": pa.array(kept, pa.binary())}
        )

    return run


# --- operator ------------------------------------------------------------------------


def repeated_strings(docs: DataFrame, text: str = "text", characters: bool = False, length: int = LENGTH, groups: int = 1) -> DataFrame:
    """(print, starts, ends, kept) of every distinct text that loses bytes.

    ``print`` is the text's MD5, ``starts`` and ``ends`` bound the maximal removed runs
    and ``kept`` are the remaining bytes. With ``characters`` a character is kept if a run
    would take only a part of its bytes, so ``kept`` is valid text. A worker is handed the
    texts of a partition in so many ``groups``: more take less memory and more disk.
    """
    source = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = groups * ranges
    long = source.filter(F.octet_length("text") >= length)
    places = repeated_suffixes(long, length)
    distinct = (
        long.groupBy(text_id(F.col("text")).alias("id"), F.md5("text").alias("print"))
        .agg(F.first("text").alias("body"), F.count("*").alias("n"))
    )
    some = stored(
        distinct.join(places.withColumnRenamed("text", "id"), "id")
        .select("print", F.col("body").cast("binary").alias("body"), "places", "n", F.pmod(F.hash("print"), F.lit(chunks)).alias("chunk")),
        "texts",
    )
    sent = some.select("chunk", "print", "body", "places").groupBy("chunk").applyInArrow(_send(ranges, length), "range int, chunk int, prints binary, often binary")
    bits = stored(sent.groupBy("range").applyInArrow(_count, "range int, chunk int, bits binary"), "bits")
    answered = some.select("chunk", "print", "body", "places").groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(
        _apply(ranges, characters, length), "print string, starts array<int>, ends array<int>, kept binary"
    )
    copies = long.groupBy(F.md5("text").alias("print"), F.octet_length("text").alias("size")).agg(F.count("*").alias("n")).filter("n > 1")
    gone = copies.select(
        "print", F.array(F.lit(0)).alias("starts"), F.array(F.col("size")).alias("ends"), F.unhex(F.lit("")).alias("kept")
    )
    parts = answered.filter(F.size("starts") > 0).join(copies.select("print"), "print", "left_anti")
    repeats = stored(gone.union(parts), "repeats")
    release(places, some, bits)
    return repeats


def without_repeats(docs: DataFrame, length: int = LENGTH, groups: int = 1) -> DataFrame:
    """Whole rows with repeated strings cut from their text; ``n_chars`` follows."""
    name, left = free_name("_print", docs.columns), free_name("_kept", docs.columns)
    lost = repeated_strings(docs, characters=True, length=length, groups=groups).select(F.col("print").alias(name), F.col("kept").alias(left))
    joined = docs.withColumn(name, F.md5(F.coalesce("text", F.lit("")))).join(lost, name, "left")
    text = F.coalesce(F.decode(left, "UTF-8"), F.col("text"))
    kinds = dict(docs.dtypes)
    return joined.select(
        *[(text if c == "text" else F.length(text).cast(kinds[c]) if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"), F.md5(body).alias("print"),
        F.sha2(body.cast("binary"), 256).alias("whole"),
    )
    lost = repeated_strings(docs).select(
        "print",
        F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda t, x: t + x).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("left"),
    )
    return rows.join(lost, "print", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("left", "whole").alias("kept_sha256"),
    )
