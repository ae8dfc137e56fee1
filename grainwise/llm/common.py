"""Helpers shared by the operators: reading, storing between passes, vectorised words."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.session import shared_folder

_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write the rows to the cluster's shared folder and read them back.

    Later passes start from files that outlive any executor. The driver's garbage
    collector is asked to run, as Spark removes the shuffle files of a finished
    stage only once its objects are collected.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "llm", f"{kind}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    schema = df.schema
    del df
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column of a table bears it; names differ in case too."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def release(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote; nothing that is read later may depend on it."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(key: Column, folds: int = 3) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash words to the open interval (0, 1)."""
    return ((x >> _U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


_BYTE = mix64(np.arange(1, 257, dtype=_U64) * _MULT)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0xD6E8FEB86659FD93  # odd, so that its powers can be undone
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n + 1:
        size = max(n + 1, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=_U64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps, dtype=_U64)
    return _POWERS["p"], _POWERS["q"]


class Prefix:
    """Polynomial fingerprints of any byte range, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.p, self.q = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=_U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * self.p[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.q[start]
            return mix64(raw + (end - start).astype(_U64) * _MULT)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Caches that outlive a task in a reused Python worker, by their operator.
CACHES: dict[str, dict] = {}


def _give_back() -> None:
    """Return freed memory to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, within: str | None = None, owner: str | None = None
) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``most`` text bytes; a longer row is a run.

    ``within`` names a struct column that holds the text as a field. Workers serve one
    operator after another, so what other operators than ``owner`` keep is given up first.
    """
    left = [cache for name, cache in CACHES.items() if name != owner and cache]
    for cache in left:
        cache.clear()
    if owner is None:
        gc.enable()
    if left:
        _give_back()
    for batch in batches:
        column = batch.column(within).field(text) if within else batch.column(text)
        whole = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        lengths = pc.binary_length(whole).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(lengths[start:])
            count = max(1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(start, count)
            start += count


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of the row that holds it."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    letter = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = letter[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    start = np.flatnonzero(letter & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = letter[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    end = np.flatnonzero(letter & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row
