"""Packing: tokenised documents into fixed windows by Karmarkar-Karp differencing.

Every document is tokenised and closed by an end id. Runs of the full capacity are
windows of their own. What is left of each document is dealt over ``k`` windows,
``k`` being the least that can hold it, by multiway differencing: partial partitions
(one sum for each window) are merged two at a time, those of the largest spread
first, the largest sums of one meeting the smallest of the other. If a window still
exceeds the capacity, its excess is cut off and put where there is room; without
cutting, ``k`` rises and the differencing is done again.

Rows are packed in blocks of about ``block`` ids as a task reads them, so memory is
bounded by a block plus one document, nothing is shuffled, and at most one window of
a block is not full. Sequence ids hold the partition number, so they are unique
without coordination; a repeated task gives the same ids if its input partition is
the same, as with files.

Defined cases: a null text is empty; an empty text is the end id alone; repeated
rows are packed each on its own; a null key stays null; an empty table gives no
rows; further columns are dropped, so none can clash.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import CACHES, slices

CAPACITY, END_ID, BLOCK = 2048, 1, 1 << 20


# --- tokens --------------------------------------------------------------------------

#: Texts that are encoded whole: longer runs of white space, ends that look ahead to nothing, white space
#: beyond ASCII, and the ASCII separators, of which one marks starts of lines below.
_WHOLE = (
    r"   |  \z|  [\t\n\r\x0b\x0c]|[\t\n\r\x0b\x0c] |^[\t\n\r\x0b\x0c]"
    r"|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Texts that keep their line feeds inside words, as other white space stands beside one.
_FEEDS = r"[\t\n\r\x0b\x0c ]\n|\n[\t\r\x0b\x0c]"
_LINE = "\x1c"
#: Letters and digits that every version of Unicode in use has as such; punctuation after them is apart.
_ENDS = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}]\z"
_INNER = re.compile(r"[\t\n\r\x0b\x0c]|\A\Z")
#: Words whose ids a worker keeps, and characters in them for each; beyond either its cache starts anew.
WORDS, WORD_CHARS = 2_000_000, 32
#: Bytes of text that a worker takes up at a time.
RUN = 4 << 20
#: Words that are encoded as one text.
TOGETHER = 64


def _runs(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of ``ids``, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(len(ids), total) < 1 << 31 else np.int64
    at = np.repeat((start - ends + count).astype(kind), count)
    at += np.arange(total, dtype=kind)
    return ids[at]


class WordTokens:
    """Ids of whole texts by a byte-level tokenizer, through a cache of its words.

    The tokenizer's pattern never joins a space with what precedes it, so a text may
    be cut before each space that no other white space precedes or ends the text, and
    the ids of the parts joined; a line feed between other characters is a token of its
    own, so a line's first word is one too, and so is punctuation that closes a word. Every
    text starts as a line does. A slice's words are numbered by Arrow, and Python meets each
    distinct one once. New words are encoded many at a time: each starts where a token
    starts with the space or line feed that leads it. Other texts are encoded whole.
    """

    def __init__(self, path: str, most: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True  # such strings in a text are ordinary text
        self.most = most
        vocabulary = self.encoder.get_vocab()
        self.leads = {" ": np.zeros(max(vocabulary.values()) + 1, bool), "\n": np.zeros(max(vocabulary.values()) + 1, bool)}
        self.leads[" "][[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        self.leads["\n"][[i for t, i in vocabulary.items() if t[0] == "Ċ"]] = True
        self._forget()

    def _forget(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.chars = 0
        self.ids = np.zeros(1 << 16, "<u4")
        self.bounds = np.zeros(1 << 14, np.int64)  # of the words' ids, in the order in which they were learned

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.encoder.encode_batch_fast(parts, add_special_tokens=False)]

    def _keep(self, cache: dict[str, int], words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Put new words and their ids, of which ``ends`` are the ends, behind those that are there."""
        done = len(self.first) + len(self.later) + len(self.tails)
        used = int(self.bounds[done])
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), used + len(ids)))
        if done + len(words) >= len(self.bounds):
            self.bounds = np.resize(self.bounds, max(2 * len(self.bounds), done + len(words) + 1))
        self.ids[used : used + len(ids)] = ids
        self.bounds[done + 1 : done + 1 + len(words)] = used + ends
        cache.update(zip(words, range(done, done + len(words))))
        self.chars += sum(map(len, words))

    def _learn(self, cache: dict[str, int], lead: str, missing: list[str]) -> None:
        alone = [w for w in missing if not lead or _INNER.search(w)]
        plain = [] if not lead else [w for w in missing if not _INNER.search(w)] if alone else missing
        for start in range(0, len(plain), 128 * TOGETHER):
            part = plain[start : start + 128 * TOGETHER]
            ids = np.concatenate(self._encode([lead + lead.join(part[k : k + TOGETHER]) for k in range(0, len(part), TOGETHER)]))
            starts = np.flatnonzero(self.leads[lead][ids])
            if len(starts) == len(part):
                self._keep(cache, part, ids, np.append(starts[1:], len(ids)))
            else:
                alone += part
        for start in range(0, len(alone), 8192):
            part = alone[start : start + 8192]
            found = self._encode([lead + w for w in part])
            self._keep(cache, part, np.concatenate(found), np.cumsum([len(x) for x in found]))

    def _numbers(self, cache: dict[str, int], lead: str, words: list[str]) -> np.ndarray:
        """Where the ids of distinct words are kept."""
        found = list(map(cache.get, words))
        missing = [w for w, at in zip(words, found) if at is None]
        if missing:
            self._learn(cache, lead, missing)
            new = iter(missing)
            found = [cache[next(new)] if at is None else at for at in found]
        return np.array(found, np.int64)

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the start and number of each word's ids."""
        base = pc.utf8_rtrim(words, characters=string.punctuation)
        base = pc.if_else(pc.match_substring_regex(base, _ENDS), base, words)
        size = pc.binary_length(words).to_numpy() - pc.binary_length(base).to_numpy()
        cut = size > 0
        ends = [w[-n:] for w, n in zip(words.filter(pa.array(cut)).to_numpy(zero_copy_only=False), size[cut].tolist())]
        coded = base.dictionary_encode()
        at_line = pc.starts_with(coded.dictionary, _LINE)
        lines = at_line.to_numpy(zero_copy_only=False)
        place = np.empty(len(lines), np.int64)
        place[lines] = self._numbers(self.first, "\n", [w[1:] for w in coded.dictionary.filter(at_line).to_numpy(zero_copy_only=False)])
        place[~lines] = self._numbers(self.later, " ", coded.dictionary.filter(pc.invert(at_line)).to_numpy(zero_copy_only=False).tolist())
        tails = dict.fromkeys(ends)
        tails = dict(zip(tails, self._numbers(self.tails, "", list(tails)).tolist()))
        start, count = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        for side, own, at in ((0, slice(None), place[coded.indices.to_numpy()]), (1, cut, np.array([tails[e] for e in ends], np.int64))):
            start[own, side] = self.bounds[at]
            count[own, side] = self.bounds[at + 1] - self.bounds[at]
        total = count.sum(1)
        return _runs(self.ids, start.ravel(), count.ravel()), np.cumsum(total) - total, total

    def closed(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Ids of every text and ``end_id`` after them."""
        if not len(texts):
            return []
        if len(self.later) + len(self.first) + len(self.tails) > self.most or self.chars > WORD_CHARS * self.most:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, _WHOLE)
        body = pc.if_else(whole, "", texts)
        body = pc.if_else(pc.match_substring_regex(body, _FEEDS), body, pc.replace_substring(body, "\n", " " + _LINE))
        line, none = pa.scalar(_LINE, pa.large_string()), pa.scalar("", pa.large_string())
        split = pc.split_pattern(pc.binary_join_element_wise(line, body, none), " ")
        last = split.offsets.to_numpy()[1:] - split.offsets[0].as_py() - 1
        coded = split.flatten().dictionary_encode()
        del body, split
        known, start, count = self._units(coded.dictionary)
        word = coded.indices.to_numpy()
        count = count[word]
        stops = np.cumsum(count)[last]
        # every text begins with a line feed; its place goes to the end id of the text before
        ids = np.append(_runs(known, start[word], count)[1:], np.uint32(end_id))
        ids[stops - 1] = end_id
        data = ids.astype("<u4", copy=False).tobytes()
        stops = (4 * stops).tolist()
        out = [data[a:b] for a, b in zip([0, *stops], stops)]
        places = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for i, own in zip(places, self._encode(texts.filter(whole).to_pylist())):
            out[i] = own.tobytes() + np.array([end_id], "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x[:-4] for x in self.closed(pa.array(texts, pa.large_string()), 0)]


_ENCODERS: dict[str, WordTokens] = CACHES.setdefault("packing", {})


def encoder(path: str, most: int = WORDS) -> WordTokens:
    """One for each Python worker, as its cache serves the worker's later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokens(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]


# --- differencing --------------------------------------------------------------------


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items of each of ``k`` windows by multiway Karmarkar-Karp differencing."""
    n = len(sizes)
    if k == 1:
        return [list(range(n))]
    left, right = [-1] * n, [-1] * n  # a node below n is an item, the others join two nodes
    order = np.argsort(-sizes, kind="stable")
    heap = [(-int(sizes[i]), int(i)) for i in order]  # (minus spread, partial partition)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    new = n

    def load(p: int) -> tuple[np.ndarray, np.ndarray]:
        if p in parts:
            return parts.pop(p)
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = sizes[p], p
        return sums, nodes

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums_a, nodes_a = load(a)
        sums_b, nodes_b = load(b)
        sums, nodes_b = sums_a + sums_b[::-1], nodes_b[::-1]
        nodes = np.maximum(nodes_a, nodes_b)
        both = np.flatnonzero((nodes_a >= 0) & (nodes_b >= 0))
        nodes[both] = np.arange(len(left), len(left) + len(both))
        left.extend(nodes_a[both].tolist())
        right.extend(nodes_b[both].tolist())
        down = np.argsort(-sums, kind="stable")
        parts[new] = (sums[down], nodes[down])
        heapq.heappush(heap, (int(sums.min() - sums.max()), new))
        new += 1
    _, nodes = load(heap[0][1])
    windows: list[list[int]] = []
    for root in nodes.tolist():
        stack, items = [root] if root >= 0 else [], []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x], right[x])
        windows.append(items)
    return windows


def windows_of(lengths: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (row, start, length); all ids of every row lie in exactly one piece."""
    full = [[(i, s, capacity)] for i, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = [(i, n - n % capacity, n % capacity) for i, n in enumerate(lengths) if n % capacity]
    if not rest:
        return full
    sizes = np.array([r[2] for r in rest], np.int64)
    k = -(-int(sizes.sum()) // capacity)
    while True:
        dealt = difference(sizes, k)
        most = max(int(sizes[w].sum()) for w in dealt)
        if cut or most <= capacity:
            break
        k += max(1, k * (most - capacity) // (8 * capacity))  # the window count rises
    open_windows: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    spare: list[tuple[int, int, int]] = []
    for items in dealt:
        pieces, used = [], 0
        for i in sorted(items):
            row, start, size = rest[i]
            take = min(size, capacity - used)
            if take:
                pieces.append((row, start, take))
            if take < size:
                spare.append((row, start + take, size - take))
            used += take
        open_windows.append(pieces)
        room.append(capacity - used)
    slot = 0
    for row, start, size in spare:
        while size:
            while not room[slot]:
                slot += 1
            take = min(size, room[slot])
            open_windows[slot].append((row, start, take))
            room[slot] -= take
            start, size = start + take, size - take
    return full + [w for w in open_windows if w]


# --- operator ------------------------------------------------------------------------


def pack(
    df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, block: int = BLOCK, cut: bool = True, words: int = WORDS,
    run_bytes: int = RUN,
) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are little-endian uint32.

    A worker keeps the ids of about ``words`` words and takes up ``run_bytes`` of text at a time:
    fewer take less memory and more time.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the collector would walk the cache again and again
        part = TaskContext.get().partitionId() << 33
        keys: list = []
        ids: list[bytes] = []
        held = 0
        done = 0

        def flush() -> pa.RecordBatch:
            nonlocal done
            lengths = [len(x) // 4 for x in ids]
            rows, starts, sizes, data, seq, offsets = [], [], [], [], [], []
            for window in windows_of(lengths, capacity, cut):
                at = 0
                for row, start, size in window:
                    rows.append(row)
                    starts.append(start)
                    sizes.append(size)
                    data.append(ids[row][4 * start : 4 * (start + size)])
                    seq.append(part + done)
                    offsets.append(at)
                    at += size
                done += 1
            taken = pa.array(keys, type=key_type).take(pa.array(rows, pa.int64()))
            totals = np.asarray(lengths, np.int64)[rows]
            return pa.RecordBatch.from_arrays(
                [taken, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()),
                 pa.array(totals), pa.array(seq, pa.int64()), pa.array(offsets, pa.int64())],
                names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in slices(batches, "text", run_bytes, owner="packing"):
            key_type = batch.column("key").type
            for k, x in zip(batch.column("key").to_pylist(), encoder(path, words).closed(batch.column("text"), end_id)):
                keys.append(k)
                ids.append(x)
                held += len(ids[-1]) // 4
                if held >= block:
                    yield flush()
                    keys, ids, held = [], [], 0
        if ids:
            yield flush()

    schema = f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


def pieces(docs: DataFrame, path: str, words: int = WORDS, run_bytes: int = RUN) -> DataFrame:
    packed = pack(docs, path, words=words, run_bytes=run_bytes)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
