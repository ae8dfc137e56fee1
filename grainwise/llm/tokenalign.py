"""Token alignment of two vocabularies, with pair counts by external spill counting.

Every text is encoded by a byte-level tokenizer (A) and by a piece model (B). Byte offsets
where tokens of both end cut the text into groups; all A and B tokens of a group are
linked. How many documents hold a pair of ids linked is counted over the whole corpus:

1. A task reads runs of ``BLOCK`` bytes of text. A run's records (pair, document, links)
   are sorted by A id, then B id, dealt to ``parts`` partitions by the low digits of the A
   id, and spilled as zstd columns to the shared folder: pairs, documents of each pair, and
   the document and number of links of each record.
2. Pairs and document counts of up to about ``fan_in`` runs are merged by a heap over the
   heads of the runs, each giving a pair once with its documents added up; merged runs are
   merged again until one for each partition is left. In the last merge pairs come in the
   order of the A side, so the largest count of an A id is known as soon as its pairs end.
3. Counts and "is the largest" stream back along the same bundles, aligned with the pairs
   of each run, and meet the run's records, which give the sums of each document.

A record of a document crosses an exchange once, beside its run. What is merged is one
entry for each pair of a run, however many documents hold it, so a pair or an id that is
in every document is no hot key. A merge holds ``fan_in`` runs of one partition, the last
step one run.

Work is shared inside a task: where white space is single, neither tokenizer joins a space
with what precedes it, so groups of one word serve all its occurrences. Other texts are
aligned whole.

Defined cases: null and empty texts, and texts whose tokens of A or B do not give back
space + text, have no tokens: zeros and no groups. Strings of special tokens are plain
text. Ties for the largest count all count as largest. Repeated rows are documents each on
its own; a null key stays null; an empty table gives no rows; further columns are dropped,
so none can clash.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import math
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.bpe import byte_alphabet
from grainwise.llm.common import CACHES, slices, stored

BLOCK, PARTS, FAN_IN = 3 << 20, 64, 32
_UNITS_MOST, _HELD_MOST, _UNIT_CHARS, _STEP = 400_000, 64 << 20, 64, 256 << 10
#: A space opens a part, a single line feed is one.
_PARTS = re.compile(r"\n| ?[^ \n]+| ")
_PLAIN_LINKS, _TOGETHER = 64, 4096
#: White space beyond single spaces and line feeds: such texts are aligned whole.
_WHOLE = ("  ", "\n ", " \n", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)),
          " ", " ", " ", " ", "　", "▁")


# --- columns of runs -----------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=np.uint64)


# --- groups --------------------------------------------------------------------------


class Aligner:
    """Groups and links of texts, kept for each word while it fits."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # such strings in a text are ordinary text
        byte = {c: b for b, c in byte_alphabet().items()}
        tokens = (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
        model = sentencepiece_model_pb2.ModelProto()
        with open(piece_path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # the space before a text is part of what is encoded here
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.b_bytes = [
            bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode() for p in model.pieces
        ]
        self.a_size, self.b_size = [len(t) for t in self.a_bytes], [len(t) for t in self.b_bytes]
        self.a_sizes, self.b_sizes = np.array(self.a_size), np.array(self.b_size)
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.sizes = array("q")  # four for each unit: a tokens, b tokens, groups, links; -1 where bytes differ
        self.text: list[bytes] = []
        self.codes: list[bytes] = []
        self.times: dict[int, bytes] = {}  # links of each code of a unit, where not each has one
        self.held = 0

    def tidy(self) -> None:
        if len(self.text) > _UNITS_MOST or self.held > _HELD_MOST:
            self.clear()

    def _add(self, unit: str, a: list[int], b: list[int]) -> int:
        a_bytes, b_bytes, a_size, b_size = self.a_bytes, self.b_bytes, self.a_size, self.b_size
        raw = unit.encode()
        if b"".join([a_bytes[i] for i in a]) != raw or b"".join([b_bytes[i] for i in b]) != raw:
            return self._keep((-1, 0, 0, 0), b"", b"")
        parts: list[str] = []
        codes: list[int] = []
        times: list[int] = []
        i = j = links = 0
        while i < len(a):
            first, second = i, j
            left, right = a_size[a[i]], b_size[b[j]]
            while left != right:
                if left < right:
                    i += 1
                    left += a_size[a[i]]
                else:
                    j += 1
                    right += b_size[b[j]]
            i, j = i + 1, j + 1
            if i - first == 1 == j - second:
                x, y = a[first], b[second]
                parts.append(f"{x}|{y}")
                codes.append(x << 32 | y)
                links += 1
                continue
            xs, ys = a[first:i], b[second:j]
            parts.append(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)))
            links += len(xs) * len(ys)
            if len(xs) * len(ys) > _PLAIN_LINKS:
                left_often, right_often = Counter(xs), Counter(ys)
                times.extend([1] * (len(codes) - len(times)))
                codes.extend([x << 32 | y for x in left_often for y in right_often])
                times.extend([n * m for n in left_often.values() for m in right_often.values()])
            else:
                codes.extend([x << 32 | y for x in xs for y in ys])
        if times:
            times.extend([1] * (len(codes) - len(times)))
            self.times[len(self.text)] = array("Q", times).tobytes()
        return self._keep((len(a), len(b), len(parts), links), ";".join(parts).encode(), array("Q", codes).tobytes())

    def _keep(self, sizes: tuple[int, int, int, int], text: bytes, codes: bytes) -> int:
        self.sizes.extend(sizes)
        self.text.append(text)
        self.codes.append(codes)
        self.held += len(text) + len(codes)
        return len(self.text) - 1

    def _alone(self, unit: str) -> int:
        return self._add(unit, self.a.encode(unit, add_special_tokens=False).ids, self.b.encode(unit))

    def _together(self, units: list[str]) -> list[int]:
        """Numbers of new short units, encoded and aligned as one text.

        Each opens with a space, or gets a line feed before it, so no token reaches into the
        next one. If the tokens do not give the text back, halves are tried, then each unit.
        """
        if len(units) == 1:
            return [self._alone(units[0])]
        apart = np.array([u[0] != " " for u in units], np.int64)
        whole = "".join([u if u[0] == " " else "\n" + u for u in units])
        raw = whole.encode()
        a = np.array(self.a.encode(whole, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(whole), np.int64)
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum(np.array([len(u.encode()) for u in units]) + apart)
        starts = np.concatenate([[0], ends[:-1]]) + apart
        group_end = np.intersect1d(a_end, b_end, assume_unique=True)
        edges = np.concatenate([starts[starts > 0], ends])
        place = np.minimum(np.searchsorted(group_end, edges), len(group_end) - 1)
        if (
            not np.array_equal(group_end[place], edges)
            or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw
            or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw
        ):
            half = len(units) // 2
            return self._together(units[:half]) + self._together(units[half:])
        a_upto, b_upto = np.searchsorted(a_end, group_end, "right"), np.searchsorted(b_end, group_end, "right")
        a_from, b_from = np.concatenate([[0], a_upto[:-1]]), np.concatenate([[0], b_upto[:-1]])
        unit = np.searchsorted(ends, group_end)
        own = group_end > starts[unit]  # not the line feed before a unit
        a_from, a_upto, b_from, b_upto, unit = a_from[own], a_upto[own], b_from[own], b_upto[own], unit[own]
        n_a, n_b = a_upto - a_from, b_upto - b_from
        text = [f"{x}|{y}" for x, y in zip(a[a_from].tolist(), b[b_from].tolist())]
        a_ids, b_ids = a.tolist(), b.tolist()
        for g in np.flatnonzero((n_a > 1) | (n_b > 1)).tolist():
            text[g] = ",".join(map(str, a_ids[a_from[g] : a_upto[g]])) + "|" + ",".join(map(str, b_ids[b_from[g] : b_upto[g]]))
        links = n_a * n_b
        upto = np.cumsum(links)
        group = np.repeat(np.arange(len(links)), links)
        at = np.arange(len(group)) - (upto - links)[group]
        codes = (a[a_from[group] + at // n_b[group]] << 32 | b[b_from[group] + at % n_b[group]]).astype("<u8").tobytes()
        table = np.zeros((len(units), 4), np.int64)
        for k, values in enumerate((n_a, n_b, np.ones(len(links), np.int64), links)):
            np.add.at(table[:, k], unit, values)
        groups, code_ends = np.cumsum(table[:, 2]).tolist(), (8 * np.cumsum(table[:, 3])).tolist()
        first = len(self.text)
        g = c = 0
        for group_stop, code_stop in zip(groups, code_ends):
            self.text.append(";".join(text[g:group_stop]).encode())
            self.codes.append(codes[c:code_stop])
            g, c = group_stop, code_stop
        self.sizes.frombytes(table.tobytes())
        self.held += len(codes) + sum(map(len, self.text[first:]))
        return list(range(first, first + len(units)))

    def _learn(self, missing: set[str]) -> dict[str, int]:
        """Numbers of new parts; those too long to be kept are returned."""
        short = [p for p in missing if len(p) <= _UNIT_CHARS and p != " " and p != "\n"]
        for start in range(0, len(short), _TOGETHER):
            units = short[start : start + _TOGETHER]
            self.units.update(zip(units, self._together(units)))
        rest = missing.difference(self.units)
        self.units.update((p, self._alone(p)) for p in rest if len(p) <= _UNIT_CHARS)
        return {p: self._alone(p) for p in rest if len(p) > _UNIT_CHARS}

    def read(self, texts: list[str]) -> list[list[int]]:
        """For each text the numbers of its parts; no token of either side lies across two of them."""
        cut: list[list[str]] = []
        for text in texts:
            whole = " " + text
            cut.append([] if not text else [whole] if any(s in whole for s in _WHOLE) else _PARTS.findall(whole))
        long = self._learn({p for parts in cut for p in parts}.difference(self.units))
        get = self.units.__getitem__
        if not long:
            return [list(map(get, parts)) for parts in cut]
        return [[n if (n := long.get(p)) is not None else get(p) for p in parts] for parts in cut]


_ALIGNERS: dict[tuple[str, str], Aligner] = CACHES.setdefault("tokenalign", {})


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each Python worker, as its words serve the worker's later tasks too."""
    if (byte_path, piece_path) not in _ALIGNERS:
        _ALIGNERS[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _ALIGNERS[byte_path, piece_path]


class Run:
    """Documents of one run and their records, in the order (A id, B id, document)."""

    def __init__(self, model: Aligner, texts: list[str]):
        flat: list[int] = []
        lengths: list[int] = []
        self.groups: list[bytes] = []
        at = held = 0
        for end in range(1, len(texts) + 1):
            held += len(texts[end - 1])
            if held < _STEP and end < len(texts):
                continue
            for numbers in model.read(texts[at:end]):
                flat += numbers
                lengths.append(len(numbers))
                self.groups.append(b";".join([model.text[n] for n in numbers]))
            at, held = end, 0
        n = len(texts)
        doc = np.repeat(np.arange(n), lengths)
        used, place = np.unique(np.array(flat, np.int64), return_inverse=True)
        table = np.frombuffer(model.sizes, np.int64).reshape(-1, 4)[used]
        broken = np.zeros(n, bool)
        broken[doc[table[place, 0] < 0]] = True
        for k in np.flatnonzero(broken):
            self.groups[k] = b""
        sums = np.zeros((len(doc) + 1, 4), np.int64)
        np.cumsum(table[place], axis=0, out=sums[1:])
        ends = np.cumsum(lengths)
        self.sizes = np.where(broken[:, None], 0, sums[ends] - sums[ends - lengths])
        whole = ~broken[doc]
        self.pairs, self.documents, self.docs, self.links = self._records(model, used, doc[whole], place[whole], n)

    @staticmethod
    def _records(
        model: Aligner, used: np.ndarray, doc: np.ndarray, place: np.ndarray, n: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, documents of each, and for each record its document and links."""
        none = np.zeros(0, np.uint64)
        if not len(doc):
            return none, none, none, none
        found, often = np.unique(doc * len(used) + place, return_counts=True)
        doc, unit = np.divmod(found, len(used))
        numbers = used.tolist()
        codes = [model.codes[u] for u in numbers]
        size = np.array([len(c) // 8 for c in codes], np.int64)
        start = np.cumsum(size) - size
        pairs, at = np.unique(np.frombuffer(b"".join(codes), "<u8"), return_inverse=True)
        times = np.ones(size.sum(), np.int64)
        for k, u in enumerate(numbers) if model.times else ():
            if u in model.times:
                times[start[k] : start[k] + size[k]] = np.frombuffer(model.times[u], "<u8")
        width = size[unit]
        entry = np.arange(width.sum()) + np.repeat(start[unit] - (np.cumsum(width) - width), width)
        record = at[entry] * n + np.repeat(doc, width)
        links = times[entry] * np.repeat(often, width)
        order = np.argsort(record, kind="stable")
        record = record[order]
        first = np.flatnonzero(np.diff(record, prepend=-1))
        links = np.add.reduceat(links[order], first)
        pair, doc = np.divmod(record[first], n)
        counted = np.bincount(pair, minlength=len(pairs))
        keep = counted > 0  # a unit may be left only in texts without tokens
        return pairs[keep], counted[keep].astype(np.uint64), doc.astype(np.uint64), links.astype(np.uint64)

    def spilled(self, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(part, pairs, documents, docs, links) of each partition that has any."""
        part = (self.pairs >> np.uint64(32)) % np.uint64(parts)
        record_part = np.repeat(part, self.documents.astype(np.int64))
        for p in np.unique(part):
            own, records = part == p, record_part == p
            yield int(p), squeeze_sorted(self.pairs[own]), squeeze(self.documents[own]), squeeze(self.docs[records]), squeeze(self.links[records])


# --- merging -------------------------------------------------------------------------


def merged(runs: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, int]]:
    """(pair, documents) in order, from the heads of sorted runs."""
    heads = [zip(expand_sorted(pairs).tolist(), expand(counts).tolist()) for pairs, counts in runs]
    last, total = -1, 0
    for pair, count in heapq.merge(*heads):
        if pair == last:
            total += count
        else:
            if last >= 0:
                yield last, total
            last, total = pair, count
    if last >= 0:
        yield last, total


def best_of(counted: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(pair, documents, whether no pair of this A id has more), one A id after another."""
    side, held, most = -1, [], 0
    for pair, count in counted:
        if pair >> 32 != side:
            for p, c in held:
                yield p, c, int(c == most)
            side, held, most = pair >> 32, [], 0
        held.append((pair, count))
        most = max(most, count)
    for p, c in held:
        yield p, c, int(c == most)


def _runs_of(table: pa.Table) -> list[tuple[bytes, bytes]]:
    return list(zip(table.column("pairs").to_pylist(), table.column("documents").to_pylist()))


def _columns(rows: Iterator[tuple], width: int) -> list[np.ndarray]:
    flat = np.fromiter((x for row in rows for x in row), np.uint64)
    return list(flat.reshape(-1, width).T)


def _bundled(runs: DataFrame, bundles: int) -> DataFrame:
    return runs.withColumn("bundle", F.pmod(F.xxhash64("run"), F.lit(bundles)).cast("bigint"))


def counts(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """(part, pairs, documents, best) of the whole corpus, one row a partition."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pairs, documents = _columns(merged(_runs_of(table)), 2)
        return pa.table({"part": [key[0].as_py()], "run": [key[1].as_py()], "pairs": [squeeze_sorted(pairs)], "documents": [squeeze(documents)]},
                        schema=pa.schema([("part", pa.int32()), ("run", pa.int64()), ("pairs", pa.binary()), ("documents", pa.binary())]))

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        pairs, documents, best = _columns(best_of(merged(_runs_of(table))), 3)
        return pa.table({"part": [key[0].as_py()], "pairs": [squeeze_sorted(pairs)], "documents": [squeeze(documents)], "best": [squeeze(best)]},
                        schema=pa.schema([("part", pa.int32()), ("pairs", pa.binary()), ("documents", pa.binary()), ("best", pa.binary())]))

    level = runs.select("part", "run", "pairs", "documents")
    while n_runs > fan_in:
        n_runs = math.ceil(n_runs / fan_in)
        level = stored(
            _bundled(level, n_runs).groupBy("part", "bundle").applyInArrow(merge, "part int, run bigint, pairs binary, documents binary"),
            "merged",
        )
    return level.groupBy("part").applyInArrow(finish, "part int, pairs binary, documents binary, best binary")


# --- operator ------------------------------------------------------------------------


def align(
    df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text",
    whole: bool = True, parts: int = PARTS, fan_in: int = FAN_IN, block: int = BLOCK,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups).

    ``groups`` are `a1,a2|b1;a3|b2,b3` in UTF-8 if ``whole``, else their SHA-256; empty
    where a text has no tokens.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    names = ["run", "part", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "documents", "docs", "links"]

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the collector would walk the words again and again
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", block, owner="tokenalign"):
            model = aligner(byte_path, piece_path)
            model.tidy()
            run = Run(model, [t or "" for t in batch.column("text").to_pylist()])
            n = batch.num_rows
            groups = run.groups if whole else [hashlib.sha256(g).digest() if g else b"" for g in run.groups]
            nothing = [pa.nulls(n, pa.binary())] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array(np.full(n, -1, np.int32)), batch.column("key"),
                 *[pa.array(run.sizes[:, i]) for i in range(4)], pa.array(groups, pa.binary()), *nothing],
                names=names,
            )
            spilled = list(zip(*run.spilled(parts)))
            if spilled:
                n = len(spilled[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(spilled[0], pa.int32()), pa.nulls(n, batch.column("key").type),
                     *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.binary()), *[pa.array(c, pa.binary()) for c in spilled[1:]]],
                    names=names,
                )
            number += 1

    schema = (
        f"run bigint, part int, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups binary, "
        "pairs binary, documents binary, docs binary, links binary"
    )
    records = stored(source.mapInArrow(spill, schema), "records")
    runs = records.where("part >= 0")
    n_runs = runs.select("run").distinct().count()
    total = stored(counts(runs, n_runs, fan_in), "counts")
    bundles = max(1, math.ceil(n_runs / fan_in))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """Corpus counts in the order of each run's pairs."""
        rows = []
        if left.num_rows and right.num_rows:
            known, count, best = expand_sorted(right["pairs"][0].as_py()), expand(right["documents"][0].as_py()), expand(right["best"][0].as_py())
            for run, part, pairs in zip(left["run"].to_pylist(), left["part"].to_pylist(), left["pairs"].to_pylist()):
                at = np.searchsorted(known, expand_sorted(pairs))
                rows.append((run, part, squeeze(count[at]), squeeze(best[at])))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["run", "part", "count", "best"])

    everywhere = total.withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bundles - 1).cast("bigint"))))
    answers = (
        _bundled(runs.select("run", "part", "pairs"), bundles).groupBy("part", "bundle")
        .cogroup(everywhere.groupBy("part", "bundle"))
        .applyInArrow(answer, "run bigint, part int, count binary, best binary")
    )

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        documents = left.filter(pc.equal(left["part"], -1))
        n_best = np.zeros(documents.num_rows, np.int64)
        count_sum = np.zeros(documents.num_rows, np.int64)
        replies = {p: i for i, p in enumerate(right["part"].to_pylist())}
        for i, part in enumerate(left["part"].to_pylist()):
            if part >= 0:
                often = expand(left["documents"][i].as_py()).astype(np.int64)
                doc, links = expand(left["docs"][i].as_py()).astype(np.int64), expand(left["links"][i].as_py()).astype(np.int64)
                count = expand(right["count"][replies[part]].as_py()).astype(np.int64)
                best = expand(right["best"][replies[part]].as_py()).astype(np.int64)
                np.add.at(count_sum, doc, links * np.repeat(count, often))
                np.add.at(n_best, doc, links * np.repeat(best, often))
        columns = [documents[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links")]
        out = [*columns, pa.array(n_best), pa.array(count_sum), documents["groups"]]
        return pa.table(out, names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    out = (
        records.select("run", "part", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "documents", "docs", "links").groupBy("run")
        .cogroup(answers.groupBy("run"))
        .applyInArrow(sums, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups binary")
    )
    return out.withColumnRenamed("key", key)


def query(spark, folder: str) -> DataFrame:
    """One row for each document: tokens, groups, links and what the whole corpus says of its links."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), whole=False)
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.lower(F.hex("groups")).alias("groups_sha256")
    )
