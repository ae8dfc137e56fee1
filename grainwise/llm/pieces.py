"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

All segmentations of a text into pieces of a given model form a lattice. Forward
filtering sums the probability of every prefix; backward sampling draws one piece
after another from the end, so a whole segmentation is drawn with its probability
under the model. Random numbers are hashes of the row's key and the place in the row:
the same row gets the same segmentation on any cluster, in any partition.

Pieces of the model never run across the start of a word, so a text's lattice is a
chain of word lattices. Those are built once for each distinct word a Python worker
meets, and all words of many texts are sampled together, one array step for each
piece from the end.

A model scored by merge ranks holds no probabilities. Pieces get Zipf's law over
their rank, ``p ~ 1 / (rank + OFFSET)``, raised to ``theta``: small values sample more
freely, large ones approach the most probable segmentation. Pieces scored out of use
by the model (runs of spaces) are not used.

Lossless: a character without a piece is written as its UTF-8 bytes, and so is the
mark that stands for a space, where a text holds it itself; decoding drops the one
leading space that encoding adds.

Defined cases: a null text has null ids; an empty text has none; rows of equal key
and text get equal segmentations, other texts of that key use the same random
numbers; a null key is a key; an empty table gives no rows; only the key and the text
are read, so further columns cannot clash.
"""

from __future__ import annotations

import gc
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import CACHES, Prefix, mix64, slices, uniform, utf8

OFFSET, THETA, SEED = 8.0, 1.0, 20_240_601
MOST_EDGES, AT_ONCE = 3_000_000, 16_384
MARK = "▁"
GLUE = "\ue0ff"  # opens a part of a text that no space precedes
_U64 = np.uint64


class Growing:
    """An array that makes room as it grows."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            room = np.zeros(int(1.4 * (self.size + len(more))), self.data.dtype)
            room[: self.size] = self.data[: self.size]
            self.data = room
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)

    def __len__(self) -> int:
        return self.size

    def view(self) -> np.ndarray:
        return self.data[: self.size]


class Lookup:
    """Places of 64-bit fingerprints in a table, by open addressing."""

    def __init__(self, prints: np.ndarray):
        self.bits = max(8, int(len(prints)).bit_length() + 3)
        self.keys, self.at = np.zeros((1 << self.bits) + 64, _U64), np.full((1 << self.bits) + 64, -1, np.int32)
        for i, (key, slot) in enumerate(zip(prints.tolist(), (prints >> _U64(64 - self.bits)).tolist())):
            while self.at[slot] >= 0:
                slot += 1
            self.keys[slot], self.at[slot] = key, i

    def of(self, prints: np.ndarray) -> np.ndarray:
        """The place of each fingerprint, -1 where there is none."""
        slot = (prints >> _U64(64 - self.bits)).astype(np.int64)
        found = self.at[slot]
        off = np.flatnonzero((found >= 0) & (self.keys[slot] != prints))
        while len(off):
            slot[off] += 1
            found[off] = self.at[slot[off]]
            off = off[(found[off] >= 0) & (self.keys[slot[off]] != prints[off])]
        return found


def piece_bytes(path: str) -> list[bytes]:
    """The bytes each id stands for; none for control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append(b"")
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


def byte_pieces(path: str) -> list[int]:
    """The id of each byte's piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def vocabulary(path: str, theta: float) -> dict[str, tuple[int, float]]:
    """Usable pieces with their ids and probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores: dict[str, tuple[int, float]] = {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        # a lone space has no rank of its own but must stay usable: it gets the last one
        rank = -model.get_score(i) if model.get_score(i) > -1e8 else float(size) if len(piece) == 1 else None
        if rank is not None:
            scores[piece] = (i, (rank + OFFSET) ** -theta)
    total = sum(p for _, p in scores.values())
    return {s: (i, p / total) for s, (i, p) in scores.items()}


class Lattices:
    """A piece model and the sampled lattices of the words met so far.

    A node is a place between two characters of a word; its edges are the pieces that
    end there, longest first, with cumulated probabilities given the node.
    """

    def __init__(self, path: str, theta: float):
        known = vocabulary(path, theta)
        self.byte_ids = byte_pieces(path)
        self.single = {s for s in known if len(s) == 1}
        # marks that no piece has right after a letter begin a part of their own
        joined = {b for s in known for a, b in zip(s, s[1:]) if a.isalpha()}
        marks = [c for c in string.punctuation if c not in joined]
        self.cut = re.compile(f"(?<=[^\\W\\d_])(?=[{re.escape(''.join(marks))}])").sub if marks else lambda _, t: t
        longer = {s[:k] for s in known for k in range(1, len(s))}
        names = sorted(longer | known.keys())
        data, offsets = utf8(pa.array(names, pa.large_string()))
        prints = Prefix(data).of(offsets[:-1], offsets[1:])
        order = np.argsort(prints)
        none = (-1, 1.0)
        self.lookup = Lookup(prints[order])
        self.ids = np.array([known.get(s, none)[0] for s in names], np.int32)[order]
        self.logs = np.log([known.get(s, none)[1] for s in names])[order]
        self.longer = np.array([s in longer for s in names])[order]
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}  # word to the node at its end
        self.first = Growing(np.int32)  # of a node: its first edge
        self.cumulated, self.before, self.piece = Growing(np.float32), Growing(np.int32), Growing(np.int32)

    def _bytes(self, data: bytes, node: int) -> int:
        """A chain of single edges, one for each byte; returns the last node."""
        for byte in data:
            self.first.add(np.array([len(self.piece)]))
            self.cumulated.add(np.array([2.0]))
            self.before.add(np.array([node]))
            self.piece.add(np.array([self.byte_ids[byte]]))
            node = len(self.first) - 1
        return node

    def _spans(self, texts: list[str], starts: np.ndarray) -> np.ndarray:
        """Nodes of texts whose characters all have pieces; returns the last node of each.

        ``starts`` are the nodes before the texts, -1 at the start of a word. All
        pieces at all characters are looked up by length; the forward filter then runs
        over all texts at once, one place after another.
        """
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        at = np.flatnonzero((data & 0xC0) != 0x80)
        text = np.searchsorted(offsets, at, side="right") - 1
        n = len(at)
        lengths = np.bincount(text, minlength=len(texts))
        last = np.cumsum(lengths)[text]  # one past the last character of its text
        place = np.arange(n) - (last - lengths[text])
        bound = np.append(at, len(data))
        prefix = Prefix(data)
        tails, heads, ids, logs = [], [], [], []
        live, size = np.arange(n), 1
        while len(live):
            prints = prefix.of(bound[live], bound[live + size])
            found = self.lookup.of(prints)
            known = found >= 0
            hit = known & (self.ids[found] >= 0)
            tails.append(live[hit])
            heads.append(live[hit] + size - 1)
            ids.append(self.ids[found[hit]])
            logs.append(self.logs[found[hit]])
            on = known & self.longer[found]
            size += 1
            live = live[on]
            live = live[live + size <= last[live]]
        tail, head, piece, log = (np.concatenate(x) for x in (tails, heads, ids, logs))
        # by place, then character, then longest first: the keys differ, so the order is fixed
        order = np.argsort((place[head] * n + head) * 64 + 63 - (head - tail))
        tail, head, piece, log = tail[order], head[order], piece[order], log[order]
        step = place[head]
        cuts = np.searchsorted(step, np.arange(int(step[-1]) + 2))
        alpha = np.zeros(n)
        weight = np.empty(len(head))
        begins = place[tail] == 0
        group = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        count = np.diff(np.append(group, len(head)))
        groups = np.searchsorted(group, cuts)
        for lo, hi, g0, g1 in zip(cuts[:-1].tolist(), cuts[1:].tolist(), groups[:-1].tolist(), groups[1:].tolist()):
            value = log[lo:hi] + np.where(begins[lo:hi], 0.0, alpha[tail[lo:hi] - 1])
            at_, many = group[g0:g1] - lo, count[g0:g1]
            top = np.maximum.reduceat(value, at_)
            share = np.exp(value - np.repeat(top, many))
            total = np.add.reduceat(share, at_)
            alpha[head[lo:hi][at_]] = top + np.log(total)
            weight[lo:hi] = share / np.repeat(total, many)
        run = np.cumsum(weight)
        run -= np.repeat(run[group] - weight[group], count)
        run[group + count - 1] = 2.0  # whatever rounding left over
        first = np.empty(n, np.int64)
        first[head[group]] = group
        base = len(self.first)
        self.first.add(first + len(self.piece))
        self.cumulated.add(run)
        self.before.add(np.where(place[tail] == 0, starts[text[tail]], base + tail - 1))
        self.piece.add(piece)
        return base + np.cumsum(lengths) - 1

    def learn(self, words: set[str]) -> None:
        """Add parts of texts. One that starts a line, or opens with ``GLUE``, has no space before
        it; characters without a piece are bytes."""
        plain: list[str] = []
        spans: list[str] = []
        starts: list[int] = []
        feed = self._bytes(b"\n", -1)
        single = self.single
        for word in words:
            line = word[:1] == "\n"
            glued = word[:1] == GLUE and word[1:2] != GLUE
            body = word[1:] if line or word[:1] == GLUE else word
            lead = "" if line or glued else MARK
            if single.issuperset(body) and MARK not in body:
                if line and not body:
                    self.words[word] = feed
                    continue
                plain.append(word)
                spans.append(lead + body)
                starts.append(feed if line else -1)
                continue
            node, run = feed if line else -1, lead
            for character in [*body, ""]:
                if character and character in single and character != MARK:
                    run += character
                    continue
                if run:
                    node = int(self._spans([run], np.array([node]))[0])
                    run = ""
                node = self._bytes(character.encode(), node)
            self.words[word] = node
        for at in range(0, len(spans), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            self.words.update(zip(plain[part], self._spans(spans[part], np.array(starts[part])).tolist()))

    def ends(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """End nodes of all words of all texts, and the number of words of each text."""
        if len(self.piece) > MOST_EDGES:
            self.reset()
        cut, glue = self.cut, " " + GLUE
        split: list[list[str]] = []
        for text in texts:
            if not text:
                split.append([])
            elif GLUE in text:  # the text's own: doubled at the start of a part
                split.append([GLUE + x if x[:1] == GLUE else x for x in text.replace("\n", " \n").split(" ")])
            else:
                split.append(cut(glue, text).replace("\n", " \n").split(" "))
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        self.learn(new - self.words.keys())
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.words.__getitem__
        nodes: list[int] = []
        for parts in split:
            nodes += map(get, parts)
        return np.array(nodes, np.int32), counts

    def sample(self, nodes: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts and the number of ids of each; one key for each text."""
        first, cumulated, before, piece = (x.view() for x in (self.first, self.cumulated, self.before, self.piece))
        total = len(nodes)
        place = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        with np.errstate(over="ignore"):
            state = mix64(np.repeat(keys, counts) + place.astype(_U64) * _U64(0x9E3779B97F4A7C15))
        active, at = np.arange(total), nodes.copy()
        sizes = np.zeros(total, np.int32)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0
        while len(active):
            with np.errstate(over="ignore"):
                u = uniform(mix64(state[active] + _U64(turn * 0xC2B2AE3D27D4EB4F % (1 << 64)))).astype(np.float32)
            edge = first[at].astype(np.int64)
            low = np.flatnonzero(cumulated[edge] <= u)
            while len(low):
                edge[low] += 1
                low = low[cumulated[edge[low]] <= u[low]]
            drawn.append((active, piece[edge]))
            sizes[active] += 1
            at = before[edge]
            on = at >= 0
            active, at = active[on], at[on]
            turn += 1
        last = np.cumsum(sizes, dtype=np.int64)
        ids = np.empty(int(last[-1]) if total else 0, np.int32)
        for step, (who, what) in enumerate(drawn):
            ids[last[who] - 1 - step] = what
        ends = np.concatenate([[0], np.cumsum(counts)])
        edges = np.concatenate([[0], last])[ends]
        return ids, np.diff(edges)


_LATTICES: dict[tuple[str, float], Lattices] = CACHES.setdefault("pieces", {})


def lattices(path: str, theta: float) -> Lattices:
    if (path, theta) not in _LATTICES:
        _LATTICES[path, theta] = Lattices(path, theta)
    return _LATTICES[path, theta]


# --- operators -----------------------------------------------------------------------


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", theta: float = THETA, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids[, carried columns]): one sampled segmentation of every text."""
    source = df.select(
        F.col(key).alias("key"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed"), F.col(text).cast("string").alias("text"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
    )
    kinds = [source.schema["key"].dataType.simpleString(), *[source.schema[f"c{i}"].dataType.simpleString() for i in range(len(carry))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the collector would walk the tables again and again
        for batch in slices(batches, "text", owner="pieces"):
            model = lattices(path, theta)
            column = batch.column("text")
            nodes, counts = model.ends([t or "" for t in column.to_pylist()])
            keys = mix64(batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(_U64))
            ids, sizes = model.sample(nodes, keys, counts)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            null = column.is_null()
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null.to_numpy(zero_copy_only=False), False)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), lists, *[batch.column(f"c{i}") for i in range(len(carry))]],
                names=["key", "ids", *[f"c{i}" for i in range(len(carry))]],
            )

    schema = f"key {kinds[0]}, ids array<int>" + "".join(f", c{i} {k}" for i, k in enumerate(kinds[1:]))
    out = source.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "ids", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, text[, carried columns]) of piece ids."""
    source = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = [source.schema["key"].dataType.simpleString(), *[source.schema[f"c{i}"].dataType.simpleString() for i in range(len(carry))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(path)
        size = np.array([len(p) for p in pieces], np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        table = np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            column = batch.column("ids")
            null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(lengths):
                base = ends[at] - lengths[at]
                stop = max(at + 1, int(np.searchsorted(ends, base + (1 << 18), side="right")))
                own = flat[base : ends[stop - 1]]
                width = size[own]
                run_ = np.concatenate([[0], np.cumsum(width)])
                data = table[np.arange(run_[-1]) + np.repeat(start[own] - run_[:-1], width)].tobytes()
                edges = run_[np.concatenate([[0], ends[at:stop] - base])].tolist()
                texts = [
                    None if n else data[a:b][1:] if data[a : a + 1] == b" " else data[a:b]
                    for a, b, n in zip(edges[:-1], edges[1:], null[at:stop])
                ]
                rest = [batch.column(c).slice(at, stop - at) for c in ("key", *[f"c{i}" for i in range(len(carry))])]
                yield pa.RecordBatch.from_arrays(
                    [rest[0], pa.array(texts, pa.binary()).cast(pa.string()), *rest[1:]],
                    names=["key", "text", *[f"c{i}" for i in range(len(carry))]],
                )
                at = stop

    schema = f"key {kinds[0]}, text string" + "".join(f", c{i} {k}" for i, k in enumerate(kinds[1:]))
    out = source.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def query(spark, folder: str) -> DataFrame:
    """One row for each document: number and digest of its pieces, and whether decoding gives it back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.md5("text").alias("print"))
    ids = encode(docs, path, carry=("print",)).select(
        "doc_id", "ids", "print", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash")
    )
    read = decode(ids, path, carry=("print", "n_pieces", "ids_hash"))
    return read.select("doc_id", "n_pieces", "ids_hash", F.md5("text").eqNullSafe(F.col("print")).alias("lossless"))
