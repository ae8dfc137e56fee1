"""BPE by backtracking: exact merges in time linear in the text, and decoding by an offset table.

A word is read as symbols (bytes, the last one marked as a word's end). An Aho-Corasick
automaton over all tokens gives the longest token at every place in one pass. The
encoder goes from left to right and takes the longest token that may follow the one
before it; if none may, it gives up the one before, marks the place as a dead end, and
tries that one's next shorter prefix. Places are given up at most once, so the work is
linear. Two neighbours are compatible if merging their joined text by rank gives just
these two: the later merge of the two sides is undone again and again, and no merge
across the border may come before the one undone. Answers are kept in a table of pairs.
The row of tokens found in this way is the one that merging by rank gives, since
neighbouring compatibility implies that of the whole row.

Normalisation, the pattern that cuts texts into words, and special tokens are those of
the tokenizer file. Texts are cut at ASCII spaces and line feeds first: no word, special
token or composition reaches across one. Ids of the parts are kept in a bounded cache.

Decoding looks up each id's text in one byte table by its offset, and joins tokens as
the file says: a file without a decoder puts one space between the tokens.

Defined cases: a null or empty text has no ids, and no ids decode to an empty text (null
ids to null); very long texts and words need no more than their own size; repeated rows
are encoded each on its own; a null key stays null; an empty table gives no rows;
further columns are dropped unless named in ``carry``, and cannot clash.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import CACHES, slices

_PARTS_MOST, _PAIRS_MOST, _PART_CHARS = 600_000, 1_000_000, 64
#: Word-end symbols are the characters of the byte alphabet, moved up by this much.
_END = 0x1000


def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Merges:
    """Tokens of a merge list: symbols, splits, and which tokens may be neighbours."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.suffix = bool(suffix)
        size = max(vocab.values()) + 1
        self.rank = [-1] * size  # -1: a symbol, not made by a merge
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            if self.rank[whole] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
            self.joined[vocab[a], vocab[b]] = whole
        self.text = [""] * size
        for token, i in sorted(vocab.items(), key=lambda x: self.rank[x[1]]):
            if self.rank[i] >= 0:
                self.text[i] = self.text[self.left[i]] + self.text[self.right[i]]
            elif len(token) == 1:
                self.text[i] = token
            elif suffix and token == token[0] + suffix:
                self.text[i] = chr(ord(token[0]) + _END)
        self.pairs: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= _PAIRS_MOST:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self._compatible(left, right, len(self.rank))
        return known

    def _compatible(self, left: int, right: int, before: int) -> bool:
        rank, joined = self.rank, self.joined
        while True:
            across = joined.get((left, right))
            if across is not None and rank[across] < before:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                # equal merges go from left to right, so an equal one on the border is later
                before = rank[left]
                left = self.right[left]
            else:
                before = rank[right] + 1
                right = self.left[right]

    def reachable(self) -> list[int]:
        """Tokens that merging their own text gives back; others never occur."""
        good = [bool(t) for t in self.text]
        for i in sorted(range(len(self.rank)), key=self.rank.__getitem__):
            if self.rank[i] >= 0:
                a, b = self.left[i], self.right[i]
                good[i] = good[a] and good[b] and self._compatible(a, b, self.rank[i])
        return [i for i, ok in enumerate(good) if ok]


class Backtracking:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = _model(path)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else lambda text: text
        self.cut = library.pre_tokenizer.pre_tokenize_str
        #: Whether ASCII letters are one word in lower case, which saves the way through the library.
        self.plain_letters = [w for w, _ in self.cut(self.normalize("aZ" * 26))] == ["az" * 26]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in spec.get("added_tokens", ())):
            raise ValueError("special tokens that look at what is around them are not supported")
        self.fill(Merges(spec["model"]))

    def fill(self, merges: Merges) -> None:
        """The automaton of the tokens in use, each one's next shorter prefix, and empty caches."""
        import ahocorasick

        self.merges = merges
        self.automaton = ahocorasick.Automaton()
        self.size = [len(t) for t in merges.text]
        by_text = {merges.text[i]: i for i in merges.reachable()}
        self.shorter = [-1] * len(self.size)
        for text, i in by_text.items():
            self.automaton.add_word(text, i)
            for end in range(len(text) - 1, 0, -1):
                if text[:end] in by_text:
                    self.shorter[i] = by_text[text[:end]]
                    break
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}

    def word(self, text: str) -> list[int]:
        """Ids of one word, given in the byte alphabet."""
        if self.merges.suffix:
            text = text[:-1] + chr(ord(text[-1]) + _END)
        size, shorter, compatible = self.size, self.shorter, self.merges.compatible
        longest = [-1] * len(text)
        for end, token in self.automaton.iter(text):
            longest[end + 1 - size[token]] = token  # later ends are longer
        dead = bytearray(len(text) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not ids or compatible(ids[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < len(text) else -1
            else:
                if not ids:
                    raise ValueError("a symbol is missing from the vocabulary")
                dead[at] = 1
                last = ids.pop()
                at -= size[last]
                token = shorter[last]
        return ids

    def _ids(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", self.word(word)).tobytes()
            if len(word) <= _PART_CHARS:
                self.words[word] = ids
        return ids

    def _plain(self, part: str) -> bytes:
        if self.plain_letters and part.isascii() and part.isalpha():
            return self._ids(part.lower())
        return b"".join(self._ids(word) for word, _ in self.cut(self.normalize(part)))

    def _part(self, part: str) -> bytes:
        """Ids of a text without ASCII spaces and line feeds; special tokens count first."""
        out, at = [], 0
        while at < len(part):
            found = min(((p, -len(s), s) for s in self.special if (p := part.find(s, at)) >= 0), default=None)
            if found is None:
                out.append(self._plain(part[at:]))
                break
            if found[0] > at:
                out.append(self._plain(part[at : found[0]]))
            out.append(array("I", [self.special[found[2]]]).tobytes())
            at = found[0] + len(found[2])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.parts) > _PARTS_MOST or len(self.words) > _PARTS_MOST:
            self.parts, self.words = {"": b""}, {}
        parts = text.replace("\n", " ").split(" ")
        known = self.parts
        for part in set(parts).difference(known):
            ids = self._part(part)
            if len(part) <= _PART_CHARS:
                known[part] = ids
            else:
                self.long[part] = ids
        if self.long:
            ids = b"".join([known[p] if p in known else self.long[p] for p in parts])
            self.long.clear()
            return ids
        return b"".join(map(known.__getitem__, parts))


_ENCODERS: dict[str, Backtracking] = CACHES.setdefault("bpe", {})


def encoder(path: str) -> Backtracking:
    """One for each Python worker, as its tables serve the worker's later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Backtracking(path)
    return _ENCODERS[path]


class Offsets:
    """All token texts in one byte table, found by offset."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = _model(path)
        decoder = spec.get("decoder")
        if decoder is not None and decoder["type"] != "ByteLevel":
            raise ValueError(f"decoder {decoder['type']} is not supported")
        library = Tokenizer.from_file(path)
        size = library.get_vocab_size(with_added_tokens=True)
        tokens = [library.id_to_token(i) or "" for i in range(size)]
        if decoder is None:
            texts = [t.encode() + b" " for t in tokens]
        else:
            byte = {c: b for b, c in byte_alphabet().items()}
            texts = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
        self.trail = decoder is None
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4")
        width = self.size[own]
        ends = np.cumsum(width)
        if not len(own):
            return b""
        data = self.table[np.arange(ends[-1]) + np.repeat(self.start[own] - ends + width, width)].tobytes()
        # byte-level ids may cut a character, whose bytes then read as U+FFFD
        return data[:-1] if self.trail else data.decode("utf-8", "replace").encode()


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: its own if printable, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}


# --- operators -----------------------------------------------------------------------


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids[, carried columns]); ``ids`` are little-endian unsigned 32-bit integers."""
    extra = [f"c{i}" for i in range(len(carry))]
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(x) for c, x in zip(carry, extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the collector would walk the tables again and again
        for batch in slices(batches, "text", owner="bpe"):
            model = encoder(path)
            ids = [model.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(ids, pa.binary()), *[batch.column(x) for x in extra]], names=["key", "ids", *extra]
            )

    kinds = "".join(f", {x} {source.schema[x].dataType.simpleString()}" for x in extra)
    out = source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, ids binary{kinds}")
    return out.select(F.col("key").alias(key), "ids", *[F.col(x).alias(c) for c, x in zip(carry, extra)])


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, text[, carried columns]) of ids as ``encode`` returns them."""
    extra = [f"c{i}" for i in range(len(carry))]
    source = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"), *[F.col(c).alias(x) for c, x in zip(carry, extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Offsets(path)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            texts = [None if x is None else table.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(texts, pa.binary()).cast(pa.string()), *[batch.column(x) for x in extra]],
                names=["key", "text", *extra],
            )

    kinds = "".join(f", {x} {source.schema[x].dataType.simpleString()}" for x in extra)
    out = source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, text string{kinds}")
    return out.select(F.col("key").alias(key), "text", *[F.col(x).alias(c) for c, x in zip(carry, extra)])


def query(spark, folder: str) -> DataFrame:
    """One row for each document: number of ids, and digests of the ids and of the decoded text."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = encode(spark.read.parquet(f"{folder}/documents.parquet"), path).select(
        "doc_id", "ids", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )
    read = decode(ids, path, carry=("n_tokens", "ids_sha256"))
    return read.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
