"""Language ID: a linear-chain conditional random field over the words of a text.

Each word has affix, byte n-gram and lexicon features; a transition matrix is learned
with them, and forward-backward gives every word's posterior, so a text that switches
languages is labelled word by word. A text's language is the one with the largest
mean posterior over its words, which is also the score.

Training takes the text and language of at most about ``PER_LANGUAGE`` texts of each
language (picked by a hash of the key from the training folds). Transitions are
learned from sequences that splice spans of different texts. Prediction reads text
alone.

Chains are cut into runs of ``RUN`` words. The product of the transition matrices of
each run is formed first, messages then pass from run to run, and last from word to
word; this is exact and bounds the number of steps for long texts.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, or if
nothing could be learned; of equal posteriors the first language in order wins;
repeated rows get equal results; an empty table gives no rows; the output takes the
key and named columns only, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm.common import fold_of, mix64, Prefix, slices, stored, utf8, words

PER_LANGUAGE, BROADCAST_LANGUAGES = 300, 100_000
BUCKETS, LEXICON, RUN = 1 << 17, 4_000, 64
NONE = "und"
_U64 = np.uint64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


# --- features ------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Features of distinct words: padded n-gram buckets by row, affix buckets, fingerprints."""

    prints: np.ndarray
    grams: np.ndarray
    counts: np.ndarray
    affixes: np.ndarray  # word x 6, -1 where the word is too short


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(x + _U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U64(47)).astype(np.int64)


def word_features(data: np.ndarray, prefix: Prefix, start: np.ndarray, end: np.ndarray) -> Vocabulary:
    """Features of words given by byte ranges of lower-cased text."""
    size = end - start
    padded = size + 2
    at = np.concatenate([[0], np.cumsum(padded)])
    buffer = np.zeros(int(at[-1]), np.uint64)
    buffer[at[:-1]], buffer[at[1:] - 1] = 1, 2
    inside = np.ones(len(buffer), dtype=bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    source = np.arange(int(size.sum())) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    buffer[inside] = data[source]
    whole = np.ones(len(buffer), dtype=bool)
    whole[at[1:] - 1] = whole[at[1:] - 2] = False
    p = np.flatnonzero(whole)
    grams = _bucket(buffer[p] | buffer[p + 1] << _U64(8) | buffer[p + 2] << _U64(16), 1)
    affixes = np.full((len(start), 6), -1, np.int64)
    for k in (1, 2, 3):
        fits = size >= k
        affixes[fits, k - 1] = _bucket(prefix.of(start[fits], start[fits] + k), 1 + k)
        affixes[fits, k + 2] = _bucket(prefix.of(end[fits] - k, end[fits]), 4 + k)
    return Vocabulary(prefix.of(start, end), grams, size, affixes)


def cores(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without marks and digits at either end; empty if a word has no letter."""
    letter = np.concatenate([[0], np.flatnonzero(_LETTER[data]), [len(data)]])
    right = np.searchsorted(letter[1:-1], start, side="left") + 1
    left = np.searchsorted(letter[1:-1], end, side="left")
    first, last = letter[right], letter[left] + 1
    empty = (right > left) | (first >= end)
    return np.where(empty, start, first), np.where(empty, start, last)


# --- model ---------------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    lexicon: np.ndarray  # sorted fingerprints
    lexicon_weights: np.ndarray
    transition: np.ndarray  # log potentials

    def emissions(self, v: Vocabulary) -> np.ndarray:
        if not len(v.prints):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.zeros((len(v.prints), len(self.languages)), np.float32)
        held = v.counts > 0
        if held.any():
            starts = np.concatenate([[0], np.cumsum(v.counts[held])[:-1]])
            out[held] = np.add.reduceat(self.weights[v.grams], starts, axis=0)
        for k in range(6):
            fits = v.affixes[:, k] >= 0
            out[fits] += self.weights[v.affixes[fits, k]]
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, v.prints), len(self.lexicon) - 1)
            known = (self.lexicon[at] == v.prints) & held
            out[known] += self.lexicon_weights[at[known]]
        return out


def marginals(emit: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word of chains of the given lengths, and expected transition counts."""
    n, c = emit.shape
    if not n:
        return np.zeros((0, c)), np.zeros((c, c))
    step = np.exp(transition - transition.max()).astype(np.float64)
    psi = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    runs = -(-lengths // RUN)
    total = int(runs.sum())
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    row, col = first_run[doc] + offset // RUN, offset % RUN
    grid = np.ones((RUN, total, c))
    grid[col, row] = psi
    held = np.zeros((RUN, total), dtype=bool)
    held[col, row] = True
    product = np.broadcast_to(np.eye(c), (total, c, c)).copy()
    for t in range(RUN):
        live = held[t]
        if live.all():
            product = (product @ step) * grid[t][:, None, :]
            product /= product.sum(axis=(1, 2), keepdims=True)
        elif live.any():
            moved = (product[live] @ step) * grid[t][live][:, None, :]
            product[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
    before, after = np.full((total, c), 1.0 / c), np.ones((total, c))
    order = np.argsort(-runs, kind="stable")
    depth = int(runs.max())
    counts = np.searchsorted(-runs[order], -np.arange(1, depth + 1), side="right")
    for k in range(1, depth):
        at = first_run[order[: counts[k]]] + k
        x = np.einsum("si,sij->sj", before[at - 1], product[at - 1])
        before[at] = x / x.sum(axis=1, keepdims=True)
    for k in range(depth - 1, 0, -1):
        at = first_run[order[: counts[k]]] + k
        x = np.einsum("sij,sj->si", product[at], after[at])
        after[at - 1] = x / x.sum(axis=1, keepdims=True)
    forward = np.empty((RUN, total, c))
    a = before
    for t in range(RUN):
        x = (a @ step) * grid[t]
        a = np.where(held[t][:, None], x / x.sum(axis=1, keepdims=True), a)
        forward[t] = a
    post = np.empty((RUN, total, c))
    pairs = np.zeros((c, c))
    b = after
    for t in range(RUN - 1, -1, -1):
        x = forward[t] * b
        post[t] = x / x.sum(axis=1, keepdims=True)
        prior = forward[t - 1] if t else before
        right = grid[t] * b
        z = np.einsum("si,ij,sj->s", prior, step, right)
        live = held[t]
        pairs += step * ((prior[live] / z[live, None]).T @ right[live])
        x = right @ step.T
        b = np.where(live[:, None], x / x.sum(axis=1, keepdims=True), b)
    return post[col, row], pairs


# --- training ------------------------------------------------------------------------


def train(texts: list[str], languages: list[str], epochs: int = 3, span: tuple[int, int] = (6, 60), seed: int = 11) -> Model:
    """Fit by AdaGrad on spliced sequences of labelled words."""
    names = sorted(set(languages))
    c = len(names)
    data, offsets = utf8(pa.array([t.lower() for t in texts], pa.large_string()))
    start, end, row = words(data, offsets)
    start, end = cores(data, start, end)
    kept = end > start
    start, end, row = start[kept], end[kept], row[kept]
    label = np.array([names.index(x) for x in languages], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    prefix = Prefix(data)
    prints = prefix.of(start, end)
    _, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
    v = word_features(data, prefix, start[first], end[first])
    lexicon = np.zeros(0, _U64)
    for k in range(c):
        often = np.bincount(inverse[label == k], minlength=len(first))
        best = np.argsort(-often, kind="stable")[:LEXICON]
        lexicon = np.union1d(lexicon, v.prints[best[often[best] >= 3]])
    model = Model(names, np.zeros((BUCKETS, c), np.float32), lexicon, np.zeros((len(lexicon), c), np.float32), np.zeros((c, c)))
    if c < 2 or not len(row):
        return model
    row_start = np.concatenate([[0], np.cumsum(v.counts)[:-1]])
    at = np.minimum(np.searchsorted(lexicon, v.prints), max(len(lexicon) - 1, 0))
    lex = np.where(lexicon[at] == v.prints, at, -1) if len(lexicon) else np.full(len(v.prints), -1)
    seen, seen_lex, seen_step = np.full((BUCKETS, c), 1e-6), np.full((len(lexicon), c), 1e-6), np.full((c, c), 1e-6)
    rng = np.random.default_rng(seed)
    groups = [np.flatnonzero(label == k) for k in range(c)]
    cuts = []
    for g in groups:
        at_, pieces = 0, []
        while at_ < len(g):
            n = int(rng.integers(*span))
            pieces.append(g[at_ : at_ + n])
            at_ += n
        cuts.append(pieces)
    spans = [s for pieces in cuts for s in pieces]
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for lo in range(0, len(order), 240):
            chosen = [spans[i] for i in order[lo : lo + 240]]
            tokens = np.concatenate(chosen)
            lengths = np.array([sum(len(s) for s in chosen[i : i + 3]) for i in range(0, len(chosen), 3)])
            vocab, back = np.unique(inverse[tokens], return_inverse=True)
            counts = v.counts[vocab]
            grams = v.grams[np.arange(int(counts.sum())) + np.repeat(row_start[vocab] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)]
            sub = Vocabulary(v.prints[vocab], grams, counts, v.affixes[vocab])
            post, pairs = marginals(model.emissions(sub)[back], model.transition, lengths)
            gold = np.zeros_like(post)
            gold[np.arange(len(tokens)), label[tokens]] = 1
            per_word = np.stack([np.bincount(back, (gold - post)[:, k], len(vocab)) for k in range(c)], axis=1)
            rows = np.concatenate([grams, *[sub.affixes[sub.affixes[:, k] >= 0, k] for k in range(6)]])
            grads = np.concatenate([np.repeat(per_word, counts, axis=0), *[per_word[sub.affixes[:, k] >= 0] for k in range(6)]])
            g = np.stack([np.bincount(rows, grads[:, k], BUCKETS) for k in range(c)], axis=1)
            touched = np.flatnonzero(np.abs(g).sum(axis=1))
            seen[touched] += g[touched] ** 2
            model.weights[touched] += (0.15 * g[touched] / np.sqrt(seen[touched])).astype(np.float32)
            known = lex[vocab] >= 0
            model.lexicon_weights *= 0.999
            at_lex = lex[vocab][known]
            seen_lex[at_lex] += per_word[known] ** 2
            model.lexicon_weights[at_lex] += (0.3 * per_word[known] / np.sqrt(seen_lex[at_lex])).astype(np.float32)
            same = np.ones(len(tokens), dtype=bool)
            same[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
            true = np.zeros((c, c))
            np.add.at(true, (label[tokens][np.flatnonzero(same) - 1], label[tokens][same]), 1)
            step = true - pairs
            seen_step += step**2
            model.transition += 0.1 * step / np.sqrt(seen_step)
    return model


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``per_language`` rows of each language."""
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(fold_of(F.col("doc_id")) != 1)
    share = F.least(F.lit(1.0), per_language / F.count("*"))
    bounds = stored(labelled.groupBy("lang").agg((share * (1 << 30)).cast("bigint").alias("bound")), "languages")  # one row each
    # beside few languages the texts need not be shuffled
    near = F.broadcast(bounds) if bounds.count() <= BROADCAST_LANGUAGES else bounds
    picked = labelled.join(near, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("bound"))
    rows = sorted((r["lang"], r["text"]) for r in picked.select("lang", "text").collect())
    return [r[1] for r in rows], [r[0] for r in rows]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    return train(*training_sample(docs.select("doc_id", "text", "lang"), per_language))


# --- prediction ----------------------------------------------------------------------


def posteriors(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, posterior) of every word with a letter; words before stripping keep their order."""
    texts = [t.lower() if t else "" for t in column.to_pylist()]
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    start, end, row = words(data, offsets)
    start, end = cores(data, start, end)
    kept = end > start
    start, end, row = start[kept], end[kept], row[kept]
    prefix = Prefix(data)
    _, first, inverse = np.unique(prefix.of(start, end), return_index=True, return_inverse=True)
    emit = model.emissions(word_features(data, prefix, start[first], end[first]))[inverse]
    lengths = np.bincount(row, minlength=len(texts))
    post, _ = marginals(emit, model.transition, lengths[lengths > 0])
    return row, post, kept, len(texts)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", label_words: bool = False) -> DataFrame:
    """(key, lang_pred, score[, word_langs]); ``word_langs`` has a label for each word that holds a letter."""
    inner = text.removeprefix(f"{key}.") if text.startswith(f"{key}.") else None  # the text is a field of the key
    source = docs.select(F.col(key).alias("key"), *([] if inner else [F.col(text).cast("string").alias("text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS, LEXICON and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, NONE], dtype=object)
        for batch in slices(batches, inner or "text", 1 << 20, "key" if inner else None):
            column = batch.column("key").field(inner) if inner else batch.column("text")
            n = len(column)
            best, score = np.full(n, len(m.languages)), np.zeros(n)
            labels = [[] for _ in range(n)]
            if m.languages:
                row, post, _, _ = posteriors(column, m)
                lengths = np.bincount(row, minlength=n)
                sums = np.stack([np.bincount(row, post[:, k], n) for k in range(post.shape[1])], axis=1)
                some = lengths > 0
                plain = [t is not None and (t.isascii() or any(map(str.isalpha, t))) for t in column.to_pylist()]
                some &= np.array(plain, dtype=bool)
                best[some] = sums[some].argmax(axis=1)
                score[some] = np.clip(sums[some].max(axis=1) / lengths[some], 0.0, 1.0)
                if label_words:
                    words_of = names[post.argmax(axis=1)] if len(post) else np.zeros(0, object)
                    ends = np.cumsum(lengths)
                    labels = [list(words_of[e - k : e]) for e, k in zip(ends, lengths)]
            out = [batch.column("key"), pa.array(list(names[best]), pa.string()), pa.array(score, pa.float64())]
            fields = ["key", "lang_pred", "score"]
            if label_words:
                out.append(pa.array(labels, pa.list_(pa.string())))
                fields.append("word_langs")
            yield pa.RecordBatch.from_arrays(out, names=fields)

    schema = T.StructType([source.schema["key"]]).add("lang_pred", "string").add("score", "double")
    if label_words:
        schema = schema.add("word_langs", T.ArrayType(T.StringType()))
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Whole rows whose language is known with a score of at least ``least``; a missing ``lang`` is filled in.

    If no language could be learned, rows with a letter stay and ``lang`` is left as it is.
    """
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = predict(docs.select(F.struct("*").alias("row")), model, key="row", text="row.text").filter((F.col("lang_pred") != NONE) & (F.col("score") >= least))
    return kept.select(
        *[(F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, learn(docs)).select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score"
    )
