"""Spelling variants: words one edit apart, found by asymmetric chunks.

``near`` joins words whose forms differ by one inserted, deleted or replaced code point.
The shorter word of a pair (of equal ones the smaller) contributes two disjoint chunks,
its halves; the other one contributes its positional grams of the lengths of such chunks.
One edit leaves one of the two chunks whole, shifted by the difference in length at most,
so the join asks for an equal gram within a shift of one; of those, only the shift that the
two lengths leave is emitted, which is none for the first half. What meets is verified.

A chunk that many words share (a common beginning, say) would make all pairs of them meet.
Such chunks are not joined: the half that holds the edit is cut into two disjoint chunks
again, one of which is whole, and the next join asks for the known half and this chunk. So
it goes on until few words meet (``most``) or one code point is left, where words that
meet are equal but for it. Each pair is emitted once, however many words share a chunk,
and nothing is left out.

``forms`` picks for each word its commonest near word if that is ``ratio`` times as common,
and follows forms to the last by pointer doubling. Forms grow at least by that ratio, so
there are no rings and the number of turns is the logarithm of a logarithm.

Defined cases: null and empty texts have no words, a very long run is one word; a null key
is perturbed as an empty one; repeated rows each count; ties between near words go to the
smallest in code-point order; an empty table gives no rows; further columns of the
documents are not read, so none can clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import slices, stored

MOST, RATIO, LEAST_LETTERS, LEAST_COUNT, EVERY = 24, 5, 6, 5, 199
_HELD_MOST = 400_000

# --- words ---------------------------------------------------------------------------

#: Bytes of Latin-1: letters stay, A to Z in lower case; all else separates.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256)
)


def word_counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
    every: int = EVERY,
) -> DataFrame:
    """(word, n): runs of letters A to Z and U+00C0 to U+00FF in lower case of A to Z, and how often each occurs.

    A run whose crc32 of `<key>:<run>` is divisible by ``every`` loses the code point at
    crc32 modulo its length. Runs are counted inside a task, at most ``_HELD_MOST`` words at
    a time, before they are shuffled.
    """
    source = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text"):
            for name, whole in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if not whole:
                    continue
                begun = zlib.crc32(f"{name}:".encode())
                # one byte for each code point; a code point beyond Latin-1 separates
                words = whole.encode("latin-1", "replace").translate(_LETTERS).split()
                plain = Counter(words)
                for word, n in plain.items():
                    if len(word) < least_letters:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_letters:
                            continue
                    held[word] += n
                if len(held) >= _HELD_MOST:
                    yield flush()
        if held:
            yield flush()

    counted = source.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- pairs ---------------------------------------------------------------------------


def _halves(frame: DataFrame, length: Column) -> DataFrame:
    """The two ways on: the edit in the first or the second half of [a, b) of the shorter word.

    ``length`` is that of the shorter word; the longer one counts what follows the edit
    from its end, which is the shift its length leaves.
    """
    middle = F.expr("(a + b) div 2")
    ways = F.array(
        F.struct(F.col("a").alias("a"), middle.alias("b")),
        F.struct(middle.alias("a"), F.col("b").alias("b")),
    )
    cut = frame.withColumn("way", F.explode(ways))
    return cut.withColumns({"a": F.col("way.a"), "b": F.col("way.b")}).drop("way").withColumn(
        "chunk",
        F.concat_ws(
            "\u0001", length.cast("string"), F.col("a").cast("string"), F.col("b").cast("string"),
            F.expr("substring(word, 1, a)"), F.substring("word", F.length("word") - (length - F.col("b")) + 1, length - F.col("b")),
        ),
    )


def near(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near): each pair of distinct words one edit apart, in both directions.

    ``words`` has distinct non-null values of ``word``.
    """
    words = words.select("word")
    size = F.length("word")
    span = words.withColumns({"a": F.lit(0), "b": size})
    chunks = _halves(span, size)
    grams = _halves(
        words.withColumn("short", F.explode(F.array(size - 1, size))).where("short > 0").withColumns({"a": F.lit(0), "b": F.col("short")}),
        F.col("short"),
    )
    found: list[DataFrame] = []
    while True:
        chunks, grams = stored(chunks, "chunks"), stored(grams, "grams")
        shared = (
            chunks.groupBy("chunk", "a", "b").agg(F.count("*").alias("x")).join(grams.groupBy("chunk").agg(F.count("*").alias("y")), "chunk")
        )
        common = stored(shared.where((F.col("x") > 1) & (F.col("y") > most) & (F.col("b") - F.col("a") > 1)).select("chunk"), "common")
        left = chunks.join(common, "chunk", "left_anti").select("chunk", "word")
        right = grams.join(common, "chunk", "left_anti").select("chunk", F.col("word").alias("near"))
        found.append(stored(_met(left.join(right, "chunk")), "pairs"))
        if common.isEmpty():
            break
        chunks = _halves(chunks.join(common, "chunk", "left_semi").drop("chunk"), F.length("word"))
        grams = _halves(grams.join(common, "chunk", "left_semi").drop("chunk"), F.col("short"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct()
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _met(candidates: DataFrame) -> DataFrame:
    """What is one edit apart; of equally long words each pair once."""
    ordered = (F.length("word") < F.length("near")) | (F.col("word") < F.col("near"))
    return candidates.where(ordered).where(F.levenshtein("word", "near", 1) == 1).select("word", "near")


# --- forms ---------------------------------------------------------------------------


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of ``words`` (word, n) and their near words."""
    counted = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    chosen = (
        pairs.join(counted, "near").groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("top"))
    )
    enough = -F.col("top.less") >= ratio * F.col("n")
    return words.join(chosen, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("top.form")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last one on their way."""
    linked = stored(formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not linked.where("moved").isEmpty():
        further = linked.select(F.col("word").alias("root"), F.col("root").alias("last"))
        linked = stored(
            linked.join(further, "root", "left")
            .select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")),
            "roots",
        )
    return linked.select("word", "root")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, ratio: int = RATIO, **options: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts; ``options`` are those of ``word_counts``."""
    words = stored(word_counts(df, key, text, **options), "words")
    formed = stored(forms(words, near(words, most), ratio), "forms")
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def query(spark, folder: str) -> DataFrame:
    """One row for each word of at least six code points and five occurrences."""
    return variants(spark.read.parquet(f"{folder}/documents.parquet"))
