"""Quality rules: a decision list learned by sequential covering, applied as Spark expressions.

Every text is reduced to counts by built-in functions. From labelled documents an
ordered list of conjunctions of thresholds is learned: a conjunction is grown by
FOIL gain on two thirds of the labelled rows and pruned on the last third; rows it
covers are set aside and the next one is grown, until a conjunction is no longer
more often right than wrong. The list becomes one ordered ``CASE`` expression.

Learning uses a sample of labelled rows of at most about ``TRAIN_ROWS`` (chosen by a
hash of the key); the counts of those rows, never their texts, reach the driver.
Verdicts are evaluated over all rows.

Defined cases: a null text has no words and fails the base rule; a document without
labels takes part in nothing but the verdict; labels that are null or contradict
each other are left out; without usable labels the list is empty and keeps what the
base rule passes; repeated rows are judged alike, each on its own; an empty table
gives no rows. Further columns are dropped, so none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "letter_share", "line_words", "distinct_share",
)


# --- statistics ----------------------------------------------------------------------


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _windows(words: Column) -> Column:
    """64-bit fingerprints of all 3-word windows; null for shorter texts."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    )


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of ``BASE`` and what ``FEATURES`` need; all are functions of the text alone."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.withColumn("_windows", _windows(F.col("_words"))).withColumn("_lines", lines)
    # windows that occur twice are neighbours once sorted; their places are then put in order
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.array(ordered),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.flatten(F.transform(twice, lambda p: F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    # most texts repeat no window, which one hash set tells
    repeated = F.when(
        F.col("_windows").isNull() | (F.size("_windows") == F.size(F.array_distinct("_windows"))), F.lit(0).cast("bigint")
    ).otherwise(covered)
    chars = _without(body, SPACES)
    return df.select(
        *[c for c in df.columns if c not in ("_words", "_windows", "_lines")],
        F.size("_words").cast("bigint").alias("n_words"),
        chars.cast("bigint").alias("word_chars"),
        (F.length(body) - _without(body, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("bigint").alias("n_distinct"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        (F.length(body) - _without(body, "0123456789")).cast("bigint").alias("n_digits"),
        (F.length(body) - _without(body, "!?;:.,")).cast("bigint").alias("n_marks"),
        F.length(F.regexp_replace(body, r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
    )


def features() -> dict[str, Column]:
    """Shares and means of the counts."""
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "n_letters"),
        "digit_share": per("n_digits", "word_chars"),
        "mark_share": per("n_marks", "word_chars"),
        "letter_share": per("n_letters", "word_chars"),
        "line_words": per("n_words", "n_lines"),
        "distinct_share": per("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# --- learning ------------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.bound if self.above else x < self.bound

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.bound) if self.above else x < F.lit(self.bound)


Rule = tuple[Test, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, dtype=bool)
    for test in rule:
        held &= test.holds(table)
    return held


def _best_test(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Test | None]:
    """The test of the largest FOIL gain among all thresholds between neighbouring values."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0 or not n0:
        return 0.0, None
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Test | None] = (1e-9, None)
    for name, x in table.items():
        order = np.argsort(x[inside], kind="stable")
        values, hit = x[inside][order], bad[inside][order]
        edges = np.flatnonzero(values[1:] > values[:-1]) + 1
        if not len(edges):
            continue
        p_below = np.cumsum(hit)[edges - 1].astype(float)
        n_below = edges - p_below
        for above, p, n in ((False, p_below, n_below), (True, p0 - p_below, n0 - n_below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                bound = float((values[edges[k] - 1] + values[edges[k]]) / 2)
                best = (float(gain[k]), Test(name, above, bound))
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, most: int = 24, least: int = 3) -> list[Rule]:
    """Ordered conjunctions that reject; a row no conjunction covers is kept."""
    n = len(bad)
    part = np.random.default_rng(seed).permutation(n) % 3
    left = np.ones(n, dtype=bool)
    rules: list[Rule] = []
    while len(rules) < most:
        grow, prune = left & (part != 0), left & (part == 0)
        if bad[grow].sum() < least:
            break
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < 5:
            _, test = _best_test(table, bad, inside)
            if test is None:
                break
            rule += (test,)
            inside &= test.holds(table)
        if not rule:
            break

        def worth(r: Rule) -> float:
            held = prune & _covers(r, table, n)
            p, m = bad[held].sum(), (~bad[held]).sum()
            return (p - m) / (p + m) if p + m else -1.0

        cuts = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(cuts, key=worth)  # of equals the longer, which rejects less
        held = left & _covers(rule, table, n)
        right = int(bad[held].sum())
        if worth(rule) <= 0 or right < least or 2 * right <= held.sum():
            break
        rules.append(rule)
        left &= ~held
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and labels of about ``most`` labelled rows, or of all if there are fewer."""
    clean = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    )
    total = clean.count()
    share = min(1.0, most / total) if total else 1.0
    picked = clean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    # at most about TRAIN_ROWS keys of 8 bytes, whatever the size of the tables
    joined = docs.join(F.broadcast(picked.select("doc_id", F.col("low").alias("quality"))), "doc_id")
    rows = text_counts(joined.select("quality", "text")).select("quality", *[c.alias(n) for n, c in features().items()]).collect()
    rows.sort()
    data = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(FEATURES) + 1)
    return {n: data[:, i + 1] for i, n in enumerate(FEATURES)}, data[:, 0] == 0


def rule_expression(rules: list[Rule]) -> Column:
    """1-based number of the first rule that holds, null if none does."""
    case = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        case = F.when(condition, F.lit(number)).otherwise(case)
    return case


def judge(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, counts, base_failed, kept, rule) of every document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rules = learn(*labelled_sample(docs, labels.select("doc_id", "quality"), most))
    counts = text_counts(docs).drop("text")
    return counts.withColumn("base_failed", base_failed()).withColumn("rule", rule_expression(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return judge(docs, labels).select("doc_id", *BASE, "base_failed", "kept", "rule")
