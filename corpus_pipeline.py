"""The corpus pipeline: five stages over ``documents``, each on what its predecessor kept.

1. language ID: documents without a letter, or in no language the model is sure of, go;
2. MinHash near-dedup: one document of each class of near-duplicates stays;
3. suffix-array dedup: strings of 400 bytes that start elsewhere too are cut out;
4. PII: validated numbers, dates, addresses and secrets become pseudonyms;
5. packing: what is left is tokenised and packed into windows.

Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows the text, and a
missing ``lang`` is filled in by stage 1. Null and empty texts are rejected by stage 1;
if no label can be learned from, it keeps every text with a letter.
A text that stage 3 empties stays as an empty document. Repeated rows are one
document from stage 2 on, rows without a doc_id stay. Columns beyond those of
``documents`` pass through stages 1 to 4 unread. An empty table stays empty.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from grainwise.llm import langid, neardup, packing, pii, suffixdedup
from grainwise.session import shared_folder

#: Executors still hold what earlier stages took, so workers get smaller groups and runs of texts and keep fewer words.
GROUPS, WORDS, RUN = 4, 250_000, 1 << 20
#: Rows that Spark hands a Python worker at once; both hold them, and its own 10,000 are all texts of a task here.
ROWS, ROWS_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Fewer rows a batch from now on, as Spark reads this setting when a stage's result is written."""
    set_now = int(spark.conf.get(ROWS_SETTING))
    if not 0 < set_now <= ROWS:
        spark.conf.set(ROWS_SETTING, ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.accepted(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffixdedup.without_repeats(docs, groups=GROUPS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.private_removed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), words=WORDS, run_bytes=RUN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("private_data", private_data),
    ("packing", pack),
]
#: Trained labels, sampled signatures and pseudonyms lie beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; every result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(ROWS_SETTING)
    try:
        for name, stage in STAGES:
            path = os.path.join(shared_folder(spark), "pipeline", f"{name}-{uuid.uuid4().hex}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(ROWS_SETTING, before)
    return docs
