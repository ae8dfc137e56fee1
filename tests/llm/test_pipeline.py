"""The pipeline's stages against brute force, one after the other."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.conftest import FOLDER
from tests.llm.test_neardup import grams
from tests.llm.test_packing import check
from tests.llm.test_suffixdedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Result of every stage over the whole small table."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df) -> dict[int, str]:
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "private_data", "packing"]
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_language_keeps_clean_documents(documents, steps):
    assert texts(steps[0]) == documents


def test_one_of_each_class_stays(steps):
    before, after = texts(steps[0]), texts(steps[1])
    sets = {i: grams(t) for i, t in before.items()}
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    kept = sorted(after)
    for n, a in enumerate(kept):
        assert all(len(sets[a] & sets[b]) < 0.83 * len(sets[a] | sets[b]) for b in kept[n + 1 :])
    for gone in set(before) - set(after):
        assert max(len(sets[gone] & sets[b]) / len(sets[gone] | sets[b]) for b in kept) > 0.75


def test_repeats_are_cut(steps):
    before, after = texts(steps[1]), {r.doc_id: r for r in steps[2].collect()}
    for (doc_id, text), (size, gone, _, _) in zip(before.items(), brute(list(before.values()))):
        left = len(after[doc_id].text.encode())
        assert size - gone <= left <= size - gone + 8 and after[doc_id].n_chars == len(after[doc_id].text)
        assert gone or after[doc_id].text == text


def test_packing_holds_all_that_is_left(spark, steps):
    check(steps[4].collect(), list(texts(steps[3]).items()))
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_edges_pass_through_every_stage(spark):
    long = " ".join(f"the{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "s", None, 1), (2, "", None, None, 0, 1), (3, "the and of to in is that it was for", None, "s", 35, None),
        (3, "the and of to in is that it was for", None, "s", 35, None), (None, "the words of a row that has no key at all", "en", "s", 41, 1), (5, long, "en", None, len(long), 2),
        (6, "1234 !!", "en", "s", 7, 1), (7, "der die das und nicht", "de", "s", 21, 1), (8, "write to ann.lee@example.org or 10.0.0.1 the and", "en", "s", 47, 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert path
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == [*COLUMNS, "class_id"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = {r.doc_id: r for r in docs.collect()}
    assert docs.count() == 5 and set(left) == {3, None, 5, 7, 8}
    assert left[3].lang in ("en", "de") and "ann.lee" not in left[8].text and "@example.org" in left[8].text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(left) and np.sum([r.length for r in packed]) > 30_000


def test_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect() == []


def test_workers_get_few_rows_at_a_time(spark):
    """A stage's texts come in batches of at most ROWS; the session has its own setting again after a run."""
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(corpus_pipeline.ROWS_SETTING)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "private_data":  # which has no Python
                spark.conf.set(corpus_pipeline.ROWS_SETTING, before)
                stage(spark, docs, FOLDER)
                sizes = [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(count, "n bigint").collect()]
                assert sum(sizes) == 5000 and max(sizes) <= 1000, name
        spark.conf.set(corpus_pipeline.ROWS_SETTING, "70")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(corpus_pipeline.ROWS_SETTING) == "70"
        spark.conf.set(corpus_pipeline.ROWS_SETTING, before)
        corpus_pipeline.run(spark, FOLDER)
        assert spark.conf.get(corpus_pipeline.ROWS_SETTING) == before
    finally:
        spark.conf.set(corpus_pipeline.ROWS_SETTING, before)
