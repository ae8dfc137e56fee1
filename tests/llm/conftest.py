"""Helpers of the operator tests."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents() -> dict[int, str]:
    table = pq.read_table(glob.glob(f"{FOLDER}/documents.parquet")[0], columns=["doc_id", "text"])
    return dict(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))


@pytest.fixture
def frame(spark):
    """Documents with nulls, empty and long texts, repeated rows and a clashing column."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint, key string"):
        return spark.createDataFrame(rows, schema)

    return make
