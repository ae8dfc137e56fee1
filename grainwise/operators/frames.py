"""Small helpers for one-row aggregates and label dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inline_table(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """A constant table (labels, expectations). Arrow keeps it a LocalRelation, so
    Catalyst knows its size."""
    return spark.createDataFrame(pa.table(dict(columns)))


def long_form(
    one_row: DataFrame, values: Mapping[str, Column], name: str = "metric", value: str = "value"
) -> DataFrame:
    """One output row per named expression over an aggregate row."""
    cells = [F.struct(F.lit(label).alias(name), cell.alias(value)) for label, cell in values.items()]
    return one_row.select(F.inline(F.array(*cells)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Columns of several one-row results in one row.

    Each result is unioned with nulls for the others' columns and folded by one
    aggregate, which needs no product of relations.
    """
    names = [c for frame in one_row for c in frame.columns]
    padded = [
        frame.selectExpr(*[f"`{c}`" if c in frame.columns else f"NULL AS `{c}`" for c in names])
        for frame in one_row
    ]
    return reduce(lambda a, b: a.union(b), padded).selectExpr(*[f"max(`{c}`) AS `{c}`" for c in names])
