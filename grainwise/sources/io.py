"""CSV, Parquet and text endpoints."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from grainwise.functions.temporal import parse_timestamp
from grainwise.sources.schemas import MARKETPLACE

# Quoted fields may hold line breaks and doubled quotes.
_CSV_FORMAT = {"header": "true", "quote": '"', "escape": '"'}
_CSV_WRITE = {
    **_CSV_FORMAT,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_CSV_READ = {**_CSV_FORMAT, "multiLine": "true", "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and quoted line breaks; unreadable timestamps become null.

    Timestamps are read as text and parsed afterwards, so a bad value nulls one
    field and leaves the rest of the row alone. Files with quoted line breaks
    cannot be split, so land them as Parquet once and query that.
    """
    as_text = StructType(
        [
            StructField(f.name, StringType() if isinstance(f.dataType, TimestampNTZType) else f.dataType)
            for f in schema.fields
        ]
    )
    raw = spark.read.schema(as_text).options(**_CSV_READ).csv(path)
    return raw.select(
        *[
            parse_timestamp(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, TimestampNTZType)
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for aggregates of a few rows."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**_CSV_WRITE).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet. With ``partition_by`` the rows are rebalanced on those columns first, so
    each value lands in a few well-sized files and a hot value is split over tasks."""
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    balanced = df.hint("rebalance", *[F.col(c) for c in partition_by])
    balanced.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_labelling_text(sample: DataFrame, path: str) -> None:
    """``idx<TAB>text`` per line, written by the executors."""
    lines = sample.select(F.concat_ws("\t", F.col("idx").cast("string"), F.col("text")).alias("value"))
    lines.write.mode("overwrite").text(path)


def land_marketplace(
    spark: SparkSession, raw_dir: str, landed_dir: str, files: Mapping[str, str] | None = None
) -> None:
    """Read the nine CSV tables and store them as Parquet. ``files`` maps table to file name."""
    for name, schema in MARKETPLACE.items():
        source = os.path.join(raw_dir, (files or {}).get(name, f"{name}.csv"))
        write_table(read_csv(spark, source, schema), os.path.join(landed_dir, name))


def load_marketplace(spark: SparkSession, landed_dir: str) -> dict[str, DataFrame]:
    """The landed tables as lazy Parquet scans with their declared schemas."""
    return {
        name: spark.read.schema(schema).parquet(os.path.join(landed_dir, name))
        for name, schema in MARKETPLACE.items()
    }


def land_bucketed(tables: Mapping[str, tuple[DataFrame, str]], folder: str, buckets: int) -> dict[str, DataFrame]:
    """Tables hashed on their keys into the same number of sorted buckets, one file each.

    Aggregates and joins on the key then need no exchange, since equal keys of all tables
    lie in buckets of one number. Paid once when landing, saved by every later query.
    """
    out = {}
    for name, (df, key) in tables.items():
        stored_as = f"{name}_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", os.path.join(folder, stored_as))
        writer.saveAsTable(stored_as, format="parquet")
        out[name] = df.sparkSession.table(stored_as)
    return out


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Expose tables to ``spark.sql`` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
