"""Loads that keep arriving: checked writes, and integrity counts carried from load to load."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from grainwise.functions.classify import first_match
from grainwise.operators.grain import cogroup_counts
from grainwise.session import landed

ACCEPTED = "accepted"


def checked_write(df: DataFrame, rules: Mapping[str, Column], path: str, most_refused: float = 1.0) -> tuple[DataFrame, dict[str, int]]:
    """Write rows with the first rule they break as ``outcome``, and count while writing.

    The rows are read once: the counts are metrics observed on the write itself. Accepted
    rows and the rows that each rule refused are folders of their own, so either is read
    without the other. A rule that is null for a row refuses it. Raises after the write,
    with the refused rows in place to be looked at, if more than ``most_refused`` of all
    rows broke a rule.
    """
    outcome = first_match([(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()], ACCEPTED)
    seen = Observation()
    marked = df.withColumn("outcome", outcome)
    counts = [F.count_if(F.col("outcome") == name).alias(name) for name in (ACCEPTED, *rules)]
    marked.observe(seen, F.count("*").alias("rows"), *counts).write.partitionBy("outcome").parquet(path)
    found = {name: int(n) for name, n in seen.get.items()}
    if found["rows"] - found[ACCEPTED] > most_refused * found["rows"]:
        raise ValueError(f"too many rows refused: {found}")
    return df.sparkSession.read.schema(marked.schema).parquet(path), found


# --- integrity carried from load to load -----------------------------------------------------


def _state(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """Counts of every key as of its last load; None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(schema).parquet(folder)


def integrity_load(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str, folder: str, load: int) -> DataFrame:
    """Take in one load of both tables; returns (load, touched, orphans_change, childless_change).

    ``folder`` keeps, for each load, the counts that its keys have after it. Only keys of
    the load are looked up there: their range is pushed to the files, which are sorted by
    key, and a semi-join picks them. Orphans and childless parents change by what the
    touched keys contribute after the load less what they did before, so the counts of all
    loads add up to those of a full recount. A null key never matches.

    A load is written before it is reported; one that failed may be repeated under its number.
    """
    spark = parents.sparkSession
    delta = landed(
        cogroup_counts(
            "_k", {"parent": (parents.select(F.col(parent_key).alias("_k")), {}), "child": (children.select(F.col(child_key).alias("_k")), {})}
        ),
        "integrity_delta",
    )
    kind = delta.schema["_k"].dataType.simpleString()
    known = _state(spark, folder, f"_k {kind}, n_parent bigint, n_child bigint, load int")
    before = delta.select("_k", F.lit(0).cast("bigint").alias("old_parent"), F.lit(0).cast("bigint").alias("old_child"))
    if known is not None:
        low, high = delta.agg(F.min("_k"), F.max("_k")).first()
        near = known.where(F.col("load") < load).where(F.col("_k").between(low, high) | F.col("_k").isNull())
        wanted = delta.select(F.col("_k").alias("_w"))
        last = (
            near.join(wanted, F.col("_k").eqNullSafe(F.col("_w")), "left_semi").groupBy("_k")
            .agg(F.max_by(F.struct("n_parent", "n_child"), "load").alias("old"))
        )
        before = last.select("_k", F.col("old.n_parent").alias("old_parent"), F.col("old.n_child").alias("old_child"))
    twin = before.withColumnRenamed("_k", "_w")
    zero = F.lit(0).cast("bigint")
    old_parent, old_child = F.coalesce("old_parent", zero), F.coalesce("old_child", zero)
    merged = delta.join(twin, F.col("_k").eqNullSafe(F.col("_w")), "left").select(
        "_k", (F.col("n_parent") + old_parent).alias("n_parent"), (F.col("n_child") + old_child).alias("n_child"),
        old_parent.alias("old_parent"), old_child.alias("old_child"),
    )
    path = os.path.join(folder, f"load={load}")
    merged.repartitionByRange("_k").sortWithinPartitions("_k").write.mode("overwrite").parquet(path)
    done = spark.read.schema(merged.schema).parquet(path)
    unmatched = F.col("_k").isNull()
    orphans = lambda parent, child: F.when(unmatched | (F.col(parent) == 0), F.col(child)).otherwise(zero)
    childless = lambda parent, child: F.when(unmatched | (F.col(child) == 0), F.col(parent)).otherwise(zero)
    change = lambda figure: F.coalesce(F.sum(figure("n_parent", "n_child") - figure("old_parent", "old_child")), zero)
    return done.agg(
        F.lit(load).alias("load"), F.count("*").alias("touched"),
        change(orphans).alias("orphans_change"), change(childless).alias("childless_change"),
    )
