"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import release, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node it reaches.

    Large stars hang all larger neighbours of a node on its least neighbour, small
    stars all smaller ones; both keep connectivity and the number of edges never
    grows. Every round is written to the shared folder, so lineage stays short.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(root, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(root.select("a", F.col("m").alias("b")))
        )
        last = now
        now = stored(small.distinct(), "edges")
        release(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(seen):
            break
        before = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
