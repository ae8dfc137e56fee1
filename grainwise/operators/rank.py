"""Global order without a global task: ranks, order statistics, shares, top-k."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.session import cut_lineage

_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row position below


def global_rank(df: DataFrame, order: Sequence[str], rank: str, total: str) -> DataFrame:
    """Exact 1-based position of every row in the total order given by ``order``.

    ``order`` must end in a unique column. Rows are range-partitioned and sorted
    inside each partition, so ties on the leading column never pile up in one task;
    the position inside the partition is read off the row id. The placement is
    checkpointed because range bounds are sampled and a second evaluation could
    choose others. Only the per-partition row counts, one row per partition, are
    ordered in a single task and broadcast back.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _SLOT_BITS).alias("_part")
    position = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    sizes = placed.groupBy(part).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy()).alias(total),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_offset") + position + 1)
        .drop("_slot", "_part", "_offset")
    )


def quantile_bin(rank: Column, n: Column, bins: int = 5) -> Column:
    """Equal-count bin (1..bins) of a rank, with the bin edges interpolated over 1..n."""
    span = F.greatest(n - 1, F.lit(1))
    ceil_div = F.floor((bins * (rank - 1) + span - 1) / span)
    return F.greatest(F.lit(1), ceil_div).cast("int")


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str], place: str = "_at", total: str = "total") -> DataFrame:
    """Position and running sums of rows in a total order, of any number of rows.

    ``sums`` maps new columns to the columns they add up; ``<new>_<total>`` is the sum over
    all rows. Rows are range-partitioned and sorted; a partition's rows are added up inside
    it and shifted by the totals of the partitions before, one row a partition, which is
    all that meets in one task. The placement is checkpointed as range bounds are sampled.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _SLOT_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    every, before = Window.partitionBy(), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(every).alias(f"{n}_{total}") for n in sums],
    )
    inside = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    running = {}
    for n, c in sums.items():
        own = F.sum(c).over(inside)
        running[n] = F.coalesce(F.col(f"_off_{n}") + own, F.col(f"_off_{n}"), own)
    position = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return joined.withColumns({place: F.col("_before") + position + 1, **running}).drop("_slot", "_part", "_before", *[f"_off_{n}" for n in sums])


def tied_sums(placed: DataFrame, value: str, sums: str, place: str = "_at") -> DataFrame:
    """Of rows with positions and running sums: one row for each value, the sum up to its last row and its rows.

    This is the running sum with a RANGE frame, where equal values share one.
    """
    return placed.groupBy(value).agg(F.max_by(sums, place).alias(sums), F.max(f"{sums}_total").alias(f"{sums}_total"), F.count("*").alias("n"))


class Cut(NamedTuple):
    """Upper end of a bin: a value, and the last tie-break among rows that equal it (None: all of them)."""

    value: int
    last: object


def bin_cuts(df: DataFrame, measures: Mapping[str, Column], tie: str, bins: int = 5) -> dict[str, list[Cut]]:
    """Ends of the equal-count bins of several integer measures, by (value, tie).

    A row is in bin k or below if its rank is at most ``1 + floor(k * (n - 1) / bins)``.
    All measures share one count of values, whose exchange serves the location of the cut
    values as well as the rows below and at them; one row for each measure comes to the
    driver. Only rows of a value that a cut divides are ranked, by ``tie``, and of those only
    the last one of each bin is looked up, so every row can be binned by comparison.
    """
    stacked = df.select(
        tie, F.inline(F.array(*[F.struct(F.lit(m).alias("_m"), v.cast("bigint").alias("_v")) for m, v in measures.items()]))
    )
    counts = count_values(stacked, F.col("_v"), ["_m"])
    limit = lambda n, k: F.floor(k * (n - 1) / bins).cast("bigint") + 1
    ks = range(1, bins)
    located = order_statistics(counts, lambda n: {f"v{k}": limit(n, k) for k in ks}, ["_m"], groups_bounded=True)
    near = counts.where("_v is not null").join(F.broadcast(located), "_m")  # one row for each measure
    found = (
        near.groupBy("_m", "n", *[f"v{k}" for k in ks])
        .agg(
            *[F.coalesce(F.sum(F.when(F.col("_v") < F.col(f"v{k}"), F.col("_n"))), F.lit(0)).alias(f"b{k}") for k in ks],
            *[F.sum(F.when(F.col("_v") == F.col(f"v{k}"), F.col("_n"))).alias(f"e{k}") for k in ks],
            *[F.first(limit(F.col("n"), k)).alias(f"l{k}") for k in ks],
        )
        .collect()
    )
    divided = {(r["_m"], r[f"v{k}"]): r[f"e{k}"] for r in found for k in ks if r[f"l{k}"] < r[f"b{k}"] + r[f"e{k}"]}
    last: dict[tuple, object] = {}
    if divided:
        starts, start = {}, 0
        for key in sorted(divided):
            starts[key], start = start, start + divided[key]
        wanted = {
            (*key, k): starts[key] + r[f"l{k}"] - r[f"b{k}"]
            for r in found for k in ks if (key := (r["_m"], r[f"v{k}"])) in divided
        }
        own = [(F.col("_m") == m) & (F.col("_v") == v) for m, v in divided]
        tied = stacked.where(reduce(lambda a, b: a | b, own))
        ranked = global_rank(tied, ["_m", "_v", tie], "_place", "_all").where(F.col("_place").isin(*wanted.values()))
        at = {r["_place"]: r[tie] for r in ranked.select("_place", tie).collect()}  # bins - 1 rows for each measure at most
        last = {key: at[place] for key, place in wanted.items()}
    cuts: dict[str, list[Cut]] = {m: [] for m in measures}
    for r in found:
        cuts[r["_m"]] = [
            Cut(r[f"v{k}"], last[r["_m"], r[f"v{k}"], k] if r[f"l{k}"] < r[f"b{k}"] + r[f"e{k}"] else None) for k in ks
        ]
    return cuts


def bin_of(value: Column, tie: Column, cuts: Sequence[Cut]) -> Column:
    """Bin (1 to the number of cuts plus one) of a row by the ends of the bins."""
    value = value.cast("bigint")
    out = F.lit(len(cuts) + 1)
    for k, cut in reversed(list(enumerate(cuts, 1))):
        here = value == cut.value if cut.last is None else (value == cut.value) & (tie <= cut.last)
        out = F.when((value < cut.value) | here, F.lit(k)).otherwise(out)
    return out.cast("int")


def binned(df: DataFrame, value: Column, tie: str, name: str, bins: int = 5) -> DataFrame:
    """``quantile_bin`` of every row by (value, tie) without ranking all rows."""
    return df.withColumn(name, bin_of(value, F.col(tie), bin_cuts(df, {name: value}, tie, bins)[name]))


_SHIFTS = (40, 20)  # bits dropped by the coarse and by the fine histogram


def count_values(
    df: DataFrame, value: Column, groups: Sequence[str] = (), totals: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows per distinct value (and group), with further sums over the same rows.

    This is the only pass over the data that quantiles need: one partial aggregate
    and one shuffle. With ``totals`` the result is checkpointed, so a report of
    quantiles and sums evaluates the joins behind ``df`` once. Rows without a value
    count zero but enter the totals.
    """
    totals = totals or {}
    counts = (
        df.select(*groups, value.cast("bigint").alias("_v"), *[c.alias(n) for n, c in totals.items()])
        .groupBy(*groups, "_v")
        .agg(F.count("_v").alias("_n"), *[F.sum(n).alias(n) for n in totals])
    )
    return cut_lineage(counts) if totals else counts


def order_statistics(
    counts: DataFrame,
    ranks: Callable[[Column], Mapping[str, Column]],
    groups: Sequence[str] = (),
    *,
    size: str = "n",
    groups_bounded: bool = False,
) -> DataFrame:
    """Exact order statistics of counted integer values, one row per group.

    ``counts`` comes from :func:`count_values`; ``ranks`` maps the group's row count
    to named 1-based ranks; ``size`` names that row count in the result. The ranks
    are located by refining histograms: high bits first (2**24 buckets at most, a
    few hundred for durations within a decade), then the next 20 bits inside the
    buckets that were hit, then single values, again 2**20 at most per rank. This
    holds for any size and skew, whereas ``percentile`` would gather every distinct
    value of a group in one task. The three steps read the same exchange.

    ``groups_bounded`` states that the groups are a fixed label set (or that there
    are none), which bounds the table of located buckets and lets it be broadcast.
    """
    groups = list(groups)
    hint = F.broadcast if (groups_bounded or not groups) else (lambda frame: frame)
    counts = counts.filter(F.col("_v").isNotNull()).select(*groups, "_v", "_n")
    carried = [*groups, "_total", "_q"]

    def locate(histogram: DataFrame, keys: list[str], targets: Column) -> DataFrame:
        """Buckets that contain a wanted rank, with the rank made relative to the bucket."""
        upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        before = F.col("_upto") - F.col("_n")
        hits = F.filter(targets, lambda t: (t["r"] > before) & (t["r"] <= F.col("_upto")))
        return (
            histogram.withColumn("_upto", F.sum("_n").over(upto))
            .withColumn("_t", F.explode(hits))
            .select(
                *groups, "_total", "_b", F.col("_t.q").alias("_q"), (F.col("_t.r") - before).alias("_r")
            )
        )

    def inside(found: DataFrame, shift: int) -> DataFrame:
        """The counted values that fall into the located buckets."""
        twins = [f"_g{i}" for i, _ in enumerate(groups)]
        right = found.select(
            *[F.col(g).alias(t) for g, t in zip(groups, twins)], "_total", "_b", "_q", "_r"
        )
        on = [F.shiftright("_v", shift) == F.col("_b")]
        on += [F.col(g).eqNullSafe(F.col(t)) for g, t in zip(groups, twins)]
        return counts.join(hint(right), on).drop("_b", *twins)

    coarse, fine = _SHIFTS
    top = (
        counts.groupBy(*groups, F.shiftright("_v", coarse).alias("_b"))
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups)))
    )
    wanted = ranks(F.col("_total"))
    all_ranks = [
        F.struct(F.lit(i).alias("q"), r.cast("bigint").alias("r")) for i, r in enumerate(wanted.values())
    ]
    one_rank = F.array(F.struct(F.col("_q").alias("q"), F.col("_r").alias("r")))

    located = locate(top, groups, F.array(*all_ranks))
    middle = (
        inside(located, coarse)
        .groupBy(*carried, "_r", F.shiftright("_v", fine).alias("_b"))
        .agg(F.sum("_n").alias("_n"))
    )
    located = locate(middle, carried, one_rank)
    leaves = inside(located, fine).withColumnRenamed("_v", "_b")
    found = locate(leaves, carried, one_rank)
    return found.groupBy(*groups).agg(
        F.max("_total").alias(size),
        *[F.max(F.when(F.col("_q") == i, F.col("_b"))).alias(name) for i, name in enumerate(wanted)],
    )


def quantiles(
    counts: DataFrame, probs: Mapping[str, float], groups: Sequence[str] = (), *, groups_bounded: bool = False
) -> DataFrame:
    """Continuous quantiles (linear interpolation) of counted integer values, per group."""

    def neighbours(n: Column) -> dict[str, Column]:
        wanted = {}
        for name, p in probs.items():
            at = (n - 1) * F.lit(p)
            wanted[f"{name}_lo"], wanted[f"{name}_hi"] = F.floor(at) + 1, F.ceil(at) + 1
        return wanted

    stats = order_statistics(counts, neighbours, groups, size="_size", groups_bounded=groups_bounded)
    out = []
    for name, p in probs.items():
        at = (F.col("_size") - 1) * F.lit(p)
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return stats.select(*groups, *out)


def exact_quantiles(
    df: DataFrame,
    value: Column,
    probs: Mapping[str, float],
    groups: Sequence[str] = (),
    *,
    groups_bounded: bool = False,
) -> DataFrame:
    """Continuous quantiles of an integer column, per group."""
    return quantiles(count_values(df, value, groups), probs, groups, groups_bounded=groups_bounded)


def share_of_total(measure: Column, digits: int | None = 2) -> Column:
    """Percentage of the column total; for tables that are already aggregated."""
    total = F.sum(measure).over(Window.partitionBy())
    value = F.lit(100.0) * F.try_divide(measure.cast("double"), total.cast("double"))
    return value if digits is None else F.round(value, digits)


def top_k(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """Largest ``k`` rows by one measure with a unique tie-break."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)
