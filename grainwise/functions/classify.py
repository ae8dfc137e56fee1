"""Ordered rules that map measures to labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels below are part of the published output tables.
SEGMENT_REPEAT = "Repeat (Loyal/Champion)"
SEGMENT_NEW_HIGH = "New high-value"
SEGMENT_NEW = "New / recent"
SEGMENT_DORMANT_HIGH = "Dormant high-value"
SEGMENT_DORMANT = "Dormant"
SEGMENT_MID = "Mid one-time"


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    (head, value), *rest = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], rule[1]), rest, F.when(head, value))
    return chain.otherwise(default)


def bucket_conditions(value: Column, edges: Sequence[float]) -> list[Column]:
    """Left-closed, right-open intervals between ``edges``; the last one is open-ended."""
    lows, highs = list(edges), list(edges[1:]) + [None]
    return [
        (value >= F.lit(low)) if high is None else ((value >= F.lit(low)) & (value < F.lit(high)))
        for low, high in zip(lows, highs)
    ]


def rfm_segment(frequency: Column, recency: Column, monetary: Column, repeat_min: int = 2) -> Column:
    """Customer segment from order count and the two quintile scores."""
    recent, dormant, high = recency >= 4, recency <= 2, monetary >= 4
    return first_match(
        [
            (frequency >= repeat_min, SEGMENT_REPEAT),
            (recent & high, SEGMENT_NEW_HIGH),
            (recent, SEGMENT_NEW),
            (dormant & high, SEGMENT_DORMANT_HIGH),
            (dormant, SEGMENT_DORMANT),
        ],
        SEGMENT_MID,
    )


def frequency_bucket(frequency: Column) -> Column:
    return first_match([(frequency == 1, "1"), (frequency == 2, "2")], "3+")


def star_sentiment(score: Column) -> Column:
    return first_match([(score >= 4, "positive"), (score == 3, "neutral")], "negative")


def category_label(raw: Column, translated: Column, manual: Mapping[str, str]) -> Column:
    """Manual label first, then the lookup, then ``unknown``."""
    if not manual:
        return F.coalesce(translated, F.lit("unknown"))
    pairs = [F.lit(x) for pair in manual.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), raw), translated, F.lit("unknown"))
