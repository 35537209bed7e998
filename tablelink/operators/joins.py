"""Joins with a side that has one row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def many_to_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join any number of left rows with the one right row of their keys.

    Small right sides are broadcast by Spark's own size check. Otherwise the
    adaptive skew join splits the left rows of a hot key over several tasks, but
    only where both sides are shuffled for the join itself. A right side that was
    just aggregated by the keys would be used as it lies; joining on a hash of
    the keys too makes Spark shuffle it (one row per key) and keeps that open.
    """
    tag = F.xxhash64(*keys)
    return (
        left.withColumn("_tag", tag)
        .join(right.withColumn("_tag", tag), ["_tag", *keys], how)
        .drop("_tag")
    )
