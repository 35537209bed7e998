"""Runs side by side, and the mentions that any run gets wrong."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.functions.answers import is_correct

_KEYS = ("group", "gold")


def merge_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on (group, gold), where missing keys match each other.

    Both sides are reduced to distinct rows first. Repeated rows would only be
    multiplied by the join and dropped after it. Every other column is kept, so
    the two sides must name theirs differently.
    """
    rest = [c for c in left.columns + right.columns if c not in _KEYS]
    other = right.distinct().withColumnsRenamed({key: f"_{key}" for key in _KEYS})
    same = reduce(
        Column.__and__, (F.col(key).eqNullSafe(F.col(f"_{key}")) for key in _KEYS)
    )
    return (
        left.distinct()
        .join(other, same, "full")
        .select(*(F.coalesce(key, f"_{key}").alias(key) for key in _KEYS), *rest)
    )


def run_columns(runs: DataFrame, number: int) -> DataFrame:
    """group, gold and the prediction of one run as `pred_<number>`."""
    return runs.where(F.col("iter") == number).select(
        *_KEYS, F.col("pred").alias(f"pred_{number}")
    )


def merge_all(runs: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """The outer join folded over any number of runs, without repeated rows."""
    return reduce(merge_runs, (run_columns(runs, n) for n in numbers)).distinct()


def compare_runs(runs: DataFrame, numbers: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Predictions of the runs side by side, with `result` 1 when all are right.

    The same rows as `merge_all`, from one shuffle on the mention instead of a
    shuffle per join: each run of a mention becomes the set of its predictions,
    and the sets are spread out again, one run after the other. `keys` (say
    dataset, config) compares several configurations at once.
    """
    side_by_side = (
        runs.where(F.col("iter").isin(list(numbers)))
        .groupBy(*keys, *_KEYS)
        .agg(
            *(
                F.collect_set(F.when(F.col("iter") == n, F.struct("pred"))).alias(f"_{n}")
                for n in numbers
            )
        )
    )
    for n in numbers:
        side_by_side = side_by_side.withColumn(f"_{n}", F.explode_outer(f"_{n}"))
    preds = [F.col(f"_{n}.pred").alias(f"pred_{n}") for n in numbers]
    right = reduce(Column.__mul__, (is_correct(F.col("gold"), pred) for pred in preds))
    return side_by_side.select(*keys, *_KEYS, *preds, right.alias("result"))


def wrong_mentions(
    scored: DataFrame, keys: Sequence[str] = ("dataset", "config")
) -> DataFrame:
    """(group, gold) that some run of the configuration misses or gets wrong.

    Long form: one aggregation over all runs and configurations, no join of
    runs. A run of a configuration counts when it has at least one row. A null
    dataset or config is one like any other.
    """
    mentions = scored.groupBy(*keys, *_KEYS).agg(
        F.min("result").alias("_all_right"), F.sort_array(F.collect_set("iter")).alias("_made")
    )
    # From the grouped mentions, so that the scored rows are read once. Mentions have
    # few different lists of runs.
    runs = F.array_distinct(F.flatten(F.collect_set("_made")))
    expected = (
        mentions.groupBy(*keys)
        .agg(F.size(runs).alias("_runs"))
        .withColumnsRenamed({key: f"_of_{key}" for key in keys})
    )
    same = reduce(
        Column.__and__, (F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys), F.lit(True)
    )
    return (
        mentions.join(expected, same)
        .where((F.col("_all_right") == 0) | (F.size("_made") < F.col("_runs")))
        .select(*keys, *_KEYS)
    )


def repeated_results(runs: DataFrame, keys: Sequence[str] = ("dataset", "config")) -> DataFrame:
    """Mentions with more than one different prediction in a run, and how many. A
    comparison shows every combination of these, so it should have none."""
    return (
        runs.groupBy(*keys, "iter", *_KEYS)
        .agg(F.count_distinct(F.coalesce("pred", F.lit(""))).alias("n"))
        .where(F.col("n") > 1)
    )


def wrong_groups(wrong: DataFrame) -> DataFrame:
    """Distinct groups, over everything that was compared."""
    return wrong.select("group").distinct()


def hard_cases(scored: DataFrame) -> DataFrame:
    """Distinct groups that some run of any configuration gets wrong."""
    return wrong_groups(wrong_mentions(scored))


def hard_case_count(scored: DataFrame) -> DataFrame:
    return wrong_mentions(scored).agg(F.count_distinct("group").alias("n_hard"))
