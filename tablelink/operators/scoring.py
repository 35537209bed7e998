"""Scores of runs: accuracy, weighted F1, means per configuration, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.functions.answers import is_correct
from tablelink.functions.formats import NIL_GOLD
from tablelink.functions.text import strip

RUN_KEYS = ("dataset", "config", "iter")


def score_rows(runs: DataFrame) -> DataFrame:
    """Trim both ids and add `result`: 1 when they agree, else 0."""
    return runs.withColumns(
        {
            "gold": strip(F.col("gold")),
            "pred": strip(F.col("pred")),
            "result": is_correct(F.col("gold"), F.col("pred")),
        }
    )


def error_rows(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("result") == 0)


def error_pairs(scored: DataFrame) -> DataFrame:
    """Gold and predicted id of every error."""
    return error_rows(scored).select("gold", "pred")


def error_counts(scored: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count_if(F.col("result") == 0).alias("errors"))


def confusion(scored: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Counts per gold and predicted id, in long form."""
    return scored.groupBy(*keys, "gold", "pred").agg(F.count("*").alias("n"))


def run_accuracy(scored: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("result").alias("accuracy")
    )


COUNTS = ("support", "predicted", "hits", "real_support", "real_predicted", "real_hits")


def class_counts(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support, predictions and hits of every class, with and without NIL rows.

    A correct row counts for one class, a wrong row for two.
    """

    def count(entity: Column, support: int, predicted: int) -> Column:
        return F.struct(
            entity.alias("entity"),
            F.lit(support).alias("support"),
            F.lit(predicted).alias("predicted"),
            F.lit(support * predicted).alias("hits"),
        )

    gold, pred = F.col("gold"), F.col("pred")
    counts = F.when(F.col("result") == 1, F.array(count(gold, 1, 1))).otherwise(
        F.array(count(gold, 1, 0), count(pred, 0, 1))
    )
    rows = scored.select(
        *keys,
        F.coalesce(gold != NIL_GOLD, F.lit(True)).cast("int").alias("_real"),
        F.inline(counts),
    )
    names = COUNTS[:3]
    return rows.groupBy(*keys, "entity").agg(
        *(F.sum(name).alias(name) for name in names),
        *(F.sum(F.col(name) * F.col("_real")).alias(f"real_{name}") for name in names),
    )


def run_scores(scored: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per run: n, accuracy, f1_all (every row) and f1_non_nil (rows with a gold id).

    F1 is weighted by support over all classes seen as gold or prediction. One
    shuffle by class serves all three scores.
    """
    return scores_of_counts(class_counts(scored, keys), keys)


def scores_of_counts(counts: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The scores of `run_scores` from the counts of every class."""

    def weighted(prefix: str) -> Column:
        support = F.col(f"{prefix}support")
        f1 = 2 * F.col(f"{prefix}hits") / F.nullif(support + F.col(f"{prefix}predicted"), F.lit(0))
        return F.sum(support * f1) / F.nullif(F.sum(support), F.lit(0))

    return counts.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        weighted("").alias("f1_all"),
        weighted("real_").alias("f1_non_nil"),
    )


def config_means(scores: DataFrame) -> DataFrame:
    """Mean accuracy and F1 over the runs a configuration has."""
    return scores.groupBy("dataset", "config").agg(
        F.count("*").alias("runs"),
        F.avg("accuracy").alias("accuracy"),
        F.avg("f1_all").alias("f1_all"),
        F.avg("f1_non_nil").alias("f1_non_nil"),
    )


def report(scores: DataFrame, runs: int = 3) -> DataFrame:
    """One line per configuration: accuracy of each run, their mean, mean F1.

    Rounded to two places; a run that was not made stays empty.
    """
    per_run = [
        F.round(F.max(F.when(F.col("iter") == n, F.col("accuracy"))), 2).alias(f"run_{n + 1}")
        for n in range(runs)
    ]
    return scores.groupBy("dataset", "config").agg(
        *per_run,
        F.round(F.avg("accuracy"), 2).alias("mean_accuracy"),
        F.round(F.avg("f1_all"), 2).alias("mean_f1"),
    )


def preview(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first rows in the given order."""
    return df.orderBy(*order).limit(n)
