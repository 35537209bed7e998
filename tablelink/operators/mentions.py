"""Mentions: allow-lists, key parts, and one row per group of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelink.functions.answers import entity_id
from tablelink.functions.keys import clean_table_name, dash_key_parts, key_parts
from tablelink.operators.joins import many_to_one
from tablelink.operators.ordered import first_k


def allowed_keys(df: DataFrame, allow: DataFrame, dataset: str | None = None) -> DataFrame:
    """Rows whose key is on the allow-list (of one dataset)."""
    if dataset is not None:
        allow = allow.where(F.col("dataset") == dataset)
    return many_to_one(df, allow.select("key").distinct(), ["key"], "left_semi")


def allowed_tables(df: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows whose table is on the list; the list may repeat names."""
    return many_to_one(df, tables.select("tableName").distinct(), ["tableName"], "left_semi")


def one_group(df: DataFrame, group: int) -> DataFrame:
    """The rows of a single mention."""
    return df.where(F.col("group") == group)


def with_key_parts(df: DataFrame, key: str = "key", dashed: bool = False) -> DataFrame:
    """Add table_name, row_no and col_no of the mention key."""
    table, row, col = (dash_key_parts if dashed else key_parts)(F.col(key))
    return df.withColumns({"table_name": table, "row_no": row, "col_no": col})


def clean_names(df: DataFrame, column: str = "tableName") -> DataFrame:
    return df.withColumn(column, clean_table_name(F.col(column)))


def mention_table(candidates: DataFrame) -> DataFrame:
    """One row per mention: group, tableName, key, gold, n_candidates.

    First values follow `cand_pos`; the gold id is that of the first candidate
    marked as target. Rows without a group are dropped. Every aggregate adds up
    before the shuffle, so a mention sends one row per input split.
    """
    at_target = F.when(F.col("target") == 1, F.col("cand_pos"))
    folded = (
        candidates.where(F.col("group").isNotNull())
        .groupBy("group")
        .agg(
            F.min_by(F.struct("tableName", "key"), "cand_pos").alias("_first"),
            F.min_by("id", at_target).alias("_gold"),
            F.count("*").alias("n_candidates"),
        )
    )
    return folded.select(
        "group", "_first.*", entity_id(F.col("_gold")).alias("gold"), "n_candidates"
    )


def bounded_candidates(candidates: DataFrame, k: int, *order: str) -> DataFrame:
    """The first `k` candidates of each mention in the given order, renumbered."""
    kept = first_k(candidates, k, keys=["group"], order=order, out="_place")
    return kept.withColumn("cand_pos", F.col("_place").cast("bigint")).drop("_place")


def budgeted_candidates(
    candidates: DataFrame, allowance: DataFrame, text: Column, cost: Column, budget: int
) -> DataFrame:
    """The first candidates of each mention whose costs add up to no more than it may
    spend; null groups are dropped.

    allowance  one row per mention: group, allowed
    text       text of a candidate, which orders equal places
    cost       what a candidate costs, at least 1
    budget     the most that any mention may spend. So only its first `budget` candidates
               can be kept: the others go before the shuffle, on each input split, and no
               window holds more.
    """
    rows = candidates.where(F.col("group").isNotNull())
    near = first_k(rows, max(budget, 1), keys=["group"], order=["cand_pos", text], out="_at")
    spent = F.sum(F.greatest(cost, F.lit(1))).over(Window.partitionBy("group").orderBy("_at"))
    # No mention is hot any more, so what is kept stays where the windows have put it.
    counted = near.withColumn("_spent", spent).join(allowance.select("group", "allowed"), "group")
    return counted.where(F.col("_spent") <= F.col("allowed")).select(*candidates.columns)
