"""Writers of results, scores, comparison sheets and group lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_runs(results: DataFrame, path: str, mode: str = "append") -> None:
    """Results of any number of runs, one folder per dataset, config and run."""
    results.write.mode(mode).partitionBy("dataset", "config", "iter").parquet(path)


def write_run_file(results: DataFrame, path: str) -> None:
    """The results of one run as CSV in group order, with the exchange column names."""
    results.orderBy("group").select(
        "tableName", "key", "group", "prompt", "output",
        F.col("gold").alias("correct QID"), F.col("pred").alias("output QID"),
    ).write.option("header", True).option("escape", '"').csv(path)


def write_scored(scored: DataFrame, path: str) -> None:
    """Scored rows; refuses to replace anything, so results stay as they are."""
    scored.write.mode("error").partitionBy("dataset", "config", "iter").parquet(path)


def write_sheet(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """A comparison or error sheet, as CSV with a header or as parquet."""
    writer = rows.write.mode("error")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_groups(groups: DataFrame, path: str) -> None:
    """One group per line, in order over all part files."""
    groups.orderBy("group").select(F.col("group").cast("string").alias("value")).write.text(path)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A table that later joins and groupings by the keys read without a shuffle.

    Table rows by table_name and row_no serve every linking run; candidates by
    group serve mentions and candidate texts, if no mention is very long.
    """
    spread = df.repartition(buckets, *keys)
    spread.write.mode("error").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
