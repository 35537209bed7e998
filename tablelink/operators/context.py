"""What surrounds a mention: its cell, its row, its table's title and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelink.functions.formats import NO_METADATA
from tablelink.functions.text import row_text, strip
from tablelink.operators.joins import many_to_one
from tablelink.operators.ordered import order_bits_of, running_total

_PLACE = ["table_name", "row_no"]


def lookup_cells(mentions: DataFrame, cells: DataFrame) -> DataFrame:
    """Add mention, col_name and cell_missing from the long cell table."""
    found = cells.select(
        "table_name", "row_no", "col_no",
        F.col("value").alias("mention"), "col_name",
        F.lit(True).alias("_found"),
    )
    return (
        mentions.join(found, [*_PLACE, "col_no"], "left")
        .withColumn("cell_missing", F.col("_found").isNull())
        .drop("_found")
    )


def rows_of_cells(cells: DataFrame) -> DataFrame:
    """Long cells to one record per table row, ordered by column."""
    cell = F.struct("col_no", "col_name", "value")
    return (
        cells.groupBy(*_PLACE)
        .agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
        .select(
            *_PLACE,
            F.col("_cells.col_name").alias("col_names"),
            F.col("_cells.value").alias("cells"),
        )
    )


def cells_of_rows(table_rows: DataFrame) -> DataFrame:
    """Table rows to one record per cell."""
    return table_rows.select(
        *_PLACE, F.posexplode(F.arrays_zip("col_names", "cells")).alias("col_no", "_cell")
    ).select(
        *_PLACE,
        "col_no",
        F.col("_cell.col_names").alias("col_name"),
        F.col("_cell.cells").alias("value"),
    )


def attach_rows(mentions: DataFrame, table_rows: DataFrame, with_text: bool = True) -> DataFrame:
    """Add mention, col_name, cell_missing and the row text in a single join.

    A record of a table row carries its column names, so the header needs no
    join on the table name, which would gather all mentions of a large table.
    A position outside the table gives nulls and the flag. A row has no more
    mentions than cells, so this join has no hot keys, and a corpus bucketed by
    table_name and row_no is not shuffled at all.
    """
    col = F.col("col_no")
    inside = (col >= 0) & (col < F.size("cells"))
    joined = mentions.join(table_rows.select(*_PLACE, "col_names", "cells"), _PLACE, "left")
    out = joined.withColumns(
        {
            "mention": F.when(inside, F.get("cells", col)),
            "col_name": F.when(inside, F.get("col_names", col)),
            "cell_missing": ~F.coalesce(inside, F.lit(False)),
        }
    )
    if with_text:
        out = out.withColumn("row", row_text(F.col("row_no"), F.col("col_names"), F.col("cells")))
    return out.drop("col_names", "cells")


def first_metadata(meta: DataFrame, order: str) -> DataFrame:
    """One title and summary per trimmed table name, the first in `order`."""
    first = F.min_by(F.struct("title", "summary"), order)
    return (
        meta.groupBy(strip(F.col("tableName")).alias("table_name"))
        .agg(first.alias("_meta"))
        .select("table_name", "_meta.title", "_meta.summary", F.lit(True).alias("_has_meta"))
    )


def attach_metadata(mentions: DataFrame, meta: DataFrame, order: str) -> DataFrame:
    """Add title, summary and has_meta. A table without a row gets `None` texts;
    a row with an empty field stays null."""
    joined = many_to_one(mentions, first_metadata(meta, order), ["table_name"])
    return joined.withColumns(
        {
            "has_meta": F.col("_has_meta").isNotNull(),
            "title": F.when(F.col("_has_meta").isNull(), F.lit(NO_METADATA)).otherwise(
                F.col("title")
            ),
            "summary": F.when(F.col("_has_meta").isNull(), F.lit(NO_METADATA)).otherwise(
                F.col("summary")
            ),
        }
    ).drop("_has_meta")


def constant_metadata(mentions: DataFrame, title: str, summary: str) -> DataFrame:
    """The same title and summary for every mention (a single-table dataset)."""
    return mentions.withColumns(
        {"title": F.lit(title), "summary": F.lit(summary), "has_meta": F.lit(True)}
    )


def expand_runs(df: DataFrame, runs: int) -> DataFrame:
    """Repeat every row once per run, numbered from 0 in `iter`."""
    return df.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def missing_metadata(df: DataFrame) -> DataFrame:
    """Mentions without metadata, per run."""
    return df.groupBy("iter").agg(F.count_if(~F.col("has_meta")).alias("missing"))


def missing_metadata_running(
    mentions: DataFrame, runs: int, order_bits: int | None = None
) -> DataFrame:
    """The running count of missing metadata in group order, for every run.

    The count does not depend on the run, so it is made once and repeated. The bits of
    the group numbers are looked up unless they are given.
    """
    if order_bits is None:
        order_bits = order_bits_of(mentions, "group")
    counted = running_total(
        mentions.select("group", "has_meta"),
        (~F.col("has_meta")).cast("bigint"),
        keys=[],
        order="group",
        out="missing_so_far",
        order_bits=order_bits,
    )
    return expand_runs(counted, runs)
