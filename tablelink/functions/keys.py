"""Mention keys: which table, row and column a mention points at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelink.functions.text import strip, words


def clean_table_name(name: Column) -> Column:
    """Trim, then drop the literal text `s/+` (it is no pattern)."""
    return F.replace(strip(name), F.lit("s/+"), F.lit(""))


def key_parts(key: Column) -> tuple[Column, Column, Column]:
    """`<table> <row> <col>`; a part that is absent or no number is null."""
    parts = words(key)
    return (
        clean_table_name(F.get(parts, F.lit(0))),
        F.get(parts, F.lit(1)).try_cast("bigint"),
        F.get(parts, F.lit(2)).try_cast("int"),
    )


def dash_key_parts(key: Column) -> tuple[Column, Column, Column]:
    """`<table>-<row>-<col>`, where the table name may hold dashes itself."""
    pattern = "^(.*)-([0-9]+)-([0-9]+)$"

    def part(n: int) -> Column:
        found = F.regexp_extract(strip(key), pattern, n)
        return F.when(found != "", found)

    return (
        clean_table_name(part(1)),
        part(2).try_cast("bigint"),
        part(3).try_cast("int"),
    )
