"""Column expressions for text: trimming, quoting, JSON strings, ordered joins."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablelink.functions.formats import MISSING, WHITESPACE


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """The parts of a text between runs of white space."""
    return F.split(strip(text), f"[{WHITESPACE}]+")


def shown(text: Column) -> Column:
    """A value as prompts show it: missing is written out."""
    return F.coalesce(text, F.lit(MISSING))


def single_quoted(text: Column) -> Column:
    """Double quotes become single quotes; missing is written out."""
    return shown(F.replace(text, F.lit('"'), F.lit("'")))


def joined_in_order(items: Column) -> Column:
    """Concatenate the `text` of an array of (position, text) by position."""
    return F.array_join(F.sort_array(items)["text"], "")


@F.pandas_udf(StringType())
def json_text(texts: pd.Series) -> pd.Series:
    """A text as a JSON string, with everything outside ASCII escaped.

    The built-in functions can spell this per character, but take eight times
    as long on accented text as one call per value on an Arrow batch.
    """
    return texts.map(json.dumps, na_action="ignore")


def row_text(row_no: Column, col_names: Column, cells: Column) -> Column:
    """The header and one row of a table, as prompts show them."""

    def bars(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.concat(shown(v), F.lit(" | "))), "")

    return F.concat(
        F.lit("col: | "), bars(col_names),
        F.lit("  row "), row_no.cast("string"), F.lit(": | "), bars(cells), F.lit(" "),
    )
