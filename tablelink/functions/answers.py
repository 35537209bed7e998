"""Entity ids and answers read out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelink.functions.formats import ANSWER_MARKER, NO_ENTITY, NO_MARKER, WHITESPACE
from tablelink.functions.text import strip


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def entity_id(text: Column) -> Column:
    """The first entity id of a gold text, or the id that stands for none."""
    return F.coalesce(_found(text, "Q[0-9]+", 0), F.lit(NO_ENTITY))


def answered_id(text: Column) -> Column:
    """The id an answer names: the first closed by `>`, else the first at all."""
    return F.coalesce(
        _found(text, "(Q[0-9]+)>", 1), _found(text, "Q[0-9]+", 0), F.lit(NO_ENTITY)
    )


def after_marker(text: Column, marker: str = ANSWER_MARKER) -> Column:
    """What follows the first marker, trimmed; a fixed message without a marker."""
    at = F.locate(marker, text)
    rest = F.substring(text, at + F.lit(len(marker)), F.length(text))
    return F.when(at > 0, strip(rest)).otherwise(F.lit(NO_MARKER))


def cut_after(text: str | None, marker: str = ANSWER_MARKER) -> str:
    """`after_marker` of one text inside a task, for answers that hold a whole long prompt."""
    at = -1 if text is None else text.find(marker)
    return NO_MARKER if at < 0 else text[at + len(marker) :].strip(WHITESPACE)


def is_correct(gold: Column, pred: Column) -> Column:
    """1 when both ids are there and equal after trimming, else 0."""
    return F.coalesce(strip(gold) == strip(pred), F.lit(False)).cast("int")
