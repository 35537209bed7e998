"""Prompt templates: texts with named fields, rendered as one expression.

Fields: {title} {summary} {row} {cand} {wiki} {mention}, and {question} {answer}
for examples. The sentences may be replaced by the caller; the fields, their
order, the quotes around them and the ### markers are what the defaults fix.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelink.functions.text import shown

_TABLE = 'The table is titled "{title}", its summary is "{summary}" and the row is "{row}". '
_ROW = 'Find the entity for the cell "{mention}" of a table. The table reads "{row}". '
_PICK = "Pick the candidate that {mention} refers to."
_BOTH = "Candidate entities: {cand} and search results: {wiki}. "

TEMPLATES: dict[str, str] = {
    "link_wiki": _ROW + "Candidate entities: {wiki}. " + _PICK,
    "link_cand_wiki": _ROW + _BOTH + _PICK,
    "title_wiki": _TABLE + "Candidate entities: {wiki}. " + _PICK,
    "title_cand_wiki": _TABLE + _BOTH + _PICK,
    "title_cand_idonly": _TABLE + "Candidate entities: {cand}. "
    "Which ID belongs to {mention}? Answer with nothing but the ID of {mention}.",
    "title_wiki_idonly": _TABLE + "Candidate entities: {wiki}. "
    "Which ID belongs to {mention}? Answer with nothing but the ID of {mention}.",
    "title_cand_wiki_what": _TABLE + _BOTH + "Which entity is {mention}",
    "sft_infer": "### Question: " + _TABLE + _BOTH + _PICK + " ### Answer:",
    "sft_train": "### Question: {question}\n ### Answer: {answer}",
}

_FIELD = re.compile(r"\{(title|summary|row|cand|wiki|mention|question|answer)\}")


def template_fields(template: str) -> set[str]:
    """The fields a template uses, so that plans fetch nothing else."""
    return set(_FIELD.findall(template))


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """One concat over the constant pieces and the fields; missing is written out."""
    pieces = _FIELD.split(template)
    parts = [
        F.lit(piece) if n % 2 == 0 else shown(fields[piece])
        for n, piece in enumerate(pieces)
        if n % 2 or piece
    ]
    return F.concat(*parts)
