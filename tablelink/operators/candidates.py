"""Candidate texts in their two layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.functions.formats import EMPTY_TYPES, NO_TYPES, PIPE_HEADER
from tablelink.functions.text import joined_in_order, shown, single_quoted
from tablelink.operators.ordered import joined_pieces, joined_text

FIELDS = ("id", "name", "description", "types")
# What stands before the candidates.
HEADS = {"pipe": PIPE_HEADER}


def candidate_text(layout: str = "tagged") -> Column:
    """One candidate from the columns id, name, description, types."""
    name, description = single_quoted(F.col("name")), single_quoted(F.col("description"))
    if layout == "pipe":
        bare = shown(F.replace(F.replace("types", F.lit('"')), F.lit("'")))
        return F.concat(
            F.concat_ws(" | ", shown(F.col("id")), name, description, bare), F.lit(",")
        )
    types = F.when(F.col("types") == EMPTY_TYPES, F.lit(NO_TYPES)).otherwise(
        single_quoted(F.col("types"))
    )
    return F.concat(
        F.lit("<[ID] "), shown(F.col("id")), F.lit(" "), name,
        F.lit(" [DESCRIPTION] "), description, F.lit(" [TYPE] "), types, F.lit(">,"),
    )


def render_candidates(candidates: DataFrame, layout: str = "tagged") -> DataFrame:
    """One row per mention: group and the text `cand` of its candidates in order."""
    rows = candidates.where(F.col("group").isNotNull()).select("group", "cand_pos", *FIELDS)
    return joined_text(
        rows, candidate_text(layout), keys=["group"], order="cand_pos", out="cand", head=HEADS.get(layout, "")
    )


def joined_candidates(rows: DataFrame, text: Column, layout: str = "tagged") -> DataFrame:
    """One row per mention, as `render_candidates`, from the `text` of each candidate. For a
    bounded number of candidates: they are listed where they lie and not shuffled again."""
    listed = F.collect_list(F.struct(F.col("cand_pos").alias("at"), text.alias("text")))
    cand = F.concat(F.lit(HEADS.get(layout, "")), joined_in_order(listed))
    return rows.groupBy("group").agg(cand.alias("cand"))


def candidate_pieces(candidates: DataFrame, piece_chars: int, layout: str = "tagged") -> DataFrame:
    """The text of `render_candidates`, without a header, in pieces of about `piece_chars`
    characters: group, piece, start, cand. For mentions whose text is too long for one
    value or one task."""
    rows = candidates.where(F.col("group").isNotNull()).select("group", "cand_pos", *FIELDS)
    return joined_pieces(
        rows, candidate_text(layout), keys=["group"], order="cand_pos", out="cand", piece_chars=piece_chars,
        order_bits=48,
    )
