"""Entity retrieval from an offline entity table, and what a prompt uses of it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.functions.formats import LIST_LIMIT, NO_RESULT, RESULT_PATTERN
from tablelink.functions.text import joined_in_order, json_text, strip
from tablelink.operators.joins import many_to_one
from tablelink.operators.ordered import first_k


# Finds entities for mentions (column `mention`): gives the mention columns, place,
# entity_id, label and description for at most so many of each.
Find = Callable[[DataFrame, DataFrame, int], DataFrame]


def label_key(text: Column) -> Column:
    return F.lower(strip(text))


def first_entities(entities: DataFrame, k: int = LIST_LIMIT) -> DataFrame:
    """The first `k` entities of each label, by rank and id.

    The order does not depend on the mention, so the list is cut per label
    before any mention meets it: a label shared by many entities and many
    mentions never pairs them all.
    """
    labelled = entities.withColumn("_label", label_key(F.col("label"))).where(
        F.col("_label").isNotNull()
    )
    return first_k(labelled, k, keys=["_label"], order=["rank", "id"], out="place")


def lookup_entities(
    mentions: DataFrame, entities: DataFrame, k: int = LIST_LIMIT
) -> DataFrame:
    """One row per mention and found entity: the mention columns, place, entity_id.

    Mentions nothing is found for are left out.
    """
    found = (
        first_entities(entities, k)
        .groupBy("_label")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("place", F.col("id").alias("entity_id")))
            ).alias("_hits")
        )
    )
    labelled = mentions.withColumn("_label", label_key(F.col("mention")))
    return many_to_one(labelled, found, ["_label"], "inner").select(
        *mentions.columns, F.inline("_hits")
    )


def result_texts(found: DataFrame, key: str) -> DataFrame:
    """One row per key, from place, entity_id, label and description: the text the
    retrieval answers with, and its JSON form."""
    block = F.concat(
        F.lit("Result "), F.col("entity_id"), F.lit(":\nLabel: "), F.coalesce("label", F.lit("")),
        F.coalesce(F.concat(F.lit("\nDescription: "), F.col("description")), F.lit("")),
    )
    spaced = F.concat(F.when(F.col("place") > 1, F.lit("\n\n")).otherwise(F.lit("")), block)
    texts = found.groupBy(F.col(key).alias("_key")).agg(
        joined_in_order(
            F.collect_list(F.struct(F.col("place").alias("at"), spaced.alias("text")))
        ).alias("_text")
    )
    return texts.withColumn("_json", json_text(F.col("_text")))


def retrieve(
    mentions: DataFrame, entities: DataFrame, k: int = LIST_LIMIT, find: Find | None = None
) -> DataFrame:
    """Add `wiki_text` and `wiki_json` for the column `mention`.

    Entities are those of the mention's label, or what `find` finds, which is asked once
    per different mention. Nothing found gives the service's own message; a missing
    mention counts as a failed call and gives null.
    """
    if find is None:
        key = label_key(F.col("mention"))
        texts = result_texts(first_entities(entities, k).withColumnRenamed("id", "entity_id"), "_label")
    else:
        key = F.col("mention")
        texts = result_texts(find(mentions.select("mention").distinct(), entities, k), "mention")
    joined = many_to_one(mentions.withColumn("_key", key), texts, ["_key"])

    def answer(found: str, nothing: Column) -> Column:
        return F.when(F.col("mention").isNotNull(), F.coalesce(F.col(found), nothing))

    return joined.withColumns(
        {
            "wiki_text": answer("_text", F.lit(NO_RESULT)),
            "wiki_json": answer("_json", F.lit(json.dumps(NO_RESULT))),
        }
    ).drop("_key", "_text", "_json")


def retrieved(policy: str, guard: str = "intended", cand: Column | None = None) -> Column:
    """What a prompt uses as retrieval output, from wiki_text and wiki_json.

    replace  guarded; otherwise the candidate text `cand`
    append   guarded; otherwise nothing
    plain    unguarded; nothing only when the call failed
    The guard looks for a result in the text. Taken `as_written` it looks in the
    JSON form, where it can never match, so the other branch always applies.
    """
    if policy == "plain":
        return F.coalesce(F.col("wiki_json"), F.lit(""))
    other = cand if policy == "replace" else F.lit("")
    if guard == "as_written":
        return other
    return F.when(F.col("wiki_text").rlike(RESULT_PATTERN), F.col("wiki_json")).otherwise(other)
