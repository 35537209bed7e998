"""Misspelt mentions: entities whose label is a few edits away.

Two strings at most d edits apart become equal after at most d deletions from each, and
so do their first characters. Labels and mentions are therefore listed under all forms
with up to two of their first characters deleted, and meet where a form is equal: an
equi-join, in which Spark's adaptive skew join splits the lists of common forms. What
meets, and agrees in length, is compared in full, within a band of the allowed edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.functions.formats import LIST_LIMIT
from tablelink.operators.joins import many_to_one
from tablelink.operators.ordered import first_k
from tablelink.operators.retrieval import first_entities, label_key

# Characters from whose start forms are made.
FORM_CHARS = 24
MOST_EDITS = 2


def allowed_edits(text: Column) -> Column:
    """Edits that a mention may have: none up to 2 characters, one up to 5, then two."""
    n = F.char_length(text)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(MOST_EDITS)


def _without_one(text: Column, start: Column) -> Column:
    """The text without one of its characters, from the place `start` on; structs of the
    form and the place."""
    places = F.sequence(start, F.char_length(text))
    return F.when(
        F.char_length(text) >= start,
        F.transform(
            places,
            lambda at: F.struct(
                F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1)).alias("form"),
                at.alias("at"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<form:string,at:int>>"))


def deletion_forms(text: Column, edits: Column, chars: int = FORM_CHARS) -> Column:
    """64-bit numbers of the first `chars` characters with up to `edits` (0 to 2) of
    them deleted, each once."""
    head = F.substr(text, F.lit(1), F.lit(chars))
    one = _without_one(head, F.lit(1))
    two = F.flatten(F.transform(one, lambda x: _without_one(x["form"], x["at"])))

    def form_of(structs: Column) -> Column:
        return F.transform(structs, lambda x: x["form"])

    forms = (
        F.when(edits <= 0, F.array(head))
        .when(edits == 1, F.concat(F.array(head), form_of(one)))
        .otherwise(F.concat(F.array(head), form_of(one), form_of(two)))
    )
    return F.array_distinct(F.transform(forms, lambda form: F.xxhash64(form)))


def near_labels(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs mention, label, edits of two tables of different texts (columns `mention`
    and `label`, not null) that are within the mention's allowed edits."""
    length = F.char_length
    asked = mentions.select(
        "mention", allowed_edits(F.col("mention")).alias("allowed"),
        F.explode(deletion_forms(F.col("mention"), allowed_edits(F.col("mention")))).alias("form"),
    )
    # A mention may be longer than the label by its allowed edits.
    reach = allowed_edits(F.concat("label", F.lit("  ")))
    listed = labels.select("label", F.explode(deletion_forms(F.col("label"), reach)).alias("form"))
    met = (
        asked.join(listed, "form")
        .where(F.abs(length("mention") - length("label")) <= F.col("allowed"))
        .select("mention", "label", "allowed")
        .distinct()
    )
    edits = F.levenshtein("mention", "label", MOST_EDITS)
    return met.withColumn("edits", edits).where(
        (F.col("edits") >= 0) & (F.col("edits") <= F.col("allowed"))
    ).select("mention", "label", "edits")


def fuzzy_entities(mentions: DataFrame, entities: DataFrame, k: int = LIST_LIMIT) -> DataFrame:
    """One row per mention and found entity: the mention columns, place (1 to k),
    entity_id, label, description, edits.

    Labels and mentions are compared trimmed and lower-cased, each different text once.
    Fewer edits come first, then rank and id; an equal label has none. Null mentions and
    labels, and mentions nothing is found for, are left out.
    """
    listed = first_entities(entities, k).groupBy("_label").agg(
        F.collect_list(F.struct("rank", "id", "label", "description")).alias("_entities")
    )
    keyed = mentions.withColumn("_key", label_key(F.col("mention")))
    asked = keyed.select(F.col("_key").alias("mention")).where("_key IS NOT NULL").distinct()
    near = near_labels(asked, listed.select(F.col("_label").alias("label")))
    met = many_to_one(near.withColumnRenamed("label", "_label"), listed, ["_label"], "inner")
    hits = first_k(
        met.select("mention", "edits", F.inline("_entities")),
        k, keys=["mention"], order=["edits", "rank", "id"], out="place",
    )
    per_mention = hits.groupBy(F.col("mention").alias("_key")).agg(
        F.sort_array(
            F.collect_list(F.struct("place", F.col("id").alias("entity_id"), "label", "description", "edits"))
        ).alias("_hits")
    )
    return many_to_one(keyed, per_mention, ["_key"], "inner").select(*mentions.columns, F.inline("_hits"))
