from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from table_values import values
from tablelink import schemas
from tablelink.operators.retrieval import first_entities, lookup_entities, retrieve, retrieved

FOUND = "Result Q1:\nLabel: Oslo\nDescription: a \"city\"\n\nResult Q5:\nLabel: oslo "
NONE = "No good Wikidata Search Result was found"


@pytest.fixture
def entities(spark):
    return spark.createDataFrame(
        [("Q5", "oslo ", None, "[]", 2), ("Q1", "Oslo", 'a "city"', "[]", 1), ("Q9", "OSLO", "x", "[]", 3),
         ("Q2", "Bergen", None, "[]", 1), ("Q3", None, "no label", "[]", 1)],
        schemas.ENTITIES,
    ).repartition(3)


@pytest.fixture
def mentions(spark):
    return spark.createDataFrame([(1, " oslo"), (2, "Rome"), (3, None)], "group bigint, mention string")


def test_lookup(mentions, entities):
    assert values(first_entities(entities, 2), "id", "place") == [("Q1", 1), ("Q2", 1), ("Q5", 2)]
    assert values(lookup_entities(mentions, entities, 2)) == [
        (1, " oslo", 1, "Q1"), (1, " oslo", 2, "Q5"),
    ]


def test_texts(mentions, entities):
    rows = {r["group"]: r for r in retrieve(mentions, entities, 2).collect()}
    assert rows[1]["wiki_text"] == FOUND and rows[1]["wiki_json"] == json.dumps(FOUND)
    assert rows[2]["wiki_text"] == NONE and rows[2]["wiki_json"] == json.dumps(NONE)
    assert rows[3]["wiki_text"] is None and rows[3]["wiki_json"] is None


@pytest.mark.parametrize("policy,guard,expected", [
    ("replace", "intended", [json.dumps(FOUND), "C", "C"]),
    ("append", "intended", [json.dumps(FOUND), "", ""]),
    ("replace", "as_written", ["C", "C", "C"]),
    ("append", "as_written", ["", "", ""]),
    ("plain", "intended", [json.dumps(FOUND), json.dumps(NONE), ""]),
])
def test_policies(mentions, entities, policy, guard, expected):
    wiki = retrieved(policy, guard, F.lit("C"))
    found = retrieve(mentions, entities, 2).orderBy("group").select(wiki)
    assert [r[0] for r in found.collect()] == expected


def test_frequent_label_forms_no_pairs(spark):
    """A third of all mentions and of all entities share one label."""
    def label(n):
        return F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("l"), (F.col("id") % n).cast("string")))

    entities = spark.range(30_000).select(
        F.concat(F.lit("Q"), F.col("id").cast("string")).alias("id"), label(1000).alias("label"),
        F.lit("d").alias("description"), F.lit("[]").alias("types"), F.col("id").alias("rank"),
    )
    mentions = spark.range(30_000).select(F.col("id").alias("group"), label(1000).alias("mention"))
    found = lookup_entities(mentions, entities, 3)
    hot = found.where("mention = 'hot'")
    assert hot.count() == 30_000
    assert values(hot.select("place", "entity_id").distinct()) == [(1, "Q0"), (2, "Q3"), (3, "Q6")]
