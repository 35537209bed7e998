from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from table_values import values
from tablelink import schemas
from tablelink.operators.candidates import joined_candidates, render_candidates
from tablelink.operators.mentions import (
    allowed_keys,
    allowed_tables,
    bounded_candidates,
    budgeted_candidates,
    clean_names,
    mention_table,
    one_group,
    with_key_parts,
)
from tablelink.plans.pipelines import build_mentions


def row(group, pos, cid, target=0, table="T", key=None):
    return (table, key or f"{table} 1 0", group, cid, f"n{cid}", "d", "[]", target, pos)


ROWS = [
    row(1, 3, "Q13"), row(1, 1, "Q11"), row(1, 2, "Q12", 1), row(1, 4, "Q14", 1),
    row(2, 1, "Q21"),
    row(3, 1, "noid", 1),
    row(4, 1, "see Q41 and Q42", 1),
    row(None, 1, "Q99", 1),
    row(5, 7, "Q57", table="late"), row(5, 2, "Q52", table="first"),
]


@pytest.fixture
def candidates(spark):
    return spark.createDataFrame(ROWS, schemas.CANDIDATES).repartition(5, "id")


def test_mention_table(candidates):
    assert values(mention_table(candidates)) == sorted([
        (1, "T", "T 1 0", "Q12", 4),
        (2, "T", "T 1 0", "0", 1),
        (3, "T", "T 1 0", "0", 1),
        (4, "T", "T 1 0", "Q41", 1),
        (5, "first", "first 1 0", "0", 2),
    ], key=repr)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_candidate_order_survives_shuffling(spark, parts):
    df = spark.createDataFrame(ROWS, schemas.CANDIDATES).repartition(parts, "cand_pos", "id")
    text = {r["group"]: r["cand"] for r in render_candidates(df).collect()}
    assert set(text) == {1, 2, 3, 4, 5}
    assert [piece.split()[1] for piece in text[1].split(",")[:-1]] == ["Q11", "Q12", "Q13", "Q14"]
    assert text[2] == "<[ID] Q21 nQ21 [DESCRIPTION] d [TYPE] None>,"
    piped = {r["group"]: r["cand"] for r in render_candidates(df, "pipe").collect()}
    assert piped[2] == "ID | NAME | DESCRIPTION | TYPEQ21 | nQ21 | d | [],"


def test_bounded_list(candidates):
    kept = bounded_candidates(candidates, 2, "cand_pos")
    assert values(kept.where("group = 1"), "cand_pos", "id") == [(1, "Q11"), (2, "Q12")]
    assert values(kept.where("group = 5"), "cand_pos", "id") == [(1, "Q52"), (2, "Q57")]


def test_large_mention_keeps_all_candidates(spark):
    rows = [row(1, n, f"Q{n}") for n in range(1, 5001)] + [row(2, 1, "Q1")]
    df = spark.createDataFrame(rows, schemas.CANDIDATES).repartition(6, "id")
    text = render_candidates(df).where("group = 1").first()["cand"]
    assert [p.split()[1] for p in text.split(",")[:-1]] == [f"Q{n}" for n in range(1, 5001)]


def test_allow_lists(spark, candidates):
    allow = spark.createDataFrame([("D", "T 1 0"), ("D", "T 1 0"), ("E", "late 1 0")], schemas.ALLOW_LIST)
    assert allowed_keys(candidates, allow, "D").count() == 8
    assert allowed_keys(candidates, allow, "E").count() == 1
    assert allowed_keys(candidates, allow).count() == 9
    tables = spark.createDataFrame([("first",), ("first",), ("other",)], "tableName string")
    assert values(allowed_tables(candidates, tables), "id") == [("Q52",)]
    assert allowed_keys(candidates, allow).columns[0] == "key"


def test_build_mentions(spark, candidates):
    allow = spark.createDataFrame([("D", "T 1 0")], schemas.ALLOW_LIST)
    built = build_mentions(candidates, allow, dataset="D")
    assert values(built, "group", "table_name", "row_no", "col_no") == [
        (1, "T", 1, 0), (2, "T", 1, 0), (3, "T", 1, 0), (4, "T", 1, 0),
    ]


def test_small_filters(spark, candidates):
    assert one_group(candidates, 5).count() == 2
    names = spark.createDataFrame([(" a s/+ ",)], "tableName string")
    assert clean_names(names).first()[0] == "a "
    dashed = with_key_parts(spark.createDataFrame([("T-a-3-1",)], "key string"), dashed=True)
    assert values(dashed, "table_name", "row_no", "col_no") == [("T-a", 3, 1)]


def test_budgeted_candidates(spark):
    """The longest prefix within the mention's own allowance, ties in place by text."""
    rows = [("T", "k", g, "Q1", f"n{g}", None, "[]", 0, pos) for g in (1, 2, 3) for pos in (3, 1, 2, 2, 9)]
    df = spark.createDataFrame(rows, schemas.CANDIDATES).withColumn("id", F.monotonically_increasing_id().cast("string"))
    cost = F.when(F.col("cand_pos") == 2, 3).otherwise(0)  # counts as 1
    allowance = spark.createDataFrame([(1, 4), (2, 100), (3, 0)], "`group` bigint, allowed int")
    got = budgeted_candidates(df, allowance, F.col("id"), cost, 4)
    assert values(got, "group", "cand_pos") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 2), (2, 3)]
    first_of_ties = df.where("`group` = 1 AND cand_pos = 2").agg(F.min("id")).first()[0]
    assert got.where("`group` = 1 AND cand_pos = 2").first()["id"] == first_of_ties


def test_budgeted_candidates_move_once(spark):
    """The windows deal the candidates by mention; neither the allowance nor the text do again."""
    rows = spark.createDataFrame([(g, p, f"t{p}") for g in (1, 2) for p in (1, 2)], "`group` bigint, cand_pos bigint, text string")
    allowance = spark.createDataFrame([(1, 1), (2, 2)], "`group` bigint, allowed int")
    text = F.col("text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = budgeted_candidates(rows.repartition(3), allowance, text, F.lit(1), 4)
        got = joined_candidates(kept, text)
        assert values(got, "group", "cand") == [(1, "t1"), (2, "t1t2")]
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # candidates, allowance
