"""The driver's tables read as inputs of this package (see FIXTURES.md, part 3).

Parts play the rows of tables and the entities, order lines the candidates, nations the
table metadata, customers a list of tables, conversations the examples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelink.functions.answers import answered_id
from tablelink.operators.context import cells_of_rows
from tablelink.operators.joins import many_to_one
from tablelink.operators.ordered import position

# The mention that has all order lines from this number on as candidates.
HOT, HOT_LINE = 1, 6

# config, shift of the choice of answers, runs made
CONFIGS = (
    ("table", 0, (0, 1, 2)),
    ("title_summary", 3, (0, 1, 2)),
    ("title_only", 5, (0,)),
)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _entity(key: Column, brand: Column, kind: Column) -> list[Column]:
    """id, description and types of the entity a part stands for."""
    return [
        F.concat(F.lit("Q"), key.cast("string")).alias("id"),
        F.when(key % 7 != 0, brand).alias("description"),
        F.when(kind == "ECONOMY", F.lit("[]"))
        .otherwise(F.concat(F.lit('[{"id": "Q9", "name": "'), kind, F.lit('"}]')))
        .alias("types"),
    ]


def entities(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part")
    entity = _entity(F.col("p_partkey"), F.col("p_brand"), F.col("p_type"))
    return part.select(
        *entity, F.col("p_name").alias("label"), F.col("p_partkey").alias("rank")
    )


def rows(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part").select(
        "p_partkey", "p_name", "p_type", "p_size", F.col("p_brand").alias("table_name")
    )
    return position(part, keys=["table_name"], order="p_partkey", out="row_no", run_bits=20, order_bits=40)


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows(spark, folder).select(
        "table_name",
        "row_no",
        F.array(F.lit("name"), F.lit("type"), F.lit("size")).alias("col_names"),
        F.array(
            F.col("p_name"),
            F.when(F.col("p_type") != "PROMO", F.col("p_type")),
            F.col("p_size").cast("string"),
        ).alias("cells"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_of_rows(table_rows(spark, folder))


def _key(col_no: Column) -> Column:
    return F.concat_ws(" ", "table_name", F.col("row_no").cast("string"), col_no.cast("string"))


def places(spark: SparkSession, folder: str, columns: Sequence[int] = (0,)) -> DataFrame:
    """One mention per table row and column: group, key and its parts."""
    col_no = F.explode(F.array(*(F.lit(c) for c in columns)))
    return (
        rows(spark, folder)
        .select(F.col("p_partkey").alias("group"), "table_name", "row_no", col_no.alias("col_no"))
        .withColumn("key", _key(F.col("col_no")))
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line is a candidate of its part. Lines numbered 6 and up are all of
    the part HOT, so that one mention has over a quarter of all candidates.

    Order lines meet their part by numbers; the texts are made of them afterwards."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    items = read(spark, folder, "lineitem").select(
        F.when(line >= HOT_LINE, F.lit(HOT)).otherwise(F.col("l_partkey")).alias("group"),
        "l_orderkey", "l_linenumber",
    )
    named = places(spark, folder).select("group", F.col("table_name").alias("tableName"), "key")
    place = (order * 8 + line).cast("bigint")
    name = F.concat(F.lit('line "'), line.cast("string"), F.lit('" of '), order.cast("string"))
    types = F.when(line == 1, F.lit("[]")).otherwise(
        F.concat(F.lit('[{"id": "Q9", "name": "line '), line.cast("string"), F.lit('"}]'))
    )
    target = (order % 5 == 0) & (F.col("group") % 10 != 0)
    return many_to_one(items, named, ["group"], "inner").select(
        "tableName", "key", "group",
        F.concat(F.lit("Q"), place.cast("string")).alias("id"),
        name.alias("name"),
        F.when(order % 7 != 0, F.concat(F.lit("order "), order.cast("string"))).alias("description"),
        types.alias("types"),
        target.cast("int").alias("target"),
        place.alias("cand_pos"),
    )


def meta(spark: SparkSession, folder: str) -> DataFrame:
    nation = read(spark, folder, "nation")
    number = F.col("n_nationkey").cast("string")
    return nation.select(
        F.concat(F.lit(" Brand#"), number, F.lit(" ")).alias("tableName"),
        F.when(F.col("n_nationkey") != 3, F.col("n_name")).alias("title"),
        F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("summary"),
        F.col("n_nationkey").cast("bigint").alias("pos"),
    )


def allow(spark: SparkSession, folder: str) -> DataFrame:
    return places(spark, folder).where(F.col("group") % 3 != 0).select(
        F.lit("D1").alias("dataset"), "key", "group"
    )


def allow_tables(spark: SparkSession, folder: str) -> DataFrame:
    customer = read(spark, folder, "customer").where(F.col("c_nationkey") % 2 == 0)
    return customer.select(
        F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("tableName")
    )


def runs(spark: SparkSession, folder: str, configs=CONFIGS[:1]) -> DataFrame:
    """Stored runs with answers in several wordings, right and wrong."""
    made = F.array(
        *(
            F.struct(F.lit(name).alias("config"), F.lit(shift).alias("shift"), F.lit(n).alias("iter"))
            for name, shift, numbers in configs
            for n in numbers
        )
    )
    at_target = F.when(F.col("target") == 1, F.col("cand_pos"))
    mentions = candidates(spark, folder).groupBy("group").agg(
        F.min(at_target).alias("right"),
        F.min("cand_pos").alias("first"),
        F.max("cand_pos").alias("last"),
    )
    group, turn = F.col("group"), F.col("group") + F.col("iter") + F.col("shift")
    place = F.when(turn % 10 != 0, F.coalesce("right", "first")).otherwise(F.col("last"))
    chosen = F.concat(F.lit("Q"), place.cast("string"))
    wording = turn % 8
    output = (
        F.when(wording < 3, F.concat(F.lit("The answer is <[ID] "), chosen, F.lit(">.")))
        .when(wording < 5, F.concat(chosen, F.lit(" is the match")))
        .when(wording < 7, F.concat(F.lit("Compare Q999999999999 with <"), chosen, F.lit(">")))
        .otherwise(F.lit("I cannot tell"))
    )
    return (
        mentions.select("*", F.inline(made))
        .where((F.col("iter") != 2) | (group % 50 != 7))
        .select(
            F.lit("D1").alias("dataset"),
            "config",
            "iter",
            "group",
            output.alias("output"),
            F.coalesce(F.concat(F.lit("Q"), F.col("right").cast("string")), F.lit("0")).alias("gold"),
        )
    )


def answered_runs(spark: SparkSession, folder: str, configs=CONFIGS[:1]) -> DataFrame:
    return runs(spark, folder, configs).withColumn("pred", answered_id(F.col("output")))


def examples(spark: SparkSession, folder: str) -> DataFrame:
    """User turns that the assistant answers next, whatever the numbers of the turns."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("question"),
        F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"),
    )
    asked = (F.col("role") == "user") & (F.col("next_role") == "assistant")
    return turns.where(asked).select("conv_id", "turn", "question", "answer")


def example_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every fifth conversation is for validation, the others are for training."""
    every = examples(spark, folder)
    held_out = F.col("conv_id") % 5 == 0
    return every.where(~held_out), every.where(held_out)
