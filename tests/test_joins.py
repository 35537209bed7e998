from __future__ import annotations

from pyspark.sql import functions as F

from tablelink.operators.joins import many_to_one

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def test_hot_key_is_split(spark):
    before = {name: spark.conf.get(name, None) for name in SMALL}
    try:
        for name, value in SMALL.items():
            spark.conf.set(name, value)
        left = spark.range(0, 60_000, 1, 12).select(
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("key"), "id"
        )
        right = spark.range(5000).groupBy((F.col("id") % 5000).alias("key")).agg(
            F.max("id").alias("v")
        )
        joined = many_to_one(left, right, ["key"])
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    assert "skew=true" in plan
    assert len(rows) == 60_000
    assert all(row["v"] == row["key"] for row in rows)
    assert sum(row["key"] == 7 for row in rows) >= 20_000
