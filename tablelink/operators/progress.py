"""Which mentions of which runs are finished, as bitmaps of their group numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.operators.joins import many_to_one

BITMAPS = "dataset STRING, config STRING, iter INT, bucket BIGINT, bits BINARY"


def finished_bitmaps(finished: DataFrame) -> DataFrame:
    """dataset, config, iter, bucket, bits: one bitmap for 32,768 neighbouring groups,
    from rows with dataset, config, iter, group. A null group is never finished."""
    return (
        finished.where(F.col("group").isNotNull())
        .groupBy("dataset", "config", "iter", F.bitmap_bucket_number("group").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("group")).alias("bits"))
    )


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """The bitmaps of one bucket as one."""
    return bitmaps.groupBy("dataset", "config", "iter", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def unfinished(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows (with dataset, config, iter, group) whose bit is not set in the merged
    bitmaps of any number of runs."""
    keys = ["dataset", "config", "iter", "_bucket"]
    known = bitmaps.withColumnRenamed("bucket", "_bucket").withColumnRenamed("bits", "_bits")
    placed = many_to_one(rows.withColumn("_bucket", F.bitmap_bucket_number("group")), known, keys)
    return placed.where(~_is_set(F.col("_bits"), F.bitmap_bit_position("group"))).drop("_bucket", "_bits")


def _is_set(bits: Column, at: Column) -> Column:
    """Whether the bit at a place is set; not in a missing bitmap."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1, F.lit(False))


def pending_by_bitmaps(mentions: DataFrame, bitmaps: DataFrame, runs: int) -> DataFrame:
    """Every (mention, run) whose bit is not set: the mention columns and `iter`.

    bitmaps  those of one dataset and configuration, merged
    """
    return runs_left(mentions, bitmaps, runs).withColumn("iter", F.explode("runs")).drop("runs")


def runs_left(mentions: DataFrame, bitmaps: DataFrame, runs: int) -> DataFrame:
    """Add `runs`: the numbers of the runs whose bit is not set, as a list. `bitmaps` are as in
    `pending_by_bitmaps`."""
    of_bucket = bitmaps.groupBy(F.col("bucket").alias("_bucket")).agg(
        F.map_from_entries(F.collect_list(F.struct("iter", "bits"))).alias("_bits")
    )
    placed = mentions.withColumn("_bucket", F.bitmap_bucket_number("group"))
    known = many_to_one(placed, of_bucket, ["_bucket"])
    at = F.bitmap_bit_position("group")
    left = F.filter(
        F.sequence(F.lit(0), F.lit(runs - 1)), lambda run: ~_is_set(F.try_element_at("_bits", run), at)
    )
    return known.withColumn("runs", left).drop("_bucket", "_bits")
