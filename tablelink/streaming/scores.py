"""Scores that follow a folder of results, without reading any result twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablelink import schemas
from tablelink.operators.progress import BITMAPS, finished_bitmaps, merged_bitmaps, unfinished
from tablelink.operators.scoring import COUNTS, RUN_KEYS, class_counts, score_rows, scores_of_counts

CLASSES = "dataset STRING, config STRING, iter INT, entity STRING, " + ", ".join(f"{name} BIGINT" for name in COUNTS)


class RunningScores:
    """Counts per run and class, and bitmaps of the mentions they count, in a folder.

    Counts of two sets of results add up, so a batch costs its own rows and one pass over
    the counts; a mention that comes again, in the same batch or a later one, counts once
    (as its first answer; within a batch, the least). Every batch writes a version of its
    own and names it when it is whole, so a batch that was stopped is made again, and one
    that is repeated changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, place: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{place}")

    def _versions(self) -> list[tuple[int, int]]:
        """(version, batch) of what is whole, in order."""
        try:
            named = self._read("versions", "version BIGINT, batch BIGINT")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return []
        return sorted((row["version"], row["batch"]) for row in named.collect())

    def _counts(self, version: int | None) -> tuple[DataFrame, DataFrame]:
        if version is None:
            return self.spark.createDataFrame([], CLASSES), self.spark.createDataFrame([], BITMAPS)
        return self._read(f"classes/{version}", CLASSES), self._read(f"seen/{version}", BITMAPS)

    def add(self, results: DataFrame, batch: int) -> None:
        """Count results (dataset, config, iter, group, gold, pred) of a numbered batch;
        rows without a group each count."""
        versions = self._versions()
        if any(number == batch for _, number in versions):
            return
        last = versions[-1][0] if versions else None
        classes, seen = self._counts(last)
        new = unfinished(results.select(*RUN_KEYS, "group", "gold", "pred"), seen)
        first = new.where(F.col("group").isNotNull()).groupBy(*RUN_KEYS, "group").agg(
            F.min(F.struct("gold", "pred")).alias("_answer")
        )
        once = first.select(*RUN_KEYS, "group", "_answer.*").unionByName(new.where(F.col("group").isNull()))
        version = 0 if last is None else last + 1
        counted = classes.unionByName(class_counts(score_rows(once), RUN_KEYS))
        merged = counted.groupBy(*RUN_KEYS, "entity").agg(*(F.sum(name).alias(name) for name in COUNTS))
        merged.write.mode("overwrite").parquet(f"{self.path}/classes/{version}")
        bitmaps = merged_bitmaps(seen.unionByName(finished_bitmaps(once)))
        bitmaps.write.mode("overwrite").parquet(f"{self.path}/seen/{version}")
        named = self.spark.createDataFrame([(version, batch)], "version BIGINT, batch BIGINT").coalesce(1)
        named.write.mode("append").parquet(f"{self.path}/versions")

    def scores(self) -> DataFrame:
        """What `run_scores` gives for all results counted so far."""
        versions = self._versions()
        return scores_of_counts(self._counts(versions[-1][0] if versions else None)[0])


def follow_scores(
    spark: SparkSession, results: str, path: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Count the result files that are there and not counted yet, then stop.

    results  a folder that `run_linking` or `follow_prompts` writes
    path     of the counts, for `RunningScores(spark, path).scores()`
    """
    source = spark.readStream.schema(schemas.RUNS).option("maxFilesPerTrigger", files_per_batch).parquet(results)

    def count(batch: DataFrame, number: int) -> None:
        RunningScores(batch.sparkSession, path).add(batch, number)

    return (
        source.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
