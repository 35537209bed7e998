"""A linking run that follows a folder of prompts and keeps its progress."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablelink.config import LinkConfig
from tablelink.operators.calls import Calls
from tablelink.operators.linking import Predict
from tablelink.plans.pipelines import ProgressLog, store_results

PROMPTS = "`group` BIGINT, tableName STRING, key STRING, gold STRING, prompt STRING"


def follow_prompts(
    spark: SparkSession,
    prompts: str,
    path: str,
    checkpoint: str,
    config: LinkConfig,
    make_predict: Callable[..., Predict],
    *,
    files_per_batch: int = 1000,
    options: dict[str, Any] | None = None,
    calls: Calls | None = None,
) -> StreamingQuery:
    """Answer the prompt files that are there and not answered yet, then stop.

    The checkpoint remembers which files are done. Each group of files is stored as
    `run_linking` stores a batch: what the results folder already has is not asked
    again, so both can add to one folder in any order.
    """
    source = (
        spark.readStream.schema(PROMPTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(prompts)
    )

    def store(batch: DataFrame, _: int) -> None:
        log = ProgressLog(batch.sparkSession, path)
        log.set_right()
        store_results(
            batch, config, make_predict, path, finished=log.bitmaps(config), options=options, calls=calls
        )

    return (
        source.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
