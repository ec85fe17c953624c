"""Submissions as streams, with the same expressions as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.intake import SUBMISSION, decide

def submission_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Lines of JSON that arrive as files in a folder."""
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", files_a_batch).json(folder)


def decided_stream(submissions: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Submissions with their decision; the time is the batch's unless it is given."""
    clock = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return decide(submissions, clock)


def deliver(decided: DataFrame, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query that keeps every decision as Parquet by status and hands accepted ones of each batch to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own folder, so that it counts once
        rows.write.mode("overwrite").partitionBy("status").parquet(f"{folder}/batch={number}")
        if sink is not None:
            sink(rows.where("status = 200"), number)

    return decided.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
