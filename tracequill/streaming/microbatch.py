"""Micro-batch forms of first-wins deduplication and gates, over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def gated(stream: DataFrame, check: Callable[[DataFrame], DataFrame], key: str, good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's violations (rule, key) go to bad_path, and its rows without any to good_path.

    Both writes carry the batch's number, so a batch that runs again overwrites itself. A row whose key is null is told
    by no violation, so it counts as good unless a violation has a null key.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            violations = check(batch).persist()
            violations.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
            bad = violations.select(F.col("key").alias("__bad")).distinct()
            batch.join(bad, F.col(key).cast("string").eqNullSafe(F.col("__bad")), "left_anti").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
            violations.unpersist()
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
