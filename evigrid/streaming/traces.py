"""Structured Streaming forms: arriving traces once each, windowed judge statistics, batch operators per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def trace_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def once(stream: DataFrame, key: str, at: str, lateness: str = "2 days") -> DataFrame:
    """Each key once within the lateness; state is dropped behind the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def judge_windows(runs: DataFrame, at: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Runs, mean score and verdict counts per model and tumbling window."""
    verdict = F.upper(F.trim("verdict"))
    return (
        runs.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), "model")
        .agg(F.count("*").alias("n"), F.avg("score_given").alias("mean_score"), *[F.count_if(verdict == v).alias(f"n_{v.lower()}") for v in ("ALLOW", "HOLD", "BLOCK")])
        .select(F.col("w.start").alias("start"), "model", "n", "mean_score", "n_allow", "n_hold", "n_block")
    )


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on every micro-batch and writes its rows under the batch's number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
