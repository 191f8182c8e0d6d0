"""Requests as a stream: a directory of JSON files solved as they come, and shares that expire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def request_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """instance_id, body and arrival of the request files of a directory."""
    lines = spark.readStream.schema("instance_id long, body string, arrived timestamp").option("maxFilesPerTrigger", files_at_once).json(path)
    return lines.withWatermark("arrived", "1 hour")


def solve_stream(stream: DataFrame, solve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Each micro-batch runs the same plan as a batch job; its folder is named by the batch, so a replay replaces it."""

    def each(batch: DataFrame, epoch: int) -> None:
        solve(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_window(stream: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Requests per strategy and window of arrival; late ones count until the watermark passes."""
    strategy = F.coalesce(F.get_json_object("body", "$.strategy"), F.lit("kmeans"))
    return stream.groupBy(F.window("arrived", width).alias("w"), strategy.alias("strategy")).count().select(F.col("w.start").alias("start"), "strategy", "count")


def live_shares(stream: DataFrame, ttl: str = "30 days") -> DataFrame:
    """First sight of each token within its life: repeats are dropped, and state ends with the watermark."""
    return stream.withWatermark("created", ttl).dropDuplicatesWithinWatermark(["token"])
