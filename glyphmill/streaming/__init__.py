"""Replies and events as they come: late rows, re-sent rows, running outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reply_stream(spark: SparkSession, path: str, schema: str, files_a_time: int = 1) -> DataFrame:
    """Replies from a folder of parquet files that grows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_time).parquet(path)


def once(replies: DataFrame, late: str = "30 days") -> DataFrame:
    """Each reply once: the same reader, region and text within the watermark is a re-sent one.

    State is kept no longer than the watermark says, so a copy that comes later counts anew.
    """
    timed = replies.withColumn("at", F.col("submitted_at").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["reader_id", "region_key", "fa"])


def answers_by_window(replies: DataFrame, late: str = "30 days", width: str = "7 days") -> DataFrame:
    """Replies and answers per series and window of their own time; a window closes after the watermark."""
    timed = replies.withColumn("at", F.col("submitted_at").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", width), "series_id").agg(F.count("*").alias("replies"), F.count("answer").alias("answers"))
    return counted.select("series_id", F.col("window.start").alias("start"), "replies", "answers")


def upsert_batches(stream: DataFrame, target: str, checkpoint: str, key: str = "region_key", order: str = "received_at"):
    """A query that keeps the newest row of each key in versioned folders under ``target``.

    Each batch writes a new version from the last and its own rows, then names it in `current`; a
    batch that is run again writes the same version again.
    """
    from glyphmill.operators.windows import latest
    from glyphmill.sources.writers import replace_bytes

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = batch.unionByName(spark.read.parquet(f"{target}/v{number - 1}"))
        latest(rows, [key], [F.desc(order), F.desc("ws_key")]).write.mode("overwrite").parquet(f"{target}/v{number}")
        replace_bytes(f"{target}/current", f"v{number}".encode())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
