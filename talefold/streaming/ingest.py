"""Incremental ingest: a stream of story files or chunks into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talefold.config import EngineConfig
from talefold.operators.collection import Collection
from talefold.plans.pipeline import collection_rows


def story_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """title, text of .txt files as they arrive in a folder."""
    lines = spark.readStream.option("pathGlobFilter", "*.[tT][xX][tT]").option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return lines.select(F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"(?i)\.txt\z", "").alias("title"), F.col("value").alias("text"))


def ingest(stories: DataFrame, target: Collection, checkpoint: str, cfg: EngineConfig = EngineConfig(), once: bool = True) -> StreamingQuery:
    """Chunk and upsert each micro-batch; the batch number is the version, so a batch that is run again changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        target.upsert(collection_rows(batch, cfg, number))

    writer = stories.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def late_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped and its windows' state goes."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
