"""The daily feature run as a stream: events in, look-back counts and upserts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def watermarked(events: DataFrame, time: str = "ts", late: str = "3 days") -> DataFrame:
    """Events that drop out of state once they are later than ``late``; to be set once per stream."""
    return events.withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "stock_id", span: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Watermarked events per key and sliding window."""
    grouped = events.groupBy(F.window(time, span, slide), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.end").alias("as_of"), key, "n", "mean_value")


def without_repeats(events: DataFrame, key: str) -> DataFrame:
    """Each key of watermarked events once within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def upsert_stream(rows: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run what is there now and hand each micro-batch to ``write`` (an overwrite by key, so replays are harmless)."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: write(df)).start()
