"""New artifacts as a stream: values that arrive are checked and counted, late ones within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_new(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """Parquet files as they appear below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def arrivals(stream: DataFrame, label: str, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and value sums by window and label; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), label).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), label, "n", "value")


def preprocess_stream(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Every batch of new cells goes through ``transform`` and is written as its own folder, once even on retry."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
