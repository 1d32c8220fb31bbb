"""Event-time roll-ups over a stream (the batch operators have no streaming counterpart to match)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and value sums by window and type; rows later than ``late`` are left out of a stream's state."""
    events = events.withColumn("ts", events["ts"].cast("timestamp"))  # a watermark needs a timestamp with a zone
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def streamed(spark: SparkSession, path: str, schema, out: str, checkpoint: str, **options) -> DataFrame:
    """Run the roll-up over a folder as one stream to its end; the sink and the checkpoint allow a restart."""
    q = windowed_counts(spark.readStream.schema(schema).parquet(path), **options).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
