"""Scoring and windowed counts on streams.

A frozen threshold makes scoring stateless, so the column builders of the batch
side are used as they are. Counts by event time need a watermark; a window is
final, and emitted once, when the watermark passes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, width: str, truth: Column, flagged: Column, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """``started`` and confusion counts for each window, and for each value of ``by``."""
    from ..operators.metrics import counts

    keys = [F.window(at, width), *(by or [])]
    sums = events.withWatermark(at, late).groupBy(*keys).agg(*counts(truth, flagged))
    return sums.select(F.col("window.start").alias("started"), *(by or []), "tp", "fn", "fp", "tn")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without those that repeat a key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there now into Parquet files, and stop; a restart goes on where it stopped."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
