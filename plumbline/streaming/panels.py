"""A panel kept up to date from a stream of readings: windowed means with a watermark, then last-value scores per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rolling_means(readings: DataFrame, unit: str, ts: str, value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(unit, period, mean, n) per window; readings later than the watermark are dropped, and state is too."""
    w = readings.withWatermark(ts, late).groupBy(F.col(unit).alias("unit"), F.window(ts, every).alias("_w"))
    out = w.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select("unit", F.col("_w.start").alias("period"), "mean", "n")


def keep_panel(means: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished windows to a Parquet panel; a restart goes on from the checkpoint, each window once."""
    return means.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
