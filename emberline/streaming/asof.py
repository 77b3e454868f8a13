"""A streaming view of evidence: late rows by watermark, repeats by key within it, windowed counts.

The reference has no streams; this is the as-of cutoff carried over to an unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, time: str, key: str, kind: str, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window start, kind, n: distinct keys in tumbling windows; rows later than delay are dropped."""
    once = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), kind, "n")
