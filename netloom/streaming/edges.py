"""Incremental networks from a stream of events (Structured Streaming).

An event names two vertices and a weight; edges accumulate by window of event time, and
events later than the watermark are dropped. The same function runs on a batch, so that a
stream's final windows can be compared with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(events: DataFrame, ts: str, src: str, dst: str, weight: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """gid (the window's start), src < dst, weight, n of events(ts, src, dst, weight). Loops
    are left out."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":  # watermarks need an instant: the session's zone gives it
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = events.withWatermark(ts, late).where(F.col(src) != F.col(dst))
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    pair = [F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")]
    sums = e.groupBy(w.alias("w"), *pair).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    return sums.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("gid"), F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "n")


def write_edges(edges: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Appends closed windows to Parquet; the checkpoint makes restarts exact."""
    out = edges.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
