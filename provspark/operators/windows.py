"""Event-time windows over records; for batch tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """By keys and window: window_start, window_end and the aggregates. slide: sliding windows; late: a watermark, for streams."""
    source = df.withWatermark(ts, late) if late else df
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return source.groupBy(*keys, span.alias("_w")).agg(*aggregates).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """By keys and session, which ends gap after its last record."""
    source = df.withWatermark(ts, late) if late else df
    return source.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(*aggregates).withColumns({"session_start": F.col("_w.start"), "session_end": F.col("_w.end")}).drop("_w")
