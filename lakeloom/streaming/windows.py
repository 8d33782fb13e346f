"""Tumbling, hopping and session windows over a batch or a stream (an extension of the engine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grouped(df: DataFrame, time: str, span: Column, keys, aggregates: dict[str, Column], late: str | None) -> DataFrame:
    source = df.withColumn(time, F.col(time).cast("timestamp"))
    if df.isStreaming:
        source = source.withWatermark(time, late or "10 minutes")
    made = source.groupBy(span.alias("__w"), *[F.col(k) for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])
    return made.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *keys, *aggregates)


def tumble(df: DataFrame, time: str, size: str, aggregates: dict[str, Column], keys=(), late: str | None = None) -> DataFrame:
    """Windows of one size that do not overlap.  On a stream rows later than ``late`` are dropped by the watermark."""
    return _grouped(df, time, F.window(time, size), keys, aggregates, late)


def hop(df: DataFrame, time: str, size: str, slide: str, aggregates: dict[str, Column], keys=(), late: str | None = None) -> DataFrame:
    """Windows of one size that start every ``slide``."""
    return _grouped(df, time, F.window(time, size, slide), keys, aggregates, late)


def session(df: DataFrame, time: str, gap: str, aggregates: dict[str, Column], keys=(), late: str | None = None) -> DataFrame:
    """Runs of rows of one key with no pause of ``gap`` or more."""
    return _grouped(df, time, F.session_window(time, gap), keys, aggregates, late)
