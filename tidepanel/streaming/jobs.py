"""Structured Streaming jobs on ticks (ST): bars and shooters.

Late rows: the reference ignores them, since it only reads what is newer than the
last row; here a watermark bounds lateness and state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def clean(ticks: DataFrame) -> DataFrame:
    """ST-1, F-12: ticks without a price go."""
    return ticks.where("price is not null and price <> 0")


def bars(ticks: DataFrame, size: str = "1 hour", late: str = "2 minutes") -> DataFrame:
    """ST-3: tumbling bars by event time; of equal times the larger id is later."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    k = F.struct("ts", "event_id")
    b = clean(ticks).groupBy(F.window("ts", size).alias("w"), "entity_id").agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count("*").alias("n"))
    return b.select("entity_id", C("w.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "n")


def shooters(ticks: DataFrame, size: str = "12 hours", slide: str = "6 hours", up: float = 0.03, down: float = -0.03, late: str = "2 minutes") -> DataFrame:
    """ST-4: first-to-last change within sliding windows beyond the thresholds."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    k = F.struct("ts", "event_id")
    g = clean(ticks).groupBy(F.window("ts", size, slide).alias("w"), "entity_id").agg(F.min_by("price", k).alias("first"), F.max_by("price", k).alias("last"))
    change = F.try_divide(C("last") - C("first"), F.abs("first"))
    return g.select("entity_id", C("w.start").cast("timestamp_ntz").alias("start"), change.alias("change")).where((C("change") >= up) | (C("change") <= down))


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stop. ``sink`` is a folder for Parquet or a function of each batch (ST-2, ST-7, ST-11)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)
    w.start().awaitTermination()
