"""Structured Streaming ingest (an extension): late-tolerant windows of arriving samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_state(samples: DataFrame, *, time: str = "ts", receiver: str = "receiver", value: str = "value", length: str = "1 day", step: str | None = None, late: str = "6 hours", expected: int | None = None) -> DataFrame:
    """Count, rms and completeness of event-time windows per receiver; rows later than ``late`` behind
    the newest are dropped by the watermark, which also bounds the state."""
    w = F.window(time, length, step) if step else F.window(time, length)
    agg = samples.withWatermark(time, late).groupBy(receiver, w.alias("w")).agg(
        F.count(value).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms")
    )
    done = F.lit(True) if expected is None else F.col("n") >= expected
    return agg.select(receiver, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rms", done.alias("complete"))


def trigger_sessions(samples: DataFrame, threshold: float, gap: str, *, time: str = "ts", receiver: str = "receiver", value: str = "value", late: str = "6 hours") -> DataFrame:
    """Trigger periods of a stream: sessions of samples above a threshold, closed by a gap."""
    on = samples.withWatermark(time, late).where(F.col(value) >= threshold)
    s = on.groupBy(receiver, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("peak"))
    return s.select(receiver, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")
