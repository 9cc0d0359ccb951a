"""Event streams of gauge readings: windowed statistics, and alarms when a level holds above its bank.

The batch operators have no streams of their own; these take the same expressions to event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H


def windowed(readings: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, gauge, readings, mean, highest of ``readings(ts, gauge, value)`` by event-time window; late rows within ``late`` count."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = readings.withWatermark("ts", late).groupBy(window, "gauge").agg(F.count(F.lit(1)).alias("readings"), F.avg("value").alias("mean"), F.max("value").alias("highest"))
    return out.select(F.col("window.start").alias("start"), "gauge", "readings", "mean", "highest")


def discharge(readings: DataFrame, gauges: DataFrame, manning_n: float = 0.035) -> DataFrame:
    """Readings with the discharge of their gauge's rectangular section(gauge, bed, width, slope): a stream-static join."""
    depth = F.greatest(F.col("value") - F.col("bed"), F.lit(0.0))
    return readings.join(gauges, "gauge").withColumn("discharge_m3s", H.rectangular_conveyance("width", depth, manning_n) * F.sqrt("slope"))


def sessions(readings: DataFrame, bank: float, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, gauge, readings, highest of floods: readings above the bank with no longer gap between them."""
    out = readings.where(F.col("value") > bank).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "gauge").agg(F.count(F.lit(1)).alias("readings"), F.max("value").alias("highest"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "gauge", "readings", "highest")
