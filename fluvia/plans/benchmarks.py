"""Analytic terrains with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The published tilted-V catchment: two planes of 1000 m by 800 m beside a channel of 20 m; fixed values.
V_LENGTH, V_PLANE, V_CHANNEL, V_SIDE_SLOPE, V_CHANNEL_SLOPE, V_RAIN_MM_H = 1000.0, 800.0, 20.0, 0.05, 0.02, 10.8


def tilted_v(spark: SparkSession, cell_m: float = 20.0) -> DataFrame:
    """row, col, cell_id, x, y, z, channel of the tilted-V catchment, outlet at the south end of the channel."""
    rows, cols = int(V_LENGTH / cell_m), int((2 * V_PLANE + V_CHANNEL) / cell_m)
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.col("id").alias("cell_id"))
    x, y = (F.col("col") + 0.5) * cell_m, V_LENGTH - (F.col("row") + 0.5) * cell_m
    aside = F.greatest(F.abs(x - (V_PLANE + V_CHANNEL / 2)) - V_CHANNEL / 2, F.lit(0.0))
    return grid.withColumns({"x": x, "y": y}).withColumns({"channel": aside == 0, "z": V_CHANNEL_SLOPE * F.col("y") + V_SIDE_SLOPE * aside})


def equilibrium_discharge() -> float:
    """Rain times area of the tilted V in m3/s."""
    return V_RAIN_MM_H / 1000 / 3600 * (2 * V_PLANE + V_CHANNEL) * V_LENGTH


def uniform_channel(spark: SparkSession, length: float, width: float, bank: float, depth: float, slope: float, cell_m: float) -> DataFrame:
    """row, col, cell_id, z, channel: a straight channel of one width in a sloping plain."""
    rows, cols = int(length / cell_m), int((width + 2 * bank) / cell_m)
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.col("id").alias("cell_id"))
    x, y = (F.col("col") + 0.5) * cell_m, length - (F.col("row") + 0.5) * cell_m
    inside = F.abs(x - (bank + width / 2)) < width / 2
    return grid.withColumn("channel", inside).withColumn("z", slope * y - F.when(inside, depth).otherwise(0.0))
