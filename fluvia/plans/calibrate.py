"""Spatial hydraulic calibration: links and zones by threshold, sample flags, fits, maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H
from fluvia.functions import labels as L
from fluvia.functions.tables import settled
from fluvia.operators import calibration, forest, nearest, stencil


@dataclass(frozen=True)
class Calibration:
    cell_m: float = 30.0
    x0: float = 0.0
    y0: float = 0.0
    max_distance: float = 5000.0
    ratios: tuple[float, float] = (0.1, 10.0)
    min_boundary: float = 0.0
    min_samples: int = 30
    min_range: float = 0.35
    max_mad: float = 3.5
    min_residual: float = 0.35
    area_source: str = "lin"


def zoned(cells: DataFrame, threshold_km2: float, cell_m: float) -> DataFrame:
    """Cells with stream mask, zone, nearest stream's area and distance, and distance to the zone's edge."""
    streams = settled(cells.withColumn("stream", F.col("area_km2") >= threshold_km2))
    zones = forest.zones(streams, "stream")
    near = nearest.nearest_source(streams, F.col("stream"), cell_m, cell_m)
    area = streams.select(F.col("cell_id").alias("source_id"), F.col("area_km2").alias("nearest_d4_area_km2"))
    rows = settled(streams.join(zones, "cell_id").join(near.join(area, "source_id", "left").withColumnRenamed("distance", "nearest_d4_distance_m").drop("source_id"), "cell_id"))
    # A zone is named by a cell id from 0, so it is raised by one: 0 means none.
    named = rows.withColumn("zone_id", F.coalesce(F.col("zone") + 1, F.lit(0))).drop("zone")
    edge = stencil.zone_boundary(named, "zone_id")
    apart = nearest.nearest_source(edge, F.col("boundary"), cell_m, cell_m).select("cell_id", F.col("distance").alias("zone_boundary_distance_m"))
    return named.join(apart, "cell_id")


def samples(cells: DataFrame, reaches: DataFrame, config: Calibration) -> DataFrame:
    """Flagged sample table of ``reaches(COMID, vertices, lin_area_km2, lin_width_m, lin_depth_m)`` at their midpoints."""
    c = config
    mid = calibration.midpoints(reaches).drop("vertices")
    bands = ["zone_id", "nearest_d4_area_km2", "nearest_d4_distance_m", "zone_boundary_distance_m"]
    rows = calibration.sampled(mid, cells, c.x0, c.y0, c.cell_m, c.cell_m, bands)
    rows = rows.withColumn("area_ratio_lin_to_nearest_d4", F.col("lin_area_km2") / F.nullif("nearest_d4_area_km2", F.lit(0.0)))
    return L.fit_area(L.quality_flags(rows, c.max_distance, *c.ratios, c.min_boundary), c.area_source)


def threshold_row(cells: DataFrame, reaches: DataFrame, threshold_km2: float, config: Calibration) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(summary row, zone coefficients, samples, zoned cells) of one threshold."""
    c = config
    grid = settled(zoned(cells, threshold_km2, c.cell_m))
    table = settled(samples(grid, reaches, c))
    zones, fits = calibration.fit_zones(table, c.min_samples, c.min_range, c.max_mad, c.min_residual, L.train_mask(F.col("COMID")))
    zones = settled(zones)
    counts = grid.agg(F.count_if("stream").alias("stream_cells"), F.countDistinct(F.when(F.col("stream"), F.col("zone_id"))).alias("stream_links"), F.count_if(F.col("zone_id") > 0).alias("zoned_cells"))
    flags = table.agg(F.count(F.lit(1)).alias("samples_total"), *[F.count_if(f).alias(f"samples_{f}") for f in ("basic_valid", "passes_distance", "passes_area_ratio", "passes_boundary", "calibration_valid")])
    local = zones.agg(F.count_if("local_fit_valid").alias("local_fit_valid_zones"), F.count(F.lit(1)).alias("total_sampled_zones"), (100.0 * F.sum(F.when(F.col("local_fit_valid"), F.col("calibration_samples")).otherwise(0)) / F.nullif(F.sum("calibration_samples"), F.lit(0))).alias("local_fit_valid_sample_percent"))
    row = counts.crossJoin(flags).crossJoin(local).crossJoin(calibration.evaluate(table, zones, fits)).select(F.lit(float(threshold_km2)).alias("threshold_km2"), "*")
    return row, zones, table, grid


def sweep(cells: DataFrame, reaches: DataFrame, thresholds: list[float], config: Calibration) -> DataFrame:
    """Summary rows of several thresholds, in order."""
    return calibration.threshold_sweep([threshold_row(cells, reaches, t, config)[0] for t in thresholds]).orderBy("threshold_km2")


def maps(grid: DataFrame, table: DataFrame, config: Calibration, least_area: float, max_lowering: float) -> DataFrame:
    """Cells with coefficients fitted on all valid samples, and calibrated width, depth and lowering."""
    c = config
    zones, fits = calibration.fit_zones(table, c.min_samples, c.min_range, c.max_mad, c.min_residual)
    out = calibration.coefficient_maps(grid, zones, fits)
    river = F.col("area_km2") >= least_area
    out = out.withColumns({"width_m": F.when(river, H.power_law("area_km2", "beta_1", "beta_2")), "depth_m": F.when(river, H.power_law("area_km2", "alfa_1", "alfa_2"))})
    return out.withColumn("lowering_m", F.when(river, H.equivalent_lowering("width_m", "depth_m", c.cell_m, "wide", max_lowering)))
