"""Conservative transfer between rasters and meshes over ``overlap(mesh_index, raster_index, area_m2)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raster_to_mesh_weights(overlap: DataFrame, mesh_area: DataFrame) -> DataFrame:
    """mesh_index, raster_index, weight: share of the mesh cell."""
    return overlap.join(mesh_area, "mesh_index").select("mesh_index", "raster_index", (F.col("area_m2") / F.col("mesh_area_m2")).alias("weight"))


def mesh_to_raster_weights(overlap: DataFrame, raster_area: DataFrame) -> DataFrame:
    """raster_index, mesh_index, weight: share of the raster cell."""
    return overlap.join(raster_area, "raster_index").select("raster_index", "mesh_index", (F.col("area_m2") / F.col("raster_area_m2")).alias("weight"))


def mesh_means(overlap: DataFrame, mesh_area: DataFrame, raster: DataFrame, value: str = "value") -> DataFrame:
    """mesh_index and the area-weighted mean of a raster value."""
    weights = raster_to_mesh_weights(overlap, mesh_area)
    return weights.join(raster.select("raster_index", value), "raster_index").groupBy("mesh_index").agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def class_fractions(overlap: DataFrame, mesh_area: DataFrame, labels: DataFrame, classes: list, label: str = "label") -> DataFrame:
    """mesh_index and one column of area fractions for each class."""
    weights = raster_to_mesh_weights(overlap, mesh_area).join(labels.select("raster_index", label), "raster_index")
    return weights.groupBy("mesh_index").agg(*[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("weight"))), F.lit(0.0)).alias(f"fraction_{c}".lower().replace("-", "_").replace(" ", "_")) for c in classes])


def raster_depths(overlap: DataFrame, raster_area: DataFrame, depths: DataFrame, depth: str = "depth_m") -> DataFrame:
    """raster_index and the depth that keeps each mesh cell's volume."""
    weights = mesh_to_raster_weights(overlap, raster_area)
    return weights.join(depths.select("mesh_index", depth), "mesh_index").groupBy("raster_index").agg(F.sum(F.col("weight") * F.col(depth)).alias(depth))


def invalid_overlap(overlap: DataFrame, mesh_area: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """mesh_index, reason of every breach: areas that are not positive, unknown cells, cells not covered exactly."""
    bad = overlap.where(~F.coalesce((F.col("area_m2") > 0) & (F.col("area_m2") < float("inf")), F.lit(False))).select("mesh_index", F.lit("area").alias("reason"))
    unknown = overlap.join(mesh_area, "mesh_index", "left_anti").select("mesh_index", F.lit("unknown cell").alias("reason")).distinct()
    closed = mesh_area.join(overlap.groupBy("mesh_index").agg(F.sum("area_m2").alias("_sum")), "mesh_index", "left")
    gap = F.abs(F.coalesce("_sum", F.lit(0.0)) - F.col("mesh_area_m2")) > tolerance * F.col("mesh_area_m2")
    return bad.unionByName(unknown).unionByName(closed.where(gap).select("mesh_index", F.lit("closure").alias("reason")))


def regular_overlap(faces: DataFrame, rows: int, cols: int, cell_area: float) -> DataFrame:
    """The identity overlap of a regular mesh ``faces(face_id, row, col)``; raster indices count rows from the south."""
    south_up = (rows - 1 - F.col("row")) * F.lit(cols).cast("long") + F.col("col")
    return faces.select(F.col("face_id").alias("mesh_index"), south_up.alias("raster_index"), F.lit(float(cell_area)).alias("area_m2"))


def area_mean_resample(source: DataFrame, value: str, dx: float, x0: float, y0: float, target_dx: float) -> DataFrame:
    """row, col, value of a target grid: means weighted by exact overlap of source cells (x, y centres); same axes."""
    low = lambda c: F.floor(c / target_dx)
    x, y = F.col("x") - x0, y0 - F.col("y")
    span = lambda c: F.sequence(low(c - dx / 2 + 1e-9 * dx), low(c + dx / 2 - 1e-9 * dx))
    hit = source.where(F.col(value).isNotNull()).select(F.col(value), x.alias("_x"), y.alias("_y")).withColumn("col", F.explode(span(F.col("_x")))).withColumn("row", F.explode(span(F.col("_y"))))
    part = lambda c, k: F.least(c + dx / 2, (k + 1) * target_dx) - F.greatest(c - dx / 2, k * target_dx)
    weight = part(F.col("_x"), F.col("col")) * part(F.col("_y"), F.col("row"))
    return hit.withColumn("_w", weight).groupBy("row", "col").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))
