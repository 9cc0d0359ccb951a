"""The mesh product: a mesh of a domain, its overlap with the terrain grid, sub-grid curves, and a manifest."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import labels as L
from fluvia.functions.tables import settled
from fluvia.operators import mesh, overlap, polygons, subgrid

CONTRACT = {"version": "1.0", "index_base": "0", "raster_order": "south_up_row_major", "boundary_neighbor": "-1", "length_unit": "m"}


@dataclass(frozen=True)
class Grid:
    """A north-up grid of square cells."""

    rows: int
    cols: int
    x0: float
    y0: float
    cell_m: float
    projected: bool = True


@dataclass(frozen=True)
class Mesh:
    faces: DataFrame
    edges: DataFrame
    overlap: DataFrame
    contract: DataFrame


def contract_table(spark, product: str) -> DataFrame:
    """key, value of the contract that a product keeps."""
    return spark.createDataFrame([*sorted({**CONTRACT, "product": product}.items())], "key string, value string")


def face_numbers(cells: DataFrame, grid: Grid) -> DataFrame:
    """Valid cells with gapless face ids in row-major order: counts of the rows before, then the place in the row."""
    from pyspark.sql import Window

    counts = cells.groupBy("row").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("row", F.coalesce(F.sum("_n").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    return cells.withColumn("_place", place).join(F.broadcast(before), "row").withColumn("face_id", (F.col("_before") + F.col("_place")).cast("long")).drop("_place", "_before")


def regular(cells: DataFrame, grid: Grid) -> Mesh:
    """A quad for every valid cell of ``cells(row, col, cell_id, z)``."""
    if not grid.projected:
        raise ValueError("a mesh needs a projected grid in metres")
    valid = settled(face_numbers(cells.where("z is not null"), grid))
    edges = settled(mesh.regular_edges(valid, grid.cell_m, grid.cell_m))
    area = float(grid.cell_m**2)
    faces = valid.select("face_id", "row", "col", "z", F.lit(area).alias("area_m2")).join(mesh.cfl_widths(edges), "face_id")
    return Mesh(faces, edges, overlap.regular_overlap(valid, grid.rows, grid.cols, area), contract_table(cells.sparkSession, "regular"))


def voronoi(cells: DataFrame, seeds: DataFrame, domain: list[tuple[float, float]], grid: Grid, tile: float, halo: float, classes: DataFrame | None = None) -> Mesh:
    """Voronoi cells of ``seeds(face_id, x, y)`` over a domain, their faces, exact overlap and mean terrain.

    Raises where cells fail the mesh contract or the overlap does not cover them.
    """
    shapes = settled(polygons.voronoi(seeds, domain, tile, halo))
    edges = settled(mesh.mesh_edges(shapes))
    broken = [r["check"] for r in mesh.validation(shapes, edges).where("failures > 0").collect()]
    if broken:
        raise ValueError(f"the mesh breaks its contract: {', '.join(broken)}")
    over = settled(polygons.raster_overlap(shapes, grid.x0, grid.y0, grid.cell_m, grid.cell_m, grid.rows, grid.cols))
    area = mesh.faces(shapes)
    gaps = overlap.invalid_overlap(over, area.select(F.col("face_id").alias("mesh_index"), F.col("area").alias("mesh_area_m2")), 1e-8)
    if gaps.limit(1).count():
        raise ValueError("the raster does not cover the mesh")
    raster = cells.select(((grid.rows - 1 - F.col("row")) * F.lit(grid.cols).cast("long") + F.col("col")).alias("raster_index"), "z")
    terrain = overlap.mesh_means(over, area.select(F.col("face_id").alias("mesh_index"), F.col("area").alias("mesh_area_m2")), raster, "z").withColumnRenamed("mesh_index", "face_id")
    faces = area.select("face_id", F.col("area").alias("area_m2"), "perimeter", "cx", "cy").join(terrain, "face_id").join(mesh.cfl_widths(edges), "face_id")
    if classes is not None:
        faces = faces.join(classes, "face_id", "left")
    return Mesh(faces, edges, over, contract_table(cells.sparkSession, "voronoi"))


def subgrid_curves(product: Mesh, cells: DataFrame, grid: Grid, feature_class: str, policy: str = "river", manning_n: float = 0.035, samples: int = 11) -> tuple[DataFrame, DataFrame]:
    """(cell curves, face curves) of a mesh.

    Cells of the policy store water by their terrain patches, others as flat prisms. Internal faces between two such cells
    follow sampled terrain, never below either cell's lowest point; others are flat.
    """
    raster = cells.select("row", "col", "z", ((grid.rows - 1 - F.col("row")) * F.lit(grid.cols).cast("long") + F.col("col")).alias("raster_index"))
    patches = product.overlap.join(raster.select("raster_index", "z"), "raster_index").select(F.col("mesh_index").alias("cell"), "area_m2", "z")
    plan = product.faces.select(F.col("face_id").alias("cell"), F.col("area_m2").alias("plan_area_m2"), F.col("z").alias("bed_mean"), L.subgrid_policy(F.col(feature_class), policy).alias("pooled"))
    curves = settled(subgrid.cell_volume_curves(patches, plan, pooled="pooled", bed_mean="bed_mean"))
    datum = curves.select(F.col("cell"), "datum_m").join(plan.select("cell", "pooled"), "cell")
    a, b = datum.select(F.col("cell").alias("owner"), F.col("datum_m").alias("_da"), F.col("pooled").alias("_pa")), datum.select(F.col("cell").alias("neighbor"), F.col("datum_m").alias("_db"), F.col("pooled").alias("_pb"))
    inner = product.edges.where("neighbor >= 0").withColumn("face", F.xxhash64("owner", "neighbor")).join(a, "owner").join(b, "neighbor").withColumn("low", F.least("_da", "_db"))
    if "mx" in inner.columns:
        half = F.col("length_m") / 2
        t = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
        spots = inner.where("_pa and _pb").withColumn("_k", t).withColumn("station", F.col("_k") * F.col("length_m") / (samples - 1))
        spots = spots.withColumns({"x": F.col("mx") - F.col("ny") * (F.col("station") - half), "y": F.col("my") + F.col("nx") * (F.col("station") - half)})
        at = {"row": F.least(F.greatest(F.floor((grid.y0 - F.col("y")) / grid.cell_m), F.lit(0)), F.lit(grid.rows - 1)).cast("int"), "col": F.least(F.greatest(F.floor((F.col("x") - grid.x0) / grid.cell_m), F.lit(0)), F.lit(grid.cols - 1)).cast("int")}
        ground = spots.withColumns(at).join(raster.select("row", "col", F.col("z").alias("_z")), ["row", "col"], "left")
        point = F.struct("station", F.greatest("_z", "low").alias("bed"), F.lit(float(manning_n)).alias("n"))
        sampled = ground.groupBy("face").agg(F.sort_array(F.collect_list(point)).alias("points"))
        rest = inner.where("not (_pa and _pb)")
    else:
        sampled, rest = None, inner
    flat = subgrid.flat_profiles(rest.select("face", "length_m", F.greatest("_da", "_db").alias("bed"), F.lit(float(manning_n)).alias("n")))
    profiles = flat if sampled is None else sampled.unionByName(flat)
    return curves, subgrid.face_conveyance_curves(profiles)


def settings_digest(values: dict) -> str:
    """SHA-256 of the settings as canonical JSON."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def manifest(spark, folder: str, values: dict) -> DataFrame:
    """path, bytes, sha256 of a product's files, with the digest of its settings."""
    from fluvia.sources.vectors import file_facts

    return file_facts(spark, folder).select("path", "bytes", "sha256", F.lit(settings_digest(values)).alias("settings_sha256"))
