"""The terrain conditioning run: from raw elevations to a carved surface with its quality report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H
from fluvia.functions.tables import settled
from fluvia.operators import fixpoint, forest, nearest, stencil, summaries
from fluvia.sources import rasters


@dataclass(frozen=True)
class Conditioning:
    """Settings; lengths in metres, areas in km2."""

    cell_m: float = 30.0
    fill_reach: int = 3
    flat_increment: float = 0.01
    breach_pits: bool = True
    pit_min_depth: float = 5.0
    pit_max_lowering: float = 15.0
    pit_max_length: int = 5
    river_min_area_km2: float = 100.0
    width: tuple[float, float] = (H.WIDTH_COEFFICIENT, H.WIDTH_EXPONENT)
    depth: tuple[float, float] = (H.DEPTH_COEFFICIENT, H.DEPTH_EXPONENT)
    width_cap: float | None = None
    depth_cap: float = 50.0
    bed_min_slope: float = 1e-5
    surface_max_lowering: float | None = None
    lowering_cap: float = 50.0
    lowering_error: float = 100.0
    carve_mode: str = "wide"
    tile: int = 256


@dataclass(frozen=True)
class Conditioned:
    cells: DataFrame
    pits: DataFrame | None
    delta: DataFrame
    scorecard: DataFrame


def run(cells: DataFrame, config: Conditioning, z: str = "z") -> Conditioned:
    """Fill small gaps, breach pits, route on a monotone surface, find rivers, carve them; ``cells(row, col, cell_id, z)``."""
    c = config
    raw = cells.select("row", "col", "cell_id", F.col(z).alias("raw"))
    clean = settled(rasters.gaps_filled(raw.withColumn("z", F.col("raw")), "z", c.fill_reach) if c.fill_reach else raw.withColumn("z", F.col("raw")))
    pits = None
    surface = clean.where("z is not null")
    if c.breach_pits:
        breached, pits = fixpoint.pit_breaches(surface, "z", c.pit_min_depth, c.pit_max_lowering, c.pit_max_length, c.flat_increment, c.tile)
        surface = settled(surface.drop("z").join(breached.select("cell_id", F.col("conditioned").alias("z")), "cell_id"))
    routing = fixpoint.routing_surface(surface, "z", c.flat_increment, tile=c.tile)
    linked = settled(stencil.receivers(surface.join(routing.select("cell_id", "routing"), "cell_id"), "routing", "d4", c.cell_m, c.cell_m))
    area = forest.accumulation(linked).select("cell_id", (F.col("accumulation") * (c.cell_m**2 / 1e6)).alias("area_km2"))
    river = settled(linked.join(area, "cell_id").withColumn("river", F.col("area_km2") >= c.river_min_area_km2))
    shaped = river.withColumns({"width": H.river_power_law("area_km2", "river", *c.width, c.width_cap), "depth": F.least(H.river_power_law("area_km2", "river", *c.depth), F.lit(float(c.depth_cap)))})
    bed = forest.conditioned_depth(shaped, "z", "depth", "river", c.bed_min_slope * c.cell_m, c.depth_cap)
    shaped = settled(shaped.drop("depth").join(bed, "cell_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0.0))))
    if c.surface_max_lowering:
        lowered = forest.conditioned_surface(shaped, "z", "depth", "river", c.bed_min_slope * c.cell_m, c.surface_max_lowering)
        shaped = shaped.join(lowered.select("cell_id", "surface"), "cell_id", "left").withColumn("z", F.coalesce("surface", "z")).drop("surface")
    carved = shaped.withColumn("lowering", H.equivalent_lowering("width", "depth", c.cell_m, c.carve_mode, c.lowering_error))
    worst = carved.agg(F.max("lowering")).first()[0]
    if worst is not None and worst >= c.lowering_error:
        raise ValueError(f"a river cell would be lowered by {worst:.6g} m")
    carved = carved.withColumn("lowering", F.least("lowering", F.lit(float(c.lowering_cap))))
    out = settled(carved.withColumn("final", F.col("z") - F.col("lowering")))
    whole = out.join(raw.select("cell_id", "raw").withColumnRenamed("raw", "_raw"), "cell_id")
    delta = summaries.delta_summary(whole, "_raw", "final")
    sills = stencil.channel_bed_sills(out, "z", "depth", "river")
    parts = fixpoint.connectivity(out, "river")
    facts = delta.select("changed_percent", "max_lowering_m").crossJoin(out.agg(F.max("lowering").alias("max_h_abg_m"))).crossJoin(sills.agg(F.max("sill").alias("max_sill_m"))).crossJoin(parts.select(F.col("largest_percent").alias("largest_component_percent")))
    return Conditioned(out, pits, delta, summaries.scorecard(facts))


def smoothed_artifacts(cells: DataFrame, z: str, smooth: str, cell_m: float, streams: str | None = None, buffer_m: float = 90.0, percent: float = 99.0, least_deg: float = 30.0) -> DataFrame:
    """Steep cells away from streams take the smoothed surface; adds ``artifact``."""
    sloped = settled(stencil.slope_degrees(cells, z, cell_m, cell_m))
    level = sloped.agg(F.greatest(F.percentile("slope_deg", percent / 100), F.lit(float(least_deg))).alias("_level"))
    if streams:
        near = nearest.within(cells, F.col(streams), buffer_m, cell_m, cell_m)
        sloped = sloped.join(near, "cell_id")
    away = ~F.coalesce(F.col("within"), F.lit(False)) if streams else F.lit(True)
    out = sloped.crossJoin(F.broadcast(level)).withColumn("artifact", (F.col("slope_deg") >= F.col("_level")) & away)
    return out.withColumn(z, H.replace_where(z, smooth, "artifact")).drop("_level", "slope_deg", "within")
