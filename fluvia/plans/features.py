"""Candidate features of a mesh: major rivers, floodplains, urban areas, waterbodies, and their classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.functions import labels as L
from fluvia.functions.tables import settled
from fluvia.operators import fixpoint, mesh, nearest, stencil


@dataclass(frozen=True)
class Candidates:
    """Settings; lengths in metres, areas in m2 unless named otherwise."""

    cell_m: float = 30.0
    river_area_km2: float = 50.0
    river_width: float = 45.0
    hand: float = 8.0
    distance: float = 900.0
    minimum_area: float = 1e5
    hole_area: float = 1e4
    minimum_width: float = 0.0
    water_area: float = 2e4
    water_distance: float = 300.0
    impervious_percent: float = 1.0
    people_km2: float = 1000.0
    urban_buffer: float = 300.0
    refinement: tuple[float, float] = (0.25, 2.0)


def major_rivers(cells: DataFrame, config: Candidates) -> DataFrame:
    """Add ``major``: river cells wide enough or with enough catchment; all river cells where that leaves none."""
    wide = F.coalesce(F.col("width") >= config.river_width, F.lit(False)) | F.coalesce(F.col("area_km2") >= config.river_area_km2, F.lit(False))
    # One row tells whether any cell passes.
    some = cells.agg(F.coalesce(F.bool_or(F.col("river") & wide), F.lit(False)).alias("_some"))
    return cells.crossJoin(F.broadcast(some)).withColumn("major", F.col("river") & (wide | ~F.col("_some"))).drop("_some")


def floodplain(cells: DataFrame, config: Candidates, blocker: str = "water") -> DataFrame:
    """Add ``floodplain``: low cells near a major river, without narrow and small parts, small holes filled, rivers and water excluded."""
    c = config
    near = nearest.height_above_nearest(cells, "z", "major", c.cell_m, c.cell_m)
    low = F.coalesce((F.col("hand") <= c.hand) & (F.col("distance") <= c.distance), F.lit(False))
    rows = settled(cells.join(near, "cell_id").withColumn("floodplain", low & ~F.coalesce(F.col(blocker), F.lit(False))).drop("hand", "distance"))
    if c.minimum_width > c.cell_m:
        rows = settled(stencil.opened(rows, "floodplain", c.minimum_width / c.cell_m / 2))
    rows = settled(fixpoint.filled_holes(rows, "floodplain", blocker, c.hole_area, c.cell_m**2))
    rows = settled(fixpoint.without_small_parts(rows, "floodplain", c.minimum_area, c.cell_m**2))
    return rows.withColumn("floodplain", F.col("floodplain") & ~F.coalesce(F.col("river"), F.lit(False)) & ~F.coalesce(F.col(blocker), F.lit(False)))


def urban(cells: DataFrame, config: Candidates) -> DataFrame:
    """Add ``urban``: built-up or populous cells and what lies within the buffer."""
    seed = F.coalesce(F.col("impervious") >= config.impervious_percent, F.lit(False)) | F.coalesce(F.col("people_km2") >= config.people_km2, F.lit(False))
    near = nearest.within(cells, seed, config.urban_buffer, config.cell_m, config.cell_m).withColumnRenamed("within", "urban")
    return cells.join(near, "cell_id")


def waterbodies(cells: DataFrame, config: Candidates) -> DataFrame:
    """Add ``waterbody`` (a label): connected parts of the water mask that are large enough and near a river."""
    c = config
    parts = fixpoint.components(cells, "water")
    apart = nearest.nearest_source(cells, F.col("river"), c.cell_m, c.cell_m).select("cell_id", "distance")
    facts = parts.join(apart, "cell_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("d"))
    kept = facts.where((F.col("n") * c.cell_m**2 >= c.water_area) & (F.col("d") <= c.water_distance)).select("label")
    return cells.join(parts.join(kept, "label").select("cell_id", F.col("label").alias("waterbody")), "cell_id", "left")


def refined_waterbodies(cells: DataFrame, config: Candidates, flat: float = 0.5, reach: float = 90.0) -> DataFrame:
    """Add ``refined``: flat cells connected to each waterbody's core level within ``reach``, where the area stays in limits."""
    c = config
    level = cells.where("waterbody is not null").groupBy(F.col("waterbody").alias("body")).agg(F.percentile("z", 0.5).alias("level"), F.count(F.lit(1)).alias("n"))
    near = nearest.nearest_source(cells, F.col("waterbody").isNotNull(), c.cell_m, c.cell_m)
    own = cells.select(F.col("cell_id").alias("source_id"), F.col("waterbody").alias("body"))
    owned = near.where(F.col("distance") <= reach).join(own, "source_id").select("cell_id", "body").join(level, "body")
    around = cells.select("row", "col", "cell_id", "z").join(owned, "cell_id").where(F.abs(F.col("z") - F.col("level")) <= flat)
    around = settled(around.select("row", "col", "cell_id", "body", "n", F.lit(True).alias("on")))
    parts = fixpoint.components(around, "on", "d4").select("cell_id", "label")
    touching = cells.where("waterbody is not null").select("cell_id", F.lit(True).alias("core"))
    joined = around.join(parts, "cell_id").join(touching, "cell_id", "left")
    good = joined.groupBy("body", "label").agg(F.bool_or(F.coalesce("core", F.lit(False))).alias("core")).where("core").drop("core")
    grown = settled(joined.drop("core").join(good, ["body", "label"]))
    ratio = grown.groupBy("body").agg((F.count(F.lit(1)) / F.max("n")).alias("ratio")).where(F.col("ratio").between(*c.refinement)).select("body")
    return cells.join(grown.join(ratio, "body").select("cell_id", F.col("body").alias("refined")), "cell_id", "left")


def classified(cells: DataFrame) -> DataFrame:
    """Add ``feature_class`` by priority water, river, floodplain, urban, rural, and its code."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in cells.columns else F.lit(False)
    out = cells.withColumn("feature_class", L.feature_class(yes("water"), yes("river"), yes("floodplain"), yes("urban")))
    code = F.create_map(*[x for k, v in L.CLASS_CODES.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("class_code", code[F.col("feature_class")])


def target_sizes(cells: DataFrame, sizes: dict[str, float], ratio: float, tile: int = 256) -> DataFrame:
    """row, col, target: each class's cell size, then smoothed so neighbours differ by at most ``ratio``."""
    size: Column = F.lit(float(sizes["rural"]))
    for name, value in sizes.items():
        size = F.when(F.col("feature_class") == name, float(value)).otherwise(size)
    rows = cells.withColumns({"target": size, "valid": F.col("z").isNotNull()})
    return fixpoint.size_field(rows, "target", "valid", ratio, tile)


def outlines(cells: DataFrame, mask: str, config: Candidates, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """ax, ay, bx, by: breaklines around a mask."""
    return mesh.mask_outline(cells, mask, x0, y0, config.cell_m, config.cell_m).select("ax", "ay", "bx", "by")
