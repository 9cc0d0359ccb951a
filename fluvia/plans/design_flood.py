"""Design floods: peaks by catchment, and the corridor that a flood wets along its reaches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H
from fluvia.functions.tables import settled
from fluvia.operators import fixpoint, forest, nearest, profiles, stencil


@dataclass(frozen=True)
class Hydrograph:
    """Settings of design peaks."""

    cell_m: float = 30.0
    return_period: float = 100.0
    idf: tuple[float, float, float, float] = (25.4, 0.2, 10.0, 0.8)
    abstraction: float = 0.2
    minimum_tc: float = 5.0
    minimum_storm: float = 5.0
    storm_ratio: float = 0.133
    lag_ratio: float = 0.6
    least_coverage: float = 0.9


def peaks(cells: DataFrame, config: Hydrograph) -> DataFrame:
    """cell_id, area_km2, cn, tc_min, storm_mm, runoff_mm, peak_m3s of ``cells(row, col, cell_id, z, cn, receiver, distance, river)``.

    Curve-number gaps take the nearest cell's. Raises where less than a share of a river cell's catchment has one, or its
    peak is not a number.
    """
    c = config
    filled = settled(nearest.filled_from_nearest(cells.withColumn("_in", F.col("z").isNotNull()), "cn", "_in").drop("_in"))
    km2 = c.cell_m**2 / 1e6
    mixed = forest.composite_mean(filled, "cn", km2).select("cell_id", F.col("mean").alias("cn"), F.col("covered").alias("covered_km2"))
    area = forest.accumulation(filled).select("cell_id", (F.col("accumulation") * km2).alias("area_km2"))
    rows = mixed.join(area, "cell_id").join(forest.longest_paths(filled), "cell_id")
    rows = rows.withColumn("tc_min", H.kirpich_minutes("length_m", "drop_m", c.minimum_tc)).withColumn("_d", H.storm_minutes("tc_min", c.storm_ratio, c.minimum_storm))
    rows = rows.withColumn("storm_mm", H.idf_depth_mm("_d", c.return_period, *c.idf)).withColumn("runoff_mm", H.scs_runoff_mm("storm_mm", "cn", c.abstraction))
    rows = settled(rows.withColumn("peak_m3s", H.unit_hydrograph_peak("area_km2", "runoff_mm", "_d", "tc_min", c.lag_ratio)).drop("_d"))
    river = rows.join(filled.where("river").select("cell_id"), "cell_id")
    thin = river.where(~F.coalesce(F.col("covered_km2") / F.col("area_km2") >= c.least_coverage, F.lit(False))).count()
    if thin:
        raise ValueError(f"curve numbers cover too little of the catchments of {thin} river cells")
    lost = river.where(F.col("peak_m3s").isNull() | F.isnan("peak_m3s")).count()
    if lost:
        raise ValueError(f"{lost} river cells have no peak")
    return rows


@dataclass(frozen=True)
class Corridor:
    """Settings of wetted corridors."""

    cell_m: float = 30.0
    channel_n: float = 0.035
    floodplain_n: float = 0.05
    min_slope: float = 1e-4
    max_slope: float = 0.05
    window_m: float = 600.0
    bank_m: float = 90.0
    half_width_m: float = 2000.0
    max_stage: float = 20.0
    scheme: str = "d4"
    tile: int = 256


def terminal_directions(cells: DataFrame, scheme: str = "d4") -> DataFrame:
    """Give river cells without a direction that of their widest upstream neighbour, else an axis toward the widest one."""
    around = {"n": (-1, 0), "e": (0, 1), "s": (1, 0), "w": (0, -1)} if scheme == "d4" else {"n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1)}
    codes = stencil.D4_CODES if scheme == "d4" else stencil.D8_CODES
    back = {"n": "s", "s": "n", "e": "w", "w": "e", "ne": "sw", "sw": "ne", "nw": "se", "se": "nw"}
    seen = stencil.gathered(cells.withColumn("_w", F.when(F.col("river"), F.col("width"))), ["_w", "direction"], around)
    up = [F.when(F.col(f"_w_{k}").isNotNull() & (F.col(f"direction_{k}") == codes[back[k]]), F.struct(F.col(f"_w_{k}").alias("w"), F.lit(-i).alias("i"), F.col(f"direction_{k}").cast("int").alias("d"))) for i, k in enumerate(around)]
    axis = {k: codes[k] if scheme == "d8" else (1 if k in "ns" else 2) for k in around}
    side = [F.when(F.col(f"_w_{k}").isNotNull(), F.struct(F.col(f"_w_{k}").alias("w"), F.lit(-i).alias("i"), F.lit(axis[k]).alias("d"))) for i, k in enumerate(around)]
    best = lambda options: F.array_max(F.array_compact(F.array(*options)))["d"]
    return seen.withColumn("direction", F.when(F.col("river") & F.col("direction").isNull(), F.coalesce(best(up), best(side))).otherwise(F.col("direction").cast("int"))).select(*cells.columns)


def wetted(cells: DataFrame, rows: int, cols: int, config: Corridor) -> DataFrame:
    """cell_id of the section, stage_m, bank_m, bed_m, slope, q: solved stages of river cells.

    ``cells(row, col, cell_id, z, river, receiver, direction, width, depth, peak)``. Every river cell must solve.
    """
    c = config
    directed = settled(terminal_directions(cells, c.scheme))
    envelope = forest.upstream_max(directed.where("river"), "peak").withColumnRenamed("peak", "q")
    river = directed.where("river").select("cell_id", "row", "col", "direction", "width", "depth", "z", F.col("cell_id").alias("section_id"))
    reach = int(round(c.half_width_m / c.cell_m))
    first = 1
    lateral = profiles.cross_sections(river, rows, cols, first, reach, c.scheme).join(cells.select("row", "col", F.col("z").alias("ground")), ["row", "col"], "left")
    sides = lateral.groupBy("section_id").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("k", "ground")))), lambda p: p["ground"]).alias(s) for s in ("left", "right")])
    banks = profiles.bank_levels(lateral, max(1, int(round(c.bank_m / c.cell_m))))
    paths = forest.reach_paths(directed, "river")
    place = paths.join(cells.select("cell_id", (F.col("col") * c.cell_m).alias("x"), (F.col("row") * c.cell_m).alias("y")), "cell_id")
    along = profiles.distances(place.join(river.select("cell_id", "depth"), "cell_id").join(banks.withColumnRenamed("section_id", "cell_id"), "cell_id", "left"))
    smooth = profiles.smoothed_profile(along, "bank", c.window_m).withColumn("bed", F.col("smoothed") - F.col("depth"))
    sloped = profiles.smoothed_slopes(smooth, "bed", c.window_m, c.min_slope, c.max_slope)
    # A junction belongs to several reaches; its own reach begins there.
    station = sloped.groupBy(F.col("cell_id").alias("section_id")).agg(F.min_by(F.struct("smoothed", "bed", "slope", "depth"), "seq").alias("s")).select("section_id", F.col("s.smoothed").alias("bank"), "s.bed", "s.slope", "s.depth")
    rows_ = station.join(sides, "section_id").join(river.select("section_id", "width", "direction"), "section_id").join(envelope.withColumnRenamed("cell_id", "section_id"), "section_id")
    stage = H.solve_stage("q", "bed", "depth", "width", "slope", F.col("left"), F.col("right"), profiles.cross_cell_width(F.col("direction"), c.cell_m, c.cell_m, c.scheme), c.channel_n, c.floodplain_n, c.max_stage)
    return rows_.select(F.col("section_id").alias("cell_id"), stage.alias("stage_m"), F.col("bank").alias("bank_m"), F.col("bed").alias("bed_m"), "slope", "q", "left", "right")


def floodplain(cells: DataFrame, stages: DataFrame, rows: int, cols: int, config: Corridor) -> DataFrame:
    """cell_id, depth_m: river cells and the connected cells beside them that some section's stage wets, at the deepest."""
    river = cells.where("river").select("cell_id", "row", "col", "direction", F.col("cell_id").alias("section_id")).join(stages.select("cell_id", "stage_m"), "cell_id").where("stage_m is not null")
    reach = int(round(config.half_width_m / config.cell_m))
    lateral = profiles.cross_sections(river, rows, cols, 1, reach, config.scheme).join(cells.select("row", "col", "cell_id", F.col("z").alias("ground")), ["row", "col"], "left").join(river.select("section_id", F.col("stage_m").alias("stage")), "section_id")
    wet = profiles.connected_side(lateral, "stage").where("depth > 0").select("cell_id", F.col("depth"))
    own = river.join(cells.select("cell_id", "z"), "cell_id").select("cell_id", F.greatest(F.col("stage_m") - F.col("z"), F.lit(0.0)).alias("depth"))
    return wet.unionByName(own).groupBy("cell_id").agg(F.max("depth").alias("depth_m"))


def floodplain_routing(cells: DataFrame, active: str, river: str, bed: str, tile: int = 256) -> DataFrame:
    """cell_id, potential, receiver, accumulation: paths over an active floodplain to its rivers."""
    on = cells.where(active).withColumn("_bed", F.coalesce(F.col(bed), F.col("z")))
    flood = settled(fixpoint.priority_flood(on, "z", 1e-4, seeds=river, seed_level="_bed", tile=tile))
    linked = flood.select("row", "col", "cell_id", F.col("filled").alias("potential"), F.col("parent").alias("receiver"))
    return linked.join(forest.accumulation(linked), "cell_id").select("cell_id", "potential", "receiver", "accumulation")
