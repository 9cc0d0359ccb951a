"""Queries over meshes, overlaps and sub-grid curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvia.functions.tables import spread
from fluvia.operators import mesh, overlap, overlay, subgrid
from fluvia.plans import bridge
from fluvia.plans.bridge import CELL_M, CELLS_SQL, OVERLAP_SQL, order_cells, read
from fluvia.plans.registry import Registry, r6

#: Inputs are scaled by an irrational factor, so rounded results have no ties.
_ROOT = 2.0**0.5

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


def _areas(over):
    return over.groupBy("mesh_index").agg(F.sum("area_m2").alias("mesh_area_m2")), over.groupBy("raster_index").agg(F.sum("area_m2").alias("raster_area_m2"))


@_R.query(f"WITH {OVERLAP_SQL} SELECT mesh_index, round(sum(area_m2 / mesh_area_m2 * (p_retailprice * sqrt(2.0::DOUBLE))), 6) AS value FROM overlap JOIN mesh USING (mesh_index) JOIN part ON p_partkey = raster_index GROUP BY ALL")
def raster_means_on_mesh(spark, sf_dir):
    over = bridge.overlap(spark, sf_dir)
    raster = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("raster_index"), (F.col("p_retailprice") * _ROOT).alias("value"))
    return overlap.mesh_means(over, _areas(over)[0], raster).select("mesh_index", F.round("value", 6).alias("value"))


@_R.query(f"""
WITH {OVERLAP_SQL} SELECT mesh_index, round(coalesce(sum(area_m2 / mesh_area_m2) FILTER (p_size % 3 = 0), 0.0), 6) AS fraction_0, round(coalesce(sum(area_m2 / mesh_area_m2) FILTER (p_size % 3 = 1), 0.0), 6) AS fraction_1, round(coalesce(sum(area_m2 / mesh_area_m2) FILTER (p_size % 3 = 2), 0.0), 6) AS fraction_2
FROM overlap JOIN mesh USING (mesh_index) JOIN part ON p_partkey = raster_index GROUP BY ALL
""")
def class_fractions_on_mesh(spark, sf_dir):
    over = bridge.overlap(spark, sf_dir)
    labels = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("raster_index"), (F.col("p_size") % 3).alias("label"))
    out = overlap.class_fractions(over, _areas(over)[0], labels, [0, 1, 2])
    return out.select("mesh_index", *[F.round(f"fraction_{k}", 6).alias(f"fraction_{k}") for k in range(3)])


@_R.query(f"WITH {OVERLAP_SQL} SELECT raster_index, round(sum(area_m2 / raster_area_m2 * (o_totalprice / 1000 * sqrt(2.0::DOUBLE))), 6) AS depth_m FROM overlap JOIN raster USING (raster_index) JOIN orders ON o_orderkey = mesh_index GROUP BY ALL")
def mesh_depths_on_raster(spark, sf_dir):
    over = bridge.overlap(spark, sf_dir)
    depths = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mesh_index"), (F.col("o_totalprice") / 1000 * _ROOT).alias("depth_m"))
    return overlap.raster_depths(over, _areas(over)[1], depths).select("raster_index", F.round("depth_m", 6).alias("depth_m"))


@_R.query(f"""
WITH {OVERLAP_SQL}, cells AS (SELECT mesh_index, CASE WHEN mesh_index % 40 = 0 THEN mesh_area_m2 + 1 ELSE mesh_area_m2 END AS a, mesh_area_m2 FROM mesh)
SELECT mesh_index, 'closure' AS reason FROM cells WHERE abs(a - mesh_area_m2) > 1e-8 * a
""")
def overlap_breaches(spark, sf_dir):
    over = bridge.overlap(spark, sf_dir)
    areas = _areas(over)[0].withColumn("mesh_area_m2", F.when(F.col("mesh_index") % 40 == 0, F.col("mesh_area_m2") + 1).otherwise(F.col("mesh_area_m2")))
    return overlap.invalid_overlap(over, areas)


_PATCHES = "patches AS (SELECT l_orderkey AS cell, l_quantity AS area_m2, l_extendedprice / 1000 * sqrt(2.0::DOUBLE) AS z, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_suppkey % 31 AS DOUBLE) AS y FROM lineitem), plan AS (SELECT cell, sum(area_m2) AS plan_area_m2 FROM patches GROUP BY ALL)"


def _patches(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_quantity").alias("area_m2"), (F.col("l_extendedprice") / 1000 * _ROOT).alias("z"), (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 31).cast("double").alias("y")
    )


@_R.query(f"""
WITH {_PATCHES}, c AS (SELECT cell, sum(area_m2 * x) / sum(area_m2) AS xc, sum(area_m2 * y) / sum(area_m2) AS yc, sum(area_m2 * z) / sum(area_m2) AS zc FROM patches GROUP BY ALL),
m AS (SELECT cell, any_value(c.zc) AS zc, sum(area_m2 * (x - xc) ** 2) AS a, sum(area_m2 * (x - xc) * (y - yc)) AS b, sum(area_m2 * (y - yc) ** 2) AS c, sum(area_m2 * (x - xc) * (z - c.zc)) AS p, sum(area_m2 * (y - yc) * (z - c.zc)) AS q, count(*) AS n FROM patches JOIN c USING (cell) GROUP BY ALL)
SELECT cell, n, round(zc, 6) AS mean_m, round(CASE WHEN abs(a * c - b * b) < 1e-12 * greatest(a * c, 1e-30) THEN 0.0 ELSE (p * c - q * b) / (a * c - b * b) END, 4) + 0.0 AS slope_x FROM m WHERE abs(a * c - b * b) < 1e-12 * greatest(a * c, 1e-30) OR abs(a * c - b * b) > 1e-6 * a * c
""")
def cell_bed_planes(spark, sf_dir):
    """Mean level and slope along x of each cell's plane, of cells whose patches clearly span one or clearly don't."""
    rows = subgrid.bed_planes(_patches(spark, sf_dir))
    w, mean = F.col("area_m2"), lambda c: F.sum(F.col("area_m2") * F.col(c)) / F.sum("area_m2")
    centre = rows.groupBy("cell").agg(mean("x").alias("xc"), mean("y").alias("yc"), mean("z").alias("zc"))
    both = rows.join(centre, "cell").withColumns({"dx": F.col("x") - F.col("xc"), "dy": F.col("y") - F.col("yc"), "dp": F.col("plane") - F.col("zc")})
    s = lambda a, b: F.sum(w * F.col(a) * F.col(b))
    m = both.groupBy("cell").agg(F.first("zc").alias("zc"), F.count(F.lit(1)).alias("n"), s("dx", "dx").alias("a"), s("dx", "dy").alias("b"), s("dy", "dy").alias("c"), s("dx", "dp").alias("p"), s("dy", "dp").alias("q"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    flat, sure = F.abs(det) < 1e-12 * F.greatest(F.col("a") * F.col("c"), F.lit(1e-30)), F.abs(det) > 1e-6 * F.col("a") * F.col("c")
    slope = F.when(flat, 0.0).otherwise((F.col("p") * F.col("c") - F.col("q") * F.col("b")) / F.nullif(det, F.lit(0.0)))
    return m.where(flat | sure).select("cell", "n", F.round("zc", 6).alias("mean_m"), r6(slope, 4).alias("slope_x"))


_CURVES = f"""
WITH {_PATCHES}, lev AS (SELECT cell, z, sum(area_m2) AS a FROM patches GROUP BY ALL),
pts AS (SELECT cell, z - min(z) OVER (PARTITION BY cell) AS zeta, min(z) OVER (PARTITION BY cell) AS datum, greatest(sum(a) OVER (PARTITION BY cell ORDER BY z), 0.01 * plan_area_m2) AS wet FROM lev JOIN plan USING (cell)),
vol AS (SELECT *, coalesce(sum(lw * (zeta - lz)) OVER (PARTITION BY cell ORDER BY zeta), 0.0) AS volume FROM (SELECT *, lag(wet) OVER w AS lw, lag(zeta) OVER w AS lz FROM pts WINDOW w AS (PARTITION BY cell ORDER BY zeta)))
"""


def _curves(spark, sf_dir):
    patches = _patches(spark, sf_dir)
    return subgrid.cell_volume_curves(patches, patches.groupBy("cell").agg(F.sum("area_m2").alias("plan_area_m2")), spacing=0.0)


@_R.query(f"{_CURVES} SELECT cell, count(*) AS points, round(any_value(datum), 6) AS datum_m, round(max(zeta), 6) AS top_m, round(max(volume), 6) AS volume_m3 FROM vol GROUP BY ALL")
def cell_storage_curves(spark, sf_dir):
    top = F.element_at("curve", -1)
    return _curves(spark, sf_dir).select("cell", F.size("curve").cast("long").alias("points"), F.round("datum_m", 6).alias("datum_m"), F.round(top["zeta"], 6).alias("top_m"), F.round(top["volume"], 6).alias("volume_m3"))


@_R.query(f"""
{_CURVES}, ask AS (SELECT cell, plan_area_m2, 40.0 * plan_area_m2 / 10 AS v FROM plan),
seg AS (SELECT a.cell, v, plan_area_m2, arg_max(struct_pack(z := zeta, vol := volume, wet := wet), zeta) FILTER (volume <= v) AS p, max(zeta) AS top, any_value(datum) AS datum FROM ask a JOIN vol USING (cell) GROUP BY ALL)
SELECT cell, round(datum + p.z + (v - p.vol) / CASE WHEN p.z = top THEN plan_area_m2 ELSE p.wet END, 6) AS stage_m FROM seg
""")
def stages_of_volumes(spark, sf_dir):
    curves = _curves(spark, sf_dir)
    return curves.select("cell", F.round(subgrid.stage_of(F.col("curve"), F.col("datum_m"), F.col("plan_area_m2"), 4.0 * F.col("plan_area_m2")), 6).alias("stage_m"))


@_R.query(f"WITH {_PATCHES} SELECT cell, round(sum(greatest(30.0 - z, 0.0) * area_m2), 6) + 0.0 AS volume_m3 FROM patches GROUP BY ALL")
def volumes_of_stages(spark, sf_dir):
    """Storage below a level of 30 m: the curve's value equals the sum over patches."""
    curves = subgrid.cell_volume_curves(_patches(spark, sf_dir), _patches(spark, sf_dir).groupBy("cell").agg(F.sum("area_m2").alias("plan_area_m2")), spacing=0.0, least_share=0.0)
    return curves.select("cell", r6(subgrid.volume_of(F.col("curve"), F.col("datum_m"), F.col("plan_area_m2"), F.lit(30.0)), 6).alias("volume_m3"))


@_R.query()
def face_conveyance(spark, sf_dir):
    """Flow area, perimeter and conveyance at 2 m above the lowest point of each order's profile of lines."""
    point = F.struct(F.col("l_linenumber").cast("double").alias("station"), (F.col("l_quantity") / 10).alias("bed"), F.lit(0.035).alias("n"))
    # Dealt by order before both groupings, so lines are sent once.
    lines = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    profiles = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(point).alias("p")).groupBy(F.col("l_orderkey").alias("face")).agg(F.sort_array(F.collect_list("p")).alias("points"))
    found = subgrid.face_conveyance_at(profiles, 2.0)
    return found.select("face", "points", *[r6(c).alias(c) for c in ("area", "perimeter", "conveyance")])


def _quads(spark, sf_dir):
    return order_cells(spark, sf_dir).select(F.col("cell_id").alias("face_id"), "row", "col")


@_R.query(f"""
WITH {CELLS_SQL}, pairs AS (
  SELECT a.cell_id AS owner, coalesce(b.cell_id, -1) AS neighbor, 1.0 AS nx, 0.0 AS ny FROM cells a LEFT JOIN cells b ON b.row = a.row AND b.col = a.col + 1
  UNION ALL SELECT a.cell_id, -1, -1.0, 0.0 FROM cells a LEFT JOIN cells b ON b.row = a.row AND b.col = a.col - 1 WHERE b.cell_id IS NULL
  UNION ALL SELECT a.cell_id, coalesce(b.cell_id, -1), 0.0, -1.0 FROM cells a LEFT JOIN cells b ON b.col = a.col AND b.row = a.row + 1
  UNION ALL SELECT a.cell_id, -1, 0.0, 1.0 FROM cells a LEFT JOIN cells b ON b.col = a.col AND b.row = a.row - 1 WHERE b.cell_id IS NULL)
SELECT owner, neighbor, nx::DOUBLE AS nx, ny::DOUBLE AS ny, 30.0::DOUBLE AS length_m, CASE WHEN neighbor < 0 THEN 15.0 ELSE 30.0 END::DOUBLE AS center_distance_m FROM pairs
""")
def regular_mesh_faces(spark, sf_dir):
    out = mesh.regular_edges(_quads(spark, sf_dir), CELL_M, CELL_M)
    return out.select("owner", "neighbor", "nx", "ny", "length_m", "center_distance_m")


@_R.query(f"""
WITH {CELLS_SQL}, m AS (SELECT max(row) AS r1, max(col) AS c1 FROM cells), f AS (
  SELECT a.cell_id, count(b.cell_id) AS k FROM cells a LEFT JOIN cells b ON (b.row = a.row AND b.col IN (a.col - 1, a.col + 1)) OR (b.col = a.col AND b.row IN (a.row - 1, a.row + 1)) GROUP BY ALL)
SELECT cell_id AS face_id, 900.0::DOUBLE AS area_m2, 120.0::DOUBLE AS perimeter_m, k AS internal_faces, 4 - k AS boundary_faces, 30.0::DOUBLE AS cfl_width_m FROM f
""")
def polygon_mesh_cells(spark, sf_dir):
    """Cells of the polygon mesh of the grid: area, perimeter, faces and CFL width, by the general polygon operators."""
    polygons = mesh.regular_polygons(_quads(spark, sf_dir), 0.0, 0.0, CELL_M, CELL_M)
    edges = mesh.mesh_edges(polygons)
    sides = edges.select(F.col("owner").alias("face_id"), "neighbor").unionByName(edges.where("neighbor >= 0").select(F.col("neighbor").alias("face_id"), F.col("owner").alias("neighbor")))
    counts = sides.groupBy("face_id").agg(F.count_if(F.col("neighbor") >= 0).alias("internal_faces"), F.count_if(F.col("neighbor") < 0).alias("boundary_faces"))
    out = mesh.faces(polygons).join(counts, "face_id").join(mesh.cfl_widths(edges), "face_id")
    return out.select("face_id", F.round("area", 4).alias("area_m2"), F.round("perimeter", 4).alias("perimeter_m"), "internal_faces", "boundary_faces", F.round("cfl_width_m", 4).alias("cfl_width_m"))


@_R.query("SELECT * FROM (VALUES ('self_pairs', 0::BIGINT), ('repeated_pairs', 0), ('closure', 0), ('areas', 0), ('lengths', 0), ('distances', 0), ('normals', 0), ('order', 0)) t(\"check\", failures)")
def mesh_contract_checks(spark, sf_dir):
    polygons = mesh.regular_polygons(_quads(spark, sf_dir), 0.0, 0.0, CELL_M, CELL_M)
    return mesh.validation(polygons, mesh.mesh_edges(polygons))


@_R.query(f"""
WITH {CELLS_SQL}, f AS (SELECT row, col FROM cells WHERE status = 'F'), left_over AS (
  SELECT c.cell_id, 900.0 - (CASE WHEN a.row IS NULL THEN 0 ELSE 23 * 19 END + CASE WHEN b.row IS NULL THEN 0 ELSE 7 * 19 END + CASE WHEN d.row IS NULL THEN 0 ELSE 23 * 11 END + CASE WHEN e.row IS NULL THEN 0 ELSE 7 * 11 END) AS area_m2
  FROM cells c LEFT JOIN f a ON a.row = c.row AND a.col = c.col LEFT JOIN f b ON b.row = c.row AND b.col = c.col - 1
  LEFT JOIN f d ON d.row = c.row + 1 AND d.col = c.col LEFT JOIN f e ON e.row = c.row + 1 AND e.col = c.col - 1)
SELECT cell_id, area_m2::DOUBLE AS area_m2 FROM left_over WHERE area_m2 > 0
""")
def cells_outside_blockers(spark, sf_dir):
    """Area of every square of the grid outside the squares of finished orders, which lie 7 m east and 11 m north of their own."""
    quads = order_cells(spark, sf_dir).select(F.col("cell_id").alias("face_id"), "row", "col", "status")
    cells = mesh.regular_polygons(quads.drop("status"), 0.0, 0.0, CELL_M, CELL_M)
    blockers = mesh.regular_polygons(quads.where("status = 'F'").drop("status"), 7.0, 11.0, CELL_M, CELL_M)
    parts = overlay.overlaid(cells, blockers, "difference").select(F.struct("face_id", "part").alias("face_id"), "ring", "seq", "x", "y")
    return mesh.faces(parts).groupBy(F.col("face_id.face_id").alias("cell_id")).agg(r6(F.sum("area"), 4).alias("area_m2"))
