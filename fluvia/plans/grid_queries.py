"""Queries over the grid: routing, conditioning, river geometry, design floods."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H
from fluvia.functions.tables import settled
from fluvia.operators import fixpoint, forest, nearest, stencil
from fluvia.plans.bridge import CELL_M, CELLS_SQL, columns, order_cells
from fluvia.plans.registry import Registry, r6

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

#: River cells have at least so many cells upstream.
RIVER_CELLS = 12
CELL_KM2 = CELL_M * CELL_M / 1e6
_KM2 = f"{CELL_KM2!r}::DOUBLE"

_WALK = """
off(rank, dr, dc) AS (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)),
down AS (
  SELECT cell_id, receiver FROM (
    SELECT a.cell_id, b.cell_id AS receiver, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.z - b.z) / 30.0 DESC, rank) AS k
    FROM cells a, off JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.z > b.z) WHERE k = 1),
links AS (SELECT cells.*, down.receiver FROM cells LEFT JOIN down USING (cell_id)),
"""
_REACH = "walk AS (SELECT cell_id AS src, cell_id AS cur, 0 AS hops FROM links UNION ALL SELECT src, receiver, hops + 1 FROM walk JOIN links ON cur = cell_id WHERE receiver IS NOT NULL)"
_PATHS = f"WITH RECURSIVE {CELLS_SQL}, {_WALK} {_REACH}, acc AS (SELECT cur AS cell_id, count(*) AS accumulation FROM walk GROUP BY ALL)"


def links(spark, sf_dir):
    """Cells with their D4 receivers."""
    return settled(stencil.receivers(order_cells(spark, sf_dir), "z", "d4", CELL_M, CELL_M))


def routed(spark, sf_dir):
    """Cells with receivers, accumulation and the river mask."""
    cells = links(spark, sf_dir)
    return settled(cells.join(forest.accumulation(cells), "cell_id").withColumn("river", F.col("accumulation") >= RIVER_CELLS))


@_R.query(f"""
WITH {CELLS_SQL}, {_WALK.rstrip().rstrip(",")}
SELECT cell_id, receiver, CAST(CASE WHEN receiver IS NULL THEN 0 WHEN receiver = cell_id - cols THEN 1 WHEN receiver = cell_id + 1 THEN 2 WHEN receiver = cell_id + cols THEN 3 ELSE 4 END AS TINYINT) AS direction
FROM links
""")
def d4_receivers(spark, sf_dir):
    cells = stencil.receivers(order_cells(spark, sf_dir), "z", "d4", CELL_M, CELL_M)
    return cells.select("cell_id", "receiver", stencil.direction_code(F.lit(columns(spark, sf_dir)), F.col("cell_id"), F.col("receiver")).alias("direction"))


@_R.query(f"""
WITH {CELLS_SQL}, off(rank, dr, dc, code) AS (VALUES (0, -1, 0, 1), (1, 1, 0, 5), (2, 0, -1, 7), (3, 0, 1, 3), (4, -1, -1, 8), (5, -1, 1, 2), (6, 1, -1, 6), (7, 1, 1, 4)),
best AS (
  SELECT cell_id, receiver, code FROM (
    SELECT a.cell_id, b.cell_id AS receiver, code, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.z - b.z) / sqrt((dr * 30.0) ** 2 + (dc * 30.0) ** 2) DESC, rank) AS k
    FROM cells a, off JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.z > b.z) WHERE k = 1)
SELECT cell_id, receiver, CAST(coalesce(code, 0) AS TINYINT) AS direction FROM cells LEFT JOIN best USING (cell_id)
""")
def d8_receivers(spark, sf_dir):
    cells = stencil.receivers(order_cells(spark, sf_dir), "z", "d8", CELL_M, CELL_M)
    return cells.select("cell_id", "receiver", stencil.direction_code(F.lit(columns(spark, sf_dir)), F.col("cell_id"), F.col("receiver"), "d8").alias("direction"))


@_R.query(f"""
WITH {CELLS_SQL}, size AS (SELECT max(row) + 1 AS rows FROM cells), coded AS (SELECT cells.*, rows, CAST(cell_id % 6 AS INT) AS code FROM cells, size),
moved AS (SELECT *, row + CASE code WHEN 1 THEN -1 WHEN 3 THEN 1 WHEN 2 THEN 0 WHEN 4 THEN 0 END AS r, col + CASE code WHEN 2 THEN 1 WHEN 4 THEN -1 WHEN 1 THEN 0 WHEN 3 THEN 0 END AS c FROM coded)
SELECT cell_id, CASE WHEN r >= 0 AND r < rows AND c >= 0 AND c < cols THEN r * cols + c END AS receiver FROM moved
""")
def receivers_from_codes(spark, sf_dir):
    cells, cols = order_cells(spark, sf_dir), columns(spark, sf_dir)
    rows = cells.agg(F.max("row") + 1).first()[0]
    code = (F.col("cell_id") % 6).cast("int")
    return cells.select("cell_id", stencil.receiver_of_code(F.lit(rows), F.lit(cols), F.col("row"), F.col("col"), code).alias("receiver"))


@_R.query(f"{_PATHS} SELECT cell_id, accumulation FROM acc")
def d4_flow_accumulation(spark, sf_dir):
    return forest.accumulation(links(spark, sf_dir))


@_R.query(f"""
{_PATHS}, river AS (
  SELECT links.*, accumulation, accumulation >= {RIVER_CELLS} AS river, accumulation * {_KM2} AS area FROM links JOIN acc USING (cell_id)),
geometry AS (
  SELECT *, CASE WHEN river THEN least(2.2695 * pow(area, 0.4942), 30.0) ELSE 0.0 END AS width, CASE WHEN river THEN 0.1097 * pow(area, 0.3856) ELSE 0.0 END AS depth FROM river)
SELECT cell_id, receiver, accumulation, river, round(width, 6) + 0.0 AS width_m, round(depth, 6) + 0.0 AS depth_m,
       round(CASE WHEN river THEN least(pow(width / 30.0 * pow(depth, 5.0 / 3.0), 0.6), 50.0) ELSE 0.0 END, 6) + 0.0 AS lowering_m,
       round(z - CASE WHEN river THEN least(pow(width / 30.0 * pow(depth, 5.0 / 3.0), 0.6), 50.0) ELSE 0.0 END, 6) + 0.0 AS carved_m
FROM geometry
""")
def river_network_carved_terrain(spark, sf_dir):
    """Rivers from flow accumulation, their width and depth, and the terrain lowered to convey as much."""
    cells = routed(spark, sf_dir).withColumn("area", F.col("accumulation") * CELL_KM2)
    width = H.river_power_law("area", "river", H.WIDTH_COEFFICIENT, H.WIDTH_EXPONENT, CELL_M)
    depth = H.river_power_law("area", "river", H.DEPTH_COEFFICIENT, H.DEPTH_EXPONENT)
    shaped = cells.withColumns({"width": width, "depth": depth}).withColumn("lowering", H.equivalent_lowering("width", "depth", CELL_M, "wide", 50.0))
    return shaped.select("cell_id", "receiver", "accumulation", "river", r6("width").alias("width_m"), r6("depth").alias("depth_m"), r6("lowering").alias("lowering_m"), r6(F.col("z") - F.col("lowering")).alias("carved_m"))


@_R.query(f"""
{_PATHS} SELECT w.cur AS cell_id, round(sum(s.cn) / count(*), 6) + 0.0 AS composite_cn, round(count(*) * {_KM2}, 6) + 0.0 AS covered_km2
FROM walk w JOIN cells s ON s.cell_id = w.src GROUP BY ALL
""")
def upstream_composite_curve_number(spark, sf_dir):
    return forest.composite_mean(links(spark, sf_dir), "cn", CELL_KM2).select("cell_id", r6("mean").alias("composite_cn"), r6("covered").alias("covered_km2"))


@_R.query(f"""
{_PATHS}, best AS (SELECT w.cur AS cell_id, max(struct_pack(hops := w.hops, z := s.z)) AS head FROM walk w JOIN cells s ON s.cell_id = w.src GROUP BY ALL)
SELECT cell_id, round(head.hops * 30.0::DOUBLE, 6) + 0.0 AS length_m, round(greatest(head.z - z, 0.0), 6) + 0.0 AS drop_m FROM best JOIN cells USING (cell_id)
""")
def longest_flow_paths(spark, sf_dir):
    return forest.longest_paths(links(spark, sf_dir)).select("cell_id", r6("length_m").alias("length_m"), r6("drop_m").alias("drop_m"))


@_R.query(f"{_PATHS} SELECT cur AS cell_id, CAST(max(hops) AS INT) AS level FROM walk GROUP BY ALL")
def topological_levels(spark, sf_dir):
    return forest.levels(links(spark, sf_dir))


@_R.query(f"{_PATHS} SELECT w.cur AS cell_id, max(s.cn) AS envelope FROM walk w JOIN cells s ON s.cell_id = w.src GROUP BY ALL")
def flow_envelope(spark, sf_dir):
    return forest.upstream_max(links(spark, sf_dir), "cn").withColumnRenamed("cn", "envelope")


@_R.query(f"""
{_PATHS}, river AS (SELECT cell_id, z, accumulation >= {RIVER_CELLS} AS river FROM cells JOIN acc USING (cell_id)),
first AS (SELECT src AS cell_id, min(struct_pack(hops := hops, reach := cur, z := z)) AS f FROM walk JOIN river ON cell_id = cur WHERE river GROUP BY ALL)
SELECT cell_id, round(greatest(cells.z - f.z, 0.0), 6) + 0.0 AS hand_m, f.reach AS reach FROM cells LEFT JOIN first USING (cell_id)
""")
def height_above_drainage(spark, sf_dir):
    return forest.height_above_drainage(routed(spark, sf_dir)).select("cell_id", r6("hand").alias("hand_m"), "reach")


_LINKS = f"""
{_PATHS}, stream AS (SELECT links.cell_id, links.receiver FROM links JOIN acc USING (cell_id) WHERE accumulation >= {RIVER_CELLS}),
degree AS (SELECT s.receiver AS cell_id, count(*) AS n FROM stream s JOIN stream t ON s.receiver = t.cell_id GROUP BY ALL),
run AS (
  SELECT cell_id, cell_id AS link, 0 AS hop FROM stream LEFT JOIN degree USING (cell_id) WHERE coalesce(n, 0) <> 1
  UNION ALL SELECT stream.receiver, link, hop + 1 FROM run JOIN stream ON run.cell_id = stream.cell_id JOIN degree ON degree.cell_id = stream.receiver WHERE n = 1)
"""


@_R.query(f"{_LINKS} SELECT cell_id, link FROM run")
def stream_links(spark, sf_dir):
    return forest.stream_links(routed(spark, sf_dir), "river")


@_R.query(f"""
{_LINKS}, first AS (SELECT src AS cell_id, min(struct_pack(hops := hops, link := link)) AS f FROM walk w JOIN run ON run.cell_id = w.cur GROUP BY src)
SELECT cell_id, f.link AS zone FROM cells LEFT JOIN first USING (cell_id)
""")
def stream_zones(spark, sf_dir):
    return forest.zones(routed(spark, sf_dir), "river")


@_R.query(f"""
{_LINKS}, whole AS (
  SELECT link, hop, cell_id FROM run
  UNION ALL SELECT a.link, a.hop + 1, s.receiver FROM run a JOIN stream s ON a.cell_id = s.cell_id JOIN run b ON b.cell_id = s.receiver WHERE a.link <> b.link)
SELECT link AS reach_id, CAST(hop AS INT) AS seq, cell_id FROM whole WHERE link IN (SELECT link FROM whole GROUP BY link HAVING count(*) > 1)
""")
def river_reach_paths(spark, sf_dir):
    return forest.reach_paths(routed(spark, sf_dir), "river")


@_R.query(f"""
{_PATHS}, marked AS (
  SELECT a.cell_id FROM links a JOIN acc x ON x.cell_id = a.cell_id JOIN acc y ON y.cell_id = a.receiver WHERE x.accumulation BETWEEN 5 AND 15 AND y.accumulation > 15),
first AS (SELECT src AS cell_id, min(struct_pack(hops := hops, cur := cur)) AS f FROM walk JOIN marked ON cur = cell_id GROUP BY src)
SELECT cell_id, f.cur AS outlet FROM first
""")
def candidate_basins(spark, sf_dir):
    return forest.basins(routed(spark, sf_dir), "accumulation", 5, 15)


@_R.query(f"""
{_PATHS}, river AS (SELECT links.*, accumulation >= {RIVER_CELLS} AS river FROM links JOIN acc USING (cell_id)),
reach AS (
  SELECT w.cur AS cell_id, s.z - 0.003 * w.hops AS top FROM walk w JOIN river s ON s.cell_id = w.src JOIN river t ON t.cell_id = w.cur WHERE s.river AND t.river)
SELECT cell_id, round(min(top), 6) + 0.0 AS surface_m FROM reach GROUP BY ALL
""")
def descending_channel_surface(spark, sf_dir):
    return forest.descending_surface(routed(spark, sf_dir), "z", "river", 0.003).select("cell_id", r6("surface").alias("surface_m"))


@_R.query(f"""
{_PATHS}, river AS (SELECT links.*, accumulation >= {RIVER_CELLS} AS river, 0.5 + cell_id % 4 AS depth FROM links JOIN acc USING (cell_id)),
bed AS (SELECT *, CASE WHEN river THEN z - depth END AS bed FROM river)
SELECT a.cell_id, round(a.bed, 6) + 0.0 AS bed_m, round(greatest(coalesce(CASE WHEN a.river THEN b.bed - a.bed END, 0.0), 0.0), 6) + 0.0 AS sill_m FROM bed a LEFT JOIN bed b ON b.cell_id = a.receiver
""")
def channel_bed_sills(spark, sf_dir):
    cells = routed(spark, sf_dir).withColumn("depth", 0.5 + F.col("cell_id") % 4)
    return stencil.channel_bed_sills(cells).select("cell_id", r6("bed").alias("bed_m"), r6("sill").alias("sill_m"))


@_R.query(f"""
{_PATHS}, river AS (SELECT cell_id, receiver, z, 0.5 + cell_id % 4 AS depth FROM links JOIN acc USING (cell_id) WHERE accumulation >= {RIVER_CELLS}),
demand AS (
  SELECT cell_id AS cur, receiver, z - depth AS bed FROM river
  UNION ALL SELECT r.cell_id, r.receiver, greatest(least(d.bed - 0.3, r.z - r.depth), r.z - 6.0) FROM demand d JOIN river r ON r.cell_id = d.receiver)
SELECT cell_id, round(z - min(demand.bed), 6) + 0.0 AS depth_m FROM demand JOIN river ON cur = cell_id GROUP BY cell_id, z
""")
def conditioned_channel_bed(spark, sf_dir):
    cells = routed(spark, sf_dir).withColumn("depth", 0.5 + F.col("cell_id") % 4)
    return forest.conditioned_depth(cells, drop=0.3, cap=6.0).select("cell_id", r6("depth").alias("depth_m"))


@_R.query(f"""
WITH {CELLS_SQL}, m AS (SELECT avg(z) AS mean, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM cells),
g AS (
  SELECT a.cell_id,
    ((CASE WHEN a.col = c1 THEN a.z ELSE coalesce(e.z, mean) END) - (CASE WHEN a.col = c0 THEN a.z ELSE coalesce(w.z, mean) END)) / (CASE WHEN a.col IN (c0, c1) THEN 1 ELSE 2 END * 30.0) AS gx,
    ((CASE WHEN a.row = r1 THEN a.z ELSE coalesce(s.z, mean) END) - (CASE WHEN a.row = r0 THEN a.z ELSE coalesce(n.z, mean) END)) / (CASE WHEN a.row IN (r0, r1) THEN 1 ELSE 2 END * 30.0) AS gy
  FROM cells a CROSS JOIN m LEFT JOIN cells e ON e.row = a.row AND e.col = a.col + 1 LEFT JOIN cells w ON w.row = a.row AND w.col = a.col - 1
  LEFT JOIN cells s ON s.col = a.col AND s.row = a.row + 1 LEFT JOIN cells n ON n.col = a.col AND n.row = a.row - 1)
SELECT cell_id, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0.0 AS slope_deg FROM g
""")
def terrain_slope(spark, sf_dir):
    return stencil.slope_degrees(order_cells(spark, sf_dir), "z", CELL_M, CELL_M).select("cell_id", r6("slope_deg").alias("slope_deg"))


@_R.query(f"""
WITH {CELLS_SQL} SELECT a.cell_id, round(max(b.z) - min(b.z), 6) + 0.0 AS relief_m FROM cells a JOIN cells b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL
""")
def local_relief(spark, sf_dir):
    return stencil.local_relief(order_cells(spark, sf_dir), "z", 2).select("cell_id", r6("relief").alias("relief_m"))


@_R.query(f"""
WITH {CELLS_SQL}, zoned AS (SELECT *, CAST(cn AS INT) // 10 AS zone FROM cells), m AS (SELECT max(row) AS r1, max(col) AS c1 FROM cells),
beside AS (SELECT DISTINCT a.cell_id FROM zoned a JOIN zoned b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND abs(a.row - b.row) <= 1 AND a.zone <> b.zone
  AND b.row IN (a.row - 1, a.row, a.row + 1))
SELECT z.cell_id, z.row IN (0, r1) OR z.col IN (0, c1) OR b.cell_id IS NOT NULL AS boundary FROM zoned z CROSS JOIN m LEFT JOIN beside b USING (cell_id)
""")
def zone_boundary_cells(spark, sf_dir):
    zoned = order_cells(spark, sf_dir).withColumn("zone", F.floor(F.col("cn") / 10).cast("int"))
    return stencil.zone_boundary(zoned).select("cell_id", "boundary")


@_R.query(f"""
WITH {CELLS_SQL} SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(min(z), 6) + 0.0 AS lowest_m, round(avg(z), 6) + 0.0 AS mean_m, count(*) AS n FROM cells GROUP BY 1, 2
""")
def block_resampling(spark, sf_dir):
    out = stencil.block_aggregate(order_cells(spark, sf_dir), 4, lowest=F.min("z"), mean=F.avg("z"), n=F.count(F.lit(1)))
    return out.select("row", "col", r6("lowest").alias("lowest_m"), r6("mean").alias("mean_m"), "n")


@_R.query(f"""
WITH {CELLS_SQL}, b AS (SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, avg(z) AS mean FROM cells GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT a.row, a.col, round(abs(e.mean - a.mean), 6) AS jump_e, round(abs(s.mean - a.mean), 6) AS jump_s
FROM b a LEFT JOIN b e ON e.row = a.row AND e.col = a.col + 1 LEFT JOIN b s ON s.row = a.row + 1 AND s.col = a.col
""")
def coarse_terrain_jumps(spark, sf_dir):
    out = stencil.coarse_jumps(order_cells(spark, sf_dir), "z", 4)
    return out.select("row", "col", F.round("jump_e", 6).alias("jump_e"), F.round("jump_s", 6).alias("jump_s"))


@_R.query(f"""
WITH {CELLS_SQL}, on_cells AS (SELECT * FROM cells WHERE status = 'F'),
off(dr, dc) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)),
eroded AS (SELECT row, col FROM (SELECT a.row + dr AS row, a.col + dc AS col FROM on_cells a, off) GROUP BY ALL HAVING count(*) = 5),
grown AS (SELECT DISTINCT e.row + dr AS row, e.col + dc AS col FROM eroded e JOIN cells c ON c.row = e.row AND c.col = e.col, off)
SELECT cell_id, g.row IS NOT NULL AS kept FROM cells c LEFT JOIN grown g ON g.row = c.row AND g.col = c.col
""")
def narrow_parts_removed(spark, sf_dir):
    cells = order_cells(spark, sf_dir).withColumn("kept", F.col("status") == "F")
    return stencil.opened(cells, "kept", 1.0).select("cell_id", "kept")


@_R.query(f"""
WITH RECURSIVE {CELLS_SQL}, on_cells AS (SELECT row, col, cell_id FROM cells WHERE status = 'P' OR (row % 9 = 0 AND col < 12)),
grow AS (
  SELECT cell_id, cell_id AS label FROM on_cells
  UNION SELECT b.cell_id, label FROM grow JOIN on_cells a USING (cell_id) JOIN on_cells b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND b.row IN (a.row - 1, a.row, a.row + 1) AND a.cell_id <> b.cell_id)
SELECT cell_id, min(label) AS label FROM grow GROUP BY ALL
""")
def connected_parts(spark, sf_dir):
    cells = order_cells(spark, sf_dir).withColumn("on", (F.col("status") == "P") | ((F.col("row") % 9 == 0) & (F.col("col") < 12)))
    return fixpoint.components(cells, "on").select("cell_id", "label")


@_R.query()
def flooded_routing_surface(spark, sf_dir):
    """cell_id, filled, parent: monotone routing surface by a priority-flood fix-point."""
    out = fixpoint.priority_flood(order_cells(spark, sf_dir), "z", 0.01, tile=64)
    return out.select("cell_id", r6("filled").alias("filled_m"), "parent", "outlet")


@_R.query()
def breached_pits(spark, sf_dir):
    """Ledger of pits and whether their way out was carved."""
    _, ledger = fixpoint.pit_breaches(order_cells(spark, sf_dir), "z", 2.0, 40.0, 8, 0.01, tile=64)
    return ledger.select("sink", r6("spill_depth").alias("spill_depth_m"), "path_length_cells", "outlet_cell", r6("max_lowering_m").alias("max_lowering_m"), "accepted", "reason")


@_R.query(f"""
WITH {CELLS_SQL}, src AS (SELECT row, col FROM cells WHERE status = 'P')
SELECT cell_id, round(min(sqrt(((a.row - s.row) * 30.0) ** 2 + ((a.col - s.col) * 20.0) ** 2)), 6) AS distance_m FROM cells a, src s GROUP BY ALL
""")
def distance_to_sources(spark, sf_dir):
    out = nearest.nearest_source(order_cells(spark, sf_dir), F.col("status") == "P", 20.0, 30.0)
    return out.select("cell_id", F.round("distance", 6).alias("distance_m"))


@_R.query()
def curve_numbers_filled(spark, sf_dir):
    """Curve numbers with gaps filled from the nearest cell."""
    cells = order_cells(spark, sf_dir).withColumns({"cn": F.when(F.col("cell_id") % 5 != 0, F.col("cn")), "in_domain": F.col("col") > 2})
    return nearest.filled_from_nearest(cells, "cn", "in_domain").select("cell_id", "cn")


@_R.query()
def graded_size_field(spark, sf_dir):
    """Cell sizes that grow by at most a fifth from cell to cell."""
    cells = order_cells(spark, sf_dir).withColumns({"target": F.when(F.col("status") == "P", 10.0).otherwise(200.0), "valid": F.lit(True)})
    return fixpoint.size_field(cells, "target", "valid", 1.2, tile=64).select("row", "col", r6("target").alias("target_m"))


_STORM = "25.4 * pow(100.0, 0.2) / pow(d + 10.0, 0.8) * d / 60.0"


@_R.query(f"""
{_PATHS}, best AS (SELECT w.cur AS cell_id, max(struct_pack(hops := w.hops, z := s.z)) AS head, sum(s.cn) / count(*) AS cn, count(*) AS n FROM walk w JOIN cells s ON s.cell_id = w.src GROUP BY ALL),
shape AS (SELECT cell_id, head.hops * 30.0::DOUBLE AS len, greatest(head.z - z, 0.0) AS dropped, best.cn AS cn, n FROM best JOIN cells USING (cell_id)),
timed AS (SELECT *, greatest(0.01947 * pow(greatest(len, 1.0), 0.77) * pow(greatest(CASE WHEN len > 0 THEN dropped / len ELSE 0.0 END, 1e-5), -0.385), 5.0) AS tc FROM shape),
storm AS (SELECT *, greatest(5.0, 0.133 * tc) AS d FROM timed),
rain AS (SELECT *, {_STORM} AS p, 25400.0 / cn - 254.0 AS s FROM storm),
excess AS (SELECT *, CASE WHEN p - 0.2 * s > 0 THEN (p - 0.2 * s) * (p - 0.2 * s) / (p - 0.2 * s + s) ELSE 0.0 END AS q FROM rain)
SELECT cell_id, round(tc, 6) + 0.0 AS tc_min, round(p, 6) + 0.0 AS storm_mm, round(q, 6) + 0.0 AS runoff_mm, round(0.208 * n * {_KM2} * q / (0.5 * d / 60.0 + 0.6 * tc / 60.0), 6) + 0.0 AS peak_m3s FROM excess
""")
def design_flood_peaks(spark, sf_dir):
    """Curve number, path, storm, runoff and peak of every cell's catchment."""
    cells = links(spark, sf_dir)
    shaped = forest.composite_mean(cells, "cn", CELL_KM2).join(forest.longest_paths(cells), "cell_id")
    tc = shaped.withColumn("tc", H.kirpich_minutes("length_m", "drop_m", 5.0)).withColumn("d", H.storm_minutes("tc"))
    rain = tc.withColumn("p", H.idf_depth_mm("d", 100.0, 25.4, 0.2, 10.0, 0.8)).withColumn("q", H.scs_runoff_mm("p", "mean", 0.2))
    return rain.select("cell_id", r6("tc").alias("tc_min"), r6("p").alias("storm_mm"), r6("q").alias("runoff_mm"), r6(H.unit_hydrograph_peak("covered", "q", "d", "tc")).alias("peak_m3s"))
