import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import mesh, overlap, polygons, seeds
from fluvia.sources import rasters


def squares(spark, *rings):
    rows = [(i, 0, s, float(x), float(y)) for i, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "face_id long, ring int, seq int, x double, y double")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_overlap_transfer(spark):
    over = spark.createDataFrame([(0, 0, 50.0), (0, 1, 50.0)], "mesh_index long, raster_index long, area_m2 double")
    cell = spark.createDataFrame([(0, 100.0)], "mesh_index long, mesh_area_m2 double")
    raster = spark.createDataFrame([(0, 50.0), (1, 50.0)], "raster_index long, raster_area_m2 double")
    values = spark.createDataFrame([(0, 2.0, "a"), (1, 4.0, "b")], "raster_index long, value double, label string")
    assert overlap.mesh_means(over, cell, values).first()["value"] == 3
    f = overlap.class_fractions(over, cell, values, ["a", "b", "c"]).first()
    assert (f["fraction_a"], f["fraction_b"], f["fraction_c"]) == (0.5, 0.5, 0)
    depth = overlap.raster_depths(over, raster, spark.createDataFrame([(0, 0.25)], "mesh_index long, depth_m double")).collect()
    assert [r["depth_m"] for r in depth] == [0.25, 0.25]
    assert overlap.invalid_overlap(over, cell).count() == 0
    assert {r["reason"] for r in overlap.invalid_overlap(over, cell.withColumn("mesh_area_m2", F.lit(99.0))).collect()} == {"closure"}


def test_exact_raster_overlap(spark):
    two = squares(spark, box(0, 0, 100, 100), box(100, 0, 200, 100))
    got = polygons.raster_overlap(two, 0.0, 100.0, 100.0, 100.0, 1, 2).collect()
    assert {(r["mesh_index"], r["raster_index"]) for r in got} == {(0, 0), (1, 1)} and all(r["area_m2"] == pytest.approx(10_000, rel=1e-12) for r in got)
    tri = squares(spark, [(10, 10), (290, 40), (120, 230)])
    found = polygons.raster_overlap(tri, 0.0, 300.0, 37.0, 41.0, 8, 9).collect()
    assert sum(r["area_m2"] for r in found) == pytest.approx(mesh.faces(tri).first()["area"], rel=1e-10)


def test_regular_mesh(spark):
    cells = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "face_id long, row int, col int")
    edges = mesh.regular_edges(cells, 100.0, 100.0)
    assert edges.where("neighbor < 0").count() == 6
    assert {r["cfl_width_m"] for r in mesh.cfl_widths(edges).collect()} == {100.0}
    general = mesh.mesh_edges(mesh.regular_polygons(cells, 0.0, 0.0, 100.0, 100.0))
    key = lambda df: sorted((r["owner"], r["neighbor"], round(r["nx"], 9) + 0.0, round(r["ny"], 9) + 0.0, round(r["length_m"], 6), round(r["center_distance_m"], 6)) for r in df.collect())
    assert key(general) == key(edges)
    assert all(r["failures"] == 0 for r in mesh.validation(mesh.regular_polygons(cells, 0.0, 0.0, 100.0, 100.0), general).collect())


def test_short_face_is_found(spark):
    two = squares(spark, box(0, 0, 10, 1), box(10, 0, 20, 1))
    q = mesh.edge_quality(mesh.mesh_edges(two), 7.5, 0.0).first()
    assert (q["minimum_face_length_m"], q["short_faces"]) == (1.0, 1)
    assert mesh.undersized(mesh.faces(two), 5.0).count() == 2


def test_segments_of_one_pair_are_one_face(spark):
    left = [(0, 0), (10, 0), (10, 4), (10, 10), (0, 10)]
    right = [(10, 0), (20, 0), (20, 10), (10, 10), (10, 4)]
    edges = mesh.mesh_edges(squares(spark, left, right))
    inner = edges.where("neighbor >= 0").collect()
    assert len(inner) == 1 and inner[0]["segments"] == 2 and inner[0]["length_m"] == pytest.approx(10) and inner[0]["nx"] == pytest.approx(1)
    assert {r["cfl_width_m"] for r in mesh.cfl_widths(edges).collect()} == {10.0}


def test_topology_checks(spark):
    df = squares(spark, box(0, 0, 1, 1), box(1, 0, 2, 1), [(5, 0), (6, 0), (6, 1), (6, 0)])
    assert mesh.topology(df).where("n_owners = 2").count() >= 1
    assert {r["face_id"] for r in mesh.self_paired_faces(df).collect()} == {2}
    assert {r["face_id"] for r in mesh.null_area_faces(df).collect()} == {2}
    domain = spark.createDataFrame([(0.0, 0.0, 2.0, 0.0)], "ax double, ay double, bx double, by double")
    open_edges = mesh.internal_unpaired_edges(df.where("face_id < 2"), domain, 0.1)
    assert open_edges.count() == 4


def test_hanging_node_is_inserted(spark):
    df = squares(spark, box(0, 0, 2, 1), box(0, 1, 1, 2), box(1, 1, 2, 2))
    assert mesh.unpaired_edges(df).where("ay = 1 and by = 1").count() == 3
    fixed = mesh.with_nodes(df, mesh.hanging_nodes(df))
    assert mesh.unpaired_edges(fixed).where("ay = 1 and by = 1").count() == 0
    assert sum(r["area"] for r in mesh.faces(fixed).collect()) == pytest.approx(4)


def test_welding_and_merging(spark):
    df = squares(spark, [(0, 0), (10, 0), (10, 9.99), (10, 10), (0, 10)], box(10, 0, 20, 10))
    welded = mesh.welded(df, 0.5)
    assert welded.where("face_id = 0").count() == 4
    edges = mesh.mesh_edges(welded)
    groups = spark.createDataFrame([(0, "surface"), (1, "surface")], "face_id long, group string")
    pairs = mesh.repair_pairs(edges, spark.createDataFrame([(0,)], "face_id long"), groups)
    assert pairs.collect() == [(0, 1)]
    matching = mesh.merge_matching(pairs)
    outline = mesh.merged_cells(welded, matching)
    area = outline.select(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2)).first()[0]
    assert {r["face_id"] for r in outline.collect()} == {0} and area == pytest.approx(200, abs=0.2)


def test_voronoi_partitions_the_domain(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 100, (80, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "face_id long, x double, y double")
    cells = polygons.voronoi(df, box(0, 0, 100, 100), 50.0, 60.0)
    got = {r["face_id"]: r["area"] for r in mesh.faces(cells).collect()}
    assert len(got) == 80 and sum(got.values()) == pytest.approx(10_000)
    assert mesh.topology(cells).where("n_owners > 2").count() == 0
    grid = np.stack(np.meshgrid(np.arange(100) + 0.5, np.arange(100) + 0.5), -1).reshape(-1, 2)
    own = np.bincount(np.hypot(*(grid[:, None] - xy[None]).transpose(2, 0, 1)).argmin(1), minlength=80)
    assert all(abs(got[i] - own[i]) < 0.15 * own[i] + 12 for i in range(80))
    with pytest.raises(Exception, match="halo"):
        polygons.voronoi(df, box(0, 0, 100, 100), 10.0, 1.0).count()


def test_ladders():
    assert seeds.grading_ladder(30, 200, 2) == [30, 30, 60, 120, 200]
    assert seeds.graded_rows(30, 200, 2.0) == [60, 120, 200]
    assert seeds.grading_ladder(0, 10, 2) == []


def test_corridor_banks_lie_between_rows(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0, 40.0), (1, 1, 300.0, 0.0, 40.0)], "reach_id long, seq int, x double, y double, width_m double")
    pts = [(r["x"], r["y"], r["spacing"]) for r in seeds.corridor_points(line, 20.0, 20.0, 80.0, 1).collect()]
    ys = sorted({round(y, 6) for _, y, _ in pts})
    assert all(round(a + b, 6) == 0 for a, b in zip(ys, ys[::-1]))
    assert 10.0 in ys and 30.0 in ys
    legs = seeds.segments(line)
    core = seeds.river_core_seeds(legs, 30.0, 20.0, 30.0).collect()
    assert len(core) == 20 and {abs(r["y"]) for r in core} == {10.0}
    bank = seeds.bank_support_seeds(legs, 30.0, 20.0, 5.0).collect()
    assert {abs(r["y"]) for r in bank} == {30.0}


def test_placement_order(spark):
    a = spark.createDataFrame([(0.0, 0.0, 10.0)], "x double, y double, spacing double")
    b = spark.createDataFrame([(1.0, 0.0, 10.0), (9.0, 0.0, 10.0)], "x double, y double, spacing double")
    out = seeds.placed_in_order([("first", a, 0.25), ("second", b, 0.75)])
    assert {(r["name"], r["points"]) for r in seeds.point_budget(out).collect()} == {("first", 1), ("second", 1)}
    assert seeds.lattice(spark, (0, 0, 10, 4), 2.0).count() == 10


def test_geotiff_round_trip(spark, tmp_path):
    band = np.arange(300 * 280, dtype=float).reshape(300, 280)
    band[5, 7] = np.nan
    (tmp_path / "a.tif").write_bytes(rasters.encode_geotiff(band, 500.0, 900.0, 30.0, 20.0))
    out = rasters.read_geotiff(spark, str(tmp_path))
    assert out.count() == 300 * 280 - 1
    row = out.where("row = 299 and col = 3").first()
    assert (row["value"], row["x"], row["y"], row["cell_id"]) == (299 * 280 + 3, 500 + 3.5 * 30, 900 - 299.5 * 20, 299 * 280 + 3)
    tiles = rasters.geotiff_tiles(out.withColumnRenamed("value", "z"), "z", 500.0, 900.0, 30.0, 20.0, 256).collect()
    assert len(tiles) == 4
    again, grid = rasters.decode_geotiff(bytes(next(t["content"] for t in tiles if t["tile_row"] == 1 and t["tile_col"] == 1)))
    assert again[0, 0] == 256 * 280 + 256 and grid["x0"] == 500 + 256 * 30


def test_resampling_and_mosaic(spark):
    src = spark.createDataFrame([(0, c, float(v), c + 0.5, -0.5) for c, v in enumerate((10, 20, 8, 6))], "row int, col int, v double, x double, y double")
    mean = {r["col"]: r["v"] for r in overlap.area_mean_resample(src, "v", 1.0, 0.0, 0.0, 2.0).collect()}
    assert mean == {0: 15, 1: 7}
    at = spark.createDataFrame([(1, 1.0, -0.5), (2, 3.9, -0.5), (3, 99.0, 0.0)], "cell_id long, x double, y double")
    assert {r["cell_id"]: r["v"] for r in rasters.bilinear_resampled(at, src, "v", 0.0, 0.0, 1.0, 1.0).collect()} == {1: 15, 2: 6}
    assert {r["cell_id"]: r["v"] for r in rasters.nearest_resampled(at, src, "v", 0.0, 0.0, 1.0, 1.0).collect()} == {1: 20, 2: 6, 3: None}
    tiles = spark.createDataFrame([(0, 0, None, 0), (0, 0, 5.0, 1), (0, 0, 7.0, 2)], "row int, col int, v double, tile_order int")
    assert rasters.mosaic(tiles, "v").first()["v"] == 5
    gaps = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (0, 9, None)], "row int, col int, v double")
    assert {r["col"]: r["v"] for r in rasters.gaps_filled(gaps, "v", 2).collect()} == {0: 1, 1: 2, 2: 3, 9: None}


def test_overlap_of_many_polygons_is_cut_side_by_side():
    """200,000 squares within seconds, with all of each square counted."""
    n = 200_000
    at = np.repeat(np.arange(n) % 447, 4) * 1.0, np.repeat(np.arange(n) // 447, 4) * 1.0
    x, y = at[0] + np.tile([0.25, 1.25, 1.25, 0.25], n), at[1] + np.tile([0.5, 0.5, 1.5, 1.5], n)
    extent = tuple(np.full(n, v) for v in (0, 0, 448, 449))
    begin = time.process_time()
    ring, row, col, area = polygons.ring_cells(np.repeat(np.arange(n), 4), x, y, extent)
    assert time.process_time() - begin < 20
    assert len(ring) == 4 * n and np.allclose(np.bincount(ring, np.abs(area)), 1.0)
    assert np.isclose(np.abs(area)[(row == 3) & (col == 7)].sum(), 1.0)


def test_overlap_with_a_hole_across_batches(spark):
    """A large ring with a hole, beyond the grid on one side, whose vertices come in several batches."""
    ring = [(i / 50, 0.0) for i in range(-100, 1000)] + [(i / 50, 20.0) for i in range(1000, -100, -1)]
    hole = [(4.5, 4.0), (4.5, 8.0), (6.5, 8.0), (6.5, 4.0)]
    rows = [(7, 0, s, x, y) for s, (x, y) in enumerate(ring)] + [(7, 1, s, x, y) for s, (x, y) in enumerate(hole)]
    shape = spark.createDataFrame(rows, "face_id long, ring int, seq int, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["raster_index"]: r["area_m2"] for r in polygons.raster_overlap(shape, 0.0, 20.0, 1.0, 1.0, 20, 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Rows are counted from the south; the hole takes half of columns 4 and 6 and all of column 5 in rows 4 to 7.
    want = {r * 10 + c: 1.0 - (4 <= r < 8) * {4: 0.5, 5: 1.0, 6: 0.5}.get(c, 0.0) for r in range(20) for c in range(10)}
    assert got == pytest.approx({k: v for k, v in want.items() if v})
