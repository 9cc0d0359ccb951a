import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import forest, mesh, network, polygons, stencil
from fluvia.plans import benchmarks, mesh_repair
from tests.grids import band, cells
from tests.test_mesh import box, squares

REACHES = "reach_id long, next_down long, area_km2 double, order int, vertices array<struct<x:double,y:double>>"


def reaches(spark):
    xy = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    return spark.createDataFrame([(1, 2, 100.0, 0, xy((1.2, 2.5), (0.2, 2.5))), (2, 0, 200.0, 1, xy((1.2, 2.5), (3.2, 2.5)))], REACHES)


def test_mapped_network(spark):
    out = network.grid_network(reaches(spark), 3, 5, 0.0, 3.0, 1.0, 1.0, 0.0)
    recv, area = band(out, "receiver"), band(out, "area_km2")
    assert set(recv) == {0, 1, 2, 3} and [recv[i] for i in range(4)] == [1, 2, 3, None]
    assert area[0] == 100 and area[1] == 200
    with pytest.raises(ValueError):
        network.grid_network(reaches(spark), 3, 5, 0.0, 3.0, 1.0, 1.0, 1e9)


def test_mapped_network_snaps_to_low_cells(spark):
    terrain = cells(spark, z=[[9.0] * 5, [1.0] * 5, [9.0] * 5])
    out = network.grid_network(reaches(spark), 3, 5, 0.0, 3.0, 1.0, 1.0, 0.0, terrain, 1)
    assert all(i // 5 == 1 for i in band(out, "receiver"))


def test_staircase():
    assert network.staircase((0, 0), (1, 2)) == [(0, 0), (0, 1), (0, 2), (1, 2)]
    assert network.staircase((2, 2), (2, 2)) == [(2, 2)]


def test_burned_channel(spark):
    df = cells(spark, z=[[5.0] * 6] * 3).withColumns({"x": F.col("col") + 0.5, "y": 2.5 - F.col("row")})
    seg = spark.createDataFrame([(0.0, 1.5, 6.0, 1.5, 2.0, 0.6)], "ax double, ay double, bx double, by double, bed double, half_width double")
    out = network.burned_channel(df, seg)
    assert {r["row"]: r["z"] for r in out.collect()} == {0: 5, 1: 2, 2: 5}


def test_tilted_v(spark):
    df = benchmarks.tilted_v(spark, 100.0)
    assert benchmarks.equilibrium_discharge() == pytest.approx(4.86, abs=0.005)
    full = benchmarks.tilted_v(spark, 20.0)
    acc = forest.accumulation(stencil.receivers(full, "z", "d4", 20, 20))
    assert acc.agg(F.max("accumulation")).first()[0] == full.count() and df.count() > 0
    assert benchmarks.uniform_channel(spark, 100, 20, 20, 1, 0.001, 10).where("channel").count() == 20


def test_repair_keeps_the_partition(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 100, (40, 2))
    seeds = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "face_id long, x double, y double")
    shapes = polygons.voronoi(seeds, box(0, 0, 100, 100), 100.0, 100.0)
    fixed, report = mesh_repair.repaired(shapes, 1.0, 4.0, rounds=4)
    areas = {r["face_id"]: r for r in mesh.faces(fixed).collect()}
    assert sum(r["area"] for r in areas.values()) == pytest.approx(10_000, rel=1e-3) and 0 < len(areas) < 40
    assert report.count() >= 1
    small = lambda df: mesh.undersized(mesh.faces(df), 4.0).count()
    assert small(fixed) < small(shapes)


def test_stitching_makes_rings_and_holes(spark):
    ring = squares(spark, box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 1, 1, 2), box(2, 1, 3, 2), box(1, 1, 2, 2)).where("face_id < 4")
    lone = mesh.unpaired_edges(mesh.with_nodes(ring, mesh.hanging_nodes(ring))).withColumn("face_id", F.lit(1).cast("long"))
    out = polygons.stitched(lone)
    assert out.select("ring").distinct().count() == 2 and mesh.faces(out).first()["area"] == pytest.approx(8)


def test_staircase_keeps_to_the_longer_way():
    for dr in range(-5, 6):
        for dc in range(-5, 6):
            path = network.staircase((3, 4), (3 + dr, 4 + dc))
            assert path[0] == (3, 4) and path[-1] == (3 + dr, 4 + dc) and len(path) == 1 + abs(dr) + abs(dc)
            for (r, c), (nr, nc) in zip(path, path[1:]):
                left = abs(3 + dr - r), abs(4 + dc - c)
                assert (abs(nr - r), abs(nc - c)) == ((0, 1) if left[1] >= left[0] else (1, 0))
