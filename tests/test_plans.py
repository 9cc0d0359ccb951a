import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions.tables import settled
from fluvia.operators import forest, stencil
from fluvia.plans import calibrate, conditioning, design_flood, mesh_product
from fluvia.sources import config, rasters, vectors
from fluvia.streaming import gauges
from tests.grids import band, cells, random_terrain


def valley(spark, rows=12, cols=9):
    rng = np.random.default_rng(4)
    z = (np.abs(np.arange(cols) - cols // 2)[None] * 3.0 + (rows - np.arange(rows))[:, None] * 1.0 + rng.random((rows, cols)) * 0.2).tolist()
    return cells(spark, z=z)


def test_conditioning_run(spark):
    df = valley(spark).withColumn("z", F.when(F.col("cell_id") != 40, F.col("z")))
    settings = conditioning.Conditioning(river_min_area_km2=0.02, width=(20.0, 0.1), depth=(1.0, 0.1), pit_min_depth=0.5, tile=8)
    out = conditioning.run(df, settings)
    rows = out.cells.collect()
    assert len(rows) == 108 and all(r["final"] <= r["z"] + 1e-9 for r in rows)
    assert any(r["river"] for r in rows) and all(r["lowering"] == 0 for r in rows if not r["river"])
    bed = {r["cell_id"]: r["z"] - r["depth"] for r in rows if r["river"]}
    assert all(bed[r["receiver"]] <= bed[r["cell_id"]] + 1e-9 for r in rows if r["river"] and r["receiver"] in bed)
    assert {r["metric"] for r in out.scorecard.collect()} >= {"changed_percent", "max_h_abg_m", "max_sill_m", "largest_component_percent"}
    assert out.delta.first()["valid_cells"] == 107


def test_routing_needs_an_outlet(spark):
    from fluvia.operators import fixpoint

    df = valley(spark).withColumn("closed", F.lit(True))
    with pytest.raises(ValueError):
        fixpoint.routing_surface(df, "z", 0.01, "closed")


def routed(spark):
    linked = settled(stencil.receivers(valley(spark), "z", "d4", 30, 30))
    acc = forest.accumulation(linked)
    return settled(linked.join(acc, "cell_id").withColumns({"river": F.col("accumulation") >= 10, "cn": F.lit(80.0)}))


def test_design_peaks_grow_downstream(spark):
    df = routed(spark)
    out = design_flood.peaks(df.withColumn("cn", F.when(F.col("cell_id") % 7 > 0, F.col("cn"))), design_flood.Hydrograph())
    peak, recv, river = band(out, "peak_m3s"), band(df, "receiver"), band(df, "river")
    assert all(peak[recv[i]] >= peak[i] * 0.9 for i in river if river[i] and recv[i] is not None)
    with pytest.raises(ValueError):
        design_flood.peaks(df.withColumn("cn", F.lit(None).cast("double")), design_flood.Hydrograph())


def test_corridor_solves_river_sections(spark):
    df = routed(spark)
    directed = df.withColumns({"direction": F.when(F.col("receiver").isNotNull(), stencil.direction_code(F.lit(9), F.col("cell_id"), F.col("receiver")).cast("int")), "width": F.lit(12.0), "depth": F.lit(0.6), "peak": F.col("accumulation") * 0.2})
    settings = design_flood.Corridor(half_width_m=120.0, bank_m=30.0, window_m=90.0)
    stages = settled(design_flood.wetted(directed, 12, 9, settings))
    n = directed.where("river").count()
    assert stages.count() == n and stages.where("stage_m is null").count() == 0
    wet = design_flood.floodplain(design_flood.terminal_directions(directed), stages, 12, 9, settings)
    assert wet.count() >= n
    active = df.join(wet.select("cell_id", F.lit(True).alias("active")), "cell_id", "left").withColumns({"active": F.coalesce("active", F.lit(False)), "bed": F.col("z") - 0.6})
    paths = design_flood.floodplain_routing(active, "active", "river", "bed", 8)
    assert paths.where("receiver is null").count() == n


def test_terminal_directions(spark):
    df = cells(spark, direction=[[2, None, 4]], width=[[20.0, 30.0, 50.0]], river=[[True, True, True]])
    assert [band(design_flood.terminal_directions(df), "direction")[i] for i in range(3)] == [2, 4, 4]


def test_calibration_threshold(spark):
    rng = np.random.default_rng(8)
    terrain = cells(spark, z=random_terrain(3, 20, 20))
    linked = settled(stencil.receivers(terrain, "z", "d4", 1000.0, 1000.0))
    grid = settled(linked.join(forest.accumulation(linked), "cell_id").withColumn("area_km2", F.col("accumulation").cast("double")))
    reaches = []
    for i in range(300):
        x, y = float(rng.uniform(0, 19_000)), -float(rng.uniform(0, 19_000))
        area = float(10 ** rng.uniform(0, 2))
        reaches.append((i, [{"x": x, "y": y}, {"x": x + 900, "y": y}], area, 3 * area**0.4 * float(np.exp(rng.normal(0, 0.05))), 0.2 * area**0.3))
    df = spark.createDataFrame(reaches, "COMID long, vertices array<struct<x:double,y:double>>, lin_area_km2 double, lin_width_m double, lin_depth_m double")
    settings = calibrate.Calibration(cell_m=1000.0, max_distance=1e6, ratios=(0.0, 1e9), min_samples=10, min_range=0.2)
    row, zones, table, zoned = calibrate.threshold_row(grid, df, 5.0, settings)
    got = row.first()
    assert got["samples_total"] == 300 and got["width_rmse_log"] < 0.2 and got["total_sampled_zones"] == zones.count()
    assert zones.where("beta_2 between 0.2 and 0.6").count() == zones.count()
    out = calibrate.maps(zoned, table, settings, 5.0, 50.0)
    assert out.where("area_km2 >= 5 and width_m is null").count() == 0
    assert calibrate.sweep(grid, df, [5.0, 9.0], settings).count() == 2


def test_regular_and_voronoi_products(spark, tmp_path):
    df = valley(spark)
    grid = mesh_product.Grid(12, 9, 0.0, 360.0, 30.0)
    made = mesh_product.regular(df.where("cell_id <> 50"), grid)
    ids = sorted(r["face_id"] for r in made.faces.collect())
    assert ids == list(range(107))
    assert {r["key"]: r["value"] for r in made.contract.collect()}["boundary_neighbor"] == "-1"
    rng = np.random.default_rng(1)
    seeds = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((0, 0), (270, 360), (25, 2)))], "face_id long, x double, y double")
    domain = [(0.0, 0.0), (270.0, 0.0), (270.0, 360.0), (0.0, 360.0)]
    mesh = mesh_product.voronoi(df, seeds, domain, grid, 200.0, 300.0)
    assert mesh.faces.agg(F.sum("area_m2")).first()[0] == pytest.approx(270 * 360)
    classed = mesh_product.Mesh(mesh.faces.withColumn("kind", F.when(F.col("face_id") % 2 == 0, "river").otherwise("rural")), mesh.edges, mesh.overlap, mesh.contract)
    curves, faces = mesh_product.subgrid_curves(classed, df, grid, "kind")
    assert curves.count() == 25 and faces.count() == mesh.edges.where("neighbor >= 0").count()
    assert faces.where("size(curve) < 2").count() == 0
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = mesh_product.manifest(spark, str(tmp_path), {"a": 1}).first()
    assert row["bytes"] == 3 and len(row["sha256"]) == 64
    with pytest.raises(ValueError):
        mesh_product.regular(df, mesh_product.Grid(12, 9, 0, 0, 30, projected=False))


def test_configuration(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cell-m": 30, "x": True}))
    (tmp_path / "b.toml").write_text('cell-m = 20\n[mesh]\na = 1\n')
    assert config.load(tmp_path / "a.json") == {"cell_m": 30, "x": True}
    assert config.load(tmp_path / "b.toml")["cell_m"] == 20
    assert config.typed_flags(["--cell-m=3", "--x", "v"]) == {"cell_m", "x"}
    assert config.merged({"a": 1, "b": 2}, {"b": 3}, {"c-d": 4}) == {"a": 1, "b": 3, "c_d": 4}
    assert config.as_arguments({"cell_m": 30, "x": True, "y": False, "z": None}) == ["--cell-m", "30", "--x"]
    (tmp_path / "c.yaml").write_text("a: 1")
    with pytest.raises(ValueError):
        config.load(tmp_path / "c.yaml")


def test_rasters_and_vectors(spark):
    df = spark.createDataFrame([(0, 0, -9999.0), (0, 1, float("nan")), (0, 2, 4.0)], "row int, col int, z double")
    assert [r["z"] for r in rasters.with_nulls(df, {"z": -9999.0}).collect()] == [None, None, 4.0]
    grid = {"rows": 1, "cols": 3, "x0": 0, "y0": 0, "dx": 1, "dy": 1, "crs": "a"}
    rasters.assert_aligned(grid, {**grid, "crs": "b"}, "mask", crs=False)
    with pytest.raises(ValueError, match="crs"):
        rasters.assert_aligned(grid, {**grid, "crs": "b"}, "mask")
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 5.0, 5.0, 6.0, 6.0)], "path string, xmin double, ymin double, xmax double, ymax double")
    assert [r["path"] for r in rasters.tiles_near(tiles, (0.5, 0.5, 2, 2)).collect()] == ["a"]
    body = json.dumps({"elements": [{"type": "way", "id": 1, "tags": {"natural": "water"}, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]}, {"type": "way", "id": 2, "tags": {}, "geometry": [{"lat": 0, "lon": 0}]}]})
    elements = vectors.map_elements(spark.createDataFrame([(body,)], "body string"))
    assert [(r["id"], r["kind"]) for r in vectors.water_polygons(elements).collect()] == [(1, "water")] and vectors.lines(elements).count() == 1
    a = vectors.table_digest(df.na.fill(0)).first()
    assert a == vectors.table_digest(df.na.fill(0).orderBy(F.desc("col"))).first()
    ground = cells(spark, z=[[1.0, 5.0]])
    line = spark.createDataFrame([(1, [{"x": 0.5, "y": -0.5}, {"x": 1.5, "y": -0.5}], 3.0), (2, [{"x": 0.0, "y": 0.0}], 0.0)], "id long, vertices array<struct<x:double,y:double>>, width_m double")
    assert [r["vertices"][0]["x"] for r in vectors.downhill(line, ground, "z", 0.0, 0.0, 1.0, 1.0).collect()] == [1.5]


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=7 * i), i % 2, float(i)) for i in range(40)]
    spark.createDataFrame(rows, "ts timestamp, gauge int, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, gauge int, value double").parquet(str(tmp_path / "in"))
    query = gauges.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("levels").start()
    query.processAllAvailable()
    query.stop()
    batch = gauges.windowed(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(spark.table("levels").collect()) == sorted(batch.collect())
    sections = spark.createDataFrame([(0, 1.0, 10.0, 0.001), (1, 1.0, 10.0, 0.001)], "gauge int, bed double, width double, slope double")
    assert gauges.discharge(spark.read.parquet(str(tmp_path / "in")), sections).where("value <= 1 and discharge_m3s > 0").count() == 0
    assert gauges.sessions(spark.read.parquet(str(tmp_path / "in")), 30.0).count() == 2
