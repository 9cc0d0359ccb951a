import numpy as np
from pyspark.sql import functions as F

from fluvia.plans import features, reports
from tests.grids import band, cells


def test_major_rivers_fall_back_to_all(spark):
    df = cells(spark, width=[[10.0, 50.0, 10.0]], area_km2=[[10.0, 10.0, 100.0]], river=[[True, True, True]])
    assert list(band(features.major_rivers(df, features.Candidates()), "major").values()) == [False, True, True]
    low = df.withColumns({"width": F.lit(1.0), "area_km2": F.lit(1.0)})
    assert all(band(features.major_rivers(low, features.Candidates()), "major").values())


def landscape(spark, n=12):
    z = (np.abs(np.arange(n)[None] - 5.0) * 2 + np.zeros((n, 1))).tolist()
    df = cells(spark, z=z).withColumns({
        "river": F.col("col") == 5, "width": F.lit(60.0), "area_km2": F.lit(80.0), "water": (F.col("col") >= 8) & (F.col("col") <= 9) & (F.col("row") < 4),
        "impervious": F.when(F.col("cell_id") == 0, 5.0).otherwise(0.0), "people_km2": F.lit(None).cast("double"),
    })
    return df


def test_floodplain_urban_and_classes(spark):
    settings = features.Candidates(cell_m=30.0, hand=4.0, distance=90.0, minimum_area=900.0 * 4, hole_area=900.0, urban_buffer=30.0, water_area=900.0 * 4, water_distance=120.0)
    df = features.major_rivers(landscape(spark), settings)
    out = features.classified(features.urban(features.floodplain(df, settings), settings))
    rows = {r["cell_id"]: r for r in out.collect()}
    assert rows[5]["feature_class"] == "river" and rows[4]["feature_class"] == "floodplain" and rows[0]["feature_class"] == "urban" and rows[8]["feature_class"] == "waterbody" and rows[11]["feature_class"] == "rural"
    assert not rows[2]["floodplain"] and rows[3]["floodplain"]
    assert rows[8]["class_code"] == 4
    sizes = features.target_sizes(out, {"rural": 120.0, "urban": 45.0, "floodplain": 60.0, "river": 30.0, "waterbody": 120.0}, 2.0, 8)
    got = {(r["row"], r["col"]): r["target"] for r in sizes.collect()}
    assert got[(0, 5)] == 30 and all(got[(r, c)] <= 2 * got[(r, c + 1)] + 1e-9 for r in range(12) for c in range(11))
    assert features.outlines(out.withColumn("m", F.col("feature_class") == "waterbody"), "m", settings).count() == 12


def test_waterbodies(spark):
    settings = features.Candidates(cell_m=30.0, water_area=900.0 * 4, water_distance=120.0)
    df = features.waterbodies(landscape(spark), settings)
    assert df.where("waterbody is not null").count() == 8
    far = features.waterbodies(landscape(spark), features.Candidates(cell_m=30.0, water_area=900.0 * 4, water_distance=10.0))
    assert far.where("waterbody is not null").count() == 0
    level = df.withColumn("z", F.when(F.col("col") >= 7, 6.0).otherwise(F.col("z")))
    wide = features.Candidates(cell_m=30.0, refinement=(0.25, 3.0))
    assert features.refined_waterbodies(level, wide, reach=31.0).where("refined is not null").count() == 8 + 4 + 4 + 2
    assert features.refined_waterbodies(level, settings, reach=31.0).where("refined is not null").count() == 0


def test_reports(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    rows = {r["check"]: r["ok"] for r in reports.preflight(spark, {"rows": 3, "cols": 3, "dx": 30, "dy": 30, "projected": True}, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert rows[f"exists:{tmp_path / 'a'}"] and not rows[f"exists:{tmp_path / 'b'}"] and rows["size"] and rows["projected"]
    record = {r["key"]: r["value"] for r in reports.run_record(spark, {"a": 1}, {"dem": "x"}).collect()}
    assert len(record["settings_sha256"]) == 64 and record["output:dem"] == "x"
    assert reports.theme("D4_flow_accumulation") == "d4" and reports.theme("DEM_final") == "dem" and reports.theme("zzz") == "misc"
    assert reports.output_path("/o/", "run_manifest.json") == "/o/reports/run_manifest.json"
