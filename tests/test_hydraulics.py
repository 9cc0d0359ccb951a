import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H
from fluvia.functions import labels as L
from fluvia.operators import calibration, profiles, subgrid, summaries
from tests.grids import band, cells


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_power_law_rivers(spark):
    df = cells(spark, a=[[0.0, 1.0], [4.0, 9.0]], r=[[False, True], [True, False]])
    assert list(band(df.withColumn("w", H.river_power_law("a", "r", 2.0, 0.5)), "w").values()) == [0, 2, 4, 0]
    assert list(band(df.withColumn("d", H.river_power_law("a", "r", 0.5, 1.0)), "d").values()) == [0, 0.5, 2, 0]


def test_equivalent_lowering(spark):
    assert one(spark, H.equivalent_lowering(F.lit(100.0), F.lit(2.0), 1000.0)) == pytest.approx(((100 / 1000) * 2 ** (5 / 3)) ** 0.6)
    exact = one(spark, H.equivalent_lowering(F.lit(100.0), F.lit(2.0), 1000.0, "manning_exact"))
    term = lambda w, d: w * d * (w * d / (w + 2 * d)) ** (2 / 3)
    assert term(1000, exact) == pytest.approx(term(100, 2), rel=1e-6)
    assert one(spark, H.equivalent_lowering(F.lit(0.0), F.lit(2.0), 1000.0)) == 0


def test_manning_depth(spark):
    m = one(spark, H.manning_depth(F.lit(50.0), F.lit(20.0), F.lit(0.001), 0.035, 20.0))
    d = m["depth"]
    assert 20 * d * (20 * d / (20 + 2 * d)) ** (2 / 3) * 0.001**0.5 / 0.035 == pytest.approx(50, rel=1e-6) and not m["clipped"]
    assert one(spark, H.manning_depth(F.lit(1e9), F.lit(1.0), F.lit(0.001), 0.035, 20.0))["clipped"]


def test_runoff(spark):
    assert one(spark, H.scs_runoff_mm(F.lit(5.0), F.lit(75.0))) == 0
    assert one(spark, H.scs_runoff_mm(F.lit(100.0), F.lit(75.0))) > 0


def ground(*values):
    return F.array(*[F.lit(v).cast("double") for v in values])


def test_connected_depths(spark):
    assert one(spark, H.connected_depths(ground(99, 101, 98), F.lit(100.0))) == [1, 0, 0]
    assert one(spark, H.connected_depths(ground(99, None, 98), F.lit(100.0))) == [1, 0, 0]


def test_stage_carries_the_discharge(spark):
    args = (F.lit(10.0), F.lit(2.0), F.lit(30.0), F.lit(0.001), ground(12, 12.5, 15), ground(12.2, 13, 16), F.lit(30.0), 0.035, 0.05)
    stage = one(spark, H.solve_stage(F.lit(200.0), *args, 20.0))
    assert one(spark, H.compound_discharge(F.lit(stage), *args)) == pytest.approx(200, rel=1e-6)
    assert one(spark, H.solve_stage(F.lit(1e9), *args, 20.0)) is None


def test_labels(spark):
    assert L.parse_resolution("30") == 30 and L.parse_resolution("30x60") == (30, 60) and L.resolution_label(12.5) == "12p5m" and L.resolution_label(1000) == "1000m"
    assert one(spark, L.resolution_label_column(F.lit(12.5))) == "12p5m" and one(spark, L.resolution_label_column(F.lit(1000.0))) == "1000m"
    assert one(spark, L.train_mask(F.lit(None).cast("long"))) is False and one(spark, L.train_mask(F.lit(-7))) is True
    with pytest.raises(ValueError):
        L.subgrid_policy(F.lit("river"), "nope")


def stations(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "reach_id long, seq int, s_m double, value double")


def test_moving_median_and_slopes(spark):
    df = stations(spark, [(0.0, 100.0), (300.0, 80.0), (600.0, 100.0)])
    assert [r["smoothed"] for r in profiles.smoothed_profile(df, "value", 600.0).orderBy("seq").collect()][1] == 100
    slopes = [r["slope"] for r in profiles.smoothed_slopes(df, "value", 10.0, 0.0001, 0.05).orderBy("seq").collect()]
    assert slopes == pytest.approx([0.05, 0.0001, 0.0001])


def test_interpolation_and_resampling(spark):
    from fluvia.operators import seeds

    points = spark.createDataFrame([(1, -1.0), (1, 0.5), (1, 1.0), (1, 9.0)], "k long, x double")
    curve = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0), (1, 2.0, 0.0)], "k long, x double, y double")
    got = sorted((r["x"], r["y"]) for r in profiles.interpolated(points, curve, "k", "x", "y").collect())
    assert got == [(-1, 10), (0.5, 15), (1, 20), (9, 0)]
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0)], "reach_id long, seq int, x double, y double")
    assert [r["x"] for r in seeds.resampled(line, 3.0).orderBy("seq").collect()] == [0, 2.5, 5, 7.5, 10]
    smooth = profiles.corner_cut(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 4.0, 4.0)], "reach_id long, seq int, x double, y double"), 1).orderBy("seq").collect()
    assert [(r["x"], r["y"]) for r in smooth] == [(0, 0), (1, 0), (3, 0), (4, 1), (4, 3), (4, 4)]


def test_cross_sections(spark):
    s = spark.createDataFrame([(1, 2, 2, 2)], "section_id long, row int, col int, direction int")
    got = {(r["side"], r["k"]): (r["row"], r["col"]) for r in profiles.cross_sections(s, 5, 5, 1, 2, "d8").collect()}
    assert got == {("left", 1): (1, 1), ("left", 2): (0, 0), ("right", 1): (3, 3), ("right", 2): (4, 4)}


def test_robust_fit_recovers_a_law_with_outliers(spark):
    rng = np.random.default_rng(1)
    rows = []
    for zone in (1, 2, 3):
        area = 10 ** rng.uniform(0, 3, 80)
        width = (2.0 + zone) * area ** (0.3 + 0.05 * zone) * np.exp(rng.normal(0, 0.02, 80))
        width[:6] *= 40
        rows += [(zone, float(a), float(w)) for a, w in zip(area, width)]
    rows += [(4, 1.0, 2.0), (4, None, 3.0), (5, 10.0, -1.0)]
    df = spark.createDataFrame(rows, "zone_id long, a double, w double")
    got = {r["zone_id"]: r for r in calibration.robust_fits(df, "a", "w", ["zone_id"], 30, 0.35, (0.05, 1.2), 3.5, 0.35).collect()}
    for zone in (1, 2, 3):
        assert got[zone]["valid"] and got[zone]["n_used"] == 74
        assert got[zone]["coefficient"] == pytest.approx(2.0 + zone, rel=0.03) and got[zone]["exponent"] == pytest.approx(0.3 + 0.05 * zone, abs=0.01)
    assert not got[4]["valid"] and got[4]["n_total"] == 1 and got[5]["n_total"] == 0
    whole = calibration.robust_fits(df.where("zone_id = 1"), "a", "w", [], 30, 0.35, (0.05, 1.2), 3.5, 0.35).first()
    assert whole["exponent"] == pytest.approx(got[1]["exponent"])


def test_midpoints(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), (2, [(1.0, 1.0)])], "k long, vertices array<struct<x double, y double>>".replace("x double", "x: double").replace("y double", "y: double"))
    got = {r["k"]: (r["x"], r["y"]) for r in calibration.midpoints(df).collect()}
    assert got == {1: (4, 0), 2: (None, None)}


def test_volume_curve_and_inverse(spark):
    patches = spark.createDataFrame([(0, 50.0, 1.0), (0, 30.0, 2.0), (0, 20.0, 4.0), (1, 100.0, 5.0), (0, 5.0, None)], "cell long, area_m2 double, z double")
    plan = spark.createDataFrame([(0, 100.0, True, 1.9), (1, 100.0, False, 5.5)], "cell long, plan_area_m2 double, pooled boolean, bed double")
    curves = subgrid.cell_volume_curves(patches, plan, pooled="pooled", bed_mean="bed")
    got = {r["cell"]: r for r in curves.collect()}
    assert [tuple(p) for p in got[0]["curve"]] == [(0, 0, 50), (1, 50, 80), (3, 210, 100)]
    assert got[1]["datum_m"] == 5.5 and [tuple(p) for p in got[1]["curve"]] == [(0, 0, 100)]
    for volume in (0.0, 25.0, 50.0, 100.0, 900.0):
        stage = subgrid.stage_of(F.col("curve"), F.col("datum_m"), F.col("plan_area_m2"), F.lit(volume))
        again = curves.select("cell", subgrid.volume_of(F.col("curve"), F.col("datum_m"), F.col("plan_area_m2"), stage).alias("v"))
        assert all(r["v"] == pytest.approx(volume) for r in again.collect())


def test_bed_plane_is_exact_on_a_plane(spark):
    rows = [(0, 1.0, 2.0 + 0.5 * x - 0.25 * y, float(x), float(y)) for x in range(3) for y in range(3)] + [(1, 1.0, 7.0, 0.0, 0.0)]
    out = subgrid.bed_planes(spark.createDataFrame(rows, "cell long, area_m2 double, z double, x double, y double"))
    assert all(r["plane"] == pytest.approx(r["z"]) for r in out.collect())


def test_conveyance_within_tolerance(spark):
    station = np.linspace(0, 40, 9)
    bed = np.array([3.0, 2, 1, 0.5, 0, 0.4, 1.2, 2.1, 3.3])
    datum, curve = subgrid.conveyance_curve(station, bed, np.full(9, 0.035))
    assert datum == 0 and (np.diff(curve[:, 0]) > 0).all() and (np.diff(curve[:, 3]) >= 0).all() and len(curve) <= 160
    points = [{"station": float(s), "bed": float(b), "n": 0.035} for s, b in zip(station, bed)]
    df = spark.createDataFrame([(1, points), (2, points[:1])], "face long, points array<struct<station:double,bed:double,n:double>>")
    curves = subgrid.face_conveyance_curves(df)
    at = {r["face"]: r["k"] for r in curves.select("face", subgrid.curve_value(F.col("curve"), F.col("datum_m"), F.lit(2.0), "conveyance").alias("k")).collect()}
    low, across, along = (bed[:-1] + bed[1:]) / 2, np.diff(station), np.hypot(np.diff(station), np.diff(bed))
    area = np.maximum(2.0 - low, 0) * across
    assert at[1] == pytest.approx((area / 0.035 * (area / along) ** (2 / 3)).sum(), rel=0.02) and at[2] == 0


def test_summaries(spark):
    df = cells(spark, v=[[1.0, None, 3.0, -2.0]], m=[[True, True, False, True]])
    row = summaries.band_statistics(df, "v", positive_only=True).first()
    assert (row["cells"], row["median"], row["maximum"]) == (2, 2, 3)
    out, stats = summaries.river_only(df, "v", "m")
    assert band(out, "v") == {0: 1, 1: None, 2: None, 3: None} and stats.first()["count"] == 1
    assert summaries.markdown(spark.createDataFrame([(1, "a")], "n int, s string")).splitlines()[2].startswith("| 1")


@pytest.mark.parametrize("by", [["k"], []])
def test_medians_of_large_groups_are_exact(spark, monkeypatch, by):
    """A hot group, groups of one and two, repeated values: by rank over range partitions as in one buffer."""
    rows = [(1, float(v * 37 % 101)) for v in range(4000)] + [(2, 5.0), (3, 1.0), (3, 2.0), *[(4, 7.0)] * 50, (4, 9.0)]
    df = spark.createDataFrame(rows, "k int, e double").repartition(6)
    want = {tuple(r) for r in calibration.medians(df, by, "e", "med", 0).collect()}
    monkeypatch.setattr(calibration, "MEDIAN_ROWS", 0)
    assert {tuple(r) for r in calibration.medians(df, by, "e", "med", 4000).collect()} == want


def test_conveyance_of_many_faces_side_by_side(spark):
    """Faces of different lengths, with gaps, with room for few levels: tolerance, tops and the single results."""
    rng = np.random.default_rng(8)
    faces = [(np.cumsum(rng.uniform(0.5, 4, n)), rng.uniform(0, 6, n), rng.uniform(0.02, 0.1, n)) for n in (2, 3, 40, 300, 7)]
    faces[4][1][2] = np.nan
    together = subgrid._Sections(np.repeat(np.arange(5), [len(f[0]) for f in faces]), *(np.concatenate([f[k] for f in faces]) for k in range(3)), 5)
    own, values = subgrid.conveyance_curves(together, subgrid.FILTER_M, 10.0, subgrid.CONVEYANCE_TOLERANCE, 160)
    for k, (station, bed, rough) in enumerate(faces):
        datum, alone = subgrid.conveyance_curve(station, bed, rough)
        curve = values[own == k]
        assert np.allclose(curve, alone) and datum == together.datum[k] == np.nanmin(bed)
        low = (bed[1:] + bed[:-1]) / 2 - datum
        fine = np.isfinite(low)
        assert len(curve) <= 160 and curve[-1, 0] >= low[fine].max() + 10 and (np.diff(curve, axis=0)[:, [0, 1, 3]] >= 0).all()
        for z in np.linspace(0.01, curve[-1, 0], 50):
            area = np.maximum(z - low, 0) * np.diff(station)
            k_exact = np.nansum(area / ((rough[1:] + rough[:-1]) / 2) * (area / np.hypot(np.diff(station), np.diff(bed))) ** (2 / 3))
            near = 0.25 if len(curve) == 160 else 2 * subgrid.CONVEYANCE_TOLERANCE
            assert np.interp(z, curve[:, 0], curve[:, 3]) == pytest.approx(k_exact, rel=near, abs=1e-6)
    few = subgrid.conveyance_curves(together, 0.0, 10.0, 1e-9, 40)
    assert np.bincount(few[0]).max() <= 60 and all(few[1][few[0] == k][-1, 0] == values[own == k][-1, 0] for k in range(5))


def test_manning_depth_equals_halvings_and_is_worked_out_once(spark):
    """Depths from shallow to deep against 200 halvings, and no condition that repeats them below the columns."""
    from fluvia.plans.reaches import reach_geometry

    def halved(term, w, top):
        lo, hi = 0.0, top
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if w * mid * (w * mid / (w + 2 * mid)) ** (2 / 3) < term else (lo, mid)
        return hi

    cases = [(q, w, s) for q in (1e-6, 0.3, 40.0, 9e3, 1e7) for w in (1e-3, 0.5, 17.0, 2e4) for s in (1e-5, 0.02)]
    got = spark.createDataFrame(cases, "q double, w double, s double").select("q", "w", "s", H.manning_depth("q", "w", "s", 0.035, 20.0).alias("m")).collect()
    assert [r["m"]["depth"] for r in got] == pytest.approx([halved(r["q"] * 0.035 / r["s"] ** 0.5, r["w"], 20.0) for r in got], rel=1e-12)
    rows = spark.createDataFrame([("1", "20", "50", "0.001"), ("2", "bad", "50", "0.001"), ("3", "20", "NaN", "0.001"), ("4", "20", "50", None)], "COMID string, width_m string, Q2 string, Slp string")
    out = reach_geometry(rows, 30.0, 0.035, 1e-5, 0.05, 20.0, 50.0)
    assert sorted(r["COMID"] for r in out.collect()) == ["1", "4"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_conveyance_at_a_level_equals_the_curve(spark):
    """Values beside the kernel and through the curve; a face without panels too, and a level beyond the curve."""
    rows = [(1, [(0.0, 3.0, 0.03), (2.0, 1.0, 0.04), (7.0, 2.5, 0.03)]), (2, [(0.0, 0.0, 0.03)]), (3, [(0.0, 1.0, 0.03), (1.0, 1.0, 0.03)]), (4, [])]
    profiles = spark.createDataFrame(rows, "face long, points array<struct<station:double,bed:double,n:double>>")
    curves = subgrid.face_conveyance_curves(profiles)
    for above in (0.0, 0.4, 2.0, 99.0):
        values = [subgrid.curve_value(F.col("curve"), F.col("datum_m"), F.col("datum_m") + above, c).alias(c) for c in ("area", "perimeter", "conveyance")]
        want = {r["face"]: tuple(r)[1:] for r in curves.select("face", F.size("curve").alias("points"), *values).collect()}
        got = {r["face"]: tuple(r)[1:] for r in subgrid.face_conveyance_at(profiles, above).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
