"""Queries over tabular data: calibration, summaries, scorecards, profiles, hydraulics of reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H
from fluvia.functions import labels as L
from fluvia.operators import calibration, profiles, summaries
from fluvia.plans.bridge import SAMPLES_SQL, STATIONS_SQL, read, reach_samples, stations
from fluvia.plans.registry import Registry, r6

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_FLAGS = f"""
{SAMPLES_SQL}, flagged AS (
  SELECT *, coalesce(in_grid AND zone_id > 0 AND lin_area_km2 > 0 AND lin_width_m > 0 AND lin_depth_m > 0, false) AS basic_valid, nearest_d4_distance_m <= 5000 AS passes_distance,
         area_ratio_lin_to_nearest_d4 BETWEEN 0.1 AND 10 AS passes_area_ratio, zone_boundary_distance_m >= 20 AS passes_boundary FROM samples),
valid AS (SELECT *, basic_valid AND passes_distance AND passes_area_ratio AND passes_boundary AS calibration_valid, abs(COMID) % 5 <> 0 AS train FROM flagged)
"""


def _samples(spark, sf_dir):
    return L.fit_area(L.quality_flags(reach_samples(spark, sf_dir), 5000, 0.1, 10, 20), "lin")


@_R.query(f"""WITH {_FLAGS} SELECT COMID, basic_valid, passes_distance, passes_area_ratio, passes_boundary, calibration_valid, train FROM valid""")
def sample_quality_flags(spark, sf_dir):
    return _samples(spark, sf_dir).select("COMID", "basic_valid", "passes_distance", "passes_area_ratio", "passes_boundary", "calibration_valid", L.train_mask(F.col("COMID")).alias("train"))


def _round_sql(step: int) -> str:
    """One round of trimming in SQL, from kept{step} to kept{step + 1}."""
    return f""",
fit{step} AS (SELECT zone_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept FROM kept{step} WHERE keep GROUP BY ALL),
res{step} AS (SELECT k.zone_id, x, y, keep, f.slope, f.icept, y - f.icept - f.slope * x AS e FROM kept{step} k JOIN fit{step} f USING (zone_id)),
med{step} AS (SELECT zone_id, median(e) AS med FROM res{step} WHERE keep GROUP BY ALL),
mad{step} AS (SELECT zone_id, med, median(abs(e - med)) AS mad FROM res{step} JOIN med{step} USING (zone_id) WHERE keep GROUP BY ALL),
kept{step + 1} AS (SELECT zone_id, x, y, abs(e - med) <= greatest(1.5 * 1.4826 * mad, 0.05) AS keep, slope, icept FROM res{step} JOIN mad{step} USING (zone_id))"""


@_R.query(f"""
WITH {_FLAGS}, kept0 AS (SELECT zone_id, ln(lin_area_km2) AS x, ln(lin_width_m) AS y, true AS keep FROM valid WHERE calibration_valid AND train AND zone_id > 0)
{"".join(_round_sql(k) for k in range(8))},
stat AS (SELECT zone_id, any_value(slope) AS slope, any_value(icept) AS icept, CAST(count(*) AS INT) AS n_used, sqrt(avg((y - icept - slope * x) ** 2)) AS rmse, 1 - sum((y - icept - slope * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM kept8 WHERE keep GROUP BY ALL),
total AS (SELECT zone_id, CAST(count(*) AS INT) AS n_total FROM kept0 GROUP BY ALL)
SELECT zone_id, n_total, n_used, round(exp(icept), 5) AS coefficient, round(slope, 5) AS exponent, round(r2, 5) AS r2_log, round(rmse, 5) AS rmse_log, slope BETWEEN 0.05 AND 1.2 AS valid FROM total JOIN stat USING (zone_id)
""")
def robust_width_fits(spark, sf_dir):
    """Trimmed log-log width fits of every zone."""
    good = _samples(spark, sf_dir).where(F.col("calibration_valid") & L.train_mask(F.col("COMID")) & (F.col("zone_id") > 0))
    fits = calibration.robust_fits(good, "fit_area_km2", "lin_width_m", ["zone_id"], 2, 0.01, calibration.WIDTH_BOUNDS, 1.5, 0.05)
    return fits.select("zone_id", "n_total", "n_used", *[F.round(c, 5).alias(c) for c in ("coefficient", "exponent", "r2_log", "rmse_log")], "valid")


def _loosely_fitted(spark, sf_dir):
    samples = L.fit_area(L.quality_flags(reach_samples(spark, sf_dir), 5000, 0.1, 10, 20), "lin")
    return samples, calibration.fit_zones(samples, 10, 0.1, 3.5, 0.35, L.train_mask(F.col("COMID")))


@_R.query()
def zone_coefficients(spark, sf_dir):
    """Width and depth coefficients of every zone, global where its own fits fail."""
    _, (zones, _) = _loosely_fitted(spark, sf_dir)
    return zones.select("zone_id", "calibration_samples", "train_samples", "local_fit_valid", "fallback_level", *[F.round(c, 6).alias(c) for c in ("beta_1", "beta_2", "alfa_1", "alfa_2")])


@_R.query()
def calibration_metrics(spark, sf_dir):
    """Held-out log metrics of the zone coefficients."""
    samples, (zones, fits) = _loosely_fitted(spark, sf_dir)
    out = calibration.evaluate(samples, zones, fits)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@_R.query(f"""
WITH {SAMPLES_SQL}, rated AS (SELECT ln(lin_width_m) AS y, ln(lin_width_m) - ln(2.2695 * pow(lin_area_km2, 0.4942)) AS e FROM samples WHERE lin_width_m > 0 AND lin_area_km2 > 0)
SELECT CAST(count(*) AS INT) AS n, round(sqrt(avg(e * e)), 6) AS rmse_log, round(avg(abs(e)), 6) AS mae_log, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2_log FROM rated
""")
def width_log_metrics(spark, sf_dir):
    m = calibration.log_metrics(F.col("lin_width_m"), H.power_law("lin_area_km2", H.WIDTH_COEFFICIENT, H.WIDTH_EXPONENT))
    return reach_samples(spark, sf_dir).agg(m.alias("m")).select("m.n", *[F.round(f"m.{c}", 6).alias(c) for c in ("rmse_log", "mae_log", "r2_log")])


@_R.query(f"""
WITH {SAMPLES_SQL} SELECT metric, round(value, 6) + 0.0 AS value FROM (
  UNPIVOT (SELECT min(lin_width_m) AS width_min, quantile_cont(lin_width_m, 0.05) AS width_p05, quantile_cont(lin_width_m, 0.5) AS width_p50, avg(lin_width_m) AS width_mean, quantile_cont(lin_width_m, 0.95) AS width_p95, max(lin_width_m) AS width_max FROM samples)
  ON COLUMNS(*) INTO NAME metric VALUE value)
""")
def width_summary(spark, sf_dir):
    out = summaries.long_summary(reach_samples(spark, sf_dir), {"lin_width_m": ("width", "m")})
    return out.select("metric", r6("value").alias("value"))


@_R.query("""
SELECT count(*) AS cells, min(o_totalprice) AS minimum, round(avg(o_totalprice), 4) AS mean, quantile_cont(o_totalprice, 0.5) AS median, max(o_totalprice) AS maximum,
       round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders WHERE o_totalprice > 0
""")
def raster_statistics(spark, sf_dir):
    out = summaries.band_statistics(read(spark, sf_dir, "orders"), "o_totalprice", positive_only=True)
    return out.select("cells", "minimum", F.round("mean", 4).alias("mean"), "median", "maximum", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@_R.query("""
WITH d AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -(o_orderkey % 11) / 4.0 ELSE 0.0 END AS delta FROM orders)
SELECT count(*) AS valid_cells, count(*) FILTER (abs(delta) > 1e-6) AS changed_cells, round(100.0 * count(*) FILTER (abs(delta) > 1e-6) / count(*), 6) AS changed_percent,
       min(delta) AS min_delta_m, max(delta) + 0.0 AS max_delta_m, round(avg(delta), 6) AS mean_delta_m, median(delta) + 0.0 AS median_delta_m, abs(min(delta)) AS max_lowering_m FROM d
""")
def terrain_change_summary(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.lit(0.0).alias("before"), F.when(key % 3 == 0, -(key % 11) / 4.0).otherwise(0.0).alias("after"))
    out = summaries.delta_summary(rows, "before", "after")
    return out.select("valid_cells", "changed_cells", F.round("changed_percent", 6).alias("changed_percent"), "min_delta_m", (F.col("max_delta_m") + 0.0).alias("max_delta_m"), F.round("mean_delta_m", 6).alias("mean_delta_m"), (F.col("median_delta_m") + 0.0).alias("median_delta_m"), "max_lowering_m")


@_R.query("""
WITH m AS (SELECT 100.0 * count(*) FILTER (o_orderkey % 3 = 0) / count(*) AS changed, max(o_totalprice) / 5000 AS depth, max(o_custkey % 7) / 100.0 AS sill FROM orders)
SELECT metric, round(value, 6) AS value, CASE WHEN value > bound THEN 'warn' ELSE 'ok' END AS status FROM (
  SELECT 'changed_percent' AS metric, changed AS value, 25.0 AS bound FROM m UNION ALL SELECT 'max_h_abg_m', depth, 45.0 FROM m UNION ALL SELECT 'max_sill_m', sill, 0.1 FROM m)
""")
def quality_scorecard(spark, sf_dir):
    key = F.col("o_orderkey")
    facts = read(spark, sf_dir, "orders").agg(
        (100.0 * F.count_if(key % 3 == 0) / F.count(F.lit(1))).alias("changed_percent"), (F.max("o_totalprice") / 5000).alias("max_h_abg_m"), (F.max(F.col("o_custkey") % 7) / 100.0).alias("max_sill_m")
    )
    return summaries.scorecard(facts).select("metric", F.round("value", 6).alias("value"), "status")


@_R.query(f"WITH {STATIONS_SQL} SELECT reach_id, seq, round(sum(hypot) OVER (PARTITION BY reach_id ORDER BY seq), 6) + 0.0 AS s_m FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS hypot FROM stations WINDOW w AS (PARTITION BY reach_id ORDER BY seq))")
def station_distances(spark, sf_dir):
    return profiles.distances(stations(spark, sf_dir)).select("reach_id", "seq", r6("s_m").alias("s_m"))


_DIST = f"""WITH {STATIONS_SQL}, far AS (
  SELECT *, sum(step) OVER (PARTITION BY reach_id ORDER BY seq) AS s_m FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS step FROM stations WINDOW w AS (PARTITION BY reach_id ORDER BY seq)))"""


@_R.query(f"{_DIST} SELECT a.reach_id, a.seq, round(median(b.value), 6) + 0.0 AS smoothed FROM far a JOIN far b ON a.reach_id = b.reach_id AND b.s_m BETWEEN a.s_m - 150 AND a.s_m + 150 GROUP BY ALL")
def moving_median_profile(spark, sf_dir):
    out = profiles.smoothed_profile(profiles.distances(stations(spark, sf_dir)), "value", 300.0)
    return out.select("reach_id", "seq", r6("smoothed").alias("smoothed"))


@_R.query(f"""{_DIST}, ends AS (
  SELECT *, first_value(value) OVER w AS z0, last_value(value) OVER w AS z1, first_value(s_m) OVER w AS s0, last_value(s_m) OVER w AS s1,
         first_value(value) OVER o AS lz0, last_value(value) OVER o AS lz1, first_value(s_m) OVER o AS ls0, last_value(s_m) OVER o AS ls1 FROM far
  WINDOW w AS (PARTITION BY reach_id ORDER BY s_m RANGE BETWEEN 100.0 PRECEDING AND 100.0 FOLLOWING), o AS (PARTITION BY reach_id ORDER BY s_m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT reach_id, seq, round(least(greatest(CASE WHEN s1 <= s0 THEN (lz0 - lz1) / greatest(ls1 - ls0, 1.0) ELSE (z0 - z1) / greatest(s1 - s0, 1.0) END, 0.0001), 0.05), 6) AS slope FROM ends""")
def smoothed_bed_slopes(spark, sf_dir):
    out = profiles.smoothed_slopes(profiles.distances(stations(spark, sf_dir)), "value", 200.0, 1e-4, 0.05)
    return out.select("reach_id", "seq", F.round("slope", 6).alias("slope"))


@_R.query(f"{_DIST} SELECT reach_id, seq FROM (SELECT *, floor(s_m / 150) > floor(lag(s_m) OVER w / 150) AS new, lead(seq) OVER w IS NULL OR lag(seq) OVER w IS NULL AS last FROM far WINDOW w AS (PARTITION BY reach_id ORDER BY seq)) WHERE coalesce(new, false) OR last")
def sampled_stations(spark, sf_dir):
    return profiles.sample_positions(profiles.distances(stations(spark, sf_dir)), 150.0).select("reach_id", "seq")


@_R.query(f"{_DIST} SELECT reach_id, seq, round(CASE WHEN max(s_m) OVER w > 0 THEN s_m / max(s_m) OVER w ELSE 0.0 END, 6) AS position FROM far WINDOW w AS (PARTITION BY reach_id)")
def arc_positions(spark, sf_dir):
    return profiles.arc_position(profiles.distances(stations(spark, sf_dir))).select("reach_id", "seq", F.round("position", 6).alias("position"))


@_R.query(f"""
WITH {STATIONS_SQL}, t AS (SELECT reach_id, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS tx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS ty FROM stations WINDOW w AS (PARTITION BY reach_id ORDER BY seq))
SELECT reach_id, seq, round(CASE WHEN tx = 0 AND ty = 0 THEN 0.0 ELSE -ty / sqrt(tx * tx + ty * ty) END, 6) + 0.0 AS nx, round(CASE WHEN tx = 0 AND ty = 0 THEN 0.0 ELSE tx / sqrt(tx * tx + ty * ty) END, 6) + 0.0 AS ny FROM t""")
def station_normals(spark, sf_dir):
    return profiles.normals(stations(spark, sf_dir)).select("reach_id", "seq", r6("nx").alias("nx"), r6("ny").alias("ny"))


@_R.query(f"""
WITH {STATIONS_SQL}, k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY reach_id) AS n FROM stations WINDOW w AS (PARTITION BY reach_id ORDER BY seq)), off AS (SELECT range - 2 AS d FROM range(5))
SELECT a.reach_id, a.seq, round(sum(b.value) / 5, 6) + 0.0 AS smoothed_width FROM k a, off JOIN k b ON b.reach_id = a.reach_id AND b.k = least(greatest(a.k + d, 1), a.n) GROUP BY ALL""")
def moving_mean_widths(spark, sf_dir):
    return profiles.smoothed_widths(stations(spark, sf_dir), "value", 5).select("reach_id", "seq", r6("smoothed_width").alias("smoothed_width"))


@_R.query("""
WITH sides AS (SELECT l_orderkey AS section_id, CASE WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END AS side, l_extendedprice AS k, 10 + l_quantity / 10 AS ground, l_partkey, l_suppkey FROM lineitem),
wet AS (SELECT *, greatest(13.0 - ground, 0.0) AS d FROM sides)
SELECT section_id, side, round(sum(CASE WHEN least > 0 THEN d ELSE 0.0 END), 6) + 0.0 AS wet_depth_m FROM (
  SELECT *, min(d) OVER (PARTITION BY section_id, side ORDER BY k, l_partkey, l_suppkey, ground ROWS UNBOUNDED PRECEDING) AS least FROM wet) GROUP BY ALL
""")
def connected_overbank_depths(spark, sf_dir):
    order = F.struct("l_extendedprice", "l_partkey", "l_suppkey", (10 + F.col("l_quantity") / 10).alias("ground"))
    side = F.when(F.col("l_linenumber") % 2 == 0, "left").otherwise("right")
    lateral = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), side.alias("side"), order.alias("k"), (10 + F.col("l_quantity") / 10).alias("ground"), F.lit(13.0).alias("stage"))
    return profiles.connected_side(lateral, "stage").groupBy("section_id", "side").agg(r6(F.sum("depth")).alias("wet_depth_m"))


@_R.query("""
WITH s AS (SELECT l_orderkey AS section_id, CASE WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END AS side, l_quantity AS ground, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
m AS (SELECT section_id, side, median(ground) AS m FROM s WHERE n <= 2 GROUP BY ALL)
SELECT section_id, min(m) AS bank_m FROM m GROUP BY ALL
""")
def bank_levels(spark, sf_dir):
    order = F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    side = F.when(F.col("l_linenumber") % 2 == 0, "left").otherwise("right")
    lateral = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), side.alias("side"), order.alias("k"), F.col("l_quantity").alias("ground"))
    return profiles.bank_levels(lateral, 2).select("section_id", F.col("bank").alias("bank_m"))


@_R.query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 100 AS q, l_quantity AS w, 0.0001 + l_discount / 10 AS s FROM lineitem)
SELECT count(*) AS reaches, round(sum(w * 2.0 * pow(w * 2.0 / (w + 4.0), 2.0 / 3.0) / 0.035 * sqrt(s)), 2) AS capacity_m3s, count(*) FILTER (q * 0.035 / sqrt(s) > w * 20.0 * pow(w * 20.0 / (w + 40.0), 2.0 / 3.0)) AS clipped FROM q
""")
def manning_capacity(spark, sf_dir):
    slope = 0.0001 + F.col("l_discount") / 10
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 100).alias("q"), F.col("l_quantity").alias("w"), slope.alias("s"))
    out = rows.withColumn("m", H.manning_depth("q", "w", "s", 0.035, 20.0))
    return out.agg(F.count(F.lit(1)).alias("reaches"), F.round(F.sum(H.rectangular_conveyance("w", 2.0, 0.035) * F.sqrt("s")), 2).alias("capacity_m3s"), F.count_if("m.clipped").alias("clipped"))


@_R.query()
def reach_hydraulic_geometry(spark, sf_dir):
    """Slope clamps, normal depth and equivalent lowering of every reach with positive width and discharge."""
    from fluvia.plans.reaches import reach_geometry

    rows = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("COMID"), F.col("l_quantity").cast("string").alias("width_m"), (F.col("l_extendedprice") / 100).cast("string").alias("Q2"),
        F.when(F.col("l_linenumber") % 4 == 0, "bad").otherwise((F.col("l_discount") / 10).cast("string")).alias("Slp"),
    )
    out = reach_geometry(rows, 30.0, 0.035, 1e-5, 0.05, 20.0, 50.0, "wide")
    return out.select("COMID", r6("Slope_used").alias("Slope_used"), "Slope_was_clamped", r6("Depth_Q2_m", 4).alias("Depth_Q2_m"), "Depth_Q2_clipped", r6("H_abg_m", 4).alias("H_abg_m"))


@_R.query("""
WITH c AS (SELECT o_orderkey AS cell, CASE o_orderstatus WHEN 'F' THEN 'river' WHEN 'O' THEN 'urban' ELSE 'floodplain' END AS class, o_custkey % 10 / 10.0 AS r, o_custkey % 7 / 30.0 AS f, o_custkey % 13 / 60.0 AS w FROM orders)
SELECT cell, CASE WHEN w > 0.1 THEN 'waterbody' WHEN r >= 0.5 THEN 'river' WHEN class = 'river' THEN CASE WHEN f >= 0.1 THEN 'floodplain' ELSE 'rural' END ELSE class END AS refined FROM c
""")
def refined_feature_classes(spark, sf_dir):
    cust = F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.when(F.col("o_orderstatus") == "F", "river").when(F.col("o_orderstatus") == "O", "urban").otherwise("floodplain").alias("class"), (cust % 10 / 10.0).alias("r"), (cust % 7 / 30.0).alias("f"), (cust % 13 / 60.0).alias("w"))
    return rows.select("cell", L.refined_class(F.col("class"), F.col("r"), F.col("f"), F.col("w")).alias("refined"))


@_R.query("""
SELECT o_orderkey AS cell, o_orderstatus IN ('F') AS river_policy, o_orderstatus IN ('F') AND o_totalprice >= 100000 AS relief_policy FROM orders
""")
def subgrid_policies(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "river").otherwise("rural")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), L.subgrid_policy(kind).alias("river_policy"), L.subgrid_policy(kind, "river", F.col("o_totalprice"), 100000.0).alias("relief_policy"))


@_R.query("""
WITH t AS (SELECT unnest([50000.0, 100000.0, 200000.0]::DOUBLE[]) AS threshold) SELECT threshold, count(*) FILTER (o_totalprice >= threshold) AS stream_cells, count(DISTINCT CASE WHEN o_totalprice >= threshold THEN o_custkey END) AS zones FROM orders, t GROUP BY ALL
""")
def threshold_sweep(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    one = lambda t: orders.where(F.col("o_totalprice") >= t).agg(F.count(F.lit(1)).alias("stream_cells"), F.countDistinct("o_custkey").alias("zones")).select(F.lit(t).alias("threshold"), "stream_cells", "zones")
    return reduce(DataFrame.unionByName, [one(t) for t in L.parse_thresholds("50000,100000,200000")])
