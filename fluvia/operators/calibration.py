"""Robust log-log power-law fits by zone, with a global fallback.

Every zone is fitted at once: a round is one aggregation by zone for the line, one for the median and one for the
spread of its residuals. A median of a group of at most ``MEDIAN_ROWS`` samples is taken in one task's buffer; those of
larger groups are found by rank over range partitions, so no task holds more of them than a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.labels import train_mask
from fluvia.functions.tables import settled

ROUNDS = 8
#: Samples of one group whose median one buffer may hold.
MEDIAN_ROWS = 500_000
#: Allowed exponents of width and depth fits: fixed values.
WIDTH_BOUNDS, DEPTH_BOUNDS = (0.05, 1.20), (0.02, 1.20)


def medians(rows: DataFrame, by: list[str], value: str, name: str, largest: int) -> DataFrame:
    """*by, name: the exact median of each group, none of which has more than ``largest`` rows."""
    if largest <= MEDIAN_ROWS:
        return rows.groupBy(*by).agg(F.percentile(value, 0.5).alias(name))
    dealt = rows.select(*by, value).repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    # Rows of a partition are numbered as they are sorted, and written, so that the numbers stand.
    held = settled(dealt.select(*by, value, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = held.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_part", (F.col("_from") - before).alias("_zero"), F.sum("_n").over(whole).alias("_all"))
    rank = F.col("_at") - F.col("_zero")
    middle = (rank == F.expr("(_all - 1) div 2")) | (rank == F.expr("_all div 2"))
    return held.join(starts, [*by, "_part"]).where(middle).groupBy(*by).agg(F.avg(value).alias(name))


def robust_fits(samples: DataFrame, area: str, target: str, by: list[str], min_samples: int | Column, min_log10_range: float, bounds: tuple[float | Column, float | Column], max_mad: float, min_residual: float) -> DataFrame:
    """For each group: coefficient, exponent, n_total, n_used, r2_log, rmse_log, mae_log, valid.

    Up to eight rounds of least squares on logarithms; a sample stays while its residual is within ``max_mad`` robust
    deviations (at least ``min_residual``) of the median. A group fails for too few samples, too small a range of areas or
    an exponent out of bounds; its statistics are then null. The least number of samples and the bounds may depend on the
    columns of the group.
    """
    # Samples of no use leave their group in the result, with no fit.
    good = F.coalesce((F.col(area) > 0) & (F.col(target) > 0), F.lit(False))
    rows = samples.select(*by, F.when(good, F.ln(area)).alias("x"), F.when(good, F.ln(target)).alias("y")).withColumn("keep", F.col("x").isNotNull())
    first = rows.groupBy(*by).agg(F.count("x").cast("int").alias("n_total"), ((F.max("x") - F.min("x")) / F.ln(F.lit(10.0))).alias("range"))
    fair = first.withColumn("fair", F.coalesce((F.col("n_total") >= min_samples) & (F.col("range") >= min_log10_range), F.lit(False))).drop("range")
    on = [F.lit(True)] if not by else None

    def back(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.crossJoin(F.broadcast(right)) if on else left.join(right, by)

    fair = settled(fair)
    largest = fair.agg(F.max("n_total")).first()[0] or 0
    rows = settled(back(rows.where("x is not null"), fair.where("fair").select(*by)))
    line = lambda df: df.where("keep").groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).cast("int").alias("n_used"))
    done = None
    for step in range(ROUNDS):
        fit = settled(line(rows))
        enough = F.col("n_used") >= min_samples
        short = fit.where(~enough).select(*by, "n_used", F.lit(None).cast("double").alias("slope"), F.lit(None).cast("double").alias("intercept"))
        rated = back(rows, fit.where(enough)).withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
        middle = medians(rated.where("keep"), by, "e", "med", largest)
        centred = back(rated, middle).withColumn("off", F.abs(F.col("e") - F.col("med")))
        spread = medians(centred.where("keep"), by, "off", "mad", largest)
        trimmed = back(centred, spread).withColumn("new", F.col("off") <= F.greatest(max_mad * 1.4826 * F.col("mad"), F.lit(float(min_residual))))
        trimmed = settled(trimmed.select(*by, "x", "y", "keep", "new", "slope", "intercept"))
        changed = trimmed.groupBy(*by).agg(F.bool_or(F.col("new") != F.col("keep")).alias("changed"))
        last = step == ROUNDS - 1
        ended = back(trimmed, changed.where(F.lit(last) | ~F.col("changed")).select(*by))
        stats = _statistics(ended, by)
        out = stats.unionByName(short, allowMissingColumns=True)
        done = settled(out if done is None else done.unionByName(out))
        if last:
            break
        rows = settled(back(trimmed.withColumn("keep", F.col("new")).select(*by, "x", "y", "keep"), changed.where("changed").select(*by)))
        if not rows.limit(1).count():
            break
    joined = fair.crossJoin(done) if on and done.limit(1).count() else fair.join(done, by, "left") if by else fair.select("*", *[F.lit(None).cast(t).alias(c) for c, t in done.dtypes])
    valid = F.coalesce(F.col("slope").between(*bounds), F.lit(False)) & F.col("fair")
    keep = lambda c: F.when(valid, c)
    return joined.select(
        *by, keep(F.exp("intercept")).alias("coefficient"), keep(F.col("slope")).alias("exponent"), "n_total", F.coalesce("n_used", F.lit(0)).alias("n_used"),
        keep(F.col("r2_log")).alias("r2_log"), keep(F.col("rmse_log")).alias("rmse_log"), keep(F.col("mae_log")).alias("mae_log"), valid.alias("valid"),
    )


def _statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Fit statistics over the samples kept last."""
    e = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    new = rows.where("new")
    return new.groupBy(*by).agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.count(F.lit(1)).cast("int").alias("n_used"),
        (1 - F.sum(e * e) / F.nullif(F.regr_syy("y", "y"), F.lit(0.0))).alias("r2_log"), F.sqrt(F.avg(e * e)).alias("rmse_log"), F.avg(F.abs(e)).alias("mae_log"),
    )


def fit_zones(samples: DataFrame, min_samples: int = 30, min_log10_range: float = 0.35, max_mad: float = 3.5, min_residual: float = 0.35, train: Column | None = None) -> tuple[DataFrame, dict[str, dict]]:
    """(zone table, global fits by 'width' and 'depth').

    A zone whose width and depth fits are not both valid takes the global coefficients. Raises if a global fit fails.
    """
    chosen = F.col("calibration_valid") & (train if train is not None else F.lit(True))
    training = settled(samples.where(chosen))
    n = training.count()
    least = max(min_samples, 50) if n >= 50 else min_samples
    # Both targets of every zone, and of all zones as zone -1, are groups of one fit.
    value = lambda k, c: F.struct(F.lit(k).alias("target"), F.col(c).alias("value"))
    zone = F.array(F.lit(-1).cast("long"), F.when(F.col("zone_id") > 0, F.col("zone_id").cast("long")))
    stacked = training.select("fit_area_km2", F.array_compact(zone).alias("_z"), F.explode(F.array(value("width", "lin_width_m"), value("depth", "lin_depth_m"))).alias("t"))
    stacked = stacked.select("fit_area_km2", "t.target", "t.value", F.explode("_z").alias("zone"))
    wide = F.col("target") == "width"
    bounds = F.when(wide, WIDTH_BOUNDS[0]).otherwise(DEPTH_BOUNDS[0]), F.when(wide, WIDTH_BOUNDS[1]).otherwise(DEPTH_BOUNDS[1])
    all_fits = settled(robust_fits(stacked, "fit_area_km2", "value", ["target", "zone"], F.when(F.col("zone") < 0, least).otherwise(min_samples), min_log10_range, bounds, max_mad, min_residual))
    fits = {r["target"]: r for r in all_fits.where("zone < 0").collect()}
    if not all(k in fits and fits[k]["valid"] for k in ("width", "depth")):
        raise RuntimeError("the global fit failed: relax the filters or check the samples")
    good = samples.where("calibration_valid and zone_id > 0")
    zones = good.groupBy("zone_id").agg(F.count(F.lit(1)).cast("int").alias("calibration_samples"), F.count_if(train if train is not None else F.lit(True)).cast("int").alias("train_samples"))
    for k in ("width", "depth"):
        local = all_fits.where((F.col("zone") > 0) & (F.col("target") == k))
        zones = zones.join(local.select(F.col("zone").alias("zone_id"), *[F.col(c).alias(f"{k}_{c}") for c in ("coefficient", "exponent", "n_total", "n_used", "r2_log", "rmse_log", "valid")]), "zone_id", "left")
    local = F.coalesce(F.col("width_valid") & F.col("depth_valid"), F.lit(False))
    pick = lambda k, c: F.when(local, F.col(f"{k}_{c}")).otherwise(F.lit(fits[k][c]))
    table = zones.select(
        "zone_id", "calibration_samples", "train_samples", local.alias("local_fit_valid"), F.when(local, 0).otherwise(1).alias("fallback_level"),
        pick("width", "coefficient").alias("beta_1"), pick("width", "exponent").alias("beta_2"), pick("depth", "coefficient").alias("alfa_1"), pick("depth", "exponent").alias("alfa_2"),
        *[F.coalesce(f"{k}_{c}", F.lit(0)).alias(f"{k}_{c}") if c.startswith("n_") else F.col(f"{k}_{c}") for k in ("width", "depth") for c in ("n_total", "n_used", "r2_log", "rmse_log")],
    )
    return table, {k: f.asDict() for k, f in fits.items()}


def with_coefficients(rows: DataFrame, zones: DataFrame, fits: dict[str, dict]) -> DataFrame:
    """Rows with a zone's coefficients, or the global ones."""
    out = rows.join(zones.select("zone_id", "beta_1", "beta_2", "alfa_1", "alfa_2", "local_fit_valid", "width_r2_log", "depth_r2_log"), "zone_id", "left")
    fill = {"beta_1": fits["width"]["coefficient"], "beta_2": fits["width"]["exponent"], "alfa_1": fits["depth"]["coefficient"], "alfa_2": fits["depth"]["exponent"]}
    return out.withColumns({**{c: F.coalesce(c, F.lit(v)) for c, v in fill.items()}, "local_fit_valid": F.coalesce("local_fit_valid", F.lit(False))})


def log_metrics(observed: Column, predicted: Column) -> Column:
    """Aggregate ``struct(n, rmse_log, mae_log, r2_log)``; null metrics below three usable pairs."""
    good = (observed > 0) & (predicted > 0)
    y, e = F.when(good, F.ln(observed)), F.when(good, F.ln(observed) - F.ln(predicted))
    n = F.count(e)
    enough = lambda c: F.when(n >= 3, c)
    total = F.var_pop(y) * n
    return F.struct(
        n.cast("int").alias("n"), enough(F.sqrt(F.avg(e * e))).alias("rmse_log"), enough(F.avg(F.abs(e))).alias("mae_log"), enough(1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2_log")
    )


def evaluate(samples: DataFrame, zones: DataFrame, fits: dict[str, dict]) -> DataFrame:
    """One row of width_* and depth_* log metrics on the held-out valid samples."""
    held = with_coefficients(samples.where(F.col("calibration_valid") & ~train_mask(F.col("COMID"))), zones, fits)
    width = F.col("beta_1") * F.pow(F.greatest("fit_area_km2", F.lit(0.0)), F.col("beta_2"))
    depth = F.col("alfa_1") * F.pow(F.greatest("fit_area_km2", F.lit(0.0)), F.col("alfa_2"))
    return held.agg(log_metrics(F.col("lin_width_m"), width).alias("width"), log_metrics(F.col("lin_depth_m"), depth).alias("depth")).select(
        *[F.col(f"{k}.{m}").alias(f"{k}_{m}") for k in ("width", "depth") for m in ("n", "rmse_log", "mae_log", "r2_log")]
    )


def coefficient_maps(cells: DataFrame, zones: DataFrame, fits: dict[str, dict]) -> DataFrame:
    """Cells with coefficients, fallback level and fit quality (mean of the two r2 where local)."""
    out = with_coefficients(cells, zones, fits)
    quality = F.when(F.col("local_fit_valid"), (F.col("width_r2_log") + F.col("depth_r2_log")) / 2)
    return out.withColumns({"fallback_level": F.when(F.col("local_fit_valid"), 0).otherwise(1), "fit_quality": quality}).drop("width_r2_log", "depth_r2_log")


def midpoints(lines: DataFrame) -> DataFrame:
    """Key columns of ``lines(..., vertices array<struct<x,y>>)`` with ``x, y`` at half the length; null for fewer than two vertices."""
    legs = F.transform(F.sequence(F.lit(1), F.size("vertices") - 1), lambda i: F.struct(F.col("vertices")[i - 1].alias("a"), F.col("vertices")[i].alias("b")))
    length = lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
    total = F.aggregate(F.col("_legs"), F.lit(0.0), lambda t, s: t + length(s))

    def walk(t: Column, s: Column) -> Column:
        here = (t["left"] >= 0) & (t["left"] <= length(s)) & t["x"].isNull()
        w = F.coalesce(t["left"] / F.nullif(length(s), F.lit(0.0)), F.lit(0.0))
        return F.struct(
            (t["left"] - length(s)).alias("left"),
            F.when(here, s["a"]["x"] + w * (s["b"]["x"] - s["a"]["x"])).otherwise(t["x"]).alias("x"),
            F.when(here, s["a"]["y"] + w * (s["b"]["y"] - s["a"]["y"])).otherwise(t["y"]).alias("y"),
        )

    none = F.lit(None).cast("double")
    start = F.struct((F.col("_total") / 2).alias("left"), none.alias("x"), none.alias("y"))
    rows = lines.withColumn("_legs", F.when(F.size("vertices") > 1, legs).otherwise(F.expr("array()").cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))).withColumn("_total", total)
    return rows.withColumn("_m", F.aggregate("_legs", start, walk)).withColumns({"x": F.col("_m.x"), "y": F.col("_m.y")}).drop("_legs", "_total", "_m")


def sampled(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float, bands: list[str]) -> DataFrame:
    """Points(x, y) with the bands of the cell under each and ``in_grid``; null bands outside."""
    placed = points.withColumns({"row": F.floor((y0 - F.col("y")) / dy).cast("int"), "col": F.floor((F.col("x") - x0) / dx).cast("int")})
    return placed.join(cells.select("row", "col", F.lit(True).alias("_in"), *bands), ["row", "col"], "left").withColumn("in_grid", F.coalesce("_in", F.lit(False))).drop("_in")


def threshold_sweep(rows: list[DataFrame]) -> DataFrame:
    """Summary rows of several thresholds as one table."""
    return reduce(DataFrame.unionByName, rows)
