"""One-pass summaries, scorecards and masks' statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Warning bounds of the scorecard: fixed values. A metric in BELOW warns when it falls below its bound.
WARN = {"changed_percent": 25.0, "max_lowering_m": 100.0, "fallback_cells": 1000.0, "max_h_abg_m": 45.0, "max_sill_m": 0.1, "max_profile_adjustment_m": 100.0, "largest_component_percent": 50.0}
BELOW = {"largest_component_percent"}


def band_statistics(cells: DataFrame, band: str, positive_only: bool = False) -> DataFrame:
    """One row: cells, minimum, mean, median, maximum, p95, p99 of present values."""
    rows = cells.where(F.col(band) > 0) if positive_only else cells.where(F.col(band).isNotNull())
    q = F.percentile(band, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.agg(F.count(F.lit(1)).alias("cells"), F.min(band).alias("minimum"), F.avg(band).alias("mean"), F.max(band).alias("maximum"), q.alias("q"))
    return out.select("cells", "minimum", "mean", F.col("q")[0].alias("median"), "maximum", F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def percentiles(cells: DataFrame, band: str, at: tuple[float, ...] = (0, 5, 25, 50, 75, 90, 95, 99, 100)) -> DataFrame:
    """percent, value rows."""
    values = cells.agg(F.percentile(band, F.array(*[F.lit(p / 100) for p in at])).alias("v"))
    return values.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in at]).alias("percent"), F.col("v").alias("value"))).alias("r")).select("r.percent", "r.value")


def delta_summary(cells: DataFrame, before: str, after: str) -> DataFrame:
    """One row on after minus before where both are present; max_lowering_m is the size of the least change."""
    rows = cells.select((F.col(after) - F.col(before)).alias("d")).where("d is not null")
    changed = F.count_if(F.abs("d") > 1e-6)
    return rows.agg(
        F.count(F.lit(1)).alias("valid_cells"), changed.alias("changed_cells"), (100.0 * changed / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("changed_percent"), F.min("d").alias("min_delta_m"),
        F.max("d").alias("max_delta_m"), F.avg("d").alias("mean_delta_m"), F.percentile("d", 0.5).alias("median_delta_m"), F.abs(F.min("d")).alias("max_lowering_m"), F.greatest(F.max("d"), F.lit(0.0)).alias("max_raising_m"),
    )


def long_summary(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """metric, value, units: least, 5 %, median, mean, 95 % and greatest of each column named in ``columns`` (label, units)."""
    values = []
    for column, (label, units) in columns.items():
        q = F.percentile(column, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
        parts = {"min": F.min(column), "p05": q[0], "p50": q[1], "mean": F.avg(column), "p95": q[2], "max": F.max(column)}
        values += [F.struct(F.lit(f"{label}_{k}").alias("metric"), v.cast("double").alias("value"), F.lit(units).alias("units")) for k, v in parts.items()]
    return rows.agg(F.array(*values).alias("v")).select(F.explode("v").alias("r")).select("r.*")


def scorecard(facts: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """metric, value, status, note from one row of metrics."""
    bounds = WARN | (bounds or {})
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(bounds.get(c)).cast("double").alias("bound"), F.lit(c in BELOW).alias("below")) for c in facts.columns])
    out = facts.select(F.explode(rows).alias("r")).select("r.*")
    bad = F.when(F.col("below"), F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    status = F.when(F.col("value").isNull(), "missing").when(F.coalesce(bad, F.lit(False)), "warn").otherwise("ok")
    return out.select("metric", "value", status.alias("status"), F.when(status == "warn", F.format_string("bound %s", F.col("bound"))).alias("note"))


def mask_overlap(cells: DataFrame, mask: str, other: str) -> DataFrame:
    """One row: cells of both masks, their intersection and its share of each."""
    a, b = F.coalesce(F.col(mask), F.lit(False)), F.coalesce(F.col(other), F.lit(False))
    out = cells.agg(F.count_if(a).alias("first"), F.count_if(b).alias("second"), F.count_if(a & b).alias("both"))
    return out.select("*", (100.0 * F.col("both") / F.nullif(F.col("first"), F.lit(0))).alias("percent_of_first"), (100.0 * F.col("both") / F.nullif(F.col("second"), F.lit(0))).alias("percent_of_second"))


def river_only(cells: DataFrame, value: str, mask: str) -> tuple[DataFrame, DataFrame]:
    """(cells with ``value`` only on the mask and where positive, one row of count, min, mean, max)."""
    out = cells.withColumn(value, F.when(F.coalesce(F.col(mask), F.lit(False)) & (F.col(value) > 0), F.col(value)))
    return out, out.agg(F.count(value).alias("count"), F.min(value).alias("minimum"), F.avg(value).alias("mean"), F.max(value).alias("maximum"))


def markdown(rows: DataFrame) -> str:
    """A small table as aligned Markdown."""
    head, body = rows.columns, [["" if v is None else str(v) for v in r] for r in rows.collect()]
    wide = [max(len(h), *(len(r[i]) for r in body), 3) if body else max(len(h), 3) for i, h in enumerate(head)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *[line(r) for r in body]])
