"""Hydraulic geometry of mapped reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import hydraulics as H


def reach_geometry(reaches: DataFrame, cell_width: float, manning_n: float, min_slope: float, max_slope: float, depth_cap: float, max_lowering: float, mode: str = "wide") -> DataFrame:
    """Add slope, normal depth and equivalent lowering; reaches without positive width, discharge and depth are dropped.

    Columns area, Slp, QMEAN, Q2, width_m, width_DHG may be text; what is no number is null.
    """
    numbers = [c for c in ("area", "Slp", "QMEAN", "Q2", "width_m", "width_DHG") if c in reaches.columns]
    number = lambda c: F.nullif(F.expr(f"try_cast({c} as double)"), F.lit(float("nan")))
    rows = reaches.withColumns({c: number(c) for c in numbers}).where("width_m > 0 and Q2 > 0")
    used = F.least(F.greatest(F.coalesce("Slp", F.lit(float(min_slope))), F.lit(float(min_slope))), F.lit(float(max_slope)))
    rows = rows.withColumns({"Slope_raw": F.col("Slp"), "Slope_used": used}).withColumn("Slope_was_clamped", ~F.col("Slope_used").eqNullSafe(F.col("Slope_raw")))
    rows = rows.withColumns({"Manning_n": F.lit(float(manning_n)), "_m": H.manning_depth("Q2", "width_m", "Slope_used", manning_n, depth_cap)})
    rows = rows.withColumns({"Depth_Q2_m": F.col("_m.depth"), "Depth_Q2_clipped": F.col("_m.clipped")}).drop("_m")
    # Elsewhere every depth is positive, and a filter would be worked out below the columns it rests on, with all their casts again.
    if min(min_slope, max_slope, depth_cap) <= 0:
        rows = rows.where("Depth_Q2_m > 0")
    return rows.withColumn("H_abg_m", H.equivalent_lowering("width_m", "Depth_Q2_m", cell_width, mode, max_lowering))
