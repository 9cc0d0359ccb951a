"""Small scalar rules: classes, labels, resolutions, split masks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature class codes and names by policy: fixed values.
CLASS_CODES = {"rural": 0, "urban": 1, "floodplain": 2, "river": 3, "waterbody": 4}
SUBGRID_CLASSES = {
    "river": ("river", "channel"),
    "waterbody": ("waterbody", "reservoir", "lake"),
    "river_floodplain": ("river", "channel", "floodplain", "waterbody", "reservoir", "lake"),
}
LAKE_TYPES = {1: "lake", 2: "reservoir", 3: "regulated_lake"}


def parse_resolution(value: str) -> float | tuple[float, float]:
    """'30' -> 30.0, '30,60' or '30x60' -> (30.0, 60.0)."""
    parts = [float(x) for x in value.lower().replace("x", ",").split(",") if x.strip()]
    if len(parts) not in (1, 2):
        raise ValueError(f"not a resolution: {value!r}")
    return parts[0] if len(parts) == 1 else (parts[0], parts[1])


def resolution_label(metres: float) -> str:
    """1000 -> '1000m', 12.5 -> '12p5m'."""
    whole = float(metres).is_integer()
    return f"{int(metres)}m" if whole else f"{metres:g}".replace(".", "p") + "m"


def resolution_label_column(metres: Column) -> Column:
    """``resolution_label`` for a column of numbers with at most six decimals."""
    text = F.regexp_replace(F.format_string("%.6f", metres), r"\.?0+$", "")
    return F.concat(F.replace(text, F.lit("."), F.lit("p")), F.lit("m"))


def parse_thresholds(value: str) -> list[float]:
    return [float(x) for x in value.split(",") if x.strip()]


def subgrid_policy(feature_class: Column, policy: str = "river", relief: Column | None = None, threshold: float = 0.0) -> Column:
    """Whether a cell gets sub-grid curves."""
    if policy in ("all", "none"):
        mask = F.lit(policy == "all")
    elif policy in SUBGRID_CLASSES:
        mask = F.coalesce(feature_class.isin(*SUBGRID_CLASSES[policy]), F.lit(False))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return mask & F.coalesce(relief >= threshold, F.lit(False)) if relief is not None and threshold > 0 else mask


def refined_class(feature_class: Column, river_fraction: Column, floodplain_fraction: Column, water_fraction: Column, share: float = 0.1, river_share: float = 0.5, water_share: float = 0.1) -> Column:
    """Class after area fractions: mostly-river cells are river, demoted ones floodplain or rural; water comes last."""
    dry = (
        F.when(river_fraction >= river_share, F.lit("river"))
        .when(feature_class == "river", F.when(floodplain_fraction >= share, F.lit("floodplain")).otherwise(F.lit("rural")))
        .otherwise(feature_class)
    )
    return F.when(F.coalesce(water_fraction > water_share, F.lit(False)), F.lit("waterbody")).otherwise(dry)


def merge_group(feature_class: Column) -> Column:
    """Cells merge only within river, waterbody or surface."""
    return F.when(feature_class == "river", "river").when(feature_class == "waterbody", "waterbody").otherwise("surface")


def train_mask(reach_id: Column) -> Column:
    """Four fifths of the reaches by id; a missing id counts as 0 and validates."""
    return F.pmod(F.abs(F.coalesce(reach_id.cast("long"), F.lit(0))), F.lit(5)) != 0


def first_present(df: DataFrame, names: Iterable[str]) -> Column:
    """First non-null of those columns that the table has."""
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def waterbody_type(lake_type: Column, *tags: Column) -> Column:
    """Name of a lake-type code, else the first tag."""
    code = F.create_map(*[x for k, v in LAKE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(code, lake_type.cast("int")), *tags, F.lit("waterbody"))


def feature_class(water: Column, river: Column, floodplain: Column, urban: Column) -> Column:
    """Class by priority water, river, floodplain, urban, rural."""
    return F.when(water, "waterbody").when(river, "river").when(floodplain, "floodplain").when(urban, "urban").otherwise("rural")


def lane_count(width: Column, spacing: Column) -> Column:
    """Lanes across a width, at least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(width / spacing).cast("int"))


def needs_routing(config: dict, has_direction: bool) -> bool:
    """Whether a plan must route flow itself."""
    return not has_direction


def quality_flags(samples: DataFrame, max_distance: float, min_ratio: float, max_ratio: float, min_boundary: float) -> DataFrame:
    """Add basic_valid, passes_distance, passes_area_ratio, passes_boundary and their conjunction calibration_valid."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    flagged = samples.withColumns({
        "basic_valid": yes(F.col("in_grid") & (F.col("zone_id") > 0) & (F.col("lin_area_km2") > 0) & (F.col("lin_width_m") > 0) & (F.col("lin_depth_m") > 0)),
        "passes_distance": yes(F.col("nearest_d4_distance_m") <= max_distance),
        "passes_area_ratio": yes(F.col("area_ratio_lin_to_nearest_d4").between(min_ratio, max_ratio)),
        "passes_boundary": yes(F.col("zone_boundary_distance_m") >= min_boundary),
    })
    return flagged.withColumn("calibration_valid", F.expr("basic_valid and passes_distance and passes_area_ratio and passes_boundary"))


def fit_area(samples: DataFrame, source: str) -> DataFrame:
    """Choose the drainage area of the fit and tighten calibration_valid to positive ones."""
    names = {"lin": "lin_area_km2", "d4": "nearest_d4_area_km2"}
    if source not in names:
        raise ValueError("source must be 'lin' or 'd4'")
    out = samples.withColumn("fit_area_km2", F.col(names[source]))
    return out.withColumn("calibration_valid", F.col("calibration_valid") & F.coalesce(F.col("fit_area_km2") > 0, F.lit(False)))
