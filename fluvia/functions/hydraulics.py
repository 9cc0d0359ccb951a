"""Hydraulic and hydrological formulas as column expressions.

Missing input is null and gives null unless a function says otherwise. All expressions stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published default coefficients of width and depth power laws, and other constants: fixed values.
WIDTH_COEFFICIENT, WIDTH_EXPONENT = 2.2695, 0.4942
DEPTH_COEFFICIENT, DEPTH_EXPONENT = 0.1097, 0.3856


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def power_law(area, coefficient, exponent) -> Column:
    """coefficient * max(area, 0) ^ exponent."""
    return _c(coefficient) * F.pow(F.greatest(_c(area), F.lit(0.0)), _c(exponent))


def river_power_law(area, river, coefficient, exponent, cap=None) -> Column:
    """A power law on river cells of positive area, optionally capped; 0 elsewhere."""
    value = power_law(area, coefficient, exponent)
    if cap is not None:
        value = F.least(value, _c(cap))
    return F.when(F.coalesce(_c(river), F.lit(False)) & (_c(area) > 0), value).otherwise(0.0)


def conveyance_term(width, depth) -> Column:
    """A R^(2/3) of a rectangle; 0 where dry or without width."""
    w, d = _c(width), _c(depth)
    return F.when((w > 0) & (d > 0), w * d * F.pow(w * d / (w + 2 * d), F.lit(2.0 / 3.0))).otherwise(0.0)


def rectangular_conveyance(width, depth, manning_n) -> Column:
    """Conveyance of a rectangle with Manning's n."""
    return conveyance_term(width, depth) / _c(manning_n)


def bisect(low, high, too_low, steps: int) -> Column:
    """``struct(lo, hi)`` after ``steps`` halvings; ``too_low(mid)`` moves the lower end up."""

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = too_low(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(_c(low).alias("lo"), _c(high).alias("hi")), halve)


#: Newton steps of ``depth_of_term``: from a start off by a factor of e^0.5 at most they reach the last digits.
DEPTH_STEPS = 4


def depth_of_term(term, width, max_depth: float) -> Column:
    """Depth up to ``max_depth`` of a rectangle whose A R^(2/3) is ``term``, for positive arguments.

    A R^(2/3) = term means ln d = ln c + 0.4 ln(w + 2 d) with c = term^0.6 / w. The slope of the difference lies in (0.6, 1], so
    Newton steps in ln d settle; they begin at the greater of the depths for w alone and for 2 d alone. The state carries width and c, which are worked out once a row.
    """
    t, w, top = F.greatest(_c(term), F.lit(1e-200)), _c(width), F.lit(float(max_depth))
    c = F.pow(t, F.lit(0.6)) / w
    start = F.struct(F.greatest(c * F.pow(w, F.lit(0.4)), F.pow(c * 2**0.4, F.lit(1 / 0.6))).alias("d"), w.alias("w"), F.ln(c).alias("c"))

    def step(s: Column, _: Column) -> Column:
        d, wetted = s["d"], s["w"] + 2 * s["d"]
        apart = (F.ln(d) - s["c"] - 0.4 * F.ln(wetted)) / (1 - 0.8 * d / wetted)
        return F.struct((d * F.exp(-apart)).alias("d"), s["w"].alias("w"), s["c"].alias("c"))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH_STEPS)), start, step, lambda s: s["d"])
    return F.when(t >= conveyance_term(w, top), top).otherwise(F.least(solved, top))


def equivalent_lowering(width, depth, grid_width, mode: str = "wide", max_depth: float = 100.0) -> Column:
    """Depth by which a channel one cell wide must be lowered to convey as much as the river; 0 without a river."""
    b, h, g = _c(width), _c(depth), _c(grid_width)
    if mode == "wide":
        value = F.pow(b / g * F.pow(h, F.lit(5.0 / 3.0)), F.lit(0.6))
    elif mode == "manning_exact":
        value = depth_of_term(conveyance_term(b, h), g, max_depth)
    else:
        raise ValueError("mode must be 'wide' or 'manning_exact'")
    return F.when((b > 0) & (h > 0), F.least(F.greatest(value, F.lit(0.0)), F.lit(float(max_depth)))).otherwise(0.0)


def manning_depth(discharge, width, slope, manning_n, max_depth: float) -> Column:
    """``struct(depth, clipped)``: normal depth of a rectangle, 0 where any input is not positive."""
    q, w, s = _c(discharge), _c(width), _c(slope)
    good = F.coalesce((q > 0) & (w > 0) & (s > 0), F.lit(False))
    target = q * _c(manning_n) / F.sqrt(s)
    return F.struct(
        F.when(good, depth_of_term(target, w, max_depth)).otherwise(0.0).alias("depth"),
        (good & (target > conveyance_term(w, F.lit(float(max_depth))))).alias("clipped"),
    )


def kirpich_minutes(length_m, drop_m, minimum: float) -> Column:
    """Time of concentration, at least ``minimum``."""
    length = _c(length_m)
    slope = F.when(length > 0, _c(drop_m) / length).otherwise(0.0)
    tc = 0.01947 * F.pow(F.greatest(length, F.lit(1.0)), F.lit(0.77)) * F.pow(F.greatest(slope, F.lit(1e-5)), F.lit(-0.385))
    return F.greatest(tc, F.lit(float(minimum)))


def scs_runoff_mm(rain_mm, curve_number, abstraction_ratio=0.2) -> Column:
    """Excess rain of one storm by the curve-number method."""
    storage = 25400.0 / _c(curve_number) - 254.0
    left = _c(rain_mm) - _c(abstraction_ratio) * storage
    return F.when(left > 0, left * left / (left + storage)).when(left.isNotNull(), 0.0)


def storm_minutes(tc_min, ratio: float = 0.133, minimum: float = 5.0) -> Column:
    return F.greatest(F.lit(float(minimum)), ratio * _c(tc_min))


def idf_depth_mm(duration_min, return_period, k, a, b, c) -> Column:
    """Storm depth by an intensity-duration-frequency curve k T^a / (d + b)^c."""
    d = _c(duration_min)
    return _c(k) * F.pow(_c(return_period), _c(a)) / F.pow(d + _c(b), _c(c)) * d / 60.0


def unit_hydrograph_peak(area_km2, runoff_mm, duration_min, tc_min, lag_ratio: float = 0.6) -> Column:
    """Peak discharge of the dimensionless unit hydrograph in m3/s."""
    time_to_peak = 0.5 * _c(duration_min) / 60.0 + lag_ratio * _c(tc_min) / 60.0
    return 0.208 * _c(area_km2) * _c(runoff_mm) / time_to_peak


def replace_where(base, replacement, mask) -> Column:
    """``replacement`` where the mask holds and it is present, else ``base``."""
    return F.when(F.coalesce(_c(mask), F.lit(False)) & _c(replacement).isNotNull(), _c(replacement)).otherwise(_c(base))


def connected_depths(ground: Column, stage: Column) -> Column:
    """Depths outward from a bank until the first dry or missing cell, as an array; cells beyond are 0."""
    depth = F.transform(ground, lambda g: F.coalesce(F.greatest(stage - g, F.lit(0.0)), F.lit(0.0)))

    def step(s: Column, d: Column) -> Column:
        wet = s["wet"] & (d > 0)
        return F.struct(wet.alias("wet"), F.array_append(s["out"], F.when(wet, d).otherwise(0.0)).alias("out"))

    start = F.struct(F.lit(True).alias("wet"), F.expr("cast(array() as array<double>)").alias("out"))
    return F.aggregate(depth, start, step, lambda s: s["out"])


def compound_discharge(stage, bed, bank_depth, width, slope, left: Column, right: Column, cell_width, channel_n: float, floodplain_n: float) -> Column:
    """Discharge of a channel with connected overbank cells on both sides."""
    z = _c(stage)
    channel = rectangular_conveyance(width, F.least(F.greatest(z - _c(bed), F.lit(0.0)), _c(bank_depth)), channel_n)

    def side(ground: Column) -> Column:
        return F.aggregate(connected_depths(ground, z), F.lit(0.0), lambda s, d: s + rectangular_conveyance(cell_width, d, floodplain_n))

    return F.sqrt(_c(slope)) * (channel + side(left) + side(right))


def solve_stage(q, bed, bank_depth, width, slope, left: Column, right: Column, cell_width, channel_n: float, floodplain_n: float, max_above_bank: float) -> Column:
    """Stage that carries ``q``, from 36 halvings; null where the highest allowed stage cannot."""
    b, bank = _c(bed), _c(bed) + _c(bank_depth)
    upper = F.least(F.greatest(F.array_max(left), F.array_max(right), bank), bank + max_above_bank)

    def carried(z: Column) -> Column:
        return compound_discharge(z, b, bank_depth, width, slope, left, right, cell_width, channel_n, floodplain_n)

    return F.when(carried(upper) >= _c(q), bisect(b, upper, lambda mid: carried(mid) < _c(q), 36)["hi"])
