"""Window operators along reaches: ``stations(reach_id, seq, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(order: str = "seq") -> Window:
    return Window.partitionBy("reach_id").orderBy(order)


def distances(stations: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``s_m``, the length along the reach so far."""
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(_by()), F.col(y) - F.lag(y).over(_by())), F.lit(0.0))
    return stations.withColumn("_step", step).withColumn("s_m", F.sum("_step").over(_by().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def arc_position(stations: DataFrame) -> DataFrame:
    """Add ``position``: s_m over the reach's length."""
    total = F.max("s_m").over(Window.partitionBy("reach_id"))
    return stations.withColumn("position", F.when(total > 0, F.col("s_m") / total).otherwise(0.0))


def sample_positions(stations: DataFrame, spacing: float) -> DataFrame:
    """Rows where floor(s_m / spacing) grows, and both ends."""
    new = F.floor(F.col("s_m") / spacing) > F.floor(F.lag("s_m").over(_by()) / spacing)
    end = F.lead("seq").over(_by()).isNull() | F.lag("seq").over(_by()).isNull()
    return stations.withColumn("_pick", F.coalesce(new, F.lit(False)) | end).where("_pick").drop("_pick")


def _near(aggregate: str, window: float) -> Column:
    """An aggregate over the stations within half a window of length."""
    half = float(window) / 2
    return F.expr(f"{aggregate} OVER (PARTITION BY reach_id ORDER BY s_m RANGE BETWEEN {half!r}D PRECEDING AND {half!r}D FOLLOWING)")


def smoothed_slopes(stations: DataFrame, bed: str, window: float, low: float, high: float) -> DataFrame:
    """Add ``slope``: fall over half a window to both sides, between neighbours where it holds one station, clipped."""
    ends = {f"_{k}": _near(f"{f}({c})", window) for k, f, c in (("z0", "first", bed), ("z1", "last", bed), ("s0", "first", "s_m"), ("s1", "last", "s_m"))}
    side = _by("s_m").rowsBetween(-1, 1)
    lone = {"_lz0": F.first(bed).over(side), "_lz1": F.last(bed).over(side), "_ls0": F.first("s_m").over(side), "_ls1": F.last("s_m").over(side)}
    alone = F.col("_s1") <= F.col("_s0")
    pick = lambda k: F.when(alone, F.col(f"_l{k}")).otherwise(F.col(f"_{k}"))
    slope = (pick("z0") - pick("z1")) / F.greatest(pick("s1") - pick("s0"), F.lit(1.0))
    return stations.withColumns(ends | lone).withColumn("slope", F.least(F.greatest(slope, F.lit(float(low))), F.lit(float(high)))).drop(*ends, *lone)


def smoothed_profile(stations: DataFrame, value: str, window: float) -> DataFrame:
    """Add ``smoothed``: median of the present values within half a window."""
    return stations.withColumn("smoothed", _near(f"percentile({value}, 0.5D)", window))


def smoothed_widths(stations: DataFrame, width: str, cells: int) -> DataFrame:
    """Add ``smoothed_width``: moving mean over an odd number of stations; ends repeat, gaps take the reach's median."""
    radius = cells // 2
    whole = Window.partitionBy("reach_id")
    filled = F.coalesce(F.col(width), F.percentile(width, 0.5).over(whole))
    rows = stations.withColumn("_w", filled).withColumns({
        "_k": F.row_number().over(_by()), "_n": F.count(F.lit(1)).over(whole),
        "_first": F.first("_w").over(_by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_last": F.last("_w").over(_by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    near = F.sum("_w").over(_by().rowsBetween(-radius, radius))
    before, after = F.greatest(F.lit(radius) - F.col("_k") + 1, F.lit(0)), F.greatest(F.col("_k") + radius - F.col("_n"), F.lit(0))
    return rows.withColumn("smoothed_width", (near + before * F.col("_first") + after * F.col("_last")) / (2 * radius + 1)).drop("_w", "_k", "_n", "_first", "_last")


def normals(stations: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add unit normals ``nx, ny`` of central differences, one-sided at the ends."""
    tx = F.coalesce(F.lead(x).over(_by()), F.col(x)) - F.coalesce(F.lag(x).over(_by()), F.col(x))
    ty = F.coalesce(F.lead(y).over(_by()), F.col(y)) - F.coalesce(F.lag(y).over(_by()), F.col(y))
    rows = stations.withColumns({"_tx": tx, "_ty": ty}).withColumn("_l", F.hypot("_tx", "_ty"))
    unit = lambda v: F.when(F.col("_l") > 0, v / F.col("_l")).otherwise(0.0)
    return rows.withColumns({"nx": unit(-F.col("_ty")), "ny": unit(F.col("_tx"))}).drop("_tx", "_ty", "_l")


def fold_limited(stations: DataFrame, half_width: str, safety: float = 0.5) -> DataFrame:
    """Cap ``half_width`` at ``safety`` times where the normal meets the next or the last station's normal."""

    def meets(other) -> Column:
        dx, dy = other("x") - F.col("x"), other("y") - F.col("y")
        cross = F.col("nx") * other("ny") - F.col("ny") * other("nx")
        t = (dx * other("ny") - dy * other("nx")) / F.nullif(cross, F.lit(0.0))
        return F.when(F.abs(cross) > 1e-12, F.abs(t) * safety)

    ahead = meets(lambda c: F.lead(c).over(_by()))
    behind = meets(lambda c: F.lag(c).over(_by()))
    return stations.withColumn(half_width, F.least(F.col(half_width), ahead, behind))


def corner_cut(vertices: DataFrame, rounds: int) -> DataFrame:
    """Chaikin smoothing of ``vertices(reach_id, seq, x, y)`` with fixed ends."""
    point = F.struct("seq", "x", "y")
    lines = vertices.groupBy("reach_id").agg(F.sort_array(F.collect_list(point)).alias("p"))

    def cut(p: Column) -> Column:
        n = F.size(p)
        legs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(p[i].alias("a"), p[i + 1].alias("b")))
        mix = lambda a, b, w: F.struct(F.lit(0).alias("seq"), (a["x"] * (1 - w) + b["x"] * w).alias("x"), (a["y"] * (1 - w) + b["y"] * w).alias("y"))
        inner = F.flatten(F.transform(legs, lambda s: F.array(mix(s["a"], s["b"], 0.25), mix(s["a"], s["b"], 0.75))))
        end = lambda q: F.struct(F.lit(0).alias("seq"), q["x"].alias("x"), q["y"].alias("y"))
        return F.concat(F.array(end(p[0])), inner, F.array(end(p[n - 1])))

    for _ in range(rounds):
        lines = lines.withColumn("p", F.when(F.size("p") > 2, cut(F.col("p"))).otherwise(F.col("p")))
    return lines.select("reach_id", F.posexplode("p").alias("seq", "v")).select("reach_id", "seq", "v.x", "v.y")


def interpolated(points: DataFrame, curve: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Add ``y`` to ``points(key, x)`` from the breakpoints ``curve(key, x, y)``: linear between, held outside. An as-of join on both sides."""
    both = points.select("*", F.lit(None).cast("double").alias("_y"), F.lit(False).alias("_knot")).unionByName(
        curve.select(key, x, F.col(y).alias("_y"), F.lit(True).alias("_knot")), allowMissingColumns=True
    )
    knot = F.when(F.col("_knot"), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    # The way back ends at the row too: a window that begins there is worked out anew for each row.
    order, back = Window.partitionBy(key).orderBy(F.col(x), F.desc("_knot")), Window.partitionBy(key).orderBy(F.desc(x), "_knot")
    before = F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(knot, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    a, b = F.col("_a"), F.col("_b")
    share = (F.col(x) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    value = F.when(a.isNull(), b["y"]).when(b.isNull() | (F.col(x) == a["x"]), a["y"]).otherwise(a["y"] + share * (b["y"] - a["y"]))
    return both.withColumns({"_a": before, "_b": after}).where("not _knot").withColumn(y, value).drop("_a", "_b", "_y", "_knot")


def connected_side(lateral: DataFrame, stage: str, ground: str = "ground") -> DataFrame:
    """Add ``depth`` to ``lateral(section_id, side, k, ...)``: wet outward until the first dry or missing cell."""
    wet = F.coalesce(F.greatest(F.col(stage) - F.col(ground), F.lit(0.0)), F.lit(0.0))
    so_far = Window.partitionBy("section_id", "side").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return lateral.withColumn("_d", wet).withColumn("depth", F.when(F.min("_d").over(so_far) > 0, F.col("_d")).otherwise(0.0)).drop("_d")


def bank_levels(lateral: DataFrame, bank_cells: int, ground: str = "ground") -> DataFrame:
    """section_id, bank: the lower of both sides' medians over the cells nearest the bank."""
    near = Window.partitionBy("section_id", "side").orderBy("k")
    sides = lateral.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= bank_cells).groupBy("section_id", "side").agg(F.percentile(ground, 0.5).alias("m"))
    return sides.groupBy("section_id").agg(F.min("m").alias("bank"))


def cross_sections(sections: DataFrame, rows: int, cols: int, first: int, cells: int, scheme: str = "d4") -> DataFrame:
    """section_id, side, k, row, col: cells along the normal of each section's link, near bank first, inside the grid."""
    # Steps of the left bank for each direction code: fixed values.
    normal = {1: (0, -1), 2: (-1, 0), 3: (0, 1), 4: (1, 0)} if scheme == "d4" else {1: (0, -1), 2: (-1, -1), 3: (-1, 0), 4: (-1, 1), 5: (0, 1), 6: (1, 1), 7: (1, 0), 8: (1, -1)}
    step = F.lit(None).cast("struct<dr:int,dc:int>")
    for code, (r, c) in normal.items():
        step = F.when(F.col("direction") == code, F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"))).otherwise(step)
    out = sections.withColumn("_n", step).where("_n is not null").withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(first + cells - 1)))).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    sign = F.when(F.col("side") == "left", 1).otherwise(-1)
    placed = out.select("section_id", "side", "k", (F.col("row") + sign * F.col("k") * F.col("_n.dr")).alias("row"), (F.col("col") + sign * F.col("k") * F.col("_n.dc")).alias("col"))
    return placed.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))


def cross_cell_width(direction: Column, dx: float, dy: float, scheme: str = "d4") -> Column:
    """Metres that one lateral step stands for; the smaller cell size without a direction."""
    slant = (dx * dx + dy * dy) ** 0.5
    if scheme == "d4":
        return F.when(direction.isin(1, 3), dx).when(direction.isin(2, 4), dy).otherwise(min(dx, dy))
    return F.when(direction.isin(1, 5), dx).when(direction.isin(3, 7), dy).when(direction.isin(2, 4, 6, 8), slant).otherwise(min(dx, dy))
