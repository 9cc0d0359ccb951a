"""Exact distance transforms and nearest-neighbour operators.

The transform is separable: a window along each column finds the nearest source above and below, and a task per row
takes the lower envelope of the parabolas of that row's columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.session import ship_package
from fluvia.functions.tables import spread


def envelope(cost: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``to`` the least cost[i] + (to - at[i])^2 and that i. ``at`` rises, ``to`` rises."""
    hull, bounds = [], []
    for i in range(len(at)):
        start = -np.inf
        while hull:
            j = hull[-1]
            start = ((cost[i] + at[i] ** 2) - (cost[j] + at[j] ** 2)) / (2 * (at[i] - at[j]))
            if start > bounds[-1]:
                break
            hull.pop()
            bounds.pop()
            start = -np.inf
        hull.append(i)
        bounds.append(start)
    best = np.array(hull)[np.searchsorted(np.array(bounds), to, side="right") - 1]
    return cost[best] + (to - at[best]) ** 2, best


def nearest_source(cells: DataFrame, source: Column, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """cell_id, distance, source_id of each cell's nearest source cell, in metres of the cell sizes; null without sources."""
    ship_package(cells.sparkSession)
    on = F.coalesce(source, F.lit(False))
    # Both windows end at the row itself: one that begins there is worked out anew for each row, with the square of a column's length.
    column, upwards = Window.partitionBy("col").orderBy("row"), Window.partitionBy("col").orderBy(F.desc("row"))
    mark = F.when(on, F.struct(F.col("row").alias("r"), F.col("cell_id").alias("id")))
    up = F.last(mark, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    down = F.last(mark, ignorenulls=True).over(upwards.rowsBetween(Window.unboundedPreceding, 0))
    rows = cells.select("row", "col", "cell_id", up.alias("up"), down.alias("down"))
    above, below = (F.col("row") - F.col("up.r")) * dy, (F.col("down.r") - F.col("row")) * dy
    nearer = F.when(F.col("down").isNull() | (above <= below), F.struct(above.alias("g"), F.col("up.id").alias("id"))).otherwise(F.struct(below.alias("g"), F.col("down.id").alias("id")))
    rows = rows.select("row", "col", "cell_id", F.when(F.col("up").isNotNull() | F.col("down").isNotNull(), nearer).alias("n")).select("row", "col", "cell_id", "n.g", "n.id")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        with_source = pdf[pdf["id"].notna()]
        if with_source.empty:
            return pd.DataFrame({"cell_id": pdf["cell_id"], "distance": np.nan, "source_id": -1})
        value, best = envelope(with_source["g"].to_numpy() ** 2, with_source["col"].to_numpy() * dx, pdf["col"].to_numpy() * dx)
        return pd.DataFrame({"cell_id": pdf["cell_id"], "distance": np.sqrt(np.maximum(value, 0)), "source_id": with_source["id"].to_numpy()[best].astype("int64")})

    found = spread(rows, "row").groupBy("row").applyInPandas(across, "cell_id long, distance double, source_id long")
    known = F.col("source_id") >= 0
    return found.select("cell_id", F.when(known, F.col("distance")).alias("distance"), F.when(known, F.col("source_id")).alias("source_id"))


def filled_from_nearest(cells: DataFrame, value: str, domain: str) -> DataFrame:
    """``cells`` with gaps of ``value`` inside the domain filled from the nearest cell that has one (by cells); null outside."""
    near = nearest_source(cells, F.col(value).isNotNull())
    given = cells.select(F.col("cell_id").alias("source_id"), F.col(value).alias("_given"))
    out = cells.join(near.join(given, "source_id", "left").select("cell_id", "_given"), "cell_id", "left")
    return out.withColumn(value, F.when(F.coalesce(domain, F.lit(False)), F.coalesce(value, "_given"))).drop("_given")


def height_above_nearest(cells: DataFrame, z: str, river: str, dx: float, dy: float) -> DataFrame:
    """cell_id, hand, distance: height above the nearest river cell, at least 0, and its distance."""
    near = nearest_source(cells, F.col(river), dx, dy)
    river_z = cells.select(F.col("cell_id").alias("source_id"), F.col(z).alias("_rz"))
    own = cells.select("cell_id", F.col(z).alias("_z"))
    return own.join(near, "cell_id").join(river_z, "source_id", "left").select("cell_id", F.greatest(F.col("_z") - F.col("_rz"), F.lit(0.0)).alias("hand"), "distance")


def within(cells: DataFrame, source: Column, radius: float, dx: float, dy: float) -> DataFrame:
    """cell_id, within: whether the nearest source is at most ``radius`` away."""
    return nearest_source(cells, source, dx, dy).select("cell_id", F.coalesce(F.col("distance") <= radius, F.lit(False)).alias("within"))


def bucketed_pairs(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Rows of ``points(x, y, ...)`` with each row of ``others(ox, oy, ...)`` closer than ``radius``: an equi-join on square buckets, then the distance."""
    ring = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left = points.withColumn("_to", ring).withColumns({"_bi": F.floor(F.col("x") / radius) + F.col("_to.a"), "_bj": F.floor(F.col("y") / radius) + F.col("_to.b")}).drop("_to")
    right = others.withColumns({"_bi": F.floor(F.col("ox") / radius), "_bj": F.floor(F.col("oy") / radius)})
    return left.join(right, ["_bi", "_bj"]).withColumn("apart", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).where(F.col("apart") < radius).drop("_bi", "_bj")


#: Cells of a quarter of the distance whose points are all closer than it to all points of the cell in the middle.
_SURE = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if (abs(a) + 1) ** 2 + (abs(b) + 1) ** 2 < 16]


def drop_near(points: DataFrame, blockers: DataFrame, minimum: float, key: str = "id") -> DataFrame:
    """Points without a blocker closer than ``minimum``, each by its own place.

    Cells of a quarter of the distance come first: a point is near if a blocker lies in a cell that is near as a whole, so crowded
    places need no pairs. Only the points that are left are paired with blockers, through buckets. Points without a finite place stay.
    """
    if minimum <= 0:
        return points
    finite = "abs(x) < double('Infinity') and abs(y) < double('Infinity')"
    cell = lambda c: F.floor(F.col(c) / (minimum / 4))
    placed = blockers.where(finite).select("x", "y")
    sure = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _SURE]))
    cells = placed.select(cell("x").alias("_i"), cell("y").alias("_j")).distinct().withColumn("_to", sure)
    taken = cells.select((F.col("_i") + F.col("_to.a")).alias("_ci"), (F.col("_j") + F.col("_to.b")).alias("_cj")).distinct()
    own = lambda c: F.when(F.expr(finite), cell(c))
    left = points.withColumns({"_ci": own("x"), "_cj": own("y")}).join(taken, ["_ci", "_cj"], "left_anti").drop("_ci", "_cj")
    hit = bucketed_pairs(left.where(finite).select("x", "y").distinct(), placed.distinct().select(F.col("x").alias("ox"), F.col("y").alias("oy")), minimum).select("x", "y").distinct()
    return left.join(hit, ["x", "y"], "left_anti").select(*points.columns)


def drop_claimed(points: DataFrame, placed: DataFrame, spacing: float, factor: float = 0.75, key: str = "id") -> DataFrame:
    """Points at least ``factor * spacing`` away from everything placed."""
    return drop_near(points, placed, factor * spacing, key)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def along_buckets(segments: DataFrame, size: float, margin: float = 2e-4) -> DataFrame:
    """``segments(ax, ay, bx, by, ...)`` with i, j of every square bucket that they pass within ``margin``: as many as they are long."""
    low_x, high_x = F.least("ax", "bx"), F.greatest("ax", "bx")
    dealt = segments.withColumn("i", F.explode(F.sequence(F.floor((low_x - margin) / size), F.floor((high_x + margin) / size))))
    height = lambda x: F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / (F.col("bx") - F.col("ax"))
    enter, leave = (height(F.least(F.greatest(F.col("i") * size + e, low_x), high_x)) for e in (-margin, size + margin))
    steep = F.col("ax") == F.col("bx")
    low = F.when(steep, F.least("ay", "by")).otherwise(F.least(enter, leave))
    high = F.when(steep, F.greatest("ay", "by")).otherwise(F.greatest(enter, leave))
    return dealt.withColumn("j", F.explode(F.sequence(F.floor((low - margin) / size), F.floor((high + margin) / size))))


def burned(cells: DataFrame, segments: DataFrame, buffer: float, cell: float) -> DataFrame:
    """cell_id, value of cells (x, y) touched by segments(ax, ay, bx, by, value, order) widened by ``buffer``; the last in order wins.

    A segment is dealt to the buckets along its bounding box; bucket and cell are joined by equality.
    """
    reach = buffer + cell * 0.5 * 2**0.5
    size = max(reach, 8 * cell)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / size), F.floor((F.greatest(a, b) + reach) / size))
    dealt = segments.withColumn("_bi", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("_bj", F.explode(span(F.col("ay"), F.col("by"))))
    near = cells.withColumns({"_bi": F.floor(F.col("x") / size), "_bj": F.floor(F.col("y") / size)}).join(dealt, ["_bi", "_bj"])
    apart = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return near.where(apart <= F.lit(reach)).groupBy("cell_id").agg(F.max_by("value", "order").alias("value"))


def inside_polygons(points: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """key, face_id of points inside polygons given by edges(face_id, ax, ay, bx, by): odd crossings of a ray along x.

    Edges are dealt to horizontal strips as high as their mean, so a point meets only the edges at its height and one tall
    edge does not widen the strips of all.
    """
    height = edges.agg(F.avg(F.abs(F.col("by") - F.col("ay"))).alias("h")).first()["h"] or 1.0
    strips = edges.where("ay <> by").withColumn("_s", F.explode(F.sequence(F.floor(F.least("ay", "by") / height), F.floor(F.greatest("ay", "by") / height))))
    rows = points.withColumn("_s", F.floor(F.col("y") / height)).join(strips, "_s")
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    right = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    return rows.where(spans & right).groupBy(key, "face_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, "face_id")
