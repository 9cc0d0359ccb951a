"""Mapped river networks on the grid: reaches as paths of cells that share an edge, and who owns a cell's link.

``reaches(reach_id, next_down, area_km2, order, vertices array<struct<x,y>>)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions.session import ship_package
from fluvia.functions.tables import settled

#: Steps of the longest bridge between a reach's end and the next one's beginning.
BRIDGE = 8


def staircase(start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """Cells from start to end: straight along the longer axis until as much is left along the other, then by turns, columns first."""
    way = np.subtract(end, start)
    rows, cols = np.abs(way)
    turns = min(rows, cols)
    # 1 for a step along the columns, 0 along the rows.
    across = np.concatenate([np.full(max(rows, cols) - turns, int(cols > rows)), np.tile([1, 0], turns)]).astype(int)
    steps = np.sign(way) * np.stack([1 - across, across], axis=1)
    return [tuple(cell) for cell in (np.cumsum(np.concatenate([[start], steps]), axis=0)).tolist()]


def oriented(reaches: DataFrame) -> DataFrame:
    """Reaches with vertices in flow order: the end nearest to the next reach last, else the end nearest to those above first."""
    first, last = F.element_at("vertices", 1), F.element_at("vertices", -1)
    apart = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    ends = settled(reaches.select("reach_id", "next_down", first.alias("a"), last.alias("b")))
    down = ends.select(F.col("reach_id").alias("next_down"), F.col("a").alias("da"), F.col("b").alias("db"))
    below = ends.join(down, "next_down", "left").select("reach_id", F.least(apart(F.col("a"), F.col("da")), apart(F.col("a"), F.col("db"))).alias("first_down"), F.least(apart(F.col("b"), F.col("da")), apart(F.col("b"), F.col("db"))).alias("last_down"))
    up = ends.select(F.col("next_down").alias("reach_id"), F.col("a").alias("ua"), F.col("b").alias("ub"))
    above = ends.join(up, "reach_id").groupBy("reach_id").agg(F.min(F.least(apart(F.col("a"), F.col("ua")), apart(F.col("a"), F.col("ub")))).alias("first_up"), F.min(F.least(apart(F.col("b"), F.col("ua")), apart(F.col("b"), F.col("ub")))).alias("last_up"))
    rows = reaches.join(below, "reach_id").join(above, "reach_id", "left")
    turn = F.when(F.col("last_down").isNotNull(), F.col("first_down") < F.col("last_down")).otherwise(F.coalesce(F.col("last_up") < F.col("first_up"), F.lit(False)))
    return rows.withColumn("vertices", F.when(turn, F.reverse("vertices")).otherwise(F.col("vertices"))).select(*reaches.columns)


def _walked(rows: DataFrame, column: str, rows_n: int, cols: int) -> DataFrame:
    """reach_id, seq, cell_id: cells between successive ``array<struct<r,c>>`` entries, inside the grid, without repeats in a row."""
    ship_package(rows.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for reach, points in zip(pdf["reach_id"], pdf[column], strict=True):
                spots = [(int(p["r"]), int(p["c"])) for p in points]
                path = spots[:1]
                for a, b in zip(spots, spots[1:]):
                    path += staircase(a, b)[1:]
                cells = [r * cols + c for r, c in path if 0 <= r < rows_n and 0 <= c < cols]
                cells = [k for i, k in enumerate(cells) if i == 0 or k != cells[i - 1]]
                out += [(reach, i, k) for i, k in enumerate(cells)]
            yield pd.DataFrame(out, columns=["reach_id", "seq", "cell_id"])

    return rows.select("reach_id", column).mapInPandas(run, "reach_id long, seq int, cell_id long")


def reach_cells(reaches: DataFrame, rows: int, cols: int, x0: float, y0: float, dx: float, dy: float, terrain: DataFrame | None = None, snap: int = 0) -> DataFrame:
    """reach_id, seq, cell_id of oriented reaches; with terrain, cells move to the lowest one within ``snap`` cells first."""
    at = lambda p: F.struct(F.floor((y0 - p["y"]) / dy).cast("int").alias("r"), F.floor((p["x"] - x0) / dx).cast("int").alias("c"))
    path = _walked(reaches.select("reach_id", F.transform("vertices", at).alias("p")), "p", rows, cols)
    if terrain is None:
        return path
    if snap > 0:
        ring = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-snap, snap + 1) for c in range(-snap, snap + 1)])
        near = path.select("reach_id", "seq", F.col("cell_id").alias("_own"), F.floor(F.col("cell_id") / cols).cast("int").alias("_r"), (F.col("cell_id") % cols).cast("int").alias("_c"), F.explode(ring).alias("o"))
        near = near.select("reach_id", "seq", "_own", (F.col("_r") + F.col("o.r")).alias("row"), (F.col("_c") + F.col("o.c")).alias("col"))
        low = near.join(terrain.where("z is not null").select("row", "col", "cell_id", "z"), ["row", "col"]).groupBy("reach_id", "seq").agg(F.min(F.struct("z", "cell_id")).alias("m"))
        path = path.join(low, ["reach_id", "seq"], "left").select("reach_id", "seq", F.coalesce("m.cell_id", "cell_id").alias("cell_id"))
    spot = F.struct("seq", F.floor(F.col("cell_id") / cols).cast("int").alias("r"), (F.col("cell_id") % cols).cast("int").alias("c"))
    return _walked(path.groupBy("reach_id").agg(F.sort_array(F.collect_list(spot)).alias("p")), "p", rows, cols)


def grid_network(reaches: DataFrame, rows: int, cols: int, x0: float, y0: float, dx: float, dy: float, least_area: float = 0.0, terrain: DataFrame | None = None, snap: int = 0) -> DataFrame:
    """cell_id, receiver, area_km2 of all cells on mapped reaches.

    Gaps of up to eight steps to the next reach are bridged. A cell takes the largest area of its reaches and the link of
    such a reach, the last in order of equal ones.
    """
    kept = reaches.where((F.col("area_km2") >= least_area) & (F.size("vertices") > 1))
    if not kept.limit(1).count():
        raise ValueError("no reach is left after filtering by area")
    path = settled(reach_cells(oriented(kept), rows, cols, x0, y0, dx, dy, terrain, snap))
    facts = kept.select("reach_id", "next_down", "area_km2", "order")
    spot = lambda c: F.struct(F.floor(c / cols).cast("int").alias("r"), (c % cols).cast("int").alias("c"))
    ends = path.groupBy("reach_id").agg(F.max_by("cell_id", "seq").alias("end"), F.max("seq").alias("n"), F.min_by("cell_id", "seq").alias("begin"))
    heads = ends.select(F.col("reach_id").alias("next_down"), F.col("begin").alias("goal"))
    gaps = ends.join(facts, "reach_id").join(heads, "next_down").where("end <> goal")
    steps = F.abs(F.floor(F.col("end") / cols) - F.floor(F.col("goal") / cols)) + F.abs(F.col("end") % cols - F.col("goal") % cols)
    bridges = _walked(gaps.where(steps <= BRIDGE).select("reach_id", F.array(spot(F.col("end")), spot(F.col("goal"))).alias("p")), "p", rows, cols)
    after = bridges.where("seq > 0").join(ends.select("reach_id", "n"), "reach_id").select("reach_id", (F.col("seq") + F.col("n")).alias("seq"), "cell_id")
    whole = settled(path.unionByName(after).join(facts, "reach_id"))
    owner = whole.groupBy("cell_id").agg(F.max("area_km2").alias("area_km2"))
    nxt = whole.select("reach_id", (F.col("seq") - 1).alias("seq"), F.col("cell_id").alias("to"))
    links = whole.join(nxt, ["reach_id", "seq"]).where("cell_id <> to").join(owner.withColumnRenamed("area_km2", "_most"), "cell_id").where(F.col("area_km2") >= F.col("_most"))
    chosen = links.groupBy("cell_id").agg(F.max_by("to", F.struct("order", "seq")).alias("receiver"))
    return owner.join(chosen, "cell_id", "left").select("cell_id", "receiver", "area_km2")


def burned_channel(cells: DataFrame, segments: DataFrame, z: str = "z") -> DataFrame:
    """Terrain lowered to the bed of ``segments(ax, ay, bx, by, bed, half_width)`` within their width; adds ``channel``."""
    from fluvia.operators.nearest import segment_distance

    size = F.lit(float(segments.agg(F.max("half_width")).first()[0] or 1.0) * 4)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - F.col("half_width")) / size), F.floor((F.greatest(a, b) + F.col("half_width")) / size))
    dealt = segments.withColumn("_i", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("_j", F.explode(span(F.col("ay"), F.col("by"))))
    near = cells.select("cell_id", "x", "y", F.floor(F.col("x") / size).alias("_i"), F.floor(F.col("y") / size).alias("_j")).join(dealt, ["_i", "_j"])
    apart = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    hit = near.where(apart <= F.col("half_width")).groupBy("cell_id").agg(F.min_by("bed", apart).alias("_bed"))
    out = cells.join(hit, "cell_id", "left")
    return out.withColumns({"channel": F.col("_bed").isNotNull(), z: F.least(z, "_bed")}).drop("_bed")
