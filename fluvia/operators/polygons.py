"""Polygon kernels on rows of vertices: clipping, exact overlap with a raster, Voronoi cells by tile.

A row carries a whole polygon as an array, so kernels work on batches of rows; only Voronoi cells need their neighbours,
which come from the tile and a halo around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions.session import ship_package
from fluvia.functions.tables import spread

OVERLAP_SCHEMA = "mesh_index long, raster_index long, area_m2 double"


def clip_half_plane(ring: np.ndarray, normal: tuple[float, float], level: float) -> np.ndarray:
    """The part of a ring where normal . p <= level (Sutherland-Hodgman)."""
    if not len(ring):
        return ring
    d = ring @ np.asarray(normal) - level
    inside, nxt, dn = d <= 0, np.roll(ring, -1, axis=0), np.roll(d, -1)
    out: list[np.ndarray] = []
    for p, q, a, b, keep in zip(ring, nxt, d, dn, inside, strict=True):
        if keep:
            out.append(p)
        if (a < 0 < b) or (b < 0 < a):
            out.append(p + (q - p) * (a / (a - b)))
    return np.array(out).reshape(-1, 2)


def ring_area(ring: np.ndarray) -> float:
    """Signed area, positive counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip_box(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    for normal, level in (((-1, 0), -x0), ((1, 0), x1), ((0, -1), -y0), ((0, 1), y1)):
        ring = clip_half_plane(ring, normal, level)
    return ring


def _cut_at_lines(own: np.ndarray, ends: np.ndarray, axis: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the edge's owner, ax, ay, bx, by) of edges cut where they pass whole numbers of ``axis`` (0 for x) from ``low`` to ``high`` of their owners."""
    a, b = ends[:, axis], ends[:, axis + 2]
    first = np.maximum(np.floor(np.minimum(a, b)).astype(np.int64) + 1, low[own])
    last = np.minimum(np.ceil(np.maximum(a, b)).astype(np.int64) - 1, high[own])
    n = np.maximum(last - first + 1, 0) + 1
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a, b = a[of], b[of]
    up = b >= a
    # Both pieces at a line use its exact place.
    start = np.where(nth == 0, a, np.where(up, first[of] + nth - 1, last[of] - nth + 1))
    stop = np.where(nth == n[of] - 1, b, np.where(up, first[of] + nth, last[of] - nth))
    span = np.where(b == a, 1.0, b - a)
    other = 1 - axis
    p, q = ends[of, other], ends[of, other + 2]
    out = np.empty((len(of), 4))
    out[:, axis], out[:, axis + 2] = start, stop
    out[:, other] = np.where(nth == 0, p, p + (q - p) * ((start - a) / span))
    out[:, other + 2] = np.where(nth == n[of] - 1, q, p + (q - p) * ((stop - a) / span))
    return own[of], out


def ring_cells(ring: np.ndarray, x: np.ndarray, y: np.ndarray, extent: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring, row, column, area) of many rings' overlaps with unit squares, from vertices in order with their rings' numbers from 0.

    Squares are those of columns x0 <= col < x1 and rows y0 <= row < y1, ``extent`` being x0, y0, x1, y1 of each ring. An edge's piece in a
    square counts the area between it and the square's left side, and the squares left of it in its row count it with their
    whole width, so squares between a ring's edges are counted too.
    """
    x0, y0, x1, y1 = extent
    starts = np.flatnonzero(np.diff(ring, prepend=-1))
    following = np.arange(1, len(ring) + 1)
    following[np.append(starts[1:], len(ring)) - 1] = starts
    own, e = _cut_at_lines(ring, np.column_stack([x, y, x[following], y[following]]), 1, y0, y1)
    row = np.floor((e[:, 1] + e[:, 3]) / 2).astype(np.int64)
    held = (e[:, 1] != e[:, 3]) & (row >= y0[own]) & (row < y1[own])
    own, e = _cut_at_lines(own[held], e[held], 0, x0, x1)
    row = np.floor((e[:, 1] + e[:, 3]) / 2).astype(np.int64)
    # What lies beside the extent shares one column on each side of it.
    col = np.clip(np.floor((e[:, 0] + e[:, 2]) / 2).astype(np.int64), x0[own] - 1, x1[own])
    rise = e[:, 3] - e[:, 1]
    part = ((e[:, 0] + e[:, 2]) / 2 - col) * rise
    order = np.lexsort((col, row, own))
    own, row, col, rise, part = own[order], row[order], col[order], rise[order], part[order]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])])[: len(own)])
    if not len(new):
        return own, row, col, part
    own, row, col, rise, part = own[new], row[new], col[new], np.add.reduceat(rise, new), np.add.reduceat(part, new)
    line = np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
    # What rises right of a square, within its row: the row's edges rise and fall by the same, so it is what falls left of it.
    total = np.cumsum(rise)
    begun = (total - rise)[np.flatnonzero(line)][np.cumsum(line) - 1]
    right = begun - total
    wide = np.concatenate([np.where(line[1:], 1, col[1:] - col[:-1]), [1]])
    of = np.repeat(np.arange(len(wide)), wide)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide)
    own, row, col, area = own[of], row[of], col[of] + nth, np.where(nth == 0, part[of], 0.0) + right[of]
    inside = (col >= x0[own]) & (col < x1[own])
    return own[inside], row[inside], col[inside], area[inside]


def raster_overlap(polygons: DataFrame, x0: float, y0: float, dx: float, dy: float, rows: int, cols: int, least_share: float = 1e-12) -> DataFrame:
    """mesh_index, raster_index (rows counted from the south), area_m2: exact overlap of polygons with raster cells.

    ``polygons(face_id, ring, seq, x, y)``; holes are subtracted. All polygons of a batch are cut side by side, and the work
    follows the cells that they cover. A vertex without a finite coordinate is an error; one without
    an id belongs to no polygon.
    """
    ship_package(polygons.sparkSession)

    def run(face: np.ndarray, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise ValueError("a vertex has no finite coordinate")
        u, v = (x - x0) / dx, (y0 - y) / dy
        new = np.concatenate([[True], (face[1:] != face[:-1]) | (ring[1:] != ring[:-1])])[: len(face)]
        number, begins = np.cumsum(new) - 1, np.flatnonzero(new)
        # Each ring is counted from a whole cell near it, so far places are as exact as near ones.
        cu, cv = np.floor(u[begins]), np.floor(v[begins])
        extent = tuple((n - at).astype(np.int64) for n, at in ((0, cu), (0, cv), (cols, cu), (rows, cv)))
        own, r, c, area = ring_cells(number, u - cu[number], v - cv[number], extent)
        r, c = r + cv[own].astype(np.int64), c + cu[own].astype(np.int64)
        area = np.where(ring[begins][own] == 0, 1.0, -1.0) * np.abs(area) * dx * dy
        of, index = face[begins][own], (rows - 1 - r) * cols + c
        order = np.lexsort((index, of))
        of, index, area = of[order], index[order], area[order]
        one = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (index[1:] != index[:-1])])[: len(of)])
        of, index, area = of[one], index[one], np.add.reduceat(area, one) if len(one) else area
        kept = area > dx * dy * least_share
        return pa.RecordBatch.from_arrays([pa.array(of[kept]), pa.array(index[kept]), pa.array(area[kept])], ["mesh_index", "raster_index", "area_m2"])

    return whole_faces(polygons, run, OVERLAP_SCHEMA)


def whole_faces(polygons: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``run(face_id, ring, x, y)`` over batches of vertices in ring order; no face is parted between batches."""
    held = spread(polygons.select(F.col("face_id").cast("long").alias("face_id"), F.col("ring").cast("int").alias("ring"), F.col("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "face_id")

    def batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            face = np.asarray(batch.column("face_id"))
            cut = int(np.searchsorted(face, face[-1]))
            if cut or (left and left[-1].column("face_id")[0].as_py() != face[0]):
                whole = pa.Table.from_batches([*left, batch.slice(0, cut)]) if cut else pa.Table.from_batches(left)
                yield run(*(whole.column(c).to_numpy() for c in ("face_id", "ring", "x", "y")))
                left = []
            left.append(batch.slice(cut))
        if left:
            yield run(*(pa.Table.from_batches(left).column(c).to_numpy() for c in ("face_id", "ring", "x", "y")))

    return held.where("face_id is not null").sortWithinPartitions("face_id", "ring", "seq", "x", "y").drop("seq").mapInArrow(batches_of, schema)


def voronoi_cell(seed: np.ndarray, others: np.ndarray, domain: np.ndarray) -> tuple[np.ndarray, float]:
    """(ring of the seed's cell within the domain, how far the last neighbour that could cut it lies)."""
    ring = domain
    apart = np.hypot(*(others - seed).T) if len(others) else np.zeros(0)
    reach = np.hypot(*(ring - seed).T).max() if len(ring) else 0.0
    # For a domain that is not convex the cutting cell stays convex, so cutting the domain by its half-planes is exact.
    box = np.array([[seed[0] - 2 * reach, seed[1] - 2 * reach], [seed[0] + 2 * reach, seed[1] - 2 * reach], [seed[0] + 2 * reach, seed[1] + 2 * reach], [seed[0] - 2 * reach, seed[1] + 2 * reach]])
    planes = []
    for i in np.argsort(apart, kind="stable"):
        if apart[i] == 0:
            continue
        radius = np.hypot(*(box - seed).T).max()
        if apart[i] > 2 * radius:
            break
        n = (others[i] - seed) / apart[i]
        level = float(n @ (others[i] + seed) / 2)
        if ((box @ n) > level).any():
            box = clip_half_plane(box, tuple(n), level)
            planes.append((tuple(n), level))
    need = 2 * np.hypot(*(box - seed).T).max()
    for n, level in planes:
        ring = clip_half_plane(ring, n, level)
    return ring, float(need)


def voronoi(seeds: DataFrame, domain: list[tuple[float, float]], tile: float, halo: float) -> DataFrame:
    """face_id, ring, seq, x, y: cells of ``seeds(face_id, x, y)`` within a domain outline (counter-clockwise).

    A tile's task sees the seeds within ``halo`` of it. A cell that a seed farther away might still cut fails the job, with
    the halo that would do; cells of no area are left out.
    """
    ship_package(seeds.sparkSession)
    outline = np.array(domain, float)
    span = lambda c: F.sequence(F.floor((c - halo) / tile), F.floor((c + halo) / tile))
    dealt = seeds.select("face_id", "x", "y", F.floor(F.col("x") / tile).alias("ti"), F.floor(F.col("y") / tile).alias("tj"))
    dealt = dealt.withColumn("i", F.explode(span(F.col("x")))).withColumn("j", F.explode(span(F.col("y")))).withColumn("own", (F.col("i") == F.col("ti")) & (F.col("j") == F.col("tj")))

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy()
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["face_id"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        out = []
        for k in np.flatnonzero(own):
            ring, need = voronoi_cell(xy[k], xy, outline)
            if len(ring) < 3 or abs(ring_area(ring)) <= 1e-8:
                continue
            # Seeds within the halo of the tile are all here; a cell at most that wide is final.
            edge = min(xy[k, 0] - i * tile, (i + 1) * tile - xy[k, 0], xy[k, 1] - j * tile, (j + 1) * tile - xy[k, 1]) + halo
            inside = np.hypot(*(ring - xy[k]).T).max() * 2
            if min(need, inside) > edge:
                raise ValueError(f"the cell of seed {ids[k]} needs a halo of {min(need, inside) - edge + halo:.6g}")
            out += [(ids[k], 0, s, float(x), float(y)) for s, (x, y) in enumerate(ring)]
        return pd.DataFrame(out, columns=["face_id", "ring", "seq", "x", "y"])

    return dealt.groupBy("i", "j").applyInPandas(cells, "face_id long, ring int, seq int, x double, y double")


def strip_cells(stations: DataFrame, cross: float, least_width: float) -> DataFrame:
    """face_id, reach_id, band, seq0, ring, seq, x, y: quads between neighbouring stations of channels, in bands across.

    ``stations(reach_id, seq, x, y, nx, ny, half)``; a reach's number of bands follows its median width.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("reach_id").orderBy("seq")
    bands = stations.groupBy("reach_id").agg(F.greatest(F.lit(1), F.bround(F.greatest(2 * F.percentile("half", 0.5), F.lit(float(least_width))) / cross).cast("int")).alias("bands"))
    rows = stations.join(bands, "reach_id").withColumns({f"{c}1": F.lead(c).over(order) for c in ("x", "y", "nx", "ny", "half")}).where("x1 is not null").withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    at = lambda s, k: (F.col(f"x{s}") + (-1 + 2.0 * k / F.col("bands")) * F.col(f"half{s}") * F.col(f"nx{s}"), F.col(f"y{s}") + (-1 + 2.0 * k / F.col("bands")) * F.col(f"half{s}") * F.col(f"ny{s}"))
    corners = [at("", F.col("band") + 1), at("", F.col("band")), at("1", F.col("band")), at("1", F.col("band") + 1)]
    ring = F.array(*[F.struct(F.lit(i).alias("seq"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(corners)])
    return rows.select(F.xxhash64("reach_id", "seq", "band").alias("face_id"), "reach_id", "band", F.col("seq").alias("seq0"), F.lit(0).alias("ring"), F.explode(ring).alias("c")).select("face_id", "reach_id", "band", "seq0", "ring", "c.*")


def stitched(edges: DataFrame) -> DataFrame:
    """face_id, ring, seq, x, y from directed outline edges(face_id, ax, ay, bx, by); the ring of largest area is the outline."""
    ship_package(edges.sparkSession)
    edge = F.struct("ax", "ay", "bx", "by")
    faces = edges.groupBy("face_id").agg(F.sort_array(F.collect_list(edge)).alias("e"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = lambda x, y: (round(x / 1e-4), round(y / 1e-4))
        for pdf in batches:
            out = []
            for face, parts in zip(pdf["face_id"], pdf["e"], strict=True):
                begin: dict[tuple, list] = {}
                for p in parts:
                    begin.setdefault(key(p["ax"], p["ay"]), []).append(p)
                rings = []
                while begin:
                    start = next(iter(begin))
                    at, ring = start, []
                    while at in begin:
                        p = begin[at].pop()
                        if not begin[at]:
                            del begin[at]
                        ring.append((p["ax"], p["ay"]))
                        at = key(p["bx"], p["by"])
                        if at == start:
                            break
                    if len(ring) > 2:
                        rings.append(np.array(ring, float))
                rings.sort(key=lambda r: -abs(ring_area(r)))
                out += [(face, n, s, float(x), float(y)) for n, r in enumerate(rings) for s, (x, y) in enumerate(r)]
            yield pd.DataFrame(out, columns=["face_id", "ring", "seq", "x", "y"])

    return faces.mapInPandas(run, "face_id long, ring int, seq int, x double, y double")
