"""Overlay of polygon tables: difference, intersection, dissolving, cutting by features and lines, simple and centred cells.

Polygons are rows ``face_id, ring, seq, x, y`` with ring 0 as the outline and others as holes. One polygon's vertices share a
row of a task. The polygons laid over a table are cut into square tiles first, so a cell meets the tiles' pieces near it and
never a whole feature, however large. Coordinates go to the grid of 0.1 mm on which meshes compare vertices.

Defined cases: vertices without an id or a finite coordinate are left out; polygons of no area give nothing; repeated rings cover
as one; empty tables give empty results; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.session import ship_package
from fluvia.functions.tables import spread
from fluvia.operators import planar
from fluvia.operators.nearest import along_buckets
from fluvia.operators.polygons import clip_half_plane

PARTS = "face_id long, part int, ring int, seq int, x double, y double"
_COLUMNS = ["part", "ring", "seq", "x", "y"]
_NEAR = ["i", "j", "xs", "ys", "x0", "y0", "x1", "y1", "whole"]
_PIECES = "i long, j long, xs array<long>, ys array<long>, x0 long, y0 long, x1 long, y1 long"


def _vertices(polygons: DataFrame) -> DataFrame:
    return polygons.where("face_id is not null and abs(x) < double('Infinity') and abs(y) < double('Infinity')")


def _shapes(polygons: DataFrame) -> DataFrame:
    point = F.struct("ring", "seq", "x", "y")
    return _vertices(polygons).groupBy("face_id").agg(F.sort_array(F.collect_list(point)).alias("p"))


def _rings(points: Iterable[dict]) -> planar.Part:
    rings: dict[int, list] = {}
    for p in points:
        rings.setdefault(p["ring"], []).append((p["x"], p["y"]))
    return planar.oriented([planar.on_grid(rings[n]) for n in sorted(rings)])


def _rows(parts: list[planar.Part], *key) -> list[tuple]:
    return [(*key, n, r, s, x / planar.STEPS, y / planar.STEPS) for n, part in enumerate(parts) for r, ring in enumerate(part) for s, (x, y) in enumerate(ring.tolist())]


def _tiles(ring: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, piece) of a grid ring, halved until a piece lies in one tile: every vertex is looked at once a halving."""
    todo = [(ring.astype(float), *(ring.min(axis=0) // size).tolist(), *((ring.max(axis=0) - 1) // size).tolist())]
    while todo:
        piece, i0, j0, i1, j1 = todo.pop()
        if len(piece) < 3:
            continue
        if i0 >= i1 and j0 >= j1:
            whole = np.rint(piece).astype(np.int64)
            if planar.twice_area(whole):
                yield i0, j0, whole
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1 + 1) // 2
            todo += [(clip_half_plane(piece, (1, 0), m * size), i0, j0, m - 1, j1), (clip_half_plane(piece, (-1, 0), -m * size), m, j0, i1, j1)]
        else:
            m = (j0 + j1 + 1) // 2
            todo += [(clip_half_plane(piece, (0, 1), m * size), i0, j0, i1, m - 1), (clip_half_plane(piece, (0, -1), -m * size), i0, m, i1, j1)]


def pieces(polygons: DataFrame, size: float) -> DataFrame:
    """i, j, xs, ys and bounds in grid steps: oriented rings cut to tiles ``size`` metres wide; equal pieces once."""
    ship_package(polygons.sparkSession)
    step = max(1, round(size * planar.STEPS))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for points in pdf["p"]:
                for ring in _rings(points):
                    for i, j, piece in _tiles(ring, step):
                        out.append((i, j, piece[:, 0].tolist(), piece[:, 1].tolist(), *piece.min(axis=0).tolist(), *piece.max(axis=0).tolist()))
            yield pd.DataFrame(out, columns=["i", "j", "xs", "ys", "x0", "y0", "x1", "y1"])

    return spread(_shapes(polygons), "face_id").mapInPandas(run, _PIECES).distinct()


def _grid_rings(faces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, ring's place in its row, vertices on the grid, their places) of ``array<struct<ring, seq, x, y>>`` of many rows, in order."""
    row = np.repeat(np.arange(len(faces)), np.asarray(pc.fill_null(pc.list_value_length(faces), 0)))
    flat = faces.flatten()
    ring, xy = np.asarray(flat.field("ring")), np.column_stack([np.asarray(flat.field(c)) for c in ("x", "y")])
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (ring[1:] != ring[:-1])
    number = np.cumsum(new) - 1
    of = row[new]
    return row, (number - np.searchsorted(of, row)), np.rint(xy * planar.STEPS).astype(np.int64).reshape(-1, 2), np.flatnonzero(new)


def _turned(place: np.ndarray, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next vertex of each, whether each ring turns the wrong way: outlines clockwise, holes counter-clockwise)."""
    following = np.arange(1, len(at) + 1)
    following[np.append(begins[1:], len(at))[: len(begins)] - 1] = begins
    length = np.diff(np.append(begins, len(at)))
    local = at - np.repeat(at[begins], length, axis=0) if len(at) else at
    after = local[following] if len(at) else local
    # Whole numbers where they fit 64 bits; wide rings are summed one by one.
    twice = np.add.reduceat(local[:, 0] * after[:, 1] - after[:, 0] * local[:, 1], begins) if len(at) else np.zeros(0, np.int64)
    wide = np.flatnonzero(np.maximum.reduceat(np.abs(local).max(axis=1), begins) > planar.MOST_BESIDE) if len(at) else []
    for n in wide:
        twice[n] = np.sign(planar.twice_area(at[begins[n] : begins[n] + length[n]]))
    return following, np.where((twice < 0) == (place[begins] == 0), True, False) if len(at) else np.zeros(0, bool)


def near_pieces(polygons: DataFrame, size: float) -> DataFrame:
    """``pieces`` with ``whole``: a ring that meets at most two tiles each way comes whole, once for each tile; only wider ones are cut."""
    ship_package(polygons.sparkSession)
    step = max(1, round(size * planar.STEPS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, place, at, begins = _grid_rings(batch.column("p"))
            if not len(at):
                continue
            _, wrong = _turned(place, at, begins)
            length = np.diff(np.append(begins, len(at)))
            lo, hi = np.minimum.reduceat(at, begins), np.maximum.reduceat(at, begins)
            first, last = lo // step, (hi - 1) // step
            small = ((last - first) <= 1).all(axis=1)
            ring = np.repeat(np.arange(len(begins)), 4)
            tile = first[ring] + np.tile([[0, 0], [0, 1], [1, 0], [1, 1]], (len(begins), 1))
            held = small[ring] & (tile <= last[ring]).all(axis=1)
            ring, tile = ring[held], tile[held]
            m = length[ring]
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            of = np.repeat(ring, m)
            vertex = at[begins[of] + np.where(wrong[of], length[of] - 1 - nth, nth)]
            bounds = pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(vertex[:, k]))) for k in (0, 1)]
            columns = [*(pa.array(np.ascontiguousarray(tile[:, k])) for k in (0, 1)), *lists, *(pa.array(np.ascontiguousarray(b[ring][:, k])) for b in (lo, hi) for k in (0, 1)), pa.array(np.ones(len(ring), bool))]
            yield pa.RecordBatch.from_arrays(columns, _NEAR)
            out = []
            for n in np.flatnonzero(~small):
                shape = at[begins[n] : begins[n] + length[n]]
                for i, j, piece in _tiles(shape[::-1] if wrong[n] else shape, step):
                    out.append((i, j, piece[:, 0].tolist(), piece[:, 1].tolist(), *piece.min(axis=0).tolist(), *piece.max(axis=0).tolist(), False))
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_NEAR), preserve_index=False)

    return spread(_vertices(polygons), "face_id").groupBy("face_id").agg(F.sort_array(F.collect_list(F.struct("ring", "seq", "x", "y"))).alias("p")).mapInArrow(run, _PIECES + ", whole boolean").distinct()


def typical_extent(polygons: DataFrame) -> float:
    """Mean of the larger side of the polygons' bounds, from one aggregation; 1 for an empty table."""
    sides = _vertices(polygons).groupBy("face_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("d"))
    return sides.agg(F.avg("d").alias("d")).first()["d"] or 1.0


def _met(polygons: DataFrame, over: DataFrame, size: float) -> DataFrame:
    """face_id, p and m: the pieces of ``over`` whose bounds meet the polygon's, null where none does."""
    step = max(1, round(size * planar.STEPS))
    low, high = (lambda c, f=f: F.round(f(c) * planar.STEPS).cast("long") for f in (F.min, F.max))
    tile = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step)))
    bounds = _vertices(polygons).groupBy("face_id").agg(low("x").alias("bx0"), low("y").alias("by0"), high("x").alias("bx1"), high("y").alias("by1"))
    dealt = bounds.withColumn("i", tile("bx0", "bx1")).withColumn("j", tile("by0", "by1"))
    near = dealt.join(near_pieces(over, size), ["i", "j"]).where("x0 <= bx1 and bx0 <= x1 and y0 <= by1 and by0 <= y1")
    # A whole ring meets a polygon in the tile of the lower left corner that both bounds share, and in no other.
    near = near.where((~F.col("whole")) | ((F.floor(F.greatest("x0", "bx0") / step) == F.col("i")) & (F.floor(F.greatest("y0", "by0") / step) == F.col("j"))))
    return _shapes(polygons).join(near.groupBy("face_id").agg(F.collect_list(F.struct("xs", "ys")).alias("m")), "face_id", "left")


def _mapped(rows: DataFrame, f: Callable[[planar.Part, list[np.ndarray]], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    ship_package(rows.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            met = pdf["m"] if "m" in pdf else [None] * len(pdf)
            for face, points, over in zip(pdf["face_id"], pdf["p"], met, strict=True):
                rings = [] if over is None else [np.stack([o["xs"], o["ys"]], axis=1).astype(np.int64) for o in over]
                out += [(face, *row) for row in f(_rings(points), rings)]
            yield pd.DataFrame(out, columns=["face_id", *columns])

    return spread(rows, "face_id").mapInPandas(run, schema)


def _each(polygons: DataFrame, f: Callable[[planar.Part], list[planar.Part]]) -> DataFrame:
    return _mapped(_shapes(polygons), lambda part, _: _rows(f(part)) if part else [], _COLUMNS, PARTS)


def overlaid(polygons: DataFrame, over: DataFrame, how: str, least_area: float = 0.0, size: float | None = None) -> DataFrame:
    """face_id, part, ring, seq, x, y: each polygon's ``intersection`` with or ``difference`` from all of ``over``.

    Parts smaller than ``least_area`` go. Tiles are ``size`` wide, or twice the polygons' typical extent.
    """
    if how not in ("intersection", "difference"):
        raise ValueError(f"no overlay named {how}")

    least = least_area * 2 * planar.STEPS**2
    alone = lambda part, rings: _rows([p for p in planar.combined(part, rings, how) if planar.area(p) >= least_area])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            face = np.asarray(batch.column("face_id").cast(pa.int64()))
            row, place, at, begins = _grid_rings(batch.column("p"))
            if not len(row):
                continue
            met = batch.column("m")
            count = np.asarray(pc.fill_null(pc.list_value_length(met), 0))
            over = met.flatten()
            xs, ys = over.field("xs"), over.field("ys")
            length = np.asarray(pc.list_value_length(xs)).astype(np.int64) if len(over) else np.zeros(0, np.int64)
            vertex = np.column_stack([np.asarray(xs.flatten()), np.asarray(ys.flatten())]).astype(np.int64) if len(over) else np.zeros((0, 2), np.int64)
            first = np.cumsum(length) - length
            owner = np.repeat(np.repeat(np.arange(len(face)), count), length)
            after = np.arange(1, len(vertex) + 1)
            after[first + length - 1] = first
            following, wrong = _turned(place, at, begins)
            sign = np.repeat(np.where(wrong, -1, 1), np.diff(np.append(begins, len(at))))
            g = np.concatenate([row, owner])
            e = np.vstack([np.hstack([at, at[following]]), np.hstack([vertex, vertex[after]])])
            w = np.zeros((len(e), 2), np.int64)
            w[: len(row), 0], w[len(row) :, 1] = sign, 1
            order = np.argsort(g, kind="stable")
            starts = np.flatnonzero(np.diff(g[order], prepend=-1))
            extent = np.maximum.reduceat(e[order].reshape(-1, 2, 2).max(axis=1), starts) - np.minimum.reduceat(e[order].reshape(-1, 2, 2).min(axis=1), starts)
            wide = g[order][starts][(extent > planar.MOST_BESIDE).any(axis=1)]
            beside = ~np.isin(g, wide)
            of, part, ring, xy, twice = planar.combined_many(g[beside], e[beside], w[beside], how)
            kept = twice >= least
            of, part, ring, xy = of[kept], part[kept], ring[kept], xy[kept]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
            turn = np.ones(len(of), bool)
            turn[1:] = new[1:] | (ring[1:] != ring[:-1])
            places = np.arange(len(of))
            seq = places - places[turn][np.cumsum(turn) - 1]
            # Parts are numbered again after small ones went.
            number = np.cumsum(new) - 1
            part = number - number[np.searchsorted(of, of)]
            columns = [face[of], part.astype(np.int32), ring.astype(np.int32), seq.astype(np.int32), xy[:, 0] / planar.STEPS, xy[:, 1] / planar.STEPS]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["face_id", *_COLUMNS])
            out = []
            for n in wide:
                rings = [vertex[first[k] : first[k] + length[k]] for k in range(count[:n].sum(), count[: n + 1].sum())]
                out += [(int(face[n]), *r) for r in alone(_rings(batch.column("p")[int(n)].as_py()), rings)]
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["face_id", *_COLUMNS]).astype({"part": "int32", "ring": "int32", "seq": "int32"}), preserve_index=False)

    rows = _met(polygons, over, size or 2 * typical_extent(polygons)).select(F.col("face_id").cast("long").alias("face_id"), "p", "m")
    ship_package(polygons.sparkSession)
    return spread(rows, "face_id").mapInArrow(run, PARTS)


def clipped_to_feature(cells: DataFrame, feature: DataFrame, least_area: float, size: float | None = None) -> DataFrame:
    """face_id, part, inside, ring, seq, x, y: cells cut along the outline of ``feature`` where no piece is below ``least_area``.

    Another cell stays whole; it is inside if at least half of it is.
    """

    def run(part: planar.Part, rings: list[np.ndarray]) -> list[tuple]:
        if not part:
            return []
        found = [(True, p) for p in planar.combined(part, rings, "intersection")] if rings else []
        found += [(False, p) for p in planar.combined(part, rings, "difference")]
        sizes = [planar.area(p) for _, p in found]
        if len(found) < 2 or min(sizes) < least_area:
            within = sum(s for s, (inside, _) in zip(sizes, found, strict=True) if inside)
            found = [(bool(found) and 2 * within >= sum(sizes), part)]
        return [(n, inside, *row[1:]) for n, (inside, p) in enumerate(found) for row in _rows([p])]

    schema = "face_id long, part int, inside boolean, ring int, seq int, x double, y double"
    return _mapped(_met(cells, feature, size or 2 * typical_extent(cells)), run, ["part", "inside", "ring", "seq", "x", "y"], schema)


def dissolved(polygons: DataFrame, size: float) -> DataFrame:
    """i, j, part, ring, seq, x, y: the union as disjoint parts by tile, so no union, however large, is one task's.

    The pieces that overlap one tile share a task; equal ones come once.
    """
    ship_package(polygons.sparkSession)
    tiles = pieces(polygons, size).groupBy("i", "j").agg(F.collect_list(F.struct("xs", "ys")).alias("m"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, j, met in zip(pdf["i"], pdf["j"], pdf["m"], strict=True):
                rings = [np.stack([o["xs"], o["ys"]], axis=1).astype(np.int64) for o in met]
                out += _rows(planar.combined(rings, [], "union"), i, j)
            yield pd.DataFrame(out, columns=["i", "j", *_COLUMNS])

    return tiles.mapInPandas(run, "i long, j long, part int, ring int, seq int, x double, y double")


def as_cells(parts: DataFrame) -> DataFrame:
    """face_id, ring, seq, x, y: first parts keep their polygon's id, further ones get an id of their own by a hash."""
    own = F.when(F.col("part") == 0, F.col("face_id")).otherwise(F.xxhash64("face_id", "part"))
    return parts.select(own.alias("face_id"), "ring", "seq", "x", "y")


def substituted(background: DataFrame, strip: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Background cells with the strip's cells cut out, as simply connected cells, and the strip's cells as they are."""
    rest = hole_free(as_cells(overlaid(background, strip, "difference", least_area)))
    return as_cells(rest).unionByName(strip.select("face_id", "ring", "seq", "x", "y"))


def hole_free(polygons: DataFrame) -> DataFrame:
    """Polygons with holes as simply connected parts by straight cuts through the holes."""
    return _each(polygons, planar.hole_free)


def centred(polygons: DataFrame, most_cuts: int = 4) -> DataFrame:
    """Polygons whose centroid lies outside them, cut straight through it, ``most_cuts`` times at most."""
    return _each(polygons, lambda part: planar.centred(part, most_cuts))


def untangled(polygons: DataFrame) -> DataFrame:
    """Polygons without spurs that go out and back, and in parts where an outline touches or crosses itself."""
    return _each(polygons, lambda part: planar.combined(part, [], "union"))


def segments_of(lines: DataFrame) -> DataFrame:
    """line_id, seq, ax, ay, bx, by of polylines(line_id, seq, x, y)."""
    order = Window.partitionBy("line_id").orderBy("seq")
    ends = lines.select("line_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by"))
    return ends.where("bx is not null and (ax <> bx or ay <> by)")


def split_by_lines(cells: DataFrame, lines: DataFrame, least_area: float, size: float | None = None) -> DataFrame:
    """Cells cut along polylines(line_id, seq, x, y), in order of their ids; a cut that leaves a piece below ``least_area`` is not made."""
    size = size or 2 * typical_extent(cells)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    bounds = _vertices(cells).groupBy("face_id").agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))])
    dealt = bounds.withColumn("i", span("x0", "x1")).withColumn("j", span("y0", "y1"))
    near = dealt.join(along_buckets(segments_of(lines), size), ["i", "j"])
    near = near.where((F.least("ax", "bx") <= F.col("x1")) & (F.greatest("ax", "bx") >= F.col("x0")) & (F.least("ay", "by") <= F.col("y1")) & (F.greatest("ay", "by") >= F.col("y0")))
    met = near.groupBy("face_id").agg(F.sort_array(F.collect_set(F.struct("line_id", "seq", "ax", "ay", "bx", "by"))).alias("s"))
    rows = spread(_shapes(cells).join(met, "face_id", "left"), "face_id")
    ship_package(cells.sparkSession)

    def cuts(part: planar.Part, segments: list[dict]) -> list[planar.Part]:
        ways: list[tuple] = []
        for s in segments:
            if ways and ways[-1][0] == s["line_id"] and ways[-1][1][-1] == (s["ax"], s["ay"]):
                ways[-1][1].append((s["bx"], s["by"]))
            else:
                ways.append((s["line_id"], [(s["ax"], s["ay"]), (s["bx"], s["by"])]))
        found = [part]
        for _, way in ways:
            tried = [(now, planar.split(now, planar.on_grid(way))) for now in found]
            found = [p for now, parts in tried for p in (parts if len(parts) > 1 and min(map(planar.area, parts)) >= least_area else [now])]
        return found

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for face, points, segments in zip(pdf["face_id"], pdf["p"], pdf["s"], strict=True):
                part = _rings(points)
                if part:
                    out += _rows([part] if segments is None else cuts(part, list(segments)), face)
            yield pd.DataFrame(out, columns=["face_id", *_COLUMNS])

    return rows.mapInPandas(run, PARTS)


def lines_outside(lines: DataFrame, blockers: DataFrame, least_length: float = 0.0, size: float | None = None) -> DataFrame:
    """line_id, run, seq, ax, ay, bx, by: what is left of polylines outside ``blockers``, in runs of ``least_length`` or more.

    A segment meets the blockers' pieces near it, so neither a long line nor a large blocker is one task's.
    """
    parts = segments_of(lines)
    size = size or 2 * (parts.agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("d")).first()["d"] or 1.0)
    near = along_buckets(parts, max(1, round(size * planar.STEPS)) / planar.STEPS).join(pieces(blockers, size), ["i", "j"]).groupBy("line_id", "seq").agg(F.collect_list(F.struct("xs", "ys")).alias("m"))
    rows = spread(parts.join(near, ["line_id", "seq"], "left"), "line_id", "seq")
    ship_package(lines.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for line, seq, ax, ay, bx, by, met in zip(*(pdf[c] for c in ("line_id", "seq", "ax", "ay", "bx", "by", "m")), strict=True):
                rings = [] if met is None else [np.stack([o["xs"], o["ys"]], axis=1).astype(np.int64) for o in met]
                n = 0
                for way in planar.outside(planar.on_grid([(ax, ay), (bx, by)]), rings):
                    for p, q in zip(way[:-1].tolist(), way[1:].tolist(), strict=True):
                        out.append((line, seq, n, *(v / planar.STEPS for v in (*p, *q))))
                        n += 1
            yield pd.DataFrame(out, columns=["line_id", "seq", "n", "ax", "ay", "bx", "by"])

    left = rows.mapInPandas(run, "line_id long, seq int, n int, ax double, ay double, bx double, by double")
    order = Window.partitionBy("line_id").orderBy("seq", "n")
    starts = F.coalesce((F.lag("bx").over(order) != F.col("ax")) | (F.lag("by").over(order) != F.col("ay")), F.lit(True))
    runs = left.withColumn("_new", starts.cast("int")).withColumn("run", F.sum("_new").over(order))
    length = F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).over(Window.partitionBy("line_id", "run"))
    return runs.withColumn("_length", length).where(F.col("_length") >= least_length).withColumn("seq", F.row_number().over(order) - 1).select("line_id", "run", "seq", "ax", "ay", "bx", "by")


def voids(polygons: DataFrame, domain: DataFrame, size: float, least_area: float = 0.0) -> DataFrame:
    """i, j, part, ring, seq, x, y: what of the ``domain`` polygons no polygon covers, by tile."""
    ship_package(polygons.sparkSession)
    dealt = pieces(domain, size).withColumn("side", F.lit(0)).unionByName(pieces(polygons, size).withColumn("side", F.lit(1)))
    gathered = dealt.groupBy("i", "j").agg(*[F.collect_list(F.when(F.col("side") == s, F.struct("xs", "ys"))).alias(n) for s, n in ((0, "d"), (1, "m"))]).where(F.size("d") > 0)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, j, whole, met in zip(pdf["i"], pdf["j"], pdf["d"], pdf["m"], strict=True):
                sets = [[np.stack([o["xs"], o["ys"]], axis=1).astype(np.int64) for o in s] for s in (whole, met)]
                out += _rows([p for p in planar.combined(*sets, "difference") if planar.area(p) > least_area], i, j)
            yield pd.DataFrame(out, columns=["i", "j", *_COLUMNS])

    return gathered.mapInPandas(run, "i long, j long, part int, ring int, seq int, x double, y double")
