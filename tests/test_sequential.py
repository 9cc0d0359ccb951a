"""Queries without SQL against one pass in order over their own input on the smallest tables."""

import heapq
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import subgrid
from fluvia.plans import catalog
from fluvia.plans.bridge import order_cells, read
from fluvia.plans.source_queries import _points

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows_of(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def test_thinned_points(spark):
    points, _ = _points(spark, DATA)
    kept = []
    for r in sorted(points.collect(), key=lambda r: r["id"]):
        if all(math.hypot(r["x"] - x, r["y"] - y) >= 12.0 for _, x, y in kept):
            kept.append((r["id"], r["x"], r["y"]))
    assert sorted(r["seq"] for r in rows_of(spark, "thinned_points")) == sorted(k for k, *_ in kept)


def test_curve_numbers_filled(spark):
    """The filled value is one of the nearest cells' values; which of equally near ones is free."""
    cells = order_cells(spark, DATA).collect()
    given = [(r["row"], r["col"], r["cn"]) for r in cells if r["cell_id"] % 5]
    got = {r["cell_id"]: r["cn"] for r in rows_of(spark, "curve_numbers_filled")}
    assert set(got) == {r["cell_id"] for r in cells}
    for r in cells:
        if r["col"] <= 2:
            assert got[r["cell_id"]] is None
        elif r["cell_id"] % 5:
            assert got[r["cell_id"]] == r["cn"]
        else:
            least = min((y - r["row"]) ** 2 + (x - r["col"]) ** 2 for y, x, _ in given)
            assert got[r["cell_id"]] in {v for y, x, v in given if (y - r["row"]) ** 2 + (x - r["col"]) ** 2 == least}


def test_graded_size_field(spark):
    size = {(r["row"], r["col"]): 10.0 if r["status"] == "P" else 200.0 for r in order_cells(spark, DATA).collect()}
    heap = [(v, k) for k, v in size.items()]
    heapq.heapify(heap)
    while heap:
        v, (r, c) = heapq.heappop(heap)
        if v > size[r, c]:
            continue
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                k = r + dr, c + dc
                if k in size and (dr, dc) in _steps() and size[k] > v * 1.2:
                    size[k] = v * 1.2
                    heapq.heappush(heap, (v * 1.2, k))
    got = {(r["row"], r["col"]): r["target_m"] for r in rows_of(spark, "graded_size_field")}
    assert got == pytest.approx(size, abs=2e-6)


def _steps():
    from fluvia.operators.fixpoint import D4

    return {tuple(s) for s in D4.values()}


def test_face_conveyance_of_every_order(spark):
    lines = {}
    for r in read(spark, DATA, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q")).collect():
        own = lines.setdefault(r["l_orderkey"], {})
        own[r["l_linenumber"]] = min(own.get(r["l_linenumber"], math.inf), r["q"] / 10)
    got = rows_of(spark, "face_conveyance")
    names = [c for c in got[0].asDict() if "conveyance" in c]
    assert len(got) == len(lines) and len(names) == 1
    for r in got:
        own = lines[r["face"]]
        station = np.array(sorted(own), float)
        bed = np.array([own[int(k)] for k in station])
        low, across = (bed[1:] + bed[:-1]) / 2 - bed.min(), np.diff(station)
        area = np.maximum(2.0 - low, 0) * across
        exact = float((area / 0.035 * (area / np.hypot(across, np.diff(bed))) ** (2 / 3)).sum()) if len(bed) > 1 else 0.0
        assert r[names[0]] == pytest.approx(exact, rel=2 * subgrid.CONVEYANCE_TOLERANCE, abs=1e-5)
