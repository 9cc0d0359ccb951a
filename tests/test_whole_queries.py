"""Queries over all cells against loops over every cell of a small table."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fluvia.plans import catalog

N, COLS = 300, 17


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    key = list(range(N))
    kinds = {"o_totalprice": [1000.0 + 37 * k % 911 for k in key], "o_custkey": [7 * k % 83 for k in key], "o_orderpriority": ["1-URGENT"] * N, "o_orderstatus": ["F"] * N}
    pq.write_table(pa.table({"o_orderkey": key} | kinds), folder / "orders.parquet")
    z = {divmod(k, COLS): 20.0 * (k // COLS) + kinds["o_totalprice"][k] / 10000.0 + k * 1e-9 for k in key}
    return str(folder), z


def test_every_square_is_overlapped(spark, orders):
    folder, z = orders
    rows = max(r for r, _ in z) + 1
    want = {}
    for r, c in z:
        for b, a in ((0, 0), (0, 1), (1, 0), (1, 1)):
            if r + b < rows and c + a < COLS:
                want[r * COLS + c, (rows - 1 - r - b) * COLS + c + a] = (10 if a else 20) * (20 if b else 10)
    found = catalog.QUERIES["polygon_raster_overlap"](spark, folder).collect()
    assert len(found) == len(want) and {(x["mesh_index"], x["raster_index"]): x["area_m2"] for x in found} == want


def test_every_section_is_cut(spark, orders):
    folder, z = orders
    rows = max(r for r, _ in z) + 1
    # The left bank's step for the directions 1 to 4.
    step = {1: (0, -1), 2: (-1, 0), 3: (0, 1), 4: (1, 0)}
    want = set()
    for r, c in z:
        cell = r * COLS + c
        for side, sign in (("left", 1), ("right", -1)):
            for k in (1, 2, 3) if cell % 5 else ():
                to = r + sign * k * step[cell % 5][0], c + sign * k * step[cell % 5][1]
                if 0 <= to[0] < rows and 0 <= to[1] < COLS:
                    want.add((cell, side, k, *to))
    found = [tuple(x) for x in catalog.QUERIES["river_cross_sections"](spark, folder).collect()]
    assert len(found) == len(want) and set(found) == want


def test_every_target_is_sampled(spark, orders):
    folder, z = orders
    want = {}
    for r, c in z:
        # The target lies at (col + 41 / 30 - 1 / 2, row + 22 / 30 - 1 / 2) in cells.
        u, v = c + 26 / 30, r + 7 / 30
        near = [((1 - abs(u - x)) * (1 - abs(v - y)), z[y, x]) for x in (c, c + 1) for y in (r, r + 1) if (y, x) in z]
        want[r * COLS + c] = sum(w * h for w, h in near) / sum(w for w, _ in near) * 2**0.5
    found = {x["cell_id"]: x["z_m"] for x in catalog.QUERIES["bilinear_samples"](spark, folder).collect()}
    assert found == pytest.approx(want, abs=2e-6)
