import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import mesh, overlay, planar
from tests.test_mesh import box, squares

LINES = "line_id long, seq int, x double, y double"


def areas(df, *by):
    """Area by part, holes negative, from the rows alone."""
    rings = {}
    for r in df.collect():
        rings.setdefault((*[r[c] for c in by], r["ring"]), []).append((r["seq"], r["x"], r["y"]))
    out = {}
    for key, points in rings.items():
        p = [(x, y) for _, x, y in sorted(points)]
        size = abs(sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True))) / 2
        out[key[:-1]] = out.get(key[:-1], 0.0) + (size if key[-1] == 0 else -size)
    return out


def polygon(rng):
    cx, cy, n = rng.uniform(0, 8), rng.uniform(0, 8), rng.randint(3, 12)
    return planar.oriented([planar.on_grid([(cx + rng.uniform(1, 6) * math.cos(a), cy + rng.uniform(1, 6) * math.sin(a)) for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))])])


def test_kernel_against_points():
    """Of random polygons every result holds the points that its rule says, and areas add up."""
    rng = random.Random(3)
    for _ in range(40):
        a, b = polygon(rng), polygon(rng)
        size = lambda *x: sum(planar.area(p) for p in planar.combined(*x))
        both, one, other = size(a, b, "intersection"), size(a, [], "union"), size(b, [], "union")
        assert size(a, b, "union") == pytest.approx(one + other - both, abs=1e-2)
        assert size(a, b, "difference") == pytest.approx(one - both, abs=1e-2)
        found = {how: planar.combined(a, b, how) for how in planar.RULES}
        for _ in range(30):
            x, y = rng.uniform(-5, 13) * planar.STEPS, rng.uniform(-5, 13) * planar.STEPS
            in_a, in_b = planar.holds(a, x, y), planar.holds(b, x, y)
            want = {"union": in_a or in_b, "intersection": in_a and in_b, "difference": in_a and not in_b}
            assert {how: any(planar.holds(p, x, y) for p in parts) for how, parts in found.items()} == want


def test_difference_and_intersection_over_tiles(spark):
    cells = squares(spark, *[box(10 * i, 10 * j, 10 * i + 10, 10 * j + 10) for i in range(4) for j in range(4)])
    wide = squares(spark, [(-5, -5), (33, 7), (21, 38)], [(2, 2), (2, 6), (6, 6), (6, 2)])
    whole = sum(planar.area(p) for p in planar.combined([r for s in ([(-5, -5), (33, 7), (21, 38)], box(2, 2, 6, 6)) for r in planar.oriented([planar.on_grid(s)])], [planar.on_grid(box(0, 0, 40, 40))], "intersection"))
    for size in (3.0, 20.0, 1000.0):
        inside = areas(overlay.overlaid(cells, wide, "intersection", size=size), "face_id", "part")
        rest = areas(overlay.overlaid(cells, wide, "difference", size=size), "face_id", "part")
        assert sum(inside.values()) == pytest.approx(whole, abs=1e-2)
        assert sum(rest.values()) == pytest.approx(1600 - whole, abs=1e-2)
        assert areas(overlay.dissolved(wide, size), "i", "j", "part") and sum(areas(overlay.dissolved(cells, size), "i", "j", "part").values()) == pytest.approx(1600)
    none = wide.limit(0)
    assert areas(overlay.overlaid(cells, none, "difference"), "face_id", "part") == {(i, 0): 100.0 for i in range(16)}
    assert overlay.overlaid(cells, none, "intersection").count() == overlay.overlaid(none, cells, "difference").count() == 0
    assert set(areas(overlay.overlaid(cells, squares(spark, box(0, 0, 9, 10)), "difference", least_area=20.0), "face_id")) == {(i,) for i in range(1, 16)}
    assert overlay.overlaid(cells, cells.unionByName(cells.withColumn("face_id", F.col("face_id") + 100)), "difference").count() == 0


def test_feature_outline_cuts_cells(spark):
    cells = squares(spark, box(0, 0, 10, 10), box(10, 0, 20, 10), box(20, 0, 30, 10))
    got = overlay.clipped_to_feature(cells, squares(spark, box(5, -1, 19.9, 11)), 5.0)
    assert areas(got, "face_id", "inside") == {(0, True): 50.0, (0, False): 50.0, (1, True): 100.0, (2, False): 100.0}


def test_strip_in_background_is_a_partition(spark):
    strip = squares(spark, box(4, 4, 5, 6), box(5, 4, 12, 6)).withColumn("face_id", F.col("face_id") + 50)
    cells = squares(spark, box(0, 0, 10, 10), box(10, 0, 20, 10))
    got = overlay.substituted(cells, strip)
    found = areas(got, "face_id")
    assert sum(found.values()) == pytest.approx(200) and found[(50,)] == 2 and found[(51,)] == 14
    assert got.where("ring > 0").count() == 0
    holed = squares(spark, box(0, 0, 10, 10)).unionByName(squares(spark, box(4, 4, 6, 6)).withColumn("ring", F.lit(1))).unionByName(squares(spark, box(1, 1, 2, 2)).withColumn("ring", F.lit(2)))
    simple = overlay.hole_free(holed)
    assert simple.where("ring > 0").count() == 0 and sum(areas(simple, "part").values()) == pytest.approx(95)


def test_self_touching_and_crescent_cells(spark):
    spur = [(0, 0), (10, 0), (10, 5), (15, 5), (10, 5), (10, 10), (0, 10)]
    pinched = [(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10)]
    crescent = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 9), (9, 9), (9, 1), (0, 1)]
    df = squares(spark, spur, pinched, crescent)
    clean = overlay.untangled(df)
    assert areas(clean, "face_id", "part") == {(0, 0): 100.0, (1, 0): 25.0, (1, 1): 25.0, (2, 0): 28.0}
    assert clean.where("face_id = 0 and x > 10").count() == 0
    parts = overlay.centred(df.where("face_id = 2"))
    centres = mesh.faces(overlay.as_cells(parts))
    assert sum(areas(parts, "part").values()) == pytest.approx(28) and centres.count() > 1
    assert areas(overlay.centred(squares(spark, box(0, 0, 1, 1))), "part") == {(0,): 1.0}


def test_lines_cut_cells(spark):
    cells = squares(spark, box(0, 0, 10, 10), box(10, 0, 20, 10))
    lines = spark.createDataFrame([(1, 0, -1.0, 4.0), (1, 1, 15.0, 4.0), (2, 0, 9.5, -1.0), (2, 1, 9.5, 11.0)], LINES)
    # The first line ends inside the second cell and the second leaves slivers: neither cuts there.
    cut = areas(overlay.split_by_lines(cells, lines, 8.0), "face_id", "part")
    assert sorted(v for (face, _), v in cut.items() if face == 0) == pytest.approx([40, 60]) and cut[(1, 0)] == 100
    assert len(areas(overlay.split_by_lines(cells, lines, 0.0), "face_id", "part")) == 5
    assert areas(overlay.split_by_lines(cells, lines.limit(0), 0.0), "face_id", "part") == {(0, 0): 100.0, (1, 0): 100.0}


def test_lines_outside_water(spark):
    lines = spark.createDataFrame([(1, 0, -5.0, 5.0), (1, 1, 25.0, 5.0), (1, 2, 25.0, 8.0), (2, 0, 3.0, 3.0), (2, 1, 4.0, 4.0), (3, 0, -1.0, 9.0), (3, 1, 5.0, 9.0)], LINES)
    water = squares(spark, box(0, 0, 10, 10), box(10, 0, 20, 10))
    for size in (2.5, None):
        got = [tuple(r) for r in overlay.lines_outside(lines, water, 2.0, size).orderBy("line_id", "seq").collect()]
        assert got == [(1, 1, 0, -5.0, 5.0, 0.0, 5.0), (1, 2, 1, 20.0, 5.0, 25.0, 5.0), (1, 2, 2, 25.0, 5.0, 25.0, 8.0)]


def test_voids_of_a_partition(spark):
    cells = squares(spark, box(0, 0, 10, 10), [(10, 0), (20, 0), (20, 10), (10, 10), (11, 5)])
    found = areas(overlay.voids(cells, squares(spark, box(0, 0, 20, 10)), 50.0), "i", "j", "part")
    assert found == {(0, 0, 0): 5.0}
    assert sum(areas(overlay.voids(cells, squares(spark, box(0, 0, 20, 10)), 4.0), "i", "j", "part").values()) == pytest.approx(5, abs=1e-2)


def test_pairs_go_round_protected_cells(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (1, 3, 4.0)], "owner long, neighbor long, length_m double")
    groups = spark.createDataFrame([(0, "river"), (1, "land"), (2, "land"), (3, "land")], "face_id long, group string")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "face_id long, into long")
    assert [tuple(r) for r in mesh.rerouted_pairs(edges, pairs, groups, "river").collect()] == [(1, 2)]


def test_vertices_without_coordinates_are_left_out(spark):
    schema = "face_id long, ring int, seq int, x double, y double"
    bad = spark.createDataFrame([(0, 0, 9, None, 1.0), (0, 0, 8, float("nan"), 1.0), (None, 0, 0, 1.0, 1.0), (7, 0, 0, float("inf"), 0.0)], schema)
    cells = squares(spark, box(0, 0, 10, 10)).unionByName(bad)
    assert areas(overlay.overlaid(cells, squares(spark, box(5, 0, 10, 10)).unionByName(bad), "difference"), "face_id", "part") == {(0, 0): 50.0}


@pytest.mark.parametrize("how", ["difference", "intersection", "union"])
def test_arrangements_side_by_side_equal_single_ones(how):
    """Random polygons, squares that touch, and a holed square, a few hundred at once and each alone."""
    rng = np.random.default_rng(5)

    def canonical(parts):
        turn = lambda r: r[r.index(min(r)) :] + r[: r.index(min(r))]
        rings = [[turn([tuple(map(int, p)) for p in r]) for r in part] for part in parts]
        return sorted((r[0], sorted(r[1:])) for r in rings)

    def box(x0, y0, x1, y1):
        return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])

    def some_box():
        x, y = rng.integers(0, 6, 2)
        return box(x, y, x + rng.integers(1, 5), y + rng.integers(1, 5))

    groups, edges, weights, want = [], [], [], {}
    for k in range(300):
        base = rng.integers(-(10**9), 10**9, 2)
        left = [[rng.integers(0, 10 ** rng.integers(1, 6), (5, 2))], [some_box()], [box(0, 0, 8, 8), box(2, 2, 5, 5)[::-1]]][k % 3]
        right = [some_box() if k % 3 else rng.integers(0, 50_000, (4, 2)) for _ in range(rng.integers(0, 5))]
        left, right = planar.oriented([r + base for r in left]), [x for r in right for x in planar.oriented([r + base])]
        want[k] = canonical(planar.combined(left, right, how))
        (e1, w1), (e2, w2) = planar._edges(left, 0, 2), planar._edges(right, 1, 2)
        groups.append(np.full(len(e1) + len(e2), k)), edges.extend((e1, e2)), weights.extend((w1, w2))
    got = {k: {} for k in want}
    for g, part, ring, at, _ in zip(*planar.combined_many(np.concatenate(groups), np.vstack(edges), np.vstack(weights), how), strict=True):
        got[g].setdefault(part, {}).setdefault(ring, []).append(at)
    assert {k: canonical([[p[r] for r in sorted(p)] for p in parts.values()]) for k, parts in got.items()} == want
