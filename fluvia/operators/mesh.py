"""Finite-volume meshes as tables: rings, edges, faces, their topology and quality.

``polygons(face_id, ring, seq, x, y)`` holds closed rings without the repeated first vertex; ring 0 is the outline.
Coordinates meet on a grid of 0.1 mm. Every operator is a join or an aggregation by edge or by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 1e-4


def _snap(c: Column, grid: float = GRID) -> Column:
    return F.round(c / grid).cast("long")


def ring_edges(polygons: DataFrame, grid: float = GRID) -> DataFrame:
    """face_id, ring, seq, ax, ay, bx, by in ring order and the snapped end points, without edges of no length."""
    order = Window.partitionBy("face_id", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    rows = polygons.select("face_id", "ring", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by"))
    keyed = rows.withColumns({"ka": F.struct(_snap(F.col("ax"), grid).alias("x"), _snap(F.col("ay"), grid).alias("y")), "kb": F.struct(_snap(F.col("bx"), grid).alias("x"), _snap(F.col("by"), grid).alias("y"))})
    return keyed.where("ka <> kb").withColumns({"k0": F.least("ka", "kb"), "k1": F.greatest("ka", "kb")})


def faces(polygons: DataFrame) -> DataFrame:
    """face_id, area, perimeter, cx, cy (area centroid); holes count negative whatever their winding."""
    edges = ring_edges(polygons)
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    rings = edges.groupBy("face_id", "ring").agg(
        (F.sum(cross) / 2).alias("a"), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("p"),
        (F.sum((F.col("ax") + F.col("bx")) * cross) / 6).alias("mx"), (F.sum((F.col("ay") + F.col("by")) * cross) / 6).alias("my"),
    )
    sign = F.when(F.col("ring") == 0, F.signum("a")).otherwise(-F.signum("a"))
    total = rings.withColumn("s", sign).groupBy("face_id").agg(*[F.sum(F.col("s") * F.col(c)).alias(c) for c in ("a", "mx", "my")], F.sum("p").alias("perimeter"))
    inverse = F.nullif(F.col("a"), F.lit(0.0))
    return total.select("face_id", F.col("a").alias("area"), "perimeter", (F.col("mx") / inverse).alias("cx"), (F.col("my") / inverse).alias("cy"))


def topology(polygons: DataFrame, grid: float = GRID) -> DataFrame:
    """k0, k1, owners (face ids in order), n_owners of every distinct edge."""
    return ring_edges(polygons, grid).groupBy("k0", "k1").agg(F.array_sort(F.collect_list("face_id")).alias("owners")).withColumn("n_owners", F.size("owners"))


def unpaired_edges(polygons: DataFrame, grid: float = GRID) -> DataFrame:
    """Ring edges that belong to one face only."""
    edges = ring_edges(polygons, grid)
    return edges.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("k0", "k1"))).where("_n = 1").drop("_n")


def self_paired_faces(polygons: DataFrame, grid: float = 1e-8) -> DataFrame:
    """face_id of faces that own an edge twice."""
    return ring_edges(polygons, grid).groupBy("k0", "k1", "face_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("face_id").distinct()


def internal_unpaired_edges(polygons: DataFrame, domain: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Unpaired edges whose middle is not within ``tolerance`` of the domain outline ``domain(ax, ay, bx, by)``: an anti join over buckets."""
    from fluvia.operators.nearest import segment_distance

    edges = unpaired_edges(polygons).withColumns({"mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2})
    size = max(50 * tolerance, 1.0)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - tolerance) / size), F.floor((F.greatest(a, b) + tolerance) / size))
    outline = domain.select(*[F.col(c).alias(f"d{c}") for c in ("ax", "ay", "bx", "by")]).withColumn("_i", F.explode(span(F.col("dax"), F.col("dbx")))).withColumn("_j", F.explode(span(F.col("day"), F.col("dby"))))
    placed = edges.withColumns({"_i": F.floor(F.col("mx") / size), "_j": F.floor(F.col("my") / size)})
    near = segment_distance(F.col("mx"), F.col("my"), F.col("dax"), F.col("day"), F.col("dbx"), F.col("dby")) <= tolerance
    return placed.join(outline, (placed["_i"] == outline["_i"]) & (placed["_j"] == outline["_j"]) & near, "left_anti").drop("_i", "_j", "mx", "my")


def mesh_edges(polygons: DataFrame, minimum_length: float = 1e-6) -> DataFrame:
    """owner, neighbor (-1 at the boundary), length_m, mx, my, nx, ny, center_distance_m, segments, deficit_m of the mesh's faces.

    Normals follow the owner's winding and point out of it; all segments that two cells share are one face, whose vector is
    the sum of their length-weighted normals, so closure holds. Boundary segments stay apart. Edges of more than two
    owners or of no length are left out.
    """
    edges = ring_edges(polygons).withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).where(F.col("length") > minimum_length)
    cells = faces(polygons)
    winding = edges.groupBy("face_id", "ring").agg(F.signum(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))).alias("w"))
    outward = F.when(F.col("ring") == 0, F.col("w")).otherwise(-F.col("w"))
    sides = edges.join(winding, ["face_id", "ring"]).withColumns({"vx": outward * (F.col("by") - F.col("ay")), "vy": -outward * (F.col("bx") - F.col("ax"))})
    side = F.struct("face_id", "ring", "seq", "vx", "vy", "length", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"))
    pairs = sides.groupBy("k0", "k1").agg(F.array_sort(F.collect_list(side)).alias("s")).where(F.size("s") <= 2)
    own = pairs.select(F.col("s")[0].alias("o"), F.coalesce(F.get("s", F.lit(1))["face_id"], F.lit(-1)).alias("neighbor")).where("neighbor <> o.face_id")
    flat = own.select(F.col("o.face_id").alias("owner"), "neighbor", F.when(F.col("neighbor") < 0, F.struct("o.ring", "o.seq")).alias("part"), "o.vx", "o.vy", "o.length", "o.mx", "o.my")
    joined = flat.groupBy("owner", "neighbor", "part").agg(
        F.sum("vx").alias("vx"), F.sum("vy").alias("vy"), F.sum("length").alias("total"), (F.sum(F.col("mx") * F.col("length")) / F.sum("length")).alias("mx"),
        (F.sum(F.col("my") * F.col("length")) / F.sum("length")).alias("my"), F.count(F.lit(1)).cast("int").alias("segments"),
    )
    a, b = cells.select(F.col("face_id").alias("owner"), F.col("cx").alias("ox"), F.col("cy").alias("oy")), cells.select(F.col("face_id").alias("neighbor"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    placed = joined.join(a, "owner").join(b, "neighbor", "left")
    length = F.hypot("vx", "vy")
    apart = F.hypot(F.coalesce("px", "mx") - F.col("ox"), F.coalesce("py", "my") - F.col("oy"))
    return placed.select(
        "owner", "neighbor", length.alias("length_m"), "mx", "my", (F.col("vx") / F.nullif(length, F.lit(0.0))).alias("nx"), (F.col("vy") / F.nullif(length, F.lit(0.0))).alias("ny"),
        apart.alias("center_distance_m"), "segments", (F.col("total") - length).alias("deficit_m"),
    )


def cfl_widths(edges: DataFrame) -> DataFrame:
    """face_id, cfl_width_m: the least centre distance over a cell's faces, a boundary one counting twice."""
    apart = F.when(F.col("neighbor") < 0, 2 * F.col("center_distance_m")).otherwise(F.col("center_distance_m"))
    both = edges.select(F.col("owner").alias("face_id"), apart.alias("d")).unionByName(edges.where("neighbor >= 0").select(F.col("neighbor").alias("face_id"), apart.alias("d")))
    return both.groupBy("face_id").agg(F.min("d").alias("cfl_width_m"))


def regular_polygons(cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Quads of grid cells(face_id, row, col), corners counter-clockwise from the south-west."""
    x, y = x0 + F.col("col") * dx, y0 - (F.col("row") + 1) * dy
    corner = lambda i, a, b: F.struct(F.lit(i).alias("seq"), (x + a * dx).alias("x"), (y + b * dy).alias("y"))
    return cells.select("face_id", F.lit(0).alias("ring"), F.explode(F.array(corner(0, 0, 0), corner(1, 1, 0), corner(2, 1, 1), corner(3, 0, 1))).alias("c")).select("face_id", "ring", "c.seq", "c.x", "c.y")


def regular_edges(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """owner, neighbor, length_m, nx, ny, center_distance_m of a regular mesh of cells(face_id, row, col), from one shuffle by grid line."""
    east, south = F.struct(F.lit("v").alias("kind"), "row", (F.col("col") + 1).alias("col")), F.struct(F.lit("h").alias("kind"), (F.col("row") + 1).alias("row"), F.col("col").alias("col"))
    west, north = F.struct(F.lit("v").alias("kind"), "row", F.col("col").alias("col")), F.struct(F.lit("h").alias("kind"), F.col("row").alias("row"), F.col("col").alias("col"))
    # Outward normals of the four sides: fixed values.
    side = lambda line, nx, ny: F.struct(line.alias("line"), F.lit(float(nx)).alias("nx"), F.lit(float(ny)).alias("ny"))
    sides = cells.select("face_id", F.explode(F.array(side(east, 1, 0), side(west, -1, 0), side(south, 0, -1), side(north, 0, 1))).alias("s")).select("face_id", "s.*")
    pairs = sides.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("face_id", "nx", "ny"))).alias("f"))
    upright = F.col("line.kind") == "v"
    return pairs.select(
        F.col("f")[0]["face_id"].alias("owner"), F.coalesce(F.get("f", F.lit(1))["face_id"], F.lit(-1)).alias("neighbor"), F.when(upright, dy).otherwise(dx).alias("length_m"),
        F.col("f")[0]["nx"].alias("nx"), F.col("f")[0]["ny"].alias("ny"), (F.when(upright, dx).otherwise(dy) / F.when(F.size("f") > 1, 1.0).otherwise(2.0)).alias("center_distance_m"),
    )


def edge_quality(edges: DataFrame, minimum_length: float, minimum_distance: float) -> DataFrame:
    """One row: internal faces, the least length and centre distance, and how many fall short of either."""
    short, near = F.col("length_m") < minimum_length, F.col("center_distance_m") < minimum_distance
    return edges.where("neighbor >= 0").agg(
        F.count(F.lit(1)).alias("internal_faces"), F.min("length_m").alias("minimum_face_length_m"), F.min("center_distance_m").alias("minimum_center_distance_m"),
        F.count_if(short).alias("short_faces"), F.count_if(near).alias("near_centers"), F.count_if(short | near).alias("bad_faces"),
    )


def bad_pairs(edges: DataFrame, minimum_length: float, minimum_distance: float) -> DataFrame:
    """owner, neighbor of internal faces that are too short or whose centres are too near."""
    return edges.where((F.col("neighbor") >= 0) & ((F.col("length_m") < minimum_length) | (F.col("center_distance_m") < minimum_distance))).select("owner", "neighbor")


def validation(polygons: DataFrame, edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """check, failures: the mesh contract, cell by cell and face by face."""
    cells = faces(polygons)
    both = edges.select(F.col("owner").alias("face_id"), (F.col("length_m") * F.col("nx")).alias("x"), (F.col("length_m") * F.col("ny")).alias("y")).unionByName(
        edges.where("neighbor >= 0").select(F.col("neighbor").alias("face_id"), (-F.col("length_m") * F.col("nx")).alias("x"), (-F.col("length_m") * F.col("ny")).alias("y"))
    )
    closure = both.groupBy("face_id").agg(F.hypot(F.sum("x"), F.sum("y")).alias("gap")).where(F.col("gap") > tolerance)
    repeated = edges.where("neighbor >= 0").groupBy(F.least("owner", "neighbor"), F.greatest("owner", "neighbor")).count().where("count > 1")
    counted = lambda name, df: df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")
    checks = [
        counted("self_pairs", edges.where("owner = neighbor")), counted("repeated_pairs", repeated), counted("closure", closure),
        counted("areas", cells.where("not area > 0")), counted("lengths", edges.where("not length_m > 0")), counted("distances", edges.where("not center_distance_m > 0")),
        counted("normals", edges.where(F.abs(F.hypot("nx", "ny") - 1) > tolerance)), counted("order", edges.where("neighbor >= 0 and owner > neighbor")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def repair_pairs(edges: DataFrame, bad: DataFrame, groups: DataFrame, same_group: bool = True) -> DataFrame:
    """bad face_id and the neighbour with which it shares the longest boundary, within its group if asked."""
    both = edges.where("neighbor >= 0").select("owner", "neighbor", "length_m")
    both = both.unionByName(both.select(F.col("neighbor").alias("owner"), F.col("owner").alias("neighbor"), "length_m"))
    shared = both.groupBy("owner", "neighbor").agg(F.sum("length_m").alias("shared")).join(bad.select(F.col("face_id").alias("owner")), "owner")
    if same_group:
        shared = shared.join(groups.select(F.col("face_id").alias("owner"), F.col("group").alias("_a")), "owner").join(groups.select(F.col("face_id").alias("neighbor"), F.col("group").alias("_b")), "neighbor").where("_a = _b")
    return shared.groupBy(F.col("owner").alias("face_id")).agg(F.max_by("neighbor", F.struct("shared", -F.col("neighbor"))).alias("into"))


def rerouted_pairs(edges: DataFrame, pairs: DataFrame, groups: DataFrame, protected: str) -> DataFrame:
    """face_id, into for ``pairs(face_id, into)`` across groups: each end outside the protected group, with the neighbour of its own group with which it shares most."""
    names = lambda end, to: groups.select(F.col("face_id").alias(end), F.col("group").alias(to))
    across = pairs.select(F.col("face_id").alias("l"), F.col("into").alias("r")).join(names("l", "gl"), "l").join(names("r", "gr"), "r").where("gl <> gr")
    ends = across.select(F.explode(F.array(F.struct(F.col("l").alias("face_id"), F.col("gl").alias("g")), F.struct(F.col("r").alias("face_id"), F.col("gr").alias("g")))).alias("e")).select("e.*")
    return repair_pairs(edges, ends.where(F.col("g") != protected).select("face_id").distinct(), groups)


def merge_matching(pairs: DataFrame) -> DataFrame:
    """Pairs(face_id, into) of which no cell is in two: those that are first of both ends in order, for one round of merging."""
    a, b = F.least("face_id", "into").alias("a"), F.greatest("face_id", "into").alias("b")
    ends = pairs.select(a, b).distinct()
    first = ends.select(F.col("a").alias("c"), "a", "b").unionByName(ends.select(F.col("b").alias("c"), "a", "b")).groupBy("c").agg(F.min(F.struct("a", "b")).alias("p"))
    return first.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("p.a", "p.b")


def merged_cells(polygons: DataFrame, matching: DataFrame) -> DataFrame:
    """face_id, ax, ay, bx, by: directed outline edges after each pair became one cell with the smaller id; shared edges vanish."""
    name = matching.select(F.col("b").alias("face_id"), F.col("a").alias("new"))
    edges = ring_edges(polygons).join(name, "face_id", "left").withColumn("face_id", F.coalesce("new", "face_id")).drop("new")
    return edges.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("face_id", "k0", "k1"))).where("_n = 1").drop("_n")


def null_area_faces(polygons: DataFrame, minimum: float = 1e-6) -> DataFrame:
    """face_id of faces of no area."""
    return faces(polygons).where(F.col("area") <= minimum).select("face_id")


def undersized(cells: DataFrame, scale: float) -> DataFrame:
    """face_id of faces whose 2A/P is below ``scale``."""
    return cells.where(2 * F.col("area") / F.col("perimeter") < scale).select("face_id")


def mask_outline(cells: DataFrame, mask: str, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """ax, ay, bx, by: the edges between mask and not mask, with the mask on the left."""
    on = cells.where(mask).select(F.col("cell_id").alias("face_id"), "row", "col")
    return unpaired_edges(regular_polygons(on, x0, y0, dx, dy)).select("face_id", "ax", "ay", "bx", "by")


def hanging_nodes(polygons: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """face_id, ring, seq, x, y of vertices of other faces that lie inside unpaired edges: where to insert them."""
    from fluvia.operators.nearest import along_buckets, segment_distance

    # Buckets are as wide as the mean edge; a long one is dealt to the many that it passes.
    edges = unpaired_edges(polygons)
    size = max(edges.agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("l")).first()["l"] or 1.0, tolerance)
    dealt = along_buckets(edges, size, tolerance)
    ends = edges.select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("ka").alias("k")).unionByName(edges.select(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("kb").alias("k"))).dropDuplicates(["k"])
    placed = ends.withColumns({"i": F.floor(F.col("x") / size), "j": F.floor(F.col("y") / size)})
    hit = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= tolerance
    return dealt.join(placed, ["i", "j"]).where(hit & (F.col("k") != F.col("ka")) & (F.col("k") != F.col("kb"))).select("face_id", "ring", "seq", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")).alias("along"), "x", "y").dropDuplicates(["face_id", "ring", "seq", "x", "y"])


def with_nodes(polygons: DataFrame, nodes: DataFrame) -> DataFrame:
    """Polygons with nodes inserted after their edges' first vertices, sequences renumbered."""
    rows = polygons.select("face_id", "ring", "seq", F.lit(-1.0).alias("along"), "x", "y").unionByName(nodes.select("face_id", "ring", "seq", "along", "x", "y"))
    order = Window.partitionBy("face_id", "ring").orderBy("seq", "along")
    return rows.withColumn("seq", F.row_number().over(order) - 1).drop("along")


def welded(polygons: DataFrame, minimum_length: float) -> DataFrame:
    """Polygons with the ends of edges shorter than ``minimum_length`` welded: each part of the short-edge graph moves to its least vertex."""
    from fluvia.functions.graph import components

    short = ring_edges(polygons).where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) < minimum_length).select("k0", "k1").distinct()
    label = components(short.select(F.col("k0").alias("u"), F.col("k1").alias("v"))).select(F.col("node").alias("k0"), F.col("comp").alias("to"))
    keyed = polygons.withColumn("k0", F.struct(_snap(F.col("x")).alias("x"), _snap(F.col("y")).alias("y"))).join(label, "k0", "left")
    moved = keyed.withColumns({"x": F.coalesce(F.col("to.x") * GRID, F.col("x")), "y": F.coalesce(F.col("to.y") * GRID, F.col("y"))}).select("face_id", "ring", "seq", "x", "y")
    order = Window.partitionBy("face_id", "ring").orderBy("seq")
    last = F.coalesce(F.lag(F.struct("x", "y")).over(order), F.last(F.struct("x", "y")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return moved.withColumn("_last", last).where("_last is null or _last <> struct(x, y)").drop("_last")
