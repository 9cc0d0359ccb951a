"""Repair rounds of a polygon mesh: nodes, short edges, cells that are too small or whose faces are too short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions.tables import settled
from fluvia.operators import mesh, polygons


def conforming(shapes: DataFrame, tolerance: float = 1e-3, rounds: int = 30) -> DataFrame:
    """Polygons with neighbours' vertices on their edges, until every shared edge is shared whole; raises if it never is."""
    for _ in range(rounds):
        nodes = settled(mesh.hanging_nodes(shapes, tolerance))
        if not nodes.limit(1).count():
            return shapes
        shapes = settled(mesh.with_nodes(shapes, nodes))
    raise RuntimeError("edges with a neighbour's vertices on them are left")


def merged_round(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One round of merging ``pairs(face_id, into)``: pairs that share no cell, the others untouched."""
    matching = settled(mesh.merge_matching(pairs))
    ends = matching.select(F.col("a").alias("face_id")).unionByName(matching.select(F.col("b").alias("face_id")))
    changed = polygons.stitched(mesh.merged_cells(shapes.join(ends, "face_id", "left_semi"), matching))
    return settled(shapes.join(ends, "face_id", "left_anti").unionByName(changed))


def repaired(shapes: DataFrame, minimum_face: float, minimum_scale: float, groups: DataFrame | None = None, minimum_distance: float = 0.0, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(polygons, report of round, cells, merged) after rounds of conforming, welding and merging.

    A cell below the scale 2A/P joins the neighbour of its longest boundary, within its group if groups(face_id, group)
    are given; so does the smaller cell beside a face that is too short or whose centres are too near. Rounds end when
    nothing is left to merge; after ``rounds`` of them a last report row with pairs says that something is. The partition of the plane is kept: areas only move between cells.
    """
    spark = shapes.sparkSession
    report = []
    shapes = settled(shapes.join(mesh.null_area_faces(shapes), "face_id", "left_anti"))
    for number in range(1, rounds + 1):
        shapes = conforming(shapes)
        if minimum_face > 0:
            shapes = conforming(settled(mesh.welded(shapes, minimum_face * 0.5)))
            shapes = settled(shapes.join(mesh.null_area_faces(shapes), "face_id", "left_anti"))
        edges = settled(mesh.mesh_edges(shapes))
        cells = settled(mesh.faces(shapes))
        small = mesh.undersized(cells, minimum_scale)
        bad = mesh.bad_pairs(edges, minimum_face, minimum_distance)
        area = cells.select(F.col("face_id"), "area")
        sides = bad.join(area.select(F.col("face_id").alias("owner"), F.col("area").alias("_a")), "owner").join(area.select(F.col("face_id").alias("neighbor"), F.col("area").alias("_b")), "neighbor")
        named = settled(small.unionByName(sides.select(F.when(F.col("_a") <= F.col("_b"), F.col("owner")).otherwise(F.col("neighbor")).alias("face_id"))).distinct())
        group = groups if groups is not None else cells.select("face_id", F.lit("all").alias("group"))
        pairs = settled(mesh.repair_pairs(edges, named, group))
        n = pairs.count()
        report.append((number, cells.count(), n))
        if not n:
            break
        shapes = merged_round(shapes, pairs)
    return shapes, spark.createDataFrame(report, "round int, cells long, pairs long")
