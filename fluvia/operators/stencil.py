"""Neighbourhood operators over ``cells(row, col, cell_id, ...)``.

Every cell sends its value to the cells that look at it, and one aggregation by cell gathers them: one shuffle, no
self-join, whatever the stencil.  Cells absent from the table are invalid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Offsets (row, column) and direction codes in the order in which ties are decided: fixed values.
D4 = {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}
D8 = {**D4, "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}
D4_CODES = {"n": 1, "e": 2, "s": 3, "w": 4}
D8_CODES = {"n": 1, "ne": 2, "e": 3, "se": 4, "s": 5, "sw": 6, "w": 7, "nw": 8}


def offsets(scheme: str) -> dict[str, tuple[int, int]]:
    return {"d4": D4, "d8": D8}[scheme]


def gathered(cells: DataFrame, bands: list[str], around: dict[str, tuple[int, int]]) -> DataFrame:
    """``cells`` with ``<band>_<name>`` of each neighbour; null where the neighbour is absent or null."""
    own = F.struct(*cells.columns)
    sent = F.array(
        F.struct(F.lit("").alias("name"), F.lit(0).alias("dr"), F.lit(0).alias("dc")),
        *[F.struct(F.lit(k).alias("name"), F.lit(-r).alias("dr"), F.lit(-c).alias("dc")) for k, (r, c) in around.items()],
    )
    flat = cells.select(own.alias("own"), F.explode(sent).alias("to")).select(
        (F.col("own.row") + F.col("to.dr")).alias("row"), (F.col("own.col") + F.col("to.dc")).alias("col"), F.col("to.name").alias("name"), "own"
    )
    own_only = F.when(F.col("name") == "", F.col("own"))
    seen = [F.max(F.when(F.col("name") == k, F.col(f"own.{b}"))).alias(f"{b}_{k}") for k in around for b in bands]
    return flat.groupBy("row", "col").agg(F.max(own_only).alias("own"), *seen).where("own is not null").select("own.*", *[f"{b}_{k}" for k in around for b in bands])


def receivers(cells: DataFrame, z: str = "z", scheme: str = "d4", dx: float = 30.0, dy: float = 30.0) -> DataFrame:
    """Add ``receiver`` (cell_id of the steepest lower neighbour, null if none) and ``distance`` to it."""
    around = offsets(scheme)
    seen = gathered(cells, [z, "cell_id"], around)
    options = []
    for rank, (name, (r, c)) in enumerate(around.items()):
        far = ((r * dy) ** 2 + (c * dx) ** 2) ** 0.5
        slope = (F.col(z) - F.col(f"{z}_{name}")) / far
        options.append(F.when(slope > 0, F.struct(slope.alias("slope"), F.lit(-rank).alias("rank"), F.col(f"cell_id_{name}").alias("receiver"), F.lit(far).alias("distance"))))
    # The steepest, of equal ones the first in order.
    best = F.array_max(F.array_compact(F.array(*options)))
    return seen.withColumn("best", best).select(*cells.columns, F.col("best.receiver").alias("receiver"), F.col("best.distance").alias("distance"))


def direction_code(cols: Column, cell_id: Column, receiver: Column, scheme: str = "d4") -> Column:
    """Code of the link to the receiver; 0 without one."""
    codes = D4_CODES if scheme == "d4" else D8_CODES
    out = F.lit(0)
    step = receiver - cell_id
    for name, (r, c) in offsets(scheme).items():
        out = F.when(step == cols * r + c, codes[name]).otherwise(out)
    return F.when(receiver.isNull(), 0).otherwise(out).cast("tinyint")


def receiver_of_code(rows: Column, cols: Column, row: Column, col: Column, code: Column, scheme: str = "d4") -> Column:
    """cell_id that a code points to; null for other codes and beyond the grid."""
    codes = D4_CODES if scheme == "d4" else D8_CODES
    pick = lambda k: reduce(lambda out, n: F.when(code == codes[n], offsets(scheme)[n][k]).otherwise(out), codes, F.lit(None).cast("int"))
    r, c = row + pick(0), col + pick(1)
    return F.when((r >= 0) & (r < rows) & (c >= 0) & (c < cols), r.cast("long") * cols + c)


def slope_degrees(cells: DataFrame, z: str = "z", dx: float = 30.0, dy: float = 30.0) -> DataFrame:
    """Add ``slope_deg`` by central differences, one-sided at the extent's edges; missing neighbours inside it count as the mean."""
    # One row: the extent and the mean.
    extent = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.avg(z).alias("mean"))
    seen = gathered(cells, [z], D4).crossJoin(F.broadcast(extent))

    def along(low: str, high: str, at: str, first: str, last: str, step: float) -> Column:
        a = F.when(F.col(at) == F.col(first), F.col(z)).otherwise(F.coalesce(f"{z}_{low}", "mean"))
        b = F.when(F.col(at) == F.col(last), F.col(z)).otherwise(F.coalesce(f"{z}_{high}", "mean"))
        n = F.when((F.col(at) == F.col(first)) | (F.col(at) == F.col(last)), 1.0).otherwise(2.0)
        return (b - a) / (n * step)

    gx, gy = along("w", "e", "col", "c0", "c1", dx), along("n", "s", "row", "r0", "r1", dy)
    return seen.select(*cells.columns, F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope_deg"))


def local_relief(cells: DataFrame, z: str, radius: int) -> DataFrame:
    """Add ``relief``: highest minus lowest value in a square window, cut at the extent.

    Rows come first: a cell sends its value along its row, also to places without a cell, so the windows along columns
    that follow miss nothing.
    """
    own = F.when(F.col("_d") == 0, F.struct(*cells.columns))
    sent = cells.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).select("row", (F.col("col") + F.col("_d")).alias("_c"), F.col(z).alias("_z"), own.alias("_own"))
    across = sent.groupBy("row", "_c").agg(F.max("_z").alias("_hi"), F.min("_z").alias("_lo"), F.max("_own").alias("_own"))
    along = Window.partitionBy("_c").orderBy("row").rangeBetween(-radius, radius)
    out = across.withColumn("relief", F.max("_hi").over(along) - F.min("_lo").over(along)).where("_own is not null")
    return out.select("_own.*", "relief")


def zone_boundary(cells: DataFrame, zone: str = "zone") -> DataFrame:
    """Add ``boundary``: an active cell at the extent's edge or beside another zone."""
    extent = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    seen = gathered(cells.withColumn(zone, F.coalesce(zone, F.lit(0))), [zone], D4).crossJoin(F.broadcast(extent))
    edge = F.expr("row = r0 or row = r1 or col = c0 or col = c1")
    beside = reduce(Column.__or__, [F.coalesce(F.col(f"{zone}_{k}") != F.col(zone), F.lit(False)) for k in D4])
    return seen.select(*cells.columns, ((F.col(zone) > 0) & (edge | beside)).alias("boundary"))


def block_aggregate(cells: DataFrame, factor: int, **aggregates: Column) -> DataFrame:
    """Cells of a grid ``factor`` times as coarse: ``row, col`` and the given aggregates."""
    coarse = cells.withColumns({"row": F.floor(F.col("row") / factor).cast("int"), "col": F.floor(F.col("col") / factor).cast("int")})
    return coarse.groupBy("row", "col").agg(*[v.alias(k) for k, v in aggregates.items()])


def coarse_jumps(cells: DataFrame, z: str, factor: int, coverage: float = 0.5) -> DataFrame:
    """row, col, jump_e, jump_s: differences of block means, of blocks with enough cells."""
    means = block_aggregate(cells, factor, mean=F.avg(z), n=F.count(z)).where(F.col("n") >= coverage * factor * factor).select("row", "col", "mean")
    seen = gathered(means, ["mean"], {"e": (0, 1), "s": (1, 0)})
    return seen.select("row", "col", F.abs(F.col("mean_e") - F.col("mean")).alias("jump_e"), F.abs(F.col("mean_s") - F.col("mean")).alias("jump_s"))


def channel_bed_sills(cells: DataFrame, z: str = "z", depth: str = "depth", river: str = "river") -> DataFrame:
    """Add ``bed`` on river cells and ``sill``: how far the bed of a river receiver stands above."""
    bed = F.when(F.col(river), F.col(z) - F.coalesce(depth, F.lit(0.0)))
    down = cells.where(river).select(F.col("cell_id").alias("_to"), bed.alias("_bed"))
    joined = cells.withColumn("bed", bed).join(down, (F.col("receiver") == F.col("_to")) & F.col(river), "left")
    return joined.withColumn("sill", F.greatest(F.coalesce(F.col("_bed") - F.col("bed"), F.lit(0.0)), F.lit(0.0))).drop("_to", "_bed")


def morphology(cells: DataFrame, mask: str, radius: float, grow: bool) -> DataFrame:
    """Dilate or erode a mask by a disk of ``radius`` cells; cells beyond the table are outside the mask."""
    reach = int(radius)
    disk = [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if r * r + c * c <= radius * radius]
    to = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in disk])
    on = F.coalesce(F.col(mask), F.lit(False))
    hits = cells.where(on).select("row", "col", F.explode(to).alias("to")).select((F.col("row") + F.col("to.dr")).alias("row"), (F.col("col") + F.col("to.dc")).alias("col"))
    counted = hits.groupBy("row", "col").agg(F.count(F.lit(1)).alias("_n"))
    need = 1 if grow else len(disk)
    return cells.join(counted, ["row", "col"], "left").withColumn(mask, F.coalesce(F.col("_n") >= need, F.lit(False))).drop("_n")


def opened(cells: DataFrame, mask: str, radius: float) -> DataFrame:
    """Binary opening: parts narrower than the disk vanish."""
    return morphology(morphology(cells, mask, radius, grow=False), mask, radius, grow=True)
