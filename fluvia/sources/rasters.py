"""Raster scans, alignment, tiles, resampling, and GeoTIFF files.

Inside the engine a missing value is null. Sentinels and NaN become null as a raster is read and appear again only in
files that need them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.functions.session import ship_package

GRID_COLUMNS = ("rows", "cols", "x0", "y0", "dx", "dy", "crs")


def present(band: str, nodata: float | None = None) -> Column:
    """A band with NaN, infinities and the sentinel as null."""
    c = F.col(band).cast("double")
    gone = F.isnan(c) | (F.abs(c) == float("inf"))
    if nodata is not None and np.isfinite(nodata):
        gone = gone | (c == float(nodata))
    return F.when(~gone, c)


def with_nulls(cells: DataFrame, nodata: dict[str, float | None]) -> DataFrame:
    """Bands with nulls for their sentinels."""
    return cells.withColumns({b: present(b, v) for b, v in nodata.items()})


def with_sentinel(cells: DataFrame, band: str, nodata: float = -9999.0) -> DataFrame:
    """A band for export: 32-bit numbers, nulls as the sentinel."""
    return cells.withColumn(band, F.coalesce(F.col(band), F.lit(float(nodata))).cast("float"))


def assert_aligned(grid: dict, other: dict, label: str, crs: bool = True) -> None:
    """Raise unless two grids have one shape and transform (and CRS)."""
    names = [c for c in GRID_COLUMNS if crs or c != "crs"]
    wrong = [c for c in names if grid[c] != other[c]]
    if wrong:
        raise ValueError(f"{label} is not aligned: {', '.join(wrong)} differ")


def aligned(cells: DataFrame, other: DataFrame, bands: dict[str, Column | None]) -> DataFrame:
    """``cells`` with bands of another raster on the same grid; a default where it has none."""
    joined = cells.join(other.select("row", "col", *bands), ["row", "col"], "left")
    return joined.withColumns({b: F.coalesce(F.col(b), d) for b, d in bands.items() if d is not None})


def cell_centres(cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Add x, y of cell centres of a north-up grid."""
    return cells.withColumns({"x": x0 + (F.col("col") + 0.5) * dx, "y": y0 - (F.col("row") + 0.5) * dy})


def tiles_near(catalog: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Tiles of ``catalog(path, xmin, ymin, xmax, ymax)`` whose box meets the bounds."""
    x0, y0, x1, y1 = bounds
    return catalog.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def padded(bounds: tuple[float, float, float, float], pad: float, lonlat: bool = False) -> tuple[float, float, float, float]:
    """Bounds widened on all sides, clamped to the globe for degrees."""
    x0, y0, x1, y1 = bounds[0] - pad, bounds[1] - pad, bounds[2] + pad, bounds[3] + pad
    return (max(x0, -180.0), max(y0, -90.0), min(x1, 180.0), min(y1, 90.0)) if lonlat else (x0, y0, x1, y1)


def looks_like_degrees(bounds: tuple[float, float, float, float]) -> bool:
    return -180.5 <= bounds[0] <= bounds[2] <= 180.5 and -90.5 <= bounds[1] <= bounds[3] <= 90.5


def mosaic(cells: DataFrame, band: str, order: str = "tile_order") -> DataFrame:
    """row, col, band: the first present value in the order of tiles."""
    return cells.where(F.col(band).isNotNull()).groupBy("row", "col").agg(F.min_by(band, order).alias(band))


def nearest_resampled(target: DataFrame, source: DataFrame, band: str, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """``target(x, y, ...)`` with the band of the source cell that holds each centre."""
    at = target.withColumns({"_r": F.floor((y0 - F.col("y")) / dy).cast("int"), "_c": F.floor((F.col("x") - x0) / dx).cast("int")})
    return at.join(source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), band), ["_r", "_c"], "left").drop("_r", "_c")


def bilinear_resampled(target: DataFrame, source: DataFrame, band: str, x0: float, y0: float, dx: float, dy: float, key: str = "cell_id") -> DataFrame:
    """key, band: the four nearest source centres by distance weights, over those that are present."""
    u, v = (F.col("x") - x0) / dx - 0.5, (y0 - F.col("y")) / dy - 0.5
    corner = lambda a, b: F.struct((F.floor(u) + a).cast("int").alias("c"), (F.floor(v) + b).cast("int").alias("r"), ((u - F.floor(u) if a else 1 - (u - F.floor(u))) * (v - F.floor(v) if b else 1 - (v - F.floor(v)))).alias("w"))
    spread = target.select(key, F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("k")).select(key, "k.*").where("w > 0")
    hit = spread.join(source.where(F.col(band).isNotNull()).select(F.col("row").alias("r"), F.col("col").alias("c"), band), ["r", "c"])
    return hit.groupBy(key).agg((F.sum(F.col("w") * F.col(band)) / F.sum("w")).alias(band))


def gaps_filled(cells: DataFrame, band: str, reach: int, inside: str | None = None) -> DataFrame:
    """Missing values within ``reach`` cells of present ones, weighted by inverse squared distance.

    Donors are sent only to missing cells in reach; present values stay. ``inside`` limits donors and gaps to a mask.
    """
    limit = F.coalesce(F.col(inside), F.lit(False)) if inside else F.lit(True)
    ring = [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if 0 < r * r + c * c <= reach * reach]
    to = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(1.0 / (r * r + c * c)).alias("w")) for r, c in ring])
    gaps = cells.where(F.col(band).isNull() & limit).select("row", "col")
    sent = gaps.select(F.col("row").alias("gr"), F.col("col").alias("gc"), F.explode(to).alias("t")).select("gr", "gc", (F.col("gr") + F.col("t.r")).alias("row"), (F.col("gc") + F.col("t.c")).alias("col"), "t.w")
    donors = cells.where(F.col(band).isNotNull() & limit).select("row", "col", F.col(band).alias("_v"))
    found = sent.join(donors, ["row", "col"]).groupBy(F.col("gr").alias("row"), F.col("gc").alias("col")).agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("_f"))
    return cells.join(found, ["row", "col"], "left").withColumn(band, F.coalesce(band, "_f")).drop("_f")


def missing_count(cells: DataFrame, band: str, inside: str | None = None) -> DataFrame:
    """One row: missing cells [inside a mask]."""
    limit = F.coalesce(F.col(inside), F.lit(False)) if inside else F.lit(True)
    return cells.agg(F.count_if(F.col(band).isNull() & limit).alias("missing"))


# Field types of TIFF with their sizes and struct codes, and sample formats: fixed values.
_FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_TAGS = {"cols": 256, "rows": 257, "bits": 258, "compression": 259, "strip_at": 273, "samples": 277, "strip_rows": 278, "strip_bytes": 279, "predictor": 317, "tile_cols": 322, "tile_rows": 323, "tile_at": 324, "tile_bytes": 325, "format": 339, "scale": 33550, "tie": 33922, "nodata": 42113}


def decode_geotiff(data: bytes) -> tuple[np.ndarray, dict]:
    """(band 1, grid) of a classic TIFF: strips or tiles, raw or deflate, without or with horizontal predictor."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    fields: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in _FIELDS:
            continue
        size, code = _FIELDS[kind]
        place = at + 10 + 12 * i
        if size * count > 4:
            (place,) = struct.unpack(order + "I", data[place : place + 4])
        raw = data[place : place + size * count]
        fields[tag] = (raw.rstrip(b"\0").decode("ascii", "replace"),) if code == "c" else struct.unpack(f"{order}{count * len(code)}{code[0]}", raw)
    get = lambda name, default=None: fields.get(_TAGS[name], default)
    rows, cols, bits = get("rows")[0], get("cols")[0], get("bits", (8,))[0]
    samples, compression, predictor = get("samples", (1,))[0], get("compression", (1,))[0], get("predictor", (1,))[0]
    kind = np.dtype(order + _SAMPLES[(get("format", (1,))[0], bits)])
    if compression not in (1, 8, 32946) or predictor not in (1, 2) or samples != 1:
        raise ValueError("this TIFF needs one sample a pixel, raw or deflate, predictor 1 or 2")
    tiled = _TAGS["tile_at"] in fields
    height, width = (get("tile_rows")[0], get("tile_cols")[0]) if tiled else (min(get("strip_rows", (rows,))[0], rows), cols)
    out = np.zeros((-(-rows // height) * height, -(-cols // width) * width), kind)
    across = -(-cols // width)
    for k, (where, length) in enumerate(zip(get("tile_at" if tiled else "strip_at"), get("tile_bytes" if tiled else "strip_bytes"), strict=True)):
        raw = data[where : where + length]
        block = np.frombuffer(zlib.decompress(raw) if compression != 1 else raw, kind)
        block = block[: len(block) // width * width].reshape(-1, width)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        r, c = k // across * height, k % across * width
        out[r : r + len(block), c : c + width] = block
    scale, tie, nodata = get("scale", (1.0, 1.0, 0.0)), get("tie", (0.0,) * 6), get("nodata")
    grid = {"rows": rows, "cols": cols, "x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1], "dx": scale[0], "dy": scale[1], "nodata": float(nodata[0]) if nodata and nodata[0].strip() else None}
    return out[:rows, :cols], grid


def encode_geotiff(band: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float = -9999.0, tile: int = 256) -> bytes:
    """A little-endian tiled deflate GeoTIFF of 32-bit floats; NaN becomes the sentinel."""
    values = np.where(np.isfinite(band), band, nodata).astype("<f4")
    rows, cols = values.shape
    blocks = []
    for r in range(0, rows, tile):
        for c in range(0, cols, tile):
            block = np.full((tile, tile), nodata, "<f4")
            part = values[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes(), 6))
    text = f"{nodata:g}".encode() + b"\0"
    entries = {
        256: (4, [cols]), 257: (4, [rows]), 258: (3, [32]), 259: (3, [8]), 262: (3, [1]), 277: (3, [1]), 322: (3, [tile]), 323: (3, [tile]), 324: (4, [0] * len(blocks)), 325: (4, [len(b) for b in blocks]),
        339: (3, [3]), 33550: (12, [dx, dy, 0.0]), 33922: (12, [0.0, 0.0, 0.0, x0, y0, 0.0]), 42113: (2, text),
    }
    body_at = 8 + 2 + 12 * len(entries) + 4
    extra: dict[int, int] = {}
    at = body_at
    pack = lambda kind, v: v if kind == 2 else struct.pack(f"<{len(v)}{_FIELDS[kind][1]}", *v)
    for tag, (kind, values_) in sorted(entries.items()):
        if len(pack(kind, values_)) > 4:
            extra[tag] = at
            at += len(pack(kind, values_))
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    entries[324] = (4, offsets)
    head = b"II*\0" + struct.pack("<IH", 8, len(entries))
    tail = b""
    for tag, (kind, values_) in sorted(entries.items()):
        raw = pack(kind, values_)
        head += struct.pack("<HHI", tag, kind, len(values_)) + (struct.pack("<I", extra[tag]) if tag in extra else raw.ljust(4, b"\0"))
        tail += raw if tag in extra else b""
    return head + b"\0\0\0\0" + tail + b"".join(blocks)


CELLS_SCHEMA = "path string, row int, col int, cell_id long, x double, y double, value double"


def read_geotiff(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, row, col, cell_id, x, y, value of present pixels of GeoTIFF files; a task reads a file and yields it in row blocks."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                band, g = decode_geotiff(data.as_py())
                step = max(1, 100_000 // g["cols"])
                for r0 in range(0, g["rows"], step):
                    part = band[r0 : r0 + step].astype(float)
                    good = np.isfinite(part)
                    if g["nodata"] is not None:
                        good &= part != g["nodata"]
                    r, c = np.nonzero(good)
                    r = r + r0
                    cols = [pa.array([name] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(r.astype("int64") * g["cols"] + c), pa.array(g["x0"] + (c + 0.5) * g["dx"]), pa.array(g["y0"] - (r + 0.5) * g["dy"]), pa.array(part[good])]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "row", "col", "cell_id", "x", "y", "value"])

    return files.select("path", "content").mapInArrow(run, CELLS_SCHEMA)


def geotiff_tiles(cells: DataFrame, band: str, x0: float, y0: float, dx: float, dy: float, tile_cells: int = 2048, nodata: float = -9999.0) -> DataFrame:
    """tile_row, tile_col, content: GeoTIFF bytes of each tile of a raster, ready for a binary sink."""
    ship_package(cells.sparkSession)
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["tile_row"].iloc[0]), int(pdf["tile_col"].iloc[0])
        r, c = pdf["row"].to_numpy() - i * tile_cells, pdf["col"].to_numpy() - j * tile_cells
        out = np.full((r.max() + 1, c.max() + 1), np.nan)
        out[r, c] = pdf[band].to_numpy(float)
        return pd.DataFrame({"tile_row": [i], "tile_col": [j], "content": [encode_geotiff(out, x0 + j * tile_cells * dx, y0 - i * tile_cells * dy, dx, dy, nodata)]})

    placed = cells.select("row", "col", band, F.floor(F.col("row") / tile_cells).cast("int").alias("tile_row"), F.floor(F.col("col") / tile_cells).cast("int").alias("tile_col"))
    return placed.groupBy("tile_row", "tile_col").applyInPandas(run, "tile_row int, tile_col int, content binary")


def write_cells(cells: DataFrame, path: str, overwrite: bool = False, block_rows: int = 1024) -> None:
    """Cells as Parquet, partitioned by blocks of rows; an existing table is kept unless ``overwrite``."""
    cells.withColumn("row_block", F.floor(F.col("row") / block_rows).cast("int")).repartition("row_block").sortWithinPartitions("row", "col").write.mode("overwrite" if overwrite else "ignore").partitionBy("row_block").parquet(path)


def ranked(cells: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in an order."""
    return cells.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
