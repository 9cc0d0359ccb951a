"""Grids, reaches, overlaps and profiles derived from relational tables, for queries over them.

Orders are the cells of one grid with as many columns as the root of their number; see ``CELLS_SQL`` for the rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_M = 30.0

#: The same grid in DuckDB.
CELLS_SQL = """
n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS cols FROM orders),
cells AS (
  SELECT CAST(o_orderkey // cols AS INT) AS row, CAST(o_orderkey % cols AS INT) AS col, o_orderkey AS cell_id,
         20.0 * (o_orderkey // cols) + o_totalprice / 10000.0 + o_orderkey * 1e-9 AS z,
         CAST(40 + o_custkey % 60 AS DOUBLE) AS cn, o_orderpriority AS class, o_orderstatus AS status, cols
  FROM orders, n)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spark: SparkSession, sf_dir: str) -> int:
    """Columns of the grid, from the table's footer counts."""
    return int(read(spark, sf_dir, "orders").count() ** 0.5)


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, cell_id, z, cn, class, status."""
    cols = columns(spark, sf_dir)
    key = F.col("o_orderkey")
    row = F.floor(key / cols)
    return read(spark, sf_dir, "orders").select(
        row.cast("int").alias("row"), (key % cols).cast("int").alias("col"), key.alias("cell_id"),
        (20.0 * row + F.col("o_totalprice") / 10000.0 + key * 1e-9).alias("z"),
        (40 + F.col("o_custkey") % 60).cast("double").alias("cn"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("status"),
    )


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mesh_index, raster_index, area_m2: orders as mesh cells over parts as raster cells, quantities as areas."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("mesh_index"), F.col("l_partkey").alias("raster_index")).agg(F.sum("l_quantity").alias("area_m2"))


OVERLAP_SQL = """
overlap AS (SELECT l_orderkey AS mesh_index, l_partkey AS raster_index, sum(l_quantity) AS area_m2 FROM lineitem GROUP BY ALL),
mesh AS (SELECT mesh_index, sum(area_m2) AS mesh_area_m2 FROM overlap GROUP BY ALL),
raster AS (SELECT raster_index, sum(area_m2) AS raster_area_m2 FROM overlap GROUP BY ALL)
"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reach_id, seq, x, y, value: events of a user in order of time as stations of a reach."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events")
    seq = F.row_number().over(order)
    return events.select(F.col("user_id").alias("reach_id"), seq.alias("seq"), (seq * 40.0).alias("x"), (F.col("value") % 50).alias("y"), F.col("value"))


STATIONS_SQL = """
stations AS (
  SELECT user_id AS reach_id, seq, seq * 40.0 AS x, value % 50 AS y, value
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM events))
"""


def reach_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration samples: orders as reaches, customers' nations as zones."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    width = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("w"), F.avg("l_discount").alias("d"))
    area = F.col("o_totalprice") / 100
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(width, orders["o_orderkey"] == width["l_orderkey"])
    return joined.select(
        F.col("o_orderkey").alias("COMID"), F.col("c_nationkey").cast("long").alias("zone_id"), area.alias("lin_area_km2"),
        (F.pow(area, F.lit(0.45)) * (0.5 + F.col("w") / 50)).alias("lin_width_m"), (F.pow(area, F.lit(0.3)) * (0.1 + F.col("d") * 3)).alias("lin_depth_m"),
        (F.col("o_custkey") % 7000).cast("double").alias("nearest_d4_distance_m"), (area * (0.05 + F.col("o_custkey") % 17)).alias("nearest_d4_area_km2"),
        (0.05 + F.col("o_custkey") % 17).cast("double").alias("area_ratio_lin_to_nearest_d4"), (F.col("o_orderkey") % 300).cast("double").alias("zone_boundary_distance_m"), (F.col("o_orderkey") % 50 != 0).alias("in_grid"),
    )


SAMPLES_SQL = """
width AS (SELECT l_orderkey, avg(l_quantity) AS w, avg(l_discount) AS d FROM lineitem GROUP BY ALL),
samples AS (
  SELECT o_orderkey AS COMID, CAST(c_nationkey AS BIGINT) AS zone_id, o_totalprice / 100 AS lin_area_km2,
         pow(o_totalprice / 100, 0.45) * (0.5 + w / 50) AS lin_width_m, pow(o_totalprice / 100, 0.3) * (0.1 + d * 3) AS lin_depth_m,
         CAST(o_custkey % 7000 AS DOUBLE) AS nearest_d4_distance_m, o_totalprice / 100 * (0.05 + o_custkey % 17) AS nearest_d4_area_km2,
         CAST(0.05 + o_custkey % 17 AS DOUBLE) AS area_ratio_lin_to_nearest_d4, CAST(o_orderkey % 300 AS DOUBLE) AS zone_boundary_distance_m, o_orderkey % 50 <> 0 AS in_grid
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN width ON o_orderkey = l_orderkey)
"""
