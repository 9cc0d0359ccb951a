"""Vector inputs: map-service responses as JSON, line networks, files' facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"


def map_elements(responses: DataFrame, column: str = "body") -> DataFrame:
    """type, id, tags, vertices of the elements of JSON responses."""
    parsed = responses.select(F.explode(F.from_json(column, ELEMENTS)["elements"]).alias("e"))
    point = lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))
    return parsed.select("e.type", "e.id", "e.tags", F.transform("e.geometry", point).alias("vertices"))


def lines(elements: DataFrame) -> DataFrame:
    """Ways of at least two vertices."""
    return elements.where((F.col("type") == "way") & (F.size("vertices") >= 2))


def water_polygons(elements: DataFrame) -> DataFrame:
    """id, kind, vertices of closed ways; kind is the first tag of water, natural, landuse, waterway."""
    closed = (F.size("vertices") >= 4) & (F.element_at("vertices", 1) == F.element_at("vertices", -1))
    kind = F.coalesce(*[F.try_element_at("tags", F.lit(t)) for t in ("water", "natural", "landuse", "waterway")])
    return elements.where((F.col("type") == "way") & closed).select("id", kind.alias("kind"), "vertices")


def vertices(features: DataFrame, key: str = "id") -> DataFrame:
    """key, seq, x, y rows of features."""
    return features.select(F.col(key).alias("reach_id"), F.posexplode("vertices").alias("seq", "v")).select("reach_id", "seq", "v.x", "v.y")


def downhill(reaches: DataFrame, cells: DataFrame, z: str, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """``reaches(id, vertices, width_m)`` with vertices reversed where the end lies above the beginning; widths of 0 dropped."""
    end = lambda k, n: (F.floor((y0 - F.element_at("vertices", k)["y"]) / dy).cast("int").alias(f"_r{n}"), F.floor((F.element_at("vertices", k)["x"] - x0) / dx).cast("int").alias(f"_c{n}"))
    rows = reaches.where("width_m > 0").select("*", *end(1, 0), *end(-1, 1))
    for n in (0, 1):
        rows = rows.join(cells.select(F.col("row").alias(f"_r{n}"), F.col("col").alias(f"_c{n}"), F.col(z).alias(f"_z{n}")), [f"_r{n}", f"_c{n}"], "left")
    return rows.withColumn("vertices", F.when(F.col("_z1") > F.col("_z0"), F.reverse("vertices")).otherwise(F.col("vertices"))).select(*reaches.columns)


def file_facts(spark, path: str, digest_up_to: int = 128 << 20) -> DataFrame:
    """path, bytes, modified, sha256 of files; no digest for larger ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.when(F.col("length") <= digest_up_to, F.sha2("content", 256)).alias("sha256"))


def table_digest(df: DataFrame) -> DataFrame:
    """rows, digest of a table whatever its order: to show that a rewrite changed nothing."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))
