"""Run records: preflight checks, manifests, and where outputs go by theme."""

from __future__ import annotations

import datetime as dt
import json
import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.plans.mesh_product import settings_digest

#: Themes by words in an output's name, in order of precedence: fixed values.
THEMES = {"reports": ("summary", "manifest", "scorecard", "report"), "diagnostics": ("diagnostic", "delta", "pit", "ledger"), "d4": ("d4", "river", "flow", "accumulation", "direction"), "dem": ("dem", "terrain", "elevation", "surface")}


def theme(name: str) -> str:
    """Theme of an output by its name; ``misc`` where no word fits."""
    low = name.lower()
    return next((t for t, words in THEMES.items() if any(w in low for w in words)), "misc")


def output_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{theme(name)}/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def preflight(spark: SparkSession, grid: dict, required: list[str], least_cells: int = 4) -> DataFrame:
    """check, ok, note: whether inputs exist and the grid can be worked on. Paths may lie in any store that Spark reads."""
    rows = [(f"exists:{p}", ok := _exists(spark, p), "" if ok else "missing") for p in required]
    size = int(grid.get("rows", 0)) * int(grid.get("cols", 0))
    rows += [
        ("projected", bool(grid.get("projected")), "" if grid.get("projected") else "cell sizes must be metres"),
        ("square cells", abs(grid.get("dx", 0) - grid.get("dy", 0)) < 1e-9, ""),
        ("size", size >= least_cells, f"{size} cells"),
    ]
    return spark.createDataFrame(rows, "check string, ok boolean, note string")


def run_record(spark: SparkSession, settings: dict, outputs: dict[str, str]) -> DataFrame:
    """key, value: when, with what settings and versions a run was made, and its outputs."""
    facts = {
        "created_utc": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "settings": json.dumps(settings, sort_keys=True, default=str), "settings_sha256": settings_digest(settings),
        "spark": pyspark.__version__, "python": platform.python_version(), **{f"output:{k}": v for k, v in outputs.items()},
    }
    return spark.createDataFrame(sorted(facts.items()), "key string, value string")


def warnings_of(scorecard: DataFrame) -> DataFrame:
    """Scorecard rows that need a look."""
    return scorecard.where(F.col("status") != "ok")
