"""Makes this package importable on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="package-")
        path = os.path.join(folder, f"{_PACKAGE.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(_PACKAGE.rglob("*.py")):
                out.write(source, source.relative_to(_PACKAGE.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
