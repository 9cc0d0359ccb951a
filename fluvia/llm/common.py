"""Session settings, shared-folder tables and distributed sums used by every operator here."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions.session import ship_package
from fluvia.functions.tables import discard, settled, written

__all__ = ["discard", "give_back", "held_out_remainder", "kept", "per_batch", "per_task", "prepare", "stored", "sum_vectors", "table", "vector_rows", "written"]

#: Rows and bytes of one Arrow batch; a batch of very long texts must fit a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

def prepare(spark: SparkSession) -> SparkSession:
    """Give Python workers this package, and bound the Arrow batches that they receive."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and survives the loss of any executor."""
    return settled(df, f"fluvia/{name}")


_kept: dict[str, dict] = {}
_libc = ctypes.CDLL(None)


def kept(owner: str) -> dict:
    """What this worker keeps between tasks of one operator. What it kept for others goes, so a worker holds one operator's memory."""
    for other in [n for n in _kept if n != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the system, which the allocators of a reused worker would keep."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def per_task(fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """A ``mapInArrow`` function that leaves behind only what ``owner`` keeps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(owner)
        yield from fn(batches)
        give_back()

    return run


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], owner: str = "") -> Callable:
    """A ``mapInArrow`` function from one that maps batch to batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return per_task(run, owner)


def vector_rows(vector: np.ndarray) -> pa.RecordBatch:
    """One partition's partial sums as a row; ``sum_vectors`` adds them up."""
    return pa.RecordBatch.from_pydict({"part": pa.array([vector.astype("<f8").tolist()], pa.list_(pa.float64()))})


def sum_vectors(partials: DataFrame, size: int) -> np.ndarray:
    """Element-wise sum of the ``part`` arrays; the driver receives ``size`` numbers whatever the input."""
    total = np.zeros(size)
    rows = (
        partials.select(F.posexplode("part").alias("i", "v"))
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    total[rows["i"].to_numpy(dtype=int)] = rows["v"].to_numpy(dtype=float)
    return total


def held_out_remainder(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
