"""Tables that cut lineage between rounds of iterative operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rounds-"))
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jvm_dir.get()


def written(df: DataFrame, name: str = "rounds") -> str:
    """Write ``df`` as Parquet below the shared folder and return the path; it is removed by ``discard`` or when the driver ends."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return path


def settled(df: DataFrame, name: str = "rounds") -> DataFrame:
    """``df`` computed once and read back from the shared folder, so a lost executor costs no earlier round."""
    path = written(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove settled tables on which nothing that is still to be computed depends."""
    for table in tables:
        _remove(getattr(table, "settled_path", ""))


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt to at least two tasks a core before a costly kernel: by bytes alone its few rows would share a task."""
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *columns)


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's cleaner takes the folder
            return
