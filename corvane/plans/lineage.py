"""Lineage cuts that survive the loss of executors.

``cut`` writes a DataFrame as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and reads it back; every executor shares that folder, so
a lost executor costs nothing but the tasks it was running.  Only where the
setting is absent and the master is local is a temporary folder made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, from the session's own setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _LOCAL[app]


def cut(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    ``replaced`` are earlier results of ``cut`` that ``df`` was the last to read;
    their files are deleted once ``df`` is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    drop(*replaced)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files behind results of ``cut``; other DataFrames are ignored."""
    for table in tables:
        path = getattr(table, "_corvane_path", None)
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _at_exit() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:
            pass
