"""Intermediate tables written to the shared folder that the cluster names.

A staged table cuts lineage, survives the loss of executors, keeps every later reader on the
same rows, and gives Catalyst real sizes and column pruning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``.

    Where that is not set, a session on one machine (tests) gets a temporary folder; any other
    session is asked to set it, because a machine-local folder is not visible to all executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _roots:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        _roots[app] = tempfile.mkdtemp(prefix="riskloom-")
    return _roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the staging folder, remembered for :func:`release_staged`."""
    path = f"{staging_root(spark).rstrip('/')}/riskloom-{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the staging folder and return a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember_table(spark: SparkSession, name: str) -> None:
    """A named table over staged files, whose name :func:`release_staged` is to drop."""
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)


def release_staged(spark: SparkSession) -> int:
    """Delete the tables this application staged. Call it once their results are written."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
