"""Cutting lineage by writing a table in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: rows of a file of ``stage_distinct``, and files at least where there are as many partitions
ROWS, LEAST = 50_000, 24

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="snpweave-")
    return _own[app]


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor costs no recomputation.

    The table goes when ``drop_stage`` removes it, and at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/snpweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def stage_distinct(df: DataFrame, name: str, most: int) -> DataFrame:
    """The distinct rows of ``df``, staged; there are about ``most`` at most, and a file holds ``ROWS`` of so many.

    They are dealt by all their columns, so no value of one can crowd a task; few rows in many partitions are written by
    ``LEAST`` tasks, as the files of a partition each cost more than their rows.
    """
    return stage(df.distinct().coalesce(max(LEAST, -(-most // ROWS))), name)


def drop_stage(*tables: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            p, fs = _path(df.sparkSession, f)
            fs.delete(p.getParent(), True)
