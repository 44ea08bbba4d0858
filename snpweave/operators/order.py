"""Numbers by a global order without one task for all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_leaving: set[str] = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, which cuts its lineage; the folder goes when the application ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="snpweave-"))
    own = sc.getCheckpointDir()
    if own not in _leaving:  # a folder of this application alone
        _leaving.add(own)
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *by) -> DataFrame:
    """``df`` with ``name``: 1 .. by the order of ``by`` (which should tell all rows apart).

    A range sort, numbers within its partitions, and the partitions' sizes added up: one row for each of them.
    """
    x = checkpointed(df.orderBy(*by).withColumn("__p", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = x.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy("__at"))
    return x.withColumn("__r", own).join(F.broadcast(before), "__p").withColumn(name, (F.col("__r") + F.col("__b")).cast("int")).drop("__p", "__at", "__r", "__b")


def tile(i: Column, n: int, tiles: int) -> Column:
    """The tile (1 ..) of the ``i``-th of ``n`` rows: as ``ntile`` deals them, the first ones a row larger."""
    size, more = divmod(n, tiles)
    if not size:
        return i.cast("int")
    edge = more * (size + 1)
    return F.when(i <= edge, F.floor((i - 1) / (size + 1)) + 1).otherwise(F.floor((i - 1 - edge) / size) + 1 + more).cast("int")
