"""Scratch tables in the shared checkpoint folder, and joins that check a side's size before broadcasting it.

Scratch tables are Parquet below ``spark.checkpoint.dir``, which every executor and the driver can read, so a
lost executor only costs the tasks it was running. Nothing is kept in an executor's own folder.
"""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers get the package's functions with the task, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: A side is broadcast only if its measured size stays below this many bytes.
BROADCAST_BYTES = 16 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder.

    Where none is named, a temporary one is set in local mode; on a cluster that is an error, as executors would write
    to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lumenframe-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a scratch table and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """left join right, right a materialised table: broadcast if its measured size is below limit, else shuffled.

    row_bytes bounds the width of a row, as a number or an expression over right. The shuffled form is a plain
    equi-join, whose skewed partitions adaptive execution splits.
    """
    width = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    small = (right.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit
    return left.join(F.broadcast(right) if small else right, on, how)
