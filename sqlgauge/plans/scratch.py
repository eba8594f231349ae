"""Written intermediate tables in the folder all executors share.

A written table cuts lineage in a way that survives lost executors, and its file size is known, so a
later join broadcasts it only when Spark's own size check (autoBroadcastJoinThreshold) allows it. ``release`` removes
what the application has written, once its results are no longer needed.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the session's checkpoint folder."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one process, one file system
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="sqlgauge-")
        root = _local_root
    return f"{_folder(spark, root)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, root: str) -> str:
    return f"{root.rstrip('/')}/sqlgauge/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the tables this application has written here; results that still read them fail afterwards."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, root))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
