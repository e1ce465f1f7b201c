"""The folder that driver and executors share, for steps that are written and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir() has set.

    Where neither is set, a temporary folder serves a session of one process (master local[...]); on a cluster it is a
    RuntimeError.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("steps are written to spark.checkpoint.dir, which isn't set")
    path = tempfile.mkdtemp(prefix="lexmill-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/lexmill-{uuid.uuid4().hex}"


@contextmanager
def step(df: DataFrame, path: str):
    """df written to a folder and read back, for plans that read it more than once; the folder is deleted at the end."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
