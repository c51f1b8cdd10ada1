"""Tables that a plan writes and reads back in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder made here where that is unset and all run in one process (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = context._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
            made = context._jsc.sc().getCheckpointDir()
        folder = made.get()
    return folder.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage, and a lost executor costs no recomputation.

    The files go when the JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/veilframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    files, path = _path(spark, where)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._stored_at = where
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``store`` that nothing reads any more."""
    files, path = _path(df.sparkSession, df._stored_at)
    files.delete(path, True)
