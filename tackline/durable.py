"""Cutting lineage so that a lost executor costs no earlier stage.

Files go to the folder that the session names in ``spark.checkpoint.dir``,
which driver and executors share, or to the session's checkpoint folder. Without
either there is no folder that all of them see: on one machine, in local mode, one of
this process is used, and on a cluster the work stops with an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tackline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of a small or iterated table, computed once and kept as checkpoint files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_table(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of a larger table, computed once and kept as Parquet; with a path, together with what it holds already."""
    spark = df.sparkSession
    path = path or new_table(spark)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_at(spark: SparkSession, path: str) -> int:
    """The size of a file or folder, wherever Spark's readers find it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
