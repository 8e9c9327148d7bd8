"""Cutting a plan's lineage in a folder that all machines share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def one_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="factloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where all of Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return folder or one_machine_folder()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, without what made it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there: for wide rows, which a checkpoint holds as they are in memory.

    Equal values of a column are written once, and only the columns that are
    asked for are read. Shuffle files of what is cut off go when it is written,
    the rows when the session ends.
    """
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), f"rows-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(str(path))
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(str(path))
