"""Tables that are written once, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where all runs on one machine (master local or local[n]) a
    folder of its own will do; elsewhere a session without the setting is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def folder_of(spark: SparkSession, path: str):
    """A path of Hadoop's, and the file system it is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """df as a Parquet table that outlives executors; cuts the lineage. Deleted by erase(), or when the session's JVM ends."""
    spark = df.sparkSession
    df = df.select(*cols) if cols else df
    path = f"{shared_dir(spark).rstrip('/')}/loomstone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, system = folder_of(spark, path)
    system.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder, system = folder_of(spark, path)
    system.delete(folder, True)


def erase(df: DataFrame) -> None:
    """Delete the table of a DataFrame that written() gave, when nothing is to read it any more."""
    if path := getattr(df, "_written_at", None):
        delete(df.sparkSession, path)
