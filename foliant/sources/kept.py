"""Tables that several branches of a query read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local, as in tests, one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_kept_folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark._kept_folder = "file://" + tempfile.mkdtemp(prefix="kept-")
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, deleted when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table that is read back: worked out once, and still there when an executor is lost."""
    folder = new_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
