"""Reading tables and landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The largest file that is taken in.
MAX_BYTES = 25 * 1024 * 1024


def landing_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files of a folder with their fingerprint and why a file is refused (null: it isn't)."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.substring_index("path", "/", -1)
    suffix = F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))
    reason = F.when(~suffix.isin(*extensions), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "size")
    return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("fingerprint"), reason.alias("refused"))
