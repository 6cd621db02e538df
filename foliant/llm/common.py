"""What the operators of this subpackage share: scratch tables, word splitting, hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text, as a regular expression for the JVM and for RE2.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset on a local master (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_foliant_scratch", None)
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = spark._foliant_scratch = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return base.rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the application ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The files are removed when the application ends. ``compression``: the session's, unless given.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    delete_on_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._foliant_path = path
    return table


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files that nothing refers to any more, those of tables that are stored by now."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables once all that was made from them is stored itself, and shuffle files that nothing refers to any more."""
    for t in tables:
        jpath = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._foliant_path)
        jpath.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
    free_shuffles(tables[0].sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_totals(df: DataFrame, group: list[str], block: str, order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Two levels, so that no group is ever in one task: rows are summed inside (group, block), blocks are
    summed inside their group. ``block`` must rise with the order; ``order`` are Columns.
    """
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(above), F.lit(0))).drop("__sum")
    keyed = sums.select(*[F.col(c).alias(f"__g_{c}") for c in [*group, block]], "__base")
    rows = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = None
    for c in [*group, block]:
        same = F.col(c).eqNullSafe(F.col(f"__g_{c}"))
        on = same if on is None else on & same
    joined = rows.join(keyed, on, "left")
    return joined.withColumn(out, (F.col("__own") + F.col("__base")).cast("long")).drop("__own", "__base", *[f"__g_{c}" for c in [*group, block]])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (multiply and xor-shift)."""
    x = x ^ U64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@dataclass
class Words:
    """All words of a batch: each one's number among the distinct words, where each text's begin (and the end), the distinct words and their hashes."""

    index: np.ndarray
    starts: np.ndarray
    distinct: list[bytes]
    hashes: np.ndarray

    def tokens(self) -> np.ndarray:
        """A 64-bit hash for each word, the same on every machine."""
        return self.hashes[self.index]


def batch_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text (null: none); with ``lower``, A-Z are made lower case. Python sees each distinct word of a batch once."""
    whole = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    index, n = coded.indices.to_numpy().astype(np.int64), split.value_lengths().to_numpy().astype(np.int64)
    if b"" in distinct:  # before the first and behind the last blank of a text
        gone = distinct.index(b"")
        stays = index != gone
        n = np.bincount(np.repeat(np.arange(len(n)), n)[stays], minlength=len(n))
        index = index[stays]
        index -= index > gone
        distinct.pop(gone)
    return Words(index, np.concatenate(([0], np.cumsum(n))), distinct, np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n consecutive entries of ``h`` (across documents too; callers mask those)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(m, dtype=U64)
    for j in range(n):
        out = (out + h[j : j + m]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
    return out
