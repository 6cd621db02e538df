"""A table of latest rows that is kept up to date by a stream of changes.

Keys are dealt to buckets. A micro-batch reads the newest version of the buckets that its changes touch, merges them in, and writes those buckets anew under its own number; buckets that
it does not touch stay as they are. A version counts once its batch is complete (Spark's _SUCCESS). So a batch that is repeated after a failure
writes the same files again, a reader never sees half a batch, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.jobs import latest

BUCKETS = 32


@dataclass
class LatestTable:
    """``folder``: where versions of buckets are, as batch=N/bucket=K; ``key``; ``version``: of rows with one key the one with the highest stays, on a tie the greatest row."""

    spark: SparkSession
    folder: str
    key: str
    version: str
    schema: str
    buckets: int = BUCKETS

    def _list(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self, before: int | None = None) -> dict[int, int]:
        """bucket -> its newest complete version, older than ``before`` if given."""
        out: dict[int, int] = {}
        batches = sorted(int(n.removeprefix("batch=")) for n in self._list(self.folder) if n.startswith("batch="))
        for b in batches:
            names = self._list(f"{self.folder}/batch={b}")
            if (before is None or b < before) and "_SUCCESS" in names:
                out |= {int(n.removeprefix("bucket=")): b for n in names if n.startswith("bucket=")}
        return out

    def read(self, only: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the newest versions (of some buckets only)."""
        found = [f"{self.folder}/batch={b}/bucket={k}" for k, b in sorted(self.versions(before).items()) if only is None or k in only]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Take a batch of changes in; a repeated call with one number does no more than the first."""
        names = [c for c in self.spark.createDataFrame([], self.schema).columns]
        new = changes.select(*names).withColumn("bucket", self.bucket())
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # no more than there are buckets
        if not touched:
            return
        both = self.read(touched, before=batch).withColumn("bucket", self.bucket()).unionByName(new)
        rows = both.groupBy("bucket", self.key).agg(F.max(F.struct(self.version, *[c for c in names if c not in (self.key, self.version)])).alias("last")).select("bucket", self.key, "last.*")
        rows.select("bucket", *names).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch}")

    def drop_old(self) -> list[str]:
        """Delete the versions of buckets that newer complete ones have taken the place of; returns their folders."""
        newest, gone = self.versions(), []
        for b in (int(n.removeprefix("batch=")) for n in self._list(self.folder) if n.startswith("batch=")):
            for n in self._list(f"{self.folder}/batch={b}"):
                if n.startswith("bucket=") and newest.get(int(n.removeprefix("bucket=")), -1) > b:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={b}/{n}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                    gone.append(f"batch={b}/{n}")
        return gone


def keep_latest(changes: DataFrame, table: LatestTable, checkpoint: str) -> int:
    """Take in all changes that a stream has by now, batch by batch, and return how many batches that took; called again, it goes on where it stopped."""
    query = changes.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows > 0 for p in query.recentProgress)


def landed_once(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Landing files (a stream of name, modified, fingerprint, ...) without those whose content came before within ``delay``; files older than that by their time of change are late and left out."""
    return files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def latest_at_once(changes: DataFrame, key: str, version: str) -> DataFrame:
    """What the stream should leave, by one query over all changes."""
    return latest(changes, key, version)
