"""Job records as an event log: latest state, recovery, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("QUEUED", "PROCESSING")


def latest(log: DataFrame, key: str, version: str) -> DataFrame:
    """The last row of each key: what an upsert would have left."""
    names = [c for c in log.columns if c != key]
    last = F.max_by(F.struct(*names), F.col(version)).alias("last")
    return log.groupBy(key).agg(last).select(key, "last.*")


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs that were under way when the service stopped have failed, with their progress at 99 at most."""
    stuck = F.col("status").isin(*OPEN)
    return jobs.withColumn("progress", F.when(stuck, F.least("progress", F.lit(99))).otherwise(F.col("progress"))).withColumn("status", F.when(stuck, "FAILED").otherwise(F.col("status")))


def best_of(rows: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The row with the best score of each key; the first in order on a tie."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def job_of(jobs: DataFrame, job_id, owner=None, key: str = "job_id", owner_column: str = "user_id") -> DataFrame:
    """One job by its id, and only if it is the owner's where one is given; equality filters, which reach the scan."""
    rows = jobs.filter(F.col(key) == job_id)
    return rows if owner is None else rows.filter(F.col(owner_column) == owner)
