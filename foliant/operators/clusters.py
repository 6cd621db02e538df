"""Clusters of numbers in a row: by gaps, however large a group is, and by density, one group at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.grouped import map_groups
from foliant.sources.kept import kept

#: Fixed value: how far apart neighbours may be.
TOLERANCE = 12.0
#: Rows of a block of sessions.
BLOCK_ROWS = 1_000_000


def gap_clusters(rows: DataFrame, group: list[str], value: str, order: str, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``cluster``, from 0 in each group: a value more than ``tolerance`` above the one before begins a new cluster.

    Rows are dealt by ranges of (group, value, order), so that a group of any size spreads over blocks. Each block counts its own beginnings; where its first
    value continues the block before is decided by the blocks' ends, a row for each group in a block. Values that are null are a cluster of their own, the first.
    """
    n_blocks = rows.count() // block_rows + 1
    dealt = kept(rows.repartitionByRange(n_blocks, *group, value, order).withColumn("__block", F.spark_partition_id()))
    own = Window.partitionBy(*group, "__block").orderBy(F.col(value).asc_nulls_first(), order)
    before = F.lag(value).over(own)
    begins = F.when(F.row_number().over(own) == 1, 0).when(F.col(value).isNotNull() & (before.isNull() | (F.col(value) - before > tolerance)), 1).otherwise(0)
    inside = dealt.withColumn("__begins", begins).withColumn("__inside", F.sum("__begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = dealt.withColumn("__begins", begins).groupBy(*group, "__block").agg(F.sum("__begins").alias("__n"), F.min(F.struct(F.col(value).isNotNull(), F.col(value).alias("v")))["v"].alias("__low"), F.max(F.struct(F.col(value).isNotNull(), F.col(value).alias("v")))["v"].alias("__high"))
    blocks = Window.partitionBy(*group).orderBy("__block")
    last = F.lag("__high").over(blocks)
    new = F.when(F.row_number().over(blocks) == 1, 0).when(F.col("__low").isNotNull() & (last.isNull() | (F.col("__low") - last > tolerance)), 1).otherwise(0)
    ends = ends.withColumn("__new", new).withColumn("__base", F.sum("__new").over(blocks) + F.coalesce(F.sum("__n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keyed = ends.select(*[F.col(c).alias(f"__g_{k}") for k, c in enumerate(group)], F.col("__block").alias("__b"), "__base")
    same = F.col("__block") == F.col("__b")
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{k}"))
    return inside.join(keyed, same).select(*rows.columns, (F.col("__base") + F.col("__inside")).alias("cluster"))


def dense_runs(x: np.ndarray, tolerance: float, min_samples: int) -> np.ndarray:
    """The cluster of each of the sorted values: a value stays in the cluster before it if that has ``min_samples`` values within the tolerance below it, or a mean within it."""
    x, out, start, low, total, now = x.tolist(), [0] * len(x), 0, 0, 0.0, 0
    for k in range(len(x)):
        if k > start:
            low = max(low, start)
            while x[k] - x[low] > tolerance:
                low += 1
            if k - low < min_samples and abs(x[k] - total / (k - start)) > tolerance:
                start, total, now = k, 0.0, now + 1
        total += x[k]
        out[k] = now
    return np.array(out, np.int64)


def dense_clusters(rows: DataFrame, group: str, value: str, order: str, tolerance: float = TOLERANCE, min_samples: int = 1) -> DataFrame:
    """(group, order, value, cluster): clusters from 0 in the order of values. A group, like the columns of a page, is worked on in one task; null values aren't clustered and go.

    A window over the values below each one moves along with it, and the mean is a running one, so that a group costs no more than its sort.
    """
    if min_samples < 1:
        raise ValueError("min_samples is 1 at least")

    def run(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        x = pages[value].to_numpy()
        found = [dense_runs(x[a:z], tolerance, min_samples) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(x)])]
        return pages.append_column("cluster", pa.array(np.concatenate(found), pa.int64()))

    held = rows.select(group, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    kinds = dict(held.dtypes)
    return map_groups(held, [group], [value, order], run, f"`{group}` {kinds[group]}, `{order}` long, `{value}` double, cluster long")
