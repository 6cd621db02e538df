"""Connected components of an edge list, by rounds of large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stored


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours move to the least of them: the larger ones (large star) or the smaller ones and itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # in a small star node = the larger end, and its neighbours are smaller
    pairs = both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) if small else both.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b), component being the least id of its component.

    Ends when a round changes nothing; every round is written to the shared folder.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.agg(mark).head()[0]
    while True:
        now = stored(_stars(_stars(now, small=False), small=True))
        after = now.agg(mark).head()[0]
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
