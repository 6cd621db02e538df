"""Exact dedup with a heavy-hitter split.

Misra-Gries counters (Spark's freqItems) name every digest that may hold at least ``support`` of the rows;
an exact count verifies those, and their winners, at most about 1/support rows, are broadcast, so that the
copies of a very frequent text are decided on the map side. All other digests meet in an ordinary shuffle,
in which no digest has more than ``support`` of the rows.

Defined results: null text counts as empty; a null id is below every other id; of fully repeated rows one
stays; an empty table gives an empty table; other columns pass through under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import stored


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def mark_copies(rows: DataFrame, id_col: str = "doc_id", digest: str = "__digest", support: float = 0.001) -> DataFrame:
    """Add ``__keep_id``, ``__group_size`` and ``__kept`` to rows that have a digest; the largest id stays."""
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__key", F.xxhash64(digest)))
    best = F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))
    frequent = rows.select("__key").freqItems(["__key"], support).select(F.explode("__key_freqItems").alias("__key"))
    # at most 1/support counters exist, whatever the size of the input
    winners = (
        rows.select(id_col, "__row", "__key", digest)
        .join(F.broadcast(frequent), "__key", "left_semi")
        .groupBy(F.col(digest).alias("__hot"))
        .agg(F.max(best).alias("__best"), F.count("*").alias("__n"))
        .filter("__n > 1")
    )
    tagged = rows.join(F.broadcast(winners), F.col(digest) == F.col("__hot"), "left")
    same = Window.partitionBy(digest)
    rest = tagged.filter("__hot IS NULL").withColumn("__best", F.max(best).over(same)).withColumn("__n", F.count("*").over(same))
    both = tagged.filter("__hot IS NOT NULL").unionByName(rest)
    return both.select(
        *[c for c in rows.columns if c not in ("__row", "__key")],
        F.col("__best.id").alias("__keep_id"),
        F.col("__n").alias("__group_size"),
        (F.col("__row") == F.col("__best.row")).alias("__kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    own = [F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(docs.columns)]  # whatever their names, they clash with none here
    marked = mark_copies(docs.select(*own, F.col(id_col).alias("__id"), digest_of(F.col(text_col)).alias("__digest")), "__id", support=support)
    return marked.filter("__kept").select(*[F.col(f"x{k}").alias(c) for k, c in enumerate(docs.columns)])


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per document: which row stays for its text, how many rows have that text, whether this one stays."""
    marked = mark_copies(docs.select(F.col(id_col), digest_of(F.col(text_col)).alias("__digest")), id_col, support=support)
    return marked.select(
        F.col(id_col),
        F.col("__keep_id").alias("keep_id"),
        F.col("__group_size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )
