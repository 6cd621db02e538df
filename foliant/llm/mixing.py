"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule (how its weight moves over the run, piecewise linear, mean 1). The
target of a source is its share of the words; what exceeds ``max_epochs`` times the source is shared again by
weight. A source's documents stand in a fixed pseudo-random order (md5 of the id); its cumulative words over its
target say how much of the source's demand has been met, and the inverse of the integrated schedule turns that
into the time of the run at which the document is due. The result is range-sorted by that time.

Defined results: null text has size 0 and takes nothing; null sources are one source, the last; repeated rows
each count; an empty table gives an empty table; ties in the order fall to id, then size. Sources are ranked in one
task, which suits up to some millions of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD, free_shuffles, running_totals, stored

#: (time, factor) knots for heavy, middle and light sources: heavy ones early, light ones late. Each has mean 1.
RAMPS = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
BLOCK_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size) -> the same with weight, slot and target; one row per source, so a small table.

    Sources are capped in the order of cap over weight: the first k are capped exactly if the k-th is above what
    it would get with the first k-1 capped and the next is not.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("slot", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("slot") + 1).cast("long")
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("left_total", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_total") / F.col("left_weight"))
        .withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    )
    # the first source that isn't above its cap sets the level for itself and all after it
    open_level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.withColumn("open_level", open_level).select(
        "source", "source_size", "slot", "weight",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight")), F.lit(0.0)).alias("target"))


def time_of(share: Column, slot: Column, schedules=RAMPS) -> Column:
    """The time at which ``share`` of a source's demand has been met: the inverse of its integrated schedule."""

    def inverse(knots) -> Column:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        out, done = F.lit(float(knots[-1][0])), sum(areas)
        for (t0, m0), (t1, m1), area in list(zip(knots, knots[1:], areas))[::-1]:
            done -= area
            c = share * F.lit(sum(areas)) - F.lit(done)
            root = F.sqrt(F.lit(m0 * m0) + F.lit(2 * (m1 - m0) / (t1 - t0)) * c)
            x = F.lit(t0) + F.when(c <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * c / (F.lit(m0) + root))
            out = x if done <= 0 else F.when(share * F.lit(sum(areas)) >= F.lit(done), x).otherwise(out)
        return out

    picked = inverse(schedules[0])
    for k, knots in enumerate(schedules[1:], 1):
        picked = F.when(slot == k, inverse(knots)).otherwise(picked)
    return picked


def plan_mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, schedules=RAMPS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: size, slot, source_size, target, words before it in its source, words taken.

    The document at which a source's last, partial epoch ends counts with the words up to there.
    ``schedules`` repeat as ``weights`` do; ``keep`` names further columns to carry.
    """
    rows = stored(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order_key"), *keep,
    ).withColumn("block", F.substring("order_key", 1, BLOCK_DIGITS)))
    rows_at = running_totals(rows, ["source"], "block", [F.col("order_key"), F.col("doc_id").asc_nulls_first(), F.col("size")], "size", "before")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumnRenamed("source", "__source")
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rest = whole - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (
        rows_at.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        .withColumn("epochs", epochs.cast("long")).withColumn("part", part.cast("long"))
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
    )


def _due(plan: DataFrame, schedules, copy: Column) -> Column:
    met = (F.col("before") + copy * F.col("source_size")).cast("double") / F.col("target")
    return time_of(met, F.col("slot"), schedules)


def mix_report(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, schedules=RAMPS) -> DataFrame:
    """Per document what the mix takes of it and when its first copy is due (null: never), sorted by that time."""
    plan = plan_mix(docs, weights, max_epochs, schedules)
    due = F.when((F.col("taken") > 0) & (F.col("target") > 0), _due(plan, schedules, F.lit(0)))
    out = plan.select("doc_id", "size", "source_size", "target", "taken", due.alias("due"))
    return out.orderBy(F.col("due").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, schedules=RAMPS) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken, in training order, with the columns of ``docs``.

    The document at which the last epoch ends is in it if the epoch reaches its middle. The plan is made without the
    texts; they are joined with it once, by the number of their row.
    """
    own = [F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(docs.columns)]  # whatever their names, they clash with none here
    rows = stored(docs.select(*own, F.monotonically_increasing_id().alias("__number")), "zstd")
    needed = [F.col(f"x{docs.columns.index(c)}").alias(c) for c in ("doc_id", "source", "text")]
    plan = plan_mix(rows.select(*needed, "__number"), weights, max_epochs, schedules, keep=["__number"])
    copies = (F.col("epochs") + F.when((F.col("part") * 2 >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("int")
    taken = plan.filter(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    taken = stored(taken.select("__number", "doc_id", _due(plan, schedules, F.col("__copy")).alias("__due")))
    free_shuffles(docs.sparkSession)
    out = rows.join(taken, "__number").orderBy("__due", "doc_id")
    return out.select(*[F.col(f"x{k}").alias(c) for k, c in enumerate(docs.columns)])
