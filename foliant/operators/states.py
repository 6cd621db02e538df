"""A job's life as an automaton that is run over its log in parts.

An event moves a job to a state if that move is legal; else the job stays where it is and the event counts as illegal. What a stretch of a log does is a map: for each state that a job may be
in before it, the state after it, how many events were illegal, and the first of those. Maps are composed in order, and how they are grouped makes no difference, so stretches
of a long log are folded by themselves, and their maps then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a job, and to which ones it may go from each.
STATES = ("NEW", "QUEUED", "PROCESSING", "SUCCESS", "FAILED")
LEGAL = {"NEW": ("QUEUED",), "QUEUED": ("PROCESSING", "FAILED"), "PROCESSING": ("PROCESSING", "SUCCESS", "FAILED"), "SUCCESS": (), "FAILED": ("PROCESSING",)}
MAP = "array<struct<to:int,illegal:long,first:long>>"
#: Events of a stretch.
STRETCH = 1024


def index(status: Column) -> Column:
    """The place of a state, null for one that isn't known."""
    return F.coalesce(*[F.when(status == s, k) for k, s in enumerate(STATES)])


def nothing() -> Column:
    """The map of no event at all."""
    return F.array(*[F.struct(F.lit(k).alias("to"), F.lit(0).cast("long").alias("illegal"), F.lit(None).cast("long").alias("first")) for k in range(len(STATES))]).cast(MAP)


def moved(so_far: Column, event: Column) -> Column:
    """A map with one more event (status, a state's place; version) behind it."""
    legal = F.array(*[F.array(*[F.lit(t in LEGAL[s]) for t in STATES]) for s in STATES])

    def one(s: Column) -> Column:
        good = F.coalesce(F.get(F.get(legal, s["to"]), event["status"]), F.lit(False))
        return F.struct(F.when(good, event["status"]).otherwise(s["to"]).alias("to"), (s["illegal"] + F.when(good, 0).otherwise(1)).alias("illegal"), F.coalesce(s["first"], F.when(~good, event["version"])).alias("first"))

    return F.transform(so_far, one).cast(MAP)


def composed(first: Column, then: Column) -> Column:
    """The map of one stretch and the next."""
    def one(s: Column) -> Column:
        t = F.get(then, s["to"])
        return F.struct(t["to"].alias("to"), (s["illegal"] + t["illegal"]).alias("illegal"), F.coalesce(s["first"], t["first"]).alias("first"))

    return F.transform(first, one).cast(MAP)


def run_log(log: DataFrame, key: str, version: str, stretch: int = STRETCH) -> DataFrame:
    """(key, status, n_events, n_illegal, first_illegal) of each job. ``log``: key, version (a long that rises with time), status; events of one version are taken by status.

    A stretch of a log is what falls into ``stretch`` versions in a row, so no log is sorted as a whole, and no task holds more of one than its stretches' maps.
    """
    event = F.struct(F.col(version).cast("long").alias("version"), index(F.col("status")).alias("status"))
    rows = log.select(key, F.floor(F.col(version) / stretch).alias("part"), event.alias("e"))
    parts = rows.groupBy(key, "part").agg(F.count("*").alias("n"), F.aggregate(F.array_sort(F.collect_list("e")), nothing(), moved).alias("map"))
    held = F.array_sort(F.collect_list(F.struct("part", "map")))
    whole = parts.groupBy(key).agg(F.sum("n").alias("n_events"), F.aggregate(held, nothing(), lambda m, p: composed(m, p["map"])).alias("map"))
    end = F.col("map")[0]  # a job is new before its first event
    return whole.select(key, F.get(F.array(*map(F.lit, STATES)), end["to"]).alias("status"), "n_events", end["illegal"].alias("n_illegal"), end["first"].alias("first_illegal"))
