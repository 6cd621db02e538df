"""Queries on job logs (events), confidence levels, history and golden scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import values as V
from foliant.operators import jobs as J
from foliant.sources.tables import table

STATUS = {"click": "QUEUED", "view": "PROCESSING", "purchase": "SUCCESS"}


def log(spark, d):
    """Events as a job log: the user is the job, the kind of event its status, the value its progress."""
    kind = F.col("event_type")
    status = F.when(kind == "click", "QUEUED").when(kind == "view", "PROCESSING").when(kind == "purchase", "SUCCESS").otherwise("FAILED")
    return table(spark, d, "events").select("user_id", "event_id", status.alias("status"), F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))).cast("int").alias("progress"))


def jobs(spark, d):
    return J.latest(log(spark, d), "user_id", "event_id")


def confidence_levels(spark, d):
    rows = table(spark, d, "events").select("event_id", V.confidence(F.col("value") / 100).alias("c"))
    return rows.select("event_id", F.round("c.value", 6).alias("value"), "c.level")


def field_status(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", V.field_status(F.when(F.col("event_id") % 5 != 0, F.col("event_type")), F.col("value") / 100, F.col("event_id") % 3).alias("status"))


def best_candidate(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.round("value").alias("score"))
    return J.best_of(e, ["user_id"], "score", "event_id").select("user_id", "event_id", "score")


def recent_history(spark, d):
    return table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25).select("event_id", F.substring("event_type", 1, 500).alias("kind"))


def artifact_chain(spark, d):
    """Users, their documents and what was made of them: customers, orders, lines."""
    c, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("n_jobs"), F.count("*").alias("n_artifacts"))


QUERIES = {
    "jobs_latest": jobs,
    "jobs_recovered": lambda s, d: J.recover(jobs(s, d)),
    "job_counts": lambda s, d: jobs(s, d).groupBy("status").agg(F.count("*").alias("n_jobs")),
    "confidence_levels": confidence_levels,
    "field_status": field_status,
    "best_candidate": best_candidate,
    "recent_history": recent_history,
    "job_artifact_chain": artifact_chain,
}

LOG = """WITH log AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CAST(least(100, greatest(0, floor(value))) AS INTEGER) AS progress FROM events),
  jobs AS (SELECT user_id, max(event_id) AS event_id, arg_max(status, event_id) AS status, arg_max(progress, event_id) AS progress FROM log GROUP BY user_id)
"""

SQL = {
    "jobs_latest": LOG + "SELECT * FROM jobs",
    "jobs_recovered": LOG + "SELECT user_id, event_id, CASE WHEN status IN ('QUEUED', 'PROCESSING') THEN 'FAILED' ELSE status END AS status, CASE WHEN status IN ('QUEUED', 'PROCESSING') THEN least(progress, 99) ELSE progress END AS progress FROM jobs",
    "job_counts": LOG + "SELECT status, count(*) AS n_jobs FROM jobs GROUP BY status",
    "confidence_levels": "WITH e AS (SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS v FROM events) SELECT event_id, round(v, 6) AS value, CASE WHEN v >= 0.9 THEN 'high' WHEN v >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM e",
    "field_status": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not_found' WHEN value / 100 IS NULL OR value / 100 < 0.7 OR event_id % 3 = 0 THEN 'uncertain' ELSE 'valid' END AS status FROM events",
    "best_candidate": "SELECT user_id, event_id, score FROM (SELECT user_id, event_id, round(value) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(value) DESC, event_id) AS n FROM events) WHERE n = 1",
    "recent_history": "SELECT event_id, event_type AS kind FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
    "job_artifact_chain": "SELECT c_custkey, count(DISTINCT o_orderkey) AS n_jobs, count(*) AS n_artifacts FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey",
}
