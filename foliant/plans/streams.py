"""Queries on streams and automata over the job log, and on clusters of positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.page_ranges import register
from foliant.operators import clusters as C
from foliant.operators import grids as G
from foliant.operators import states as ST
from foliant.plans.documents import P, pages
from foliant.plans.jobs import LOG, log
from foliant.plans.layout import words
from foliant.sources.kept import kept, new_folder
from foliant.sources.tables import table
from foliant.streaming.upsert import LatestTable, keep_latest

SCHEMA = "user_id long, event_id long, status string, progress int"
#: Files that the log is landed in.
FILES = 6


def job_states(spark, d):
    """Where the automaton of a job ends, with how many moves that its log asks for are illegal; statuses follow each other at random here, so many are."""
    return ST.run_log(log(spark, d), "user_id", "event_id", stretch=256)


def jobs_streamed(spark, d):
    """Latest states by a stream: the log lands as files by time, is taken in one file a batch up to a part, then, after a restart, to its end."""
    folder = new_folder(spark)
    log(spark, d).select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).repartitionByRange(FILES, "event_id").write.parquet(f"{folder}/landing")
    table = LatestTable(spark, f"{folder}/jobs", "user_id", "event_id", SCHEMA)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landing")
    keep_latest(stream(), table, f"{folder}/progress")
    log(spark, d).filter("event_id % 5 = 0").write.mode("append").parquet(f"{folder}/landing")  # a part comes twice, which changes nothing
    keep_latest(stream(), table, f"{folder}/progress")
    table.drop_old()
    return table.read()


def dense_columns(spark, d):
    """Words of each order in columns by their left edge: two words within 60 below, or the mean of the column within 60, keep one in it."""
    rows = words(spark, d).withColumn("word", F.xxhash64("text", "top"))
    out = C.dense_clusters(rows, "doc_id", "x0", "word", tolerance=60, min_samples=2)
    return out.groupBy("doc_id", "cluster").agg(F.count("*").alias("n_words"), F.min("x0").alias("left"), F.max("x0").alias("right"))


def aligned_words(spark, d):
    """Words of each order that stand in up to three columns, a little off their edges and lines."""
    n = F.col("l_linenumber") - 1
    x0, top = (n % 3) * 200 + F.col("l_partkey") % 3, F.floor(n / 3) * 20 + F.col("l_suppkey") % 4
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.concat("l_returnflag", F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("text"), x0.alias("x0"), top.alias("top"), (x0 + 40).alias("x1"), (top + 12).alias("bottom"))


def text_tables(spark, d):
    """Cells of the tables that the words' alignment shows, where ruled lines didn't show the same already: those of every fifth order did."""
    found = kept(G.text_tables(aligned_words(spark, d)))
    ruled = found.filter("doc_id % 5 = 0").withColumn("strategy", F.lit("lines"))
    rows = G.one_of_each(ruled.unionByName(found), ["lines", "text"]).select("doc_id", "strategy", F.posexplode("rows").alias("r", "row"))
    return rows.select("doc_id", "strategy", "r", F.posexplode("row").alias("c", "text"))


def page_selection(spark, d):
    """Pages chosen by ranges in a text, by a table function; ranges that go beyond a document's end say so."""
    register(spark)
    ranges = F.element_at(F.array(*map(F.lit, ("1", "2-3, 1", "1-2,2", "9-8"))), (F.col("doc_id") % 4 + 1).cast("int"))
    pages(spark, d).groupBy("doc_id").agg(F.max("page_number").alias("n_pages")).select("doc_id", ranges.alias("ranges"), "n_pages").createOrReplaceTempView("wanted_pages")
    return spark.sql("SELECT doc_id, page, error FROM page_ranges(TABLE(wanted_pages))")


QUERIES = {"job_states": job_states, "jobs_streamed": jobs_streamed, "dense_columns": dense_columns, "text_tables": text_tables, "page_selection": page_selection}

SQL = {
    "jobs_streamed": LOG + "SELECT * FROM jobs",
    "job_states": LOG.replace("WITH log", "WITH RECURSIVE log", 1) + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM log),
      r AS (SELECT user_id, 0 AS rn, 'NEW' AS status, CAST(0 AS BIGINT) AS n_illegal, CAST(NULL AS BIGINT) AS first_illegal FROM n WHERE rn = 1
        UNION ALL SELECT user_id, rn, CASE WHEN good THEN next ELSE status END, n_illegal + CASE WHEN good THEN 0 ELSE 1 END, coalesce(first_illegal, CASE WHEN NOT good THEN event_id END)
        FROM (SELECT r.user_id, n.rn, r.status, n.status AS next, n.event_id, n_illegal, first_illegal,
            (r.status || '>' || n.status) IN ('NEW>QUEUED', 'QUEUED>PROCESSING', 'QUEUED>FAILED', 'PROCESSING>PROCESSING', 'PROCESSING>SUCCESS', 'PROCESSING>FAILED', 'FAILED>PROCESSING') AS good
          FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1))
      SELECT user_id, arg_max(status, rn) AS status, max(rn) AS n_events, max(n_illegal) AS n_illegal, max(first_illegal) AS first_illegal FROM r GROUP BY user_id""",
    "dense_columns": """WITH RECURSIVE w AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 600 AS DOUBLE) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 600) AS rn FROM lineitem),
      r AS (SELECT doc_id, rn, x, [x] AS held, 0 AS cluster FROM w WHERE rn = 1
        UNION ALL SELECT doc_id, rn, x, CASE WHEN stays THEN list_append(held, x) ELSE [x] END, cluster + CASE WHEN stays THEN 0 ELSE 1 END
        FROM (SELECT r.doc_id, w.rn, w.x, held, cluster, len(list_filter(held, lambda y: w.x - y <= 60)) >= 2 OR abs(w.x - list_avg(held)) <= 60 AS stays FROM r JOIN w ON w.doc_id = r.doc_id AND w.rn = r.rn + 1))
      SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n_words, min(x) AS "left", max(x) AS "right" FROM r GROUP BY doc_id, cluster""",
    "text_tables": """WITH RECURSIVE w0 AS (SELECT l_orderkey AS doc_id, (l_linenumber - 1) % 3 * 200 + l_partkey % 3 AS x, (l_linenumber - 1) // 3 * 20 + l_suppkey % 4 AS top, l_returnflag || l_partkey || '/' || l_suppkey AS text FROM lineitem),
      w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top, x, text) AS rn FROM w0),
      r AS (SELECT doc_id, rn, x, top, text, top AS anchor, 1 AS line FROM w WHERE rn = 1
        UNION ALL SELECT w.doc_id, w.rn, w.x, w.top, w.text, CASE WHEN abs(w.top - anchor) > 4 THEN w.top ELSE anchor END, line + CASE WHEN abs(w.top - anchor) > 4 THEN 1 ELSE 0 END FROM r JOIN w ON w.doc_id = r.doc_id AND w.rn = r.rn + 1),
      g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) <= 3 THEN 0 ELSE 1 END AS new FROM r),
      k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x) AS run FROM g),
      e AS (SELECT doc_id, list_sort(list(edge)) AS edges FROM (SELECT doc_id, run, min(x) AS edge FROM k GROUP BY doc_id, run HAVING count(DISTINCT line) >= 2) GROUP BY doc_id HAVING count(*) >= 2),
      c AS (SELECT r.doc_id, line, edges, greatest(1, len(list_filter(edges, lambda v: v <= r.x))) AS c, string_agg(text, ' ' ORDER BY x, top, text) AS text FROM r JOIN e USING (doc_id) GROUP BY ALL),
      n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS r FROM (SELECT doc_id, line, edges FROM c GROUP BY ALL)),
      s AS (SELECT doc_id, line, r, unnest(range(1, len(edges) + 1)) AS c FROM n)
      SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'lines' ELSE 'text' END AS strategy, CAST(r AS INTEGER) AS r, CAST(s.c - 1 AS INTEGER) AS c, coalesce(text, '') AS text FROM s LEFT JOIN c USING (doc_id, line, c)""",
    "page_selection": P + """, n AS (SELECT doc_id, max(page_number) AS n FROM pages GROUP BY doc_id), t AS (SELECT doc_id, n, doc_id % 4 AS k FROM n)
      SELECT doc_id, CAST(page AS INTEGER) AS page, error FROM (SELECT doc_id, unnest(CASE k WHEN 0 THEN [1] WHEN 1 THEN CASE WHEN n >= 3 THEN [1, 2, 3] ELSE [] END WHEN 2 THEN CASE WHEN n >= 2 THEN [1, 2] ELSE [] END ELSE [] END) AS page, NULL AS error FROM t)
      UNION ALL SELECT doc_id, NULL, 'pages ' || CASE k WHEN 1 THEN '2-3' WHEN 2 THEN CASE WHEN n >= 2 THEN '' ELSE '1-2' END ELSE '9-8' END || ' aren''t within 1 to ' || n FROM t WHERE k = 3 OR (k = 1 AND n < 3) OR (k = 2 AND n < 2)""",
}
