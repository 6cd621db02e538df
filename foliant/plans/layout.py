"""Queries on positions, whole tables, golden scores, evidence and audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.values import parse_options
from foliant.operators import audit as A
from foliant.operators import evaluation as EV
from foliant.operators import folds
from foliant.operators import layout as LY
from foliant.plans import tables as TP
from foliant.plans.documents import P, docs, lines, pages
from foliant.sources.kept import kept
from foliant.sources.tables import table


def words(spark, d):
    """Order lines as words of a page: the quantity says how far down one stands, the part how far to the right."""
    top, x0 = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 600).cast("int")
    text = F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), top.alias("top"), x0.alias("x0"), (x0 + 40).alias("x1"), (top + 12).alias("bottom"), text.alias("text"),
        (F.col("l_linenumber") % 2).cast("int").alias("block"), (F.col("l_suppkey") % 3).cast("int").alias("line"), (1 - F.col("l_tax")).alias("confidence"), (F.col("l_linenumber") % 3).cast("int").alias("page"), "l_returnflag")


def ocr_lines(spark, d):
    rows = LY.token_lines(words(spark, d))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("top", "x0", "block", "line"))
    return rows.select("doc_id", place.alias("line_no"), "text", "x0", "top", "x1", "bottom", F.round("confidence", 6).alias("confidence"))


def ocr_confidence(spark, d):
    """Mean confidence of recognised pages of a document, 1 where none was: pages with a returned line count as recognised."""
    rows = words(spark, d).groupBy("doc_id", "page").agg(F.avg("confidence").alias("c"), F.max(F.col("l_returnflag") == "R").alias("used"))
    return rows.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("used"), F.col("c"))), F.lit(1.0)), 6).alias("confidence"), F.count_if("used").alias("n_recognised"))


def text_quality(spark, d):
    """How good the recognised lines of each order look."""
    rows = LY.token_lines(words(spark, d))
    return rows.select("doc_id", "block", "line", F.round(LY.ocr_quality(F.col("confidence"), F.col("text")), 6).alias("quality"))


def order_tables(spark, d):
    """A customer's orders as the tables of a document, one a page; every third one leaves its header out."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))), lambda x: F.array(F.concat(F.lit("part "), x["l_partkey"].cast("string")), F.when(x["l_linenumber"] % 4 == 0, "").otherwise(x["l_quantity"].cast("int").cast("string")), F.format_number(x["l_extendedprice"], 2)))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(body.alias("body"))
    rows = li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
    head = F.when(F.col("l_orderkey") % 3 == 0, F.array().cast("array<array<string>>")).when(F.col("l_orderkey") % 3 == 1, F.array(F.array(*map(F.lit, ("Item", "Qty", "Amount"))))).otherwise(F.array(F.array(F.lit("Item"), F.lit("Units"), F.col("o_orderpriority"))))
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey"))
    return rows.select(F.col("o_custkey").alias("doc_id"), (page + F.floor(page / 5)).cast("int").alias("page"), F.lit(1).alias("place"), F.concat(head, "body").alias("rows"), "l_orderkey")


def merged_cells(spark, d):
    found = folds.merged_cells(order_tables(spark, d).select(F.col("l_orderkey").alias("table_id"), "rows"))
    return found.select("table_id", F.explode("spans").alias("s")).select("table_id", "s.*")


def continuations(spark, d):
    return folds.merge_continuations(order_tables(spark, d)).select("doc_id", "first_page", "last_page", F.size("rows").alias("n_rows"))


def structures(spark, d):
    """How many tables have one structure."""
    head = F.col("rows")[0]
    rows = order_tables(spark, d).select(folds.structure_key(head).alias("structure"), F.array_join(folds.header_signature(head), "|").alias("signature"))
    return rows.filter("signature LIKE 'item|%'").groupBy("structure", "signature").agg(F.count("*").alias("n_tables"))


def golden(spark, d):
    """Order tables as golden cases: what was found misses some cells, merged cells and headers."""
    want = kept(TP.cells(spark, d).withColumnRenamed("table_id", "case_id"))  # every share reads them
    wrong = (F.col("case_id") + F.col("row_idx") + F.col("col_idx")) % 11 == 0
    found = want.withColumn("text", F.when(wrong, F.concat("text", F.lit("x"))).otherwise(F.concat(F.lit("  "), F.upper("text"))))
    cases = want.select("case_id").distinct()
    span = F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("case_id") % 3))
    spans = cases.select("case_id", span.alias("row")).select("case_id", "row", F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(2).alias("col_span"))
    heads = cases.select("case_id", F.explode(F.array(*map(F.lit, ("a", "b", "c", "d")))).alias("child")).withColumn("parent", F.lit("top"))
    return EV.case_scores(cases, (want, found), (spans, spans.filter("case_id % 4 <> 0 OR row = 1")), (heads, heads.filter("child <> 'd' OR case_id % 5 > 0")))


def block_objects(spark, d):
    quote = F.when(F.col("line_no") % 9 == 0, "").otherwise(F.col("text"))
    engine = F.when(F.col("page_number") % 2 == 0, "ocr").otherwise("native")
    rows = lines(spark, d).withColumn("engine", engine).withColumn("object_id", F.concat(F.lit("b"), F.col("line_no").cast("string")))
    return rows.withColumn("evidence", A.evidence(F.col("page_number"), F.col("object_id"), quote, F.col("engine"))).withColumn("confidence", (F.length("text") % 97) / 97)


def page_objects(spark, d):
    rows = pages(spark, d).withColumn("object_id", F.concat(F.lit("p"), F.col("page_number").cast("string")))
    return rows.withColumn("evidence", A.evidence(F.col("page_number"), F.col("object_id"), F.when(F.col("n_lines") > 2, F.col("text")).otherwise(""), F.lit("native")))


def audit(spark, d):
    whole = docs(spark, d).select("doc_id", F.lit(None).cast("int").alias("page_number"), F.col("doc_id").cast("string").alias("object_id"), "source", F.lit(1.0).alias("confidence"), F.lit("native").alias("engine"), F.struct(F.col("n_chars").alias("chars")).alias("evidence"))
    return A.audit_rows(document=whole.withColumnRenamed("source", "raw_value"), block=block_objects(spark, d).withColumnRenamed("text", "raw_value"))


def pages_with_stats(spark, d):
    """All pages with the statistics that there are for them; pages with few lines have none."""
    p = pages(spark, d).select("doc_id", "page_number", "n_lines")
    stats = p.filter("n_lines > 3").select("doc_id", "page_number", (F.col("n_lines") * 2).alias("stat"))
    return p.join(stats, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.coalesce("stat", F.lit(0)).alias("stat"))


def page_text_choice(spark, d):
    """On mixed pages the native text and the recognised text in a row; else the one there is."""
    p = pages(spark, d).select("doc_id", "page_number", F.when(F.col("page_number") % 3 > 0, F.col("text")).alias("native"), F.when(F.col("page_number") % 3 != 1, F.concat(F.lit("~ "), "text")).alias("ocr"))
    return p.select("doc_id", "page_number", F.concat_ws("\n", "native", "ocr").alias("text"), F.when(F.col("ocr").isNotNull(), "ocr").otherwise("native").alias("blocks_from"))


def overview(spark, d):
    """Label rows of a document and the list of its merged tables: pages, rows without the header, columns."""
    t = folds.merge_continuations(order_tables(spark, d))
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    return t.select("doc_id", F.array_join(F.col("source_pages").cast("array<string>"), ", ").alias("source_pages"), (F.size("rows") - 1).alias("n_rows"), width.alias("n_columns"))


def job_settings(spark, d):
    """What an event's properties, as JSON, set over defaults; broken JSON changes nothing."""
    e = table(spark, d, "events").withColumn("given", F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    both = A.merged_settings(F.create_map(F.lit("mode"), F.lit("auto"), F.lit("k"), F.lit("none")), parse_options(F.col("given")))
    return e.select("event_id", both["mode"].alias("mode"), both["k"].alias("k"), F.size(both).alias("n_keys"))


QUERIES = {
    "word_lines": lambda s, d: LY.word_lines(words(s, d)),
    "ocr_token_lines": ocr_lines,
    "ocr_confidence": ocr_confidence,
    "ocr_text_quality": text_quality,
    "median_height": lambda s, d: words(s, d).groupBy("doc_id").agg(LY.upper_median("top").alias("median_height")),
    "visual_lines": lambda s, d: LY.visual_lines(words(s, d)),
    "merged_cells": merged_cells,
    "continuation_merge": continuations,
    "table_routes": lambda s, d: folds.route_tables(order_tables(s, d)).select("doc_id", "page", "place_in_document", "route"),
    "table_structures": structures,
    "golden_cases": golden,
    "golden_dataset": lambda s, d: EV.dataset_score(golden(s, d).withColumn("part", F.col("case_id") % 10), ["part"]),
    "evidence_coverage": lambda s, d: A.coverage(block_objects(s, d), page_objects(s, d)),
    "table_consistency": lambda s, d: A.equal_widths(TP.rows(s, d)),
    "audit_rows": audit,
    "pages_with_stats": pages_with_stats,
    "page_text_choice": page_text_choice,
    "table_overview": overview,
    "job_settings": job_settings,
}

WORDS = """WITH RECURSIVE w0 AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS INTEGER) AS top, CAST(l_partkey % 600 AS INTEGER) AS x0, l_returnflag || l_linenumber || '-' || l_suppkey AS text,
    CAST(l_linenumber % 2 AS INTEGER) AS block, CAST(l_suppkey % 3 AS INTEGER) AS line, 1 - l_tax AS confidence, l_linenumber % 3 AS page, l_returnflag FROM lineitem),
  w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top, x0, text) AS rn FROM w0),
  r AS (SELECT doc_id, rn, top, x0, text, top AS anchor, 1 AS line_no FROM w WHERE rn = 1
    UNION ALL SELECT w.doc_id, w.rn, w.top, w.x0, w.text, CASE WHEN abs(w.top - r.anchor) > 4 THEN w.top ELSE r.anchor END, r.line_no + CASE WHEN abs(w.top - r.anchor) > 4 THEN 1 ELSE 0 END
    FROM r JOIN w ON w.doc_id = r.doc_id AND w.rn = r.rn + 1)
"""
OBJECTS = P + """, b AS (SELECT *, CASE WHEN page_number % 2 = 0 THEN 'ocr' ELSE 'native' END AS engine, 'b' || line_no AS object_id, CASE WHEN line_no % 9 = 0 THEN '' ELSE text END AS quote, length(text) % 97 / 97 AS confidence FROM lines),
  pn AS (SELECT doc_id, page_number, count(*) AS n_lines FROM lines GROUP BY ALL)
"""
GOLDEN = TP.CELLS + """, c AS (SELECT table_id AS case_id, count_if((table_id + row_idx + col_idx) % 11 <> 0) / count(*) AS a FROM cells GROUP BY table_id),
  s AS (SELECT case_id, a, CAST(CASE WHEN case_id % 4 <> 0 THEN 1 ELSE 1 / (1 + case_id % 3) END AS DOUBLE) AS m, CAST(CASE WHEN case_id % 5 > 0 THEN 1 ELSE 0.75 END AS DOUBLE) AS h FROM c),
  g AS (SELECT case_id, round(a, 4) AS cell_accuracy, round(m, 4) AS merged_cell_recall, round(h, 4) AS header_accuracy, round((a + m + h) / 3, 4) AS structural_accuracy FROM s)
"""

SQL = {
    "word_lines": WORDS + """SELECT doc_id, 1 AS page_number, CAST(line_no AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY x0, top, text) AS text, min(x0) AS x0, min(top) AS top, max(x0) + 40 AS x1, max(top) + 12 AS bottom, CAST(0.98 AS DOUBLE) AS confidence
      FROM r GROUP BY doc_id, line_no""",
    "ocr_token_lines": WORDS + """, l AS (SELECT doc_id, block, line, string_agg(text, ' ' ORDER BY x0, text) AS text, min(x0) AS x0, min(top) AS top, max(x0) + 40 AS x1, max(top) + 12 AS bottom, round(avg(confidence), 6) AS confidence FROM w0 GROUP BY doc_id, block, line)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY top, x0, block, line) AS INTEGER) AS line_no, text, x0, top, x1, bottom, confidence FROM l""",
    "ocr_confidence": WORDS + """, p AS (SELECT doc_id, page, avg(confidence) AS c, bool_or(l_returnflag = 'R') AS used FROM w0 GROUP BY doc_id, page)
      SELECT doc_id, round(coalesce(avg(c) FILTER (used), 1.0), 6) AS confidence, count_if(used) AS n_recognised FROM p GROUP BY doc_id""",
    "ocr_text_quality": WORDS + r""", l AS (SELECT doc_id, block, line, string_agg(text, ' ' ORDER BY x0, text) AS text, avg(confidence) AS c FROM w0 GROUP BY doc_id, block, line),
      t AS (SELECT *, length(regexp_replace(text, '[\s\x0B]', '', 'g')) AS n, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS s FROM l)
      SELECT doc_id, block, line, round(0.55 * c + 0.25 * coalesce(s / nullif(n, 0), 0) + 0.20 * least(1.0, s / 30), 6) AS quality FROM t""",
    "median_height": WORDS + "SELECT doc_id, list_sort(list(top))[len(list(top)) // 2 + 1] AS median_height FROM w0 GROUP BY doc_id",
    "table_structures": """WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'Item|Qty|Amount' ELSE 'Item|Units|' || o_orderpriority END AS h FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
      SELECT '3:' || lower(h) AS structure, lower(h) AS signature, count(*) AS n_tables FROM o GROUP BY h""",
    "golden_cases": GOLDEN + "SELECT * FROM g",
    "golden_dataset": GOLDEN + "SELECT case_id % 10 AS part, count(*) AS n_cases, round(sum(structural_accuracy) / count(*), 4) AS average, sum(structural_accuracy) / count(*) >= 0.9 AS passed FROM g GROUP BY case_id % 10",
    "evidence_coverage": OBJECTS + """, a AS (SELECT doc_id, line_no % 9 <> 0 AS ok FROM lines UNION ALL SELECT doc_id, n_lines > 2 FROM pn), k AS (SELECT doc_id, count_if(ok) AS covered, count(*) AS total FROM a GROUP BY doc_id)
      SELECT doc_id, covered, total, round(covered / total, 4) AS coverage, CASE WHEN covered / total >= 0.95 THEN 'valid' WHEN covered / total >= 0.70 THEN 'uncertain' ELSE 'invalid' END AS status FROM k""",
    "table_consistency": "SELECT l_orderkey AS table_id, CASE WHEN count(*) >= 3 THEN 2 ELSE 1 END AS n_widths, CASE WHEN count(*) >= 3 THEN 'uncertain' ELSE 'valid' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "audit_rows": OBJECTS + """SELECT doc_id, 'document' AS kind, CAST(NULL AS INTEGER) AS page_number, CAST(doc_id AS VARCHAR) AS object_id, source AS raw_value, 1.0 AS confidence, 'native' AS engine, '{"chars":' || n_chars || '}' AS evidence FROM documents
      UNION ALL SELECT doc_id, 'block', page_number, object_id, text, round(confidence, 4), engine,
        CASE WHEN quote <> '' THEN CAST(to_json(struct_pack(page := page_number, object_id := object_id, quote := substr(quote, 1, 500), engine := engine)) AS VARCHAR) END FROM b""",
    "pages_with_stats": OBJECTS + "SELECT doc_id, page_number, CASE WHEN n_lines > 3 THEN n_lines * 2 ELSE 0 END AS stat FROM pn",
    "page_text_choice": P + """SELECT doc_id, page_number, CASE page_number % 3 WHEN 0 THEN '~ ' || text WHEN 1 THEN text ELSE text || chr(10) || '~ ' || text END AS text, CASE WHEN page_number % 3 = 1 THEN 'native' ELSE 'ocr' END AS blocks_from FROM pages""",
    "job_settings": """SELECT event_id, 'auto' AS mode, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE json_extract_string(props, '$.k') END AS k, 2 AS n_keys FROM events""",
}
