"""Queries on the signals of web pages, times, boxes, flags, whole tables and single jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import values as V
from foliant.operators import jobs as J
from foliant.operators import layout as LY
from foliant.operators import lines as L
from foliant.operators import profile as PF
from foliant.operators import tables as T
from foliant.plans import tables as TP
from foliant.plans.documents import LINES, NOISE, lines
from foliant.plans.layout import WORDS, words
from foliant.sources.tables import table


def web_pages(spark, d):
    """Web pages as the pages of their host: the text of the article, ads as images, list items as drawn objects."""
    host = F.regexp_extract("url", "://([^/]*)", 1)
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    n = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, d, "pages").select(host.alias("doc_id"), F.col("page_id").alias("page_number"), F.regexp_replace(article, "<[^>]*>", "").alias("text"), n("<div class=\"ad\">").alias("images"), n("<table").alias("tables"), n("<li>").alias("vectors"))


def web_signals(spark, d):
    rows = PF.full_signals(web_pages(spark, d))
    return rows.select("doc_id", "page_number", "chars", "images", "native_text", "image_heavy", "blank", "table_signal", "ocr_recommended", F.array_join("warnings", ",").alias("warnings"))


def web_profiles(spark, d):
    rows = PF.full_profile(PF.full_signals(web_pages(spark, d)))
    return rows.withColumns({"ocr_page_numbers": F.array_join(F.col("ocr_page_numbers").cast("array<string>"), ","), "warnings": F.array_join("warnings", ",")})


def iso_times(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", V.iso_time(F.col("ts")).alias("shown"))
    return rows.select("event_id", "shown", (V.parse_iso(F.col("shown")) == F.col("ts").cast("timestamp")).alias("same"))


def line_boxes(spark, d):
    m = LY.box_measures()
    rows = LY.word_lines(words(spark, d)).withColumns(m)
    return rows.select("doc_id", "line_no", "width", "height", F.array_join(F.transform("box", lambda x: x.cast("int").cast("string")), ",").alias("box"))


def whole_tables(spark, d):
    """Order tables from raw rows to what is worked on, with two columns of one name; a repeated header doesn't equal the header any more once that is numbered, so it stays."""
    named = TP.rows(spark, d).withColumn("cells", F.transform("cells", lambda x: F.when(F.lower(x).isin("unit price", "line total"), "Price").otherwise(x)))
    rows = T.normalized(named)
    return rows.select("table_id", F.array_join(F.col("rows")[0], "|").alias("header"), (F.size("rows") - 1).alias("n_rows"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "~")).alias("digest"), T.header_repeated(F.col("rows")).alias("header_repeated"))


QUERIES = {
    "web_page_signals": web_signals,
    "web_profiles": web_profiles,
    "iso_times": iso_times,
    "line_boxes": line_boxes,
    "whole_tables": whole_tables,
    "noise_flags": lambda s, d: L.flagged_blocks(lines(s, d)).select("doc_id", "line_no", "is_noise"),
    "job_lookup": lambda s, d: J.job_of(table(s, d, "orders"), 7, 0, "o_orderkey", "o_orderkey").unionByName(J.job_of(table(s, d, "orders"), 7, key="o_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus"),
}

WEB = r"""WITH w AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS doc_id, page_id AS page_number, length(trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g'))) AS chars,
    len(regexp_extract_all(html, '<div class="ad">')) AS images, len(regexp_extract_all(html, '<li>')) AS vectors FROM pages),
  s AS (SELECT *, chars >= 24 AS native_text, images > 0 AND chars < 80 AS image_heavy, chars = 0 AND images = 0 AS blank, vectors >= 8 AS table_signal, chars > 0 AND chars < 24 AS sparse FROM w),
  g AS (SELECT *, NOT native_text OR image_heavy OR blank OR sparse AS ocr_recommended, array_to_string(list_filter([CASE WHEN blank THEN 'blank_page' END, CASE WHEN image_heavy THEN 'image_heavy' END, CASE WHEN sparse THEN 'sparse_native_text' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s),
  p AS (SELECT doc_id, count(*) AS page_count, count_if(native_text) AS native_pages, count_if(blank) AS blank_pages, count_if(image_heavy) AS image_heavy_pages, count_if(table_signal) AS table_pages, count_if(image_heavy OR sparse) AS low_quality_pages,
    count_if(ocr_recommended) AS ocr_pages, coalesce(string_agg(CASE WHEN ocr_recommended THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS ocr_page_numbers FROM g GROUP BY doc_id),
  h AS (SELECT *, table_pages >= greatest(1, page_count // 3) AS table_heavy FROM p), c AS (SELECT *, least(100, page_count * 2 + table_pages * 5 + image_heavy_pages * 6 + low_quality_pages * 4 + CASE WHEN table_heavy THEN 20 ELSE 0 END) AS complexity_score FROM h)
"""
SQL = {
    "web_page_signals": WEB + "SELECT doc_id, page_number, chars, images, native_text, image_heavy, blank, table_signal, ocr_recommended, warnings FROM g",
    "web_profiles": WEB + """SELECT *, CASE WHEN native_pages = page_count THEN 'native' WHEN native_pages = 0 THEN 'scan' ELSE 'mixed' END AS source_type,
      CASE WHEN complexity_score > 80 THEN 'extreme' WHEN complexity_score > 60 THEN 'very_complex' WHEN complexity_score > 40 THEN 'complex' WHEN complexity_score > 20 THEN 'normal' ELSE 'easy' END AS complexity,
      CASE WHEN blank_pages > 0 OR image_heavy_pages > 0 THEN 'low' WHEN ocr_pages > 0 THEN 'medium' ELSE 'high' END AS label, round(1 - ocr_pages / page_count, 3) AS score,
      array_to_string(list_filter([CASE WHEN image_heavy_pages > 0 THEN 'ocr_required_on_image_pages' END, CASE WHEN low_quality_pages > 0 THEN 'low_native_text_quality_on_some_pages' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c""",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS shown, true AS same FROM events",
    "line_boxes": WORDS + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(max(x0) + 40 - min(x0) AS DOUBLE) AS width, CAST(max(top) + 12 - min(top) AS DOUBLE) AS height, min(x0) || ',' || min(top) || ',' || (max(x0) + 40) || ',' || (max(top) + 12) AS box FROM r GROUP BY doc_id, line_no",
    "whole_tables": TP.CELLS + """, q AS (SELECT table_id, row_idx // 10 * 10 AS item, row_idx, cells FROM arr WHERE row_idx > 0 UNION ALL SELECT DISTINCT table_id, 15, 15, ['DESCRIPTION', 'qty', 'Price', 'Price'] FROM arr), i AS (SELECT table_id, item, string_agg(cells[1], chr(10) ORDER BY row_idx) AS a, arg_min(cells, row_idx) AS c FROM q GROUP BY table_id, item),
      t AS (SELECT table_id, count(*) AS n, string_agg(a || '|' || c[2] || '|' || c[3] || '|' || c[4], '~' ORDER BY item) AS body FROM i GROUP BY table_id)
      SELECT table_id, 'Description|Qty|Price|Price (2)' AS header, n AS n_rows, md5('Description|Qty|Price|Price (2)~' || body) AS digest, false AS header_repeated FROM t""",
    "noise_flags": LINES + NOISE + "SELECT doc_id, line_no, noise AS is_noise FROM tested",
    "job_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
}
