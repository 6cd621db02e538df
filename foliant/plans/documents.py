"""Queries on the text of documents: lines, pages, noise, profiles, page operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.text import VOWELS, is_noise
from foliant.operators import lines as L
from foliant.operators.clusters import gap_clusters
from foliant.operators.grouped import dealt
from foliant.operators.profile import document_profile, page_signals, processing_plan
from foliant.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def lines(spark, d):
    return L.split_lines(docs(spark, d))


def pages(spark, d):
    return L.page_texts(lines(spark, d))


def dealt_lines(spark, d):
    """Lines of documents that are dealt to all tasks first: a look for noise is far more work than reading."""
    return L.split_lines(dealt(docs(spark, d).select("doc_id", "text"), "doc_id"))


def noise_lines(spark, d):
    return dealt_lines(spark, d).filter(is_noise(F.col("text"), cleaned=True)).select("doc_id", "line_no", "text")


def kept_lines(spark, d):
    return dealt_lines(spark, d).filter(~is_noise(F.col("text"), cleaned=True)).groupBy("doc_id").agg(F.count("*").alias("n_kept"))


def duplicate_docs(spark, d):
    """Rows whose text a row with a smaller id has too, by fingerprint."""
    rows = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    first = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "fingerprint").filter("doc_id > first_id").select("doc_id", "first_id", "fingerprint")


def page_rows(spark, d):
    return pages(spark, d).select("doc_id", "page_number", F.length("text").alias("n_chars"), F.lit(0).alias("rotation"))


def merge_pages(spark, d):
    rows = page_rows(spark, d).join(docs(spark, d).select("doc_id", "source", "lang"), "doc_id")
    return L.merge_pages(rows.withColumn("volume", F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 10))), "volume").select("volume", "doc_id", "page_number", "merged_page")


def text_sheet_rows(spark, d):
    return L.page_breaks(lines(spark, d)).select("doc_id", "page_number", "line_no", "kind", "value")


def placeholder_text(spark, d):
    kept = dealt_lines(spark, d).filter(~is_noise(F.col("text"), cleaned=True))
    text = L.page_texts(kept).select("doc_id", "page_number", F.col("text").alias("kept_text"))
    every = pages(spark, d).select("doc_id", "page_number")
    return every.join(text, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.coalesce("kept_text", F.lit("[no text layer]")).alias("text"))


def signals(spark, d):
    return page_signals(pages(spark, d))


def result_metadata(spark, d):
    """A document's figures as JSON, read back as fields."""
    profile = document_profile(signals(spark, d))
    packed = profile.select("doc_id", F.to_json(F.struct("page_count", "source_type", "complexity", "label")).alias("metadata"))
    return packed.select("doc_id", *[F.get_json_object("metadata", f"$.{c}").alias(c) for c in ("page_count", "source_type", "complexity", "label")])


def language_list(spark, d):
    return docs(spark, d).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.count("*").alias("n_docs"))


def split_pages(spark, d):
    return page_rows(spark, d).select("doc_id", "page_number", F.concat("doc_id", F.lit("-page-"), "page_number", F.lit(".txt")).alias("artifact"), "n_chars")


def similar_lengths(spark, d):
    """Documents in clusters of neighbouring lengths inside their source: a gap above 12 characters starts a cluster."""
    rows = docs(spark, d).select("doc_id", "source", "lang", "n_chars")
    return gap_clusters(rows, ["source", "lang"], "n_chars", "doc_id").select("doc_id", "cluster")


QUERIES = {
    "line_split": lines,
    "page_full_text": lambda s, d: L.full_texts(pages(s, d)),
    "noise_lines": noise_lines,
    "kept_lines": kept_lines,
    "doc_fingerprint": lambda s, d: docs(s, d).select("doc_id", F.sha2("text", 256).alias("fingerprint")),
    "duplicate_docs": duplicate_docs,
    "extract_pages": lambda s, d: L.extract_pages(page_rows(s, d), L.page_numbers("1, 3-4", 4)).select("doc_id", "page_number", "n_chars"),
    "delete_pages": lambda s, d: L.delete_pages(page_rows(s, d), L.page_numbers("1", 1)).select("doc_id", "page_number", "n_chars"),
    "delete_refused": lambda s, d: L.fully_chosen(page_rows(s, d), [1]),
    "rotate_pages": lambda s, d: L.rotate_pages(page_rows(s, d).withColumn("rotation", F.col("page_number") % 4 * 90), 270).select("doc_id", "page_number", "rotation"),
    "merge_pages": merge_pages,
    "split_pages": split_pages,
    "text_sheet_rows": text_sheet_rows,
    "text_with_placeholder": placeholder_text,
    "page_signals": signals,
    "document_profile": lambda s, d: document_profile(signals(s, d)),
    "processing_plan": lambda s, d: processing_plan(document_profile(signals(s, d))),
    "result_metadata": result_metadata,
    "language_list": language_list,
    "column_clusters": similar_lengths,
}

LINES = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
raw AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS t FROM parts),
lines AS (SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST((n - 1) // 40 + 1 AS INTEGER) AS page_number, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM raw WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> ''),
pages AS (SELECT doc_id, page_number, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL),
"""
NOISE = r"""
sized AS (SELECT *, length(replace(text, ' ', '')) AS solid, length(regexp_replace(text, '[\p{L}\p{N}_\s]', '', 'g')) AS odd, lower(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters FROM lines),
tested AS (SELECT *, length(text) >= 6 AND (odd / solid > 0.40
    OR (length(letters) >= 6 AND length(regexp_replace(letters, '[VOWELS]', '', 'g')) / length(letters) >= 0.85 AND len(list_distinct(string_split(letters, ''))) <= greatest(3, length(letters) // 2))
    OR len(list_distinct(string_split(text, ''))) = 1) AS noise FROM sized)
""".replace("VOWELS", VOWELS)
SIGNALS = r"""
stats AS (SELECT doc_id, page_number, length(text) AS chars, n_lines FROM pages),
signals AS (SELECT doc_id, page_number, chars, chars >= 24 AS native_text, chars = 0 AS blank, chars > 0 AND chars < 24 AS sparse, n_lines >= 30 AS table_signal, chars < 24 AS ocr_recommended FROM stats),
rolled AS (SELECT doc_id, count(*) AS page_count, count_if(native_text) AS native_pages, count_if(blank) AS blank_pages, count_if(table_signal) AS table_pages, count_if(sparse) AS low_quality_pages, count_if(ocr_recommended) AS ocr_pages FROM signals GROUP BY doc_id),
heavy AS (SELECT *, table_pages >= greatest(1, page_count // 3) AS table_heavy FROM rolled),
scored AS (SELECT *, least(100, page_count * 2 + table_pages * 5 + low_quality_pages * 4 + CASE WHEN table_heavy THEN 20 ELSE 0 END) AS complexity_score FROM heavy),
profile AS (SELECT doc_id, page_count, ocr_pages, table_heavy, complexity_score,
  CASE WHEN native_pages = page_count THEN 'native' WHEN native_pages = 0 THEN 'scan' ELSE 'mixed' END AS source_type,
  CASE WHEN complexity_score > 80 THEN 'extreme' WHEN complexity_score > 60 THEN 'very_complex' WHEN complexity_score > 40 THEN 'complex' WHEN complexity_score > 20 THEN 'normal' ELSE 'easy' END AS complexity,
  CASE WHEN blank_pages > 0 THEN 'low' WHEN ocr_pages > 0 THEN 'medium' ELSE 'high' END AS label,
  round(1 - ocr_pages / page_count, 3) AS score FROM scored)
"""
P = LINES.rstrip().rstrip(",") + "\n"

SQL = {
    "line_split": P + "SELECT * FROM lines",
    "page_full_text": P + ", titled AS (SELECT doc_id, page_number, '--- Page ' || page_number || ' ---' || chr(10) || text AS t FROM pages) SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM titled GROUP BY doc_id",
    "noise_lines": LINES + NOISE + "SELECT doc_id, line_no, text FROM tested WHERE noise",
    "kept_lines": LINES + NOISE + "SELECT doc_id, count(*) AS n_kept FROM tested WHERE NOT noise GROUP BY doc_id",
    "doc_fingerprint": "SELECT doc_id, sha256(text) AS fingerprint FROM documents",
    "duplicate_docs": "SELECT * FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, sha256(text) AS fingerprint FROM documents) WHERE doc_id > first_id",
    "extract_pages": P + "SELECT doc_id, page_number, CAST(length(text) AS INTEGER) AS n_chars FROM pages WHERE page_number IN (1, 3, 4)",
    "delete_pages": P + "SELECT doc_id, page_number, CAST(length(text) AS INTEGER) AS n_chars FROM pages WHERE page_number <> 1",
    "delete_refused": P + "SELECT doc_id, bool_and(page_number = 1) AS refused FROM pages GROUP BY doc_id",
    "rotate_pages": P + "SELECT doc_id, page_number, (page_number % 4 * 90 + 270) % 360 AS rotation FROM pages",
    "merge_pages": P + "SELECT source || '/' || lang || '/' || (doc_id // 10) AS volume, doc_id, page_number, CAST(row_number() OVER (PARTITION BY source || '/' || lang || '/' || (doc_id // 10) ORDER BY doc_id, page_number) AS INTEGER) AS merged_page FROM pages JOIN documents USING (doc_id)",
    "split_pages": P + "SELECT doc_id, page_number, doc_id || '-page-' || page_number || '.txt' AS artifact, CAST(length(text) AS INTEGER) AS n_chars FROM pages",
    "text_sheet_rows": P + """SELECT doc_id, page_number, min(line_no) AS line_no, 0 AS kind, '--- Page ' || page_number || ' ---' AS value FROM lines GROUP BY doc_id, page_number
      UNION ALL SELECT doc_id, page_number, line_no, 1, text FROM lines""",
    "text_with_placeholder": LINES + NOISE + """, good AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY line_no) AS t FROM tested WHERE NOT noise GROUP BY ALL)
      SELECT p.doc_id, p.page_number, coalesce(g.t, '[no text layer]') AS text FROM pages p LEFT JOIN good g ON p.doc_id = g.doc_id AND p.page_number = g.page_number""",
    "page_signals": LINES + SIGNALS + "SELECT doc_id, page_number, CAST(chars AS INTEGER) AS chars, native_text, blank, sparse, table_signal, ocr_recommended FROM signals",
    "document_profile": LINES + SIGNALS + "SELECT * FROM profile",
    "processing_plan": LINES + SIGNALS + """SELECT doc_id,
      'ingest,validate,profile,' || CASE source_type WHEN 'native' THEN 'native_parse,' WHEN 'scan' THEN 'preprocess,ocr,' ELSE 'native_parse,preprocess,ocr,' END || 'layout_analysis,'
      || CASE WHEN table_heavy THEN 'table_detection,table_structure,table_validation,' ELSE '' END || CASE WHEN label = 'low' THEN 'quality_review,' ELSE '' END || 'canonicalize,quality_validate,export' AS stages,
      CASE source_type WHEN 'native' THEN 'native-pdf' WHEN 'scan' THEN 'tesseract' ELSE 'hybrid' END AS primary_engine,
      CASE WHEN source_type = 'scan' THEN 'high' WHEN table_heavy THEN 'medium' ELSE 'low' END AS estimated_cost FROM profile""",
    "result_metadata": LINES + SIGNALS + "SELECT doc_id, CAST(page_count AS VARCHAR) AS page_count, source_type, complexity, label FROM profile",
    "language_list": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS n_docs FROM documents GROUP BY source",
    "column_clusters": """WITH g AS (SELECT doc_id, source, lang, n_chars, CASE WHEN n_chars - lag(n_chars) OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) > 12 THEN 1 ELSE 0 END AS gap FROM documents)
      SELECT doc_id, CAST(sum(gap) OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g""",
}
