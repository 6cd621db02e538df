"""Page signals, document profiles and processing plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_signals(pages: DataFrame, least_chars: int = 24, table_lines: int = 30) -> DataFrame:
    """What each page looks like, from its number of characters and lines."""
    chars = F.length("text")
    return pages.select(
        "doc_id", "page_number", chars.alias("chars"), (chars >= least_chars).alias("native_text"), (chars == 0).alias("blank"),
        ((chars > 0) & (chars < least_chars)).alias("sparse"), (F.col("n_lines") >= table_lines).alias("table_signal"), (chars < least_chars).alias("ocr_recommended"))


def document_profile(signals: DataFrame) -> DataFrame:
    """One row per document: kind of source, complexity, quality label and score."""
    rolled = signals.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.count_if("native_text").alias("native_pages"), F.count_if("blank").alias("blank_pages"),
        F.count_if("table_signal").alias("table_pages"), F.count_if("sparse").alias("low_quality_pages"), F.count_if("ocr_recommended").alias("ocr_pages"))
    rolled = rolled.withColumn("table_heavy", F.col("table_pages") >= F.greatest(F.lit(1), F.floor(F.col("page_count") / 3)))
    score = F.least(F.lit(100), F.col("page_count") * 2 + F.col("table_pages") * 5 + F.col("low_quality_pages") * 4 + F.when(F.col("table_heavy"), 20).otherwise(0))
    rolled = rolled.withColumn("complexity_score", score)
    level = F.col("complexity_score")
    return rolled.select(
        "doc_id", "page_count", "ocr_pages", "table_heavy", "complexity_score",
        F.when(F.col("native_pages") == F.col("page_count"), "native").when(F.col("native_pages") == 0, "scan").otherwise("mixed").alias("source_type"),
        F.when(level > 80, "extreme").when(level > 60, "very_complex").when(level > 40, "complex").when(level > 20, "normal").otherwise("easy").alias("complexity"),
        F.when(F.col("blank_pages") > 0, "low").when(F.col("ocr_pages") > 0, "medium").otherwise("high").alias("label"),
        F.round(1 - F.col("ocr_pages") / F.col("page_count"), 3).alias("score"))


def processing_plan(profile: DataFrame) -> DataFrame:
    """Stages, engine and cost class of each document; advice that nothing else depends on."""
    kind = F.col("source_type")
    stages = F.concat(
        F.array(*map(F.lit, ("ingest", "validate", "profile"))),
        F.when(kind == "native", F.array(F.lit("native_parse"))).when(kind == "scan", F.array(F.lit("preprocess"), F.lit("ocr"))).otherwise(F.array(F.lit("native_parse"), F.lit("preprocess"), F.lit("ocr"))),
        F.array(F.lit("layout_analysis")),
        F.when(F.col("table_heavy"), F.array(*map(F.lit, ("table_detection", "table_structure", "table_validation")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("label") == "low", F.array(F.lit("quality_review"))).otherwise(F.array().cast("array<string>")),
        F.array(*map(F.lit, ("canonicalize", "quality_validate", "export"))))
    engine = F.when(kind == "native", "native-pdf").when(kind == "scan", "tesseract").otherwise("hybrid")
    cost = F.when(kind == "scan", "high").when(F.col("table_heavy"), "medium").otherwise("low")
    return profile.select("doc_id", F.array_join(stages, ",").alias("stages"), engine.alias("primary_engine"), cost.alias("estimated_cost"))


#: Characters from which on text is native, below which a page with images is image-heavy; drawn objects that hint at a table.
NATIVE_FROM, HEAVY_BELOW, DRAWN = 24, 80, 8


def full_signals(pages: DataFrame) -> DataFrame:
    """What each page looks like, from its text, images, tables and drawn objects (counts; null: none), with its warnings and whether it is to be recognised."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = pages.select("doc_id", "page_number", F.length(text).alias("chars"), n("images").alias("images"), n("tables").alias("tables"), n("vectors").alias("vectors"))
    chars = F.col("chars")
    rows = rows.withColumns({"native_text": chars >= NATIVE_FROM, "image_heavy": (F.col("images") > 0) & (chars < HEAVY_BELOW), "blank": (chars == 0) & (F.col("images") == 0), "table_signal": (F.col("tables") > 0) | (F.col("vectors") >= DRAWN)})
    sparse = (chars > 0) & (chars < NATIVE_FROM)
    warnings = F.array_compact(F.array(F.when(F.col("blank"), "blank_page"), F.when(F.col("image_heavy"), "image_heavy"), F.when(sparse, "sparse_native_text")))
    rows = rows.withColumns({"sparse": sparse, "warnings": warnings})
    return rows.withColumn("ocr_recommended", ~F.col("native_text") | F.col("image_heavy") | (F.size("warnings") > 0))


def full_profile(signals: DataFrame) -> DataFrame:
    """One row per document from ``full_signals``: kind of source, complexity, quality label and score, its warnings and the pages to be recognised."""
    count = lambda c: F.count_if(F.col(c))
    rows = signals.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), count("native_text").alias("native_pages"), count("blank").alias("blank_pages"), count("image_heavy").alias("image_heavy_pages"), count("table_signal").alias("table_pages"),
        F.count_if(F.col("image_heavy") | F.col("sparse")).alias("low_quality_pages"), count("ocr_recommended").alias("ocr_pages"), F.array_sort(F.collect_list(F.when(F.col("ocr_recommended"), F.col("page_number")))).alias("ocr_page_numbers"))
    n, t, i, low = (F.col(c) for c in ("page_count", "table_pages", "image_heavy_pages", "low_quality_pages"))
    rows = rows.withColumn("table_heavy", t >= F.greatest(F.lit(1), F.floor(n / 3)))
    rows = rows.withColumn("complexity_score", F.least(F.lit(100), n * 2 + t * 5 + i * 6 + low * 4 + F.when(F.col("table_heavy"), 20).otherwise(0)))
    level = F.col("complexity_score")
    return rows.select(
        "doc_id", "page_count", "native_pages", "blank_pages", "image_heavy_pages", "table_pages", "low_quality_pages", "ocr_pages", "ocr_page_numbers", "table_heavy", "complexity_score",
        F.when(F.col("native_pages") == n, "native").when(F.col("native_pages") == 0, "scan").otherwise("mixed").alias("source_type"),
        F.when(level > 80, "extreme").when(level > 60, "very_complex").when(level > 40, "complex").when(level > 20, "normal").otherwise("easy").alias("complexity"),
        F.when((F.col("blank_pages") > 0) | (i > 0), "low").when(F.col("ocr_pages") > 0, "medium").otherwise("high").alias("label"), F.round(1 - F.col("ocr_pages") / n, 3).alias("score"),
        F.array_compact(F.array(F.when(i > 0, "ocr_required_on_image_pages"), F.when(low > 0, "low_native_text_quality_on_some_pages"))).alias("warnings"))
