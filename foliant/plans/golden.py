"""Queries on golden cases that come as JSON, and on stricter entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import entities as E
from foliant.operators import evaluation as EV
from foliant.plans.invoices import INVOICES, invoice_lines
from foliant.sources.kept import kept
from foliant.sources.tables import table


def payloads(spark, d):
    """Parts as golden cases, the parts of one size a dataset: even sizes with a threshold of their own, odd ones as a bare list, each tenth cut off."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    text = lambda s: F.lit(s)
    rows = lambda name, brand, *more: F.array(F.array(text("Name"), text("Brand")), F.array(name, brand), *more)
    last = F.array(F.col("p_type"), F.col("p_size").cast("string"))
    seen = F.concat(text("  "), F.upper("p_name"))
    found = F.when(key % 4 == 1, rows(seen, F.col("p_brand"))).when(key % 4 == 0, rows(seen, F.concat(F.col("p_brand"), text("x")), last)).otherwise(rows(seen, F.col("p_brand"), last))
    span = lambda k: F.struct(k.alias("row"), F.lit(1).alias("column"), F.when(k > 1, 2).alias("row_span"), F.lit(2).alias("col_span"))
    spans = F.transform(F.sequence(F.lit(1), 1 + key % 3), lambda k: span(k.cast("int")))
    heads = F.array(*[F.struct(text("top").alias("parent"), text(c).alias("child")) for c in "abcd"])
    want = F.struct(rows(F.col("p_name"), F.col("p_brand"), last).alias("rows"), spans.alias("merged_cells"), heads.alias("header_hierarchy"))
    have = F.struct(found.alias("rows"), F.when(key % 5 == 0, F.slice(spans, 1, 1)).otherwise(spans).alias("merged_cells"), F.when(key % 6 == 0, F.slice(heads, 1, 3)).otherwise(heads).alias("header_hierarchy"))
    case = F.struct(F.when(key % 7 > 0, F.concat(text("part "), key.cast("string"))).alias("name"), want.alias("expected"), have.alias("actual"))
    sets = p.groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(case).alias("case")))), lambda c: c["case"]).alias("cases"))
    held, size = F.concat(text("["), F.array_join("cases", ","), text("]")), F.col("p_size")
    payload = F.when(size % 10 == 5, F.concat(text('{"cases":'), F.substring(held, 1, 40))).when(size % 2 == 0, F.concat(text('{"pass_threshold":0.97,"cases":'), held, text("}"))).otherwise(held)
    return sets.select(F.concat(text("size "), size).alias("dataset"), payload.alias("payload"))


def cases(spark, d):
    return EV.golden_json_cases(EV.golden_datasets(kept(payloads(spark, d))))


def scores(spark, d):
    return EV.golden_json_scores(kept(cases(spark, d)))


def results(spark, d):
    sets = kept(EV.golden_datasets(payloads(spark, d)))
    return EV.golden_json_results(sets, EV.golden_json_scores(kept(EV.golden_json_cases(sets))))


def strict_values(spark, d):
    """Values of invoices by the stricter patterns, of which none overlaps another."""
    found = E.entities(invoice_lines(spark, d), strict=True)
    return found.select("doc_id", "line_no", "entity_type", F.coalesce(F.round("number", 6).cast("string"), "normal_text").alias("value"))


QUERIES = {
    "golden_json_cases": lambda s, d: scores(s, d).drop("case_id"),
    "golden_scores": results,
    "golden_broken": lambda s, d: EV.golden_datasets(payloads(s, d)).filter("broken IS NOT NULL").select("dataset", "broken"),
    "entities_strict": strict_values,
}

SCORES = """WITH p AS (SELECT 'size ' || p_size AS dataset, p_size, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 5 / 6 WHEN 1 THEN 4 / 6 ELSE 1.0 END AS a, CASE WHEN p_partkey % 5 = 0 THEN 1 / (1 + p_partkey % 3) ELSE 1.0 END AS m,
    CASE WHEN p_partkey % 6 = 0 THEN 0.75 ELSE 1.0 END AS h FROM part WHERE p_size % 10 <> 5),
  s AS (SELECT dataset, p_size, CASE WHEN k % 7 > 0 THEN 'part ' || k ELSE 'unnamed' END AS name, round(CAST(a AS DOUBLE), 4) AS cell_accuracy, round(CAST(m AS DOUBLE), 4) AS merged_cell_recall, round(CAST(h AS DOUBLE), 4) AS header_accuracy,
    round((CAST(a AS DOUBLE) + CAST(m AS DOUBLE) + CAST(h AS DOUBLE)) / 3, 4) AS structural_accuracy FROM p)
"""
SQL = {
    "golden_json_cases": SCORES + "SELECT dataset, name, cell_accuracy, merged_cell_recall, header_accuracy, structural_accuracy FROM s",
    "golden_scores": SCORES + "SELECT dataset, count(*) AS n_cases, (2 * sum(CAST(round(structural_accuracy * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000 AS average, sum(CAST(round(structural_accuracy * 10000) AS BIGINT)) / count(*) / 10000 >= CASE WHEN p_size % 2 = 0 THEN 0.97 ELSE 0.9 END AS passed FROM s GROUP BY dataset, p_size",
    "golden_broken": "SELECT DISTINCT 'size ' || p_size AS dataset, 'no JSON' AS broken FROM part WHERE p_size % 10 = 5",
    "entities_strict": INVOICES + """SELECT doc_id, 1 AS line_no, 'Invoice_Number' AS entity_type, number AS value FROM v UNION ALL SELECT doc_id, 1, 'Date', day FROM v UNION ALL SELECT doc_id, 1, 'Tax_Code', tax_code FROM v
      UNION ALL SELECT doc_id, 1, 'VAT_Rate', CAST(rate AS VARCHAR) FROM v WHERE rate IS NOT NULL UNION ALL SELECT doc_id, 1, 'MONEY', CAST(subtotal AS VARCHAR) FROM v
      UNION ALL SELECT doc_id, 2, 'Subtotal', CAST(subtotal AS VARCHAR) FROM v UNION ALL SELECT doc_id, 3, 'Grand_Total', CAST(total AS VARCHAR) FROM v""",
}
