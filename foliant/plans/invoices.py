"""Queries on invoices rendered from orders, and on the entities found in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import values as V
from foliant.operators import entities as E
from foliant.operators.grouped import dealt
from foliant.plans.documents import P, lines
from foliant.sources.tables import table

#: DuckDB and Spark render the same four notations of an amount in cents.
AMOUNT = """CASE {k} % 4
  WHEN 0 THEN {us} || '.' || lpad(CAST({c} % 100 AS STRING), 2, '0') || ' USD'
  WHEN 1 THEN replace({us}, ',', '.') || ',' || lpad(CAST({c} % 100 AS STRING), 2, '0') || ' €'
  WHEN 2 THEN replace({us}, ',', '.') || ' VND'
  ELSE {whole} || '.' || lpad(CAST({c} % 100 AS STRING), 2, '0') END"""
SPARK_AMOUNT = AMOUNT.format(k="o_orderkey", c="cents", us="format_number(cents div 100, 0)", whole="CAST(cents div 100 AS STRING)")
DUCK_AMOUNT = AMOUNT.format(k="o_orderkey", c="cents", us="format('{:,}', cents // 100)", whole="CAST(cents // 100 AS VARCHAR)").replace("STRING", "VARCHAR")
DUCK_CENTS = "WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"


def orders(spark, d):
    return table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


def money_roundtrip(spark, d):
    rows = orders(spark, d).select("o_orderkey", F.expr(SPARK_AMOUNT).alias("shown"))
    return rows.select("o_orderkey", "shown", V.parse_money(F.col("shown")).alias("amount"))


def percent_roundtrip(spark, d):
    shown = F.expr("replace(CAST(CAST(round(l_tax * 100) AS INT) AS STRING), '.', ',') || ' %'")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.parse_percent(shown), 6).alias("rate"))


def date_roundtrip(spark, d):
    shown = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'd/M/yyyy')
                      WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy') ELSE date_format(o_orderdate, 'MM/dd/yyyy') END""")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(V.parse_date(shown), "yyyy-MM-dd").alias("day"))


def invoice_lines(spark, d):
    """Three lines per order, as ``rendered``, the orders being dealt before anything is found in them."""
    rows = rendered(dealt(orders(spark, d).select("o_orderkey", "o_custkey", "o_orderdate", "cents"), "o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("doc_id"), "line_no", F.lit(1).alias("page_number"), "text")


def invoice_texts():
    """The three lines of an order as an invoice would have it, as an array; every third one leaves the VAT rate out."""
    text = F.concat(
        F.lit("Invoice #: INV-"), F.col("o_orderkey").cast("string"), F.lit(" | Date: "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit(" | MST: "), F.lpad(F.col("o_custkey").cast("string"), 10, "0"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(" | VAT: "), (F.col("o_orderkey") % 11).cast("string"), F.lit("%"))),
        F.lit(" | Net: "), F.expr("CAST(cents div 100 AS STRING)"), F.lit(" USD"))
    second = F.concat(F.lit("Subtotal: "), F.expr("CAST(cents div 100 AS STRING)"), F.lit(" USD"))
    third = F.concat(F.lit("Grand Total: "), F.expr("CAST((cents div 100) * (100 + o_orderkey % 11) div 100 + CASE WHEN o_orderkey % 7 = 0 THEN (cents div 100) div 10 + 5 ELSE 0 END AS STRING)"), F.lit(" USD"))
    return F.array(text, second, third)


def rendered(orders, *carry):
    """(o_orderkey, carry, line_no, text): the lines of orders."""
    rows = orders.select("o_orderkey", *carry, F.posexplode(invoice_texts()).alias("k", "text"))
    return rows.select("o_orderkey", *carry, (F.col("k") + 1).alias("line_no"), "text")


INVOICES = """WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
  v AS (SELECT o_orderkey AS doc_id, 'INV-' || o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS tax_code,
    CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 11) / 100 END AS rate, CAST(cents // 100 AS DOUBLE) AS subtotal,
    CAST((cents // 100) * (100 + o_orderkey % 11) // 100 + CASE WHEN o_orderkey % 7 = 0 THEN (cents // 100) // 10 + 5 ELSE 0 END AS DOUBLE) AS total FROM o)
"""


def invoice_entities(spark, d):
    return E.entities(invoice_lines(spark, d))


def document_entities(spark, d):
    return E.entities(lines(spark, d).select("doc_id", "page_number", "line_no", "text"))


def labelled_values(spark, d):
    found = invoice_entities(spark, d).filter(F.col("entity_type").isin("Invoice_Number", "Date", "Tax_Code", "VAT_Rate", "Subtotal", "Grand_Total"))
    return found.select("doc_id", "line_no", "entity_type", F.coalesce(F.round("number", 6).cast("string"), "normal_text").alias("value"))


def entity_facts_summary(spark, d):
    """Facts by kind and status over documents and invoices."""
    both = E.facts(document_entities(spark, d)).unionByName(E.facts(invoice_entities(spark, d)))
    return both.groupBy("entity_type", "status").agg(F.count("*").alias("n_facts"), F.countDistinct("doc_id").alias("n_docs"))


def emails(spark, d):
    return document_entities(spark, d).filter("entity_type = 'EMAIL'").select("doc_id", "page_number", "line_no", "raw_value")


def amount_edges(spark, d):
    return E.amount_edges(E.facts(invoice_entities(spark, d))).groupBy("doc_id").agg(F.count("*").alias("n_edges"), F.min("predicate").alias("predicate"))


def vat(spark, d):
    """Subtotal, grand total and rate of each invoice; a missing rate is inferred where it would be 0 to 30 percent."""
    found = E.entities(invoice_lines(spark, d), ("Subtotal", "Grand_Total", "VAT_Rate"))
    return vat_status(found).filter("subtotal IS NOT NULL AND total IS NOT NULL")


def vat_status(found):
    """Of every document with entities, also of those without a subtotal or total, whose arithmetic can't fail."""
    rows = E.last_numbers(found, Subtotal="subtotal", Grand_Total="total", VAT_Rate="rate")
    guess = F.col("total") / F.when(F.col("subtotal") != 0, F.col("subtotal")) - 1
    guess = F.when(F.col("rate").isNull() & (guess >= 0) & (guess <= 0.30), guess)
    rows = rows.withColumn("inferred", guess).withColumn("used", F.coalesce("rate", "inferred"))
    wrong = V.breaks_tolerance(F.col("subtotal") + F.col("subtotal") * F.col("used"), F.col("total"))
    return rows.withColumn("status", F.when(F.col("used").isNull(), "uncertain").when(wrong, "invalid").otherwise("valid"))


def conflicting_facts(spark, d):
    """Facts of invoices whose arithmetic fails: all of a document's facts turn to conflicting. Status and facts come from one look at the lines."""
    wrong = F.col("status") == "invalid"
    return vat_status(E.facts(invoice_entities(spark, d))).select("doc_id", F.when(wrong, "CONFLICTING").otherwise("KEPT").alias("state"), wrong.alias("any_conflict"))


QUERIES = {
    "money_roundtrip": money_roundtrip,
    "percent_roundtrip": percent_roundtrip,
    "date_roundtrip": date_roundtrip,
    "entities_documents": lambda s, d: document_entities(s, d).select("doc_id", "page_number", "line_no", "entity_type", "raw_value"),
    "entities_labelled": labelled_values,
    "entity_emails": emails,
    "entity_facts_summary": entity_facts_summary,
    "fact_edges": amount_edges,
    "vat_arithmetic": lambda s, d: vat(s, d).select("doc_id", "subtotal", "total", "status"),
    "vat_inference": lambda s, d: vat(s, d).filter("inferred IS NOT NULL").select("doc_id", F.round("inferred", 4).alias("inferred")),
    "conflicting_facts": conflicting_facts,
}

VAT = INVOICES + """, g AS (SELECT *, CASE WHEN rate IS NULL AND subtotal <> 0 AND total / subtotal - 1 BETWEEN 0 AND 0.30 THEN total / subtotal - 1 END AS inferred FROM v),
  u AS (SELECT *, coalesce(rate, inferred) AS used FROM g),
  c AS (SELECT *, CASE WHEN used IS NULL THEN 'uncertain' WHEN abs(subtotal + subtotal * used - total) > greatest(0.01, abs(total) * 0.01) THEN 'invalid' ELSE 'valid' END AS status FROM u)
"""

LABELLED = INVOICES + """, t AS (SELECT doc_id, 2 AS line_no, 'Grand_Total' AS entity_type, subtotal AS x FROM v UNION ALL SELECT doc_id, 3, 'Grand_Total', total FROM v WHERE total <> subtotal UNION ALL SELECT doc_id, 2, 'Subtotal', subtotal FROM v),
  labelled AS (SELECT doc_id, line_no, entity_type, CAST(x AS VARCHAR) AS value FROM t
    UNION ALL SELECT doc_id, 1, 'Invoice_Number', number FROM v UNION ALL SELECT doc_id, 1, 'Date', day FROM v UNION ALL SELECT doc_id, 1, 'Tax_Code', tax_code FROM v
    UNION ALL SELECT doc_id, 1, 'VAT_Rate', CAST(rate AS VARCHAR) FROM v WHERE rate IS NOT NULL)
"""

SQL = {
    "money_roundtrip": DUCK_CENTS + f" SELECT o_orderkey, {DUCK_AMOUNT} AS shown, CASE WHEN o_orderkey % 4 = 2 THEN CAST(cents // 100 AS DOUBLE) ELSE cents / 100 END AS amount FROM o",
    "percent_roundtrip": "SELECT l_orderkey, l_linenumber, round(round(l_tax * 100) / 100, 6) AS rate FROM lineitem",
    "date_roundtrip": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 AND day(o_orderdate) <= 12
        THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
    "entity_emails": P + r""", m AS (SELECT doc_id, page_number, line_no, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS raw_value FROM lines)
        SELECT doc_id, page_number, min(line_no) AS line_no, raw_value FROM m GROUP BY doc_id, page_number, raw_value""",
    "entities_labelled": LABELLED + "SELECT * FROM labelled",
    "fact_edges": INVOICES + "SELECT doc_id, CAST(CASE WHEN subtotal = total THEN 1 ELSE 2 END AS BIGINT) AS n_edges, 'has_amount' AS predicate FROM v",
    "vat_arithmetic": VAT + "SELECT doc_id, subtotal, total, status FROM c",
    "vat_inference": VAT + "SELECT doc_id, round(inferred, 4) AS inferred FROM c WHERE inferred IS NOT NULL",
    "conflicting_facts": VAT + "SELECT doc_id, CASE WHEN status = 'invalid' THEN 'CONFLICTING' ELSE 'KEPT' END AS state, status = 'invalid' AS any_conflict FROM c",
}
