"""Queries on tables: cells are order lines (quantity, unit price, total), a table to an order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import values as V
from foliant.functions.text import header_key, sheet_base, sheet_kind
from foliant.operators import tables as T
from foliant.operators.grouped import dealt
from foliant.operators.headers import similar_headers
from foliant.sources.kept import kept
from foliant.sources.tables import table


def lines(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return dealt(table(spark, d, "lineitem").join(part, "l_partkey"), "l_orderkey").withColumn("n", F.row_number().over(order))


def rows(spark, d):
    """Rows as arrays: a header, then for each line its cells, and under every third a continuation line; headers come twice."""
    row = lambda at, *cells: F.struct(at.alias("row_idx"), F.array(*cells).alias("cells"))
    at = F.col("n") * 10
    body = row(at, F.concat(F.lit(" "), "p_name"), F.col("l_quantity").cast("int").cast("string"), F.format_number("p_retailprice", 2), F.format_number("l_extendedprice", 2))
    more = F.when(F.col("n") % 3 == 0, row(at + 1, F.lit("with  support")))
    heads = [F.when(F.col("n") == 1, row(F.lit(k), *map(F.lit, names))) for k, names in ((0, ("Description", "Qty", "Unit Price", "Line Total")), (15, ("DESCRIPTION", "qty", "Unit price", "Line total")))]
    made = F.filter(F.array(body, more, *heads), lambda r: r.isNotNull())
    return lines(spark, d).select(F.col("l_orderkey").alias("table_id"), F.explode(made).alias("r")).select("table_id", "r.row_idx", "r.cells")


def cells(spark, d):
    held = T.drop_repeated_headers(T.pad_rows(rows(spark, d)))
    return held.select("table_id", "row_idx", F.posexplode("cells").alias("col_idx", "text"))


def multiline_collapse(spark, d):
    items = T.collapse_lines(T.drop_repeated_headers(T.pad_rows(rows(spark, d))))
    return items.select("table_id", "item_no", "description", F.col("cells")[1].alias("quantity"))


def typed_cells(spark, d):
    typed = cells(spark, d).withColumn("v", V.typed_value(F.col("text")))
    return typed.groupBy("table_id", "col_idx").agg(F.round(F.sum("v.number"), 2).alias("total"), F.count("v.text").alias("n_texts"), F.count_if(V.cell_type(F.col("text")) == "number").alias("n_numbers"), F.count_if(V.data_type(F.col("text")) == "number").alias("n_plain"))


def sheet_names(spark, d):
    """A sheet's name for each nation's order priorities; a name that is taken gets a number."""
    header = F.concat_ws(" ", F.lit("Payment"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "amount").otherwise("stock"))
    rows_ = table(spark, d, "customer").select("c_custkey", "c_nationkey", sheet_kind(header).alias("kind"))
    rows_ = rows_.withColumn("base", sheet_base(F.concat("kind", F.lit("_Page"), (F.col("c_custkey") % 5 + 1).cast("string"))))
    n = F.row_number().over(Window.partitionBy("c_nationkey", "base").orderBy("c_custkey"))
    return rows_.select("c_custkey", F.when(n == 1, F.col("base")).otherwise(F.concat(F.substring("base", 1, 25), F.lit("-"), n.cast("string"))).alias("sheet"))


def header_hierarchy(spark, d):
    """Parents and children of header cells: part brands over part types, with gaps to fill."""
    p = table(spark, d, "part").withColumn("col_idx", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return T.header_hierarchy(p.select(F.col("p_brand").alias("table_id"), "col_idx", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("").alias("parent"), F.col("p_name").alias("child")))


def unique_headers(spark, d):
    p = table(spark, d, "part").withColumn("col_idx", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return T.unique_headers(p.select(F.col("p_brand").alias("table_id"), "col_idx", F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_type")).alias("text")))


def width_cosine(spark, d):
    """Each table's widths against those of the next order's table."""
    v = kept(T.width_vectors(cells(spark, d)).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "width"))), lambda x: x["width"]).alias("v")))  # both sides read it
    other = v.select((F.col("table_id") - 1).alias("table_id"), F.col("v").alias("w"))
    return v.join(other, "table_id").select("table_id", F.round(T.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


def header_similarity(spark, d):
    """Part types and names that are nearly alike as headers."""
    p = table(spark, d, "part")
    kinds = p.select(F.split("p_type", " ").alias("h")).unionByName(p.select(F.split("p_name", " ").alias("h"))).select(F.transform("h", header_key).alias("k"))
    return similar_headers(kinds, 0.8).select(F.array_join("left", " ").alias("left_header"), F.array_join("right", " ").alias("right_header"), "ratio")


def continued(spark, d):
    """Order lines by ship month: months in a row with the same return flag are one table."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), month.alias("page")).agg(F.max("l_returnflag").alias("header"), F.count("*").alias("n_rows"))
    return T.continued_on_next_page(t)


QUERIES = {
    "table_normalized": cells,
    "multiline_collapse": multiline_collapse,
    "typed_cells": typed_cells,
    "header_hierarchy": header_hierarchy,
    "unique_headers": unique_headers,
    "column_width_vectors": lambda s, d: T.width_vectors(cells(s, d)),
    "width_cosine": width_cosine,
    "header_similarity": header_similarity,
    "table_quality": lambda s, d: T.table_quality(cells(s, d)),
    "line_item_arithmetic": lambda s, d: T.line_arithmetic(T.drop_repeated_headers(T.pad_rows(rows(s, d)))),
    "table_continuation": continued,
    "sheet_names": sheet_names,
}

CELLS = """WITH li AS (SELECT l.*, p_name, p_retailprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS n FROM lineitem l JOIN part ON l_partkey = p_partkey),
 body AS (SELECT l_orderkey AS table_id, n * 10 AS row_idx, [trim(regexp_replace(p_name, '\\s+', ' ', 'g')), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), format('{:,.2f}', p_retailprice), format('{:,.2f}', l_extendedprice)] AS cells, n FROM li),
 arr AS (SELECT table_id, row_idx, cells FROM body
   UNION ALL SELECT table_id, row_idx + 1, ['with support', '', '', ''] FROM body WHERE n % 3 = 0
   UNION ALL SELECT DISTINCT table_id, 0, ['Description', 'Qty', 'Unit Price', 'Line Total'] FROM body),
 cells AS (SELECT table_id, CAST(row_idx AS INTEGER) AS row_idx, CAST(i - 1 AS INTEGER) AS col_idx, cells[i] AS text FROM arr, (SELECT unnest([1, 2, 3, 4]) AS i))
"""
VECTORS = """, n AS (SELECT table_id, col_idx, CAST(sum(length(trim(text))) AS DOUBLE) AS n FROM cells GROUP BY ALL),
 vec AS (SELECT table_id, col_idx, round(n / sqrt(sum(n * n) OVER (PARTITION BY table_id)), 6) AS width FROM n)
"""
PARTS = "WITH p AS (SELECT p_brand AS table_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS col_idx, * FROM part)"

SQL = {
    "table_normalized": CELLS + "SELECT * FROM cells",
    "multiline_collapse": CELLS + """, p AS (SELECT *, CASE WHEN row_idx % 10 = 1 THEN 0 ELSE 1 END AS fresh FROM arr),
      g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY table_id ORDER BY row_idx) AS BIGINT) AS item_no FROM p)
      SELECT table_id, item_no, string_agg(cells[1], chr(10) ORDER BY row_idx) AS description, arg_min(cells[2], row_idx) AS quantity FROM g GROUP BY table_id, item_no""",
    "typed_cells": CELLS + r""", t AS (SELECT *, regexp_replace(text, '[^0-9,.-]', '', 'g') AS c FROM cells), n AS (SELECT *, CASE WHEN regexp_full_match(c, '[-+]?[0-9][0-9.,]*') THEN CAST(replace(c, ',', '') AS DOUBLE) END AS x FROM t)
      SELECT table_id, col_idx, round(sum(x), 2) AS total, count_if(x IS NULL) AS n_texts, count_if(regexp_full_match(replace(text, ' ', ''), '[-+]?[0-9][0-9.,]*')) AS n_numbers, count_if(regexp_full_match(replace(text, ' ', ''), '[-+]?[0-9]+([.,][0-9]+)?')) AS n_plain
      FROM n GROUP BY table_id, col_idx""",
    "header_hierarchy": PARTS + " SELECT table_id, col_idx, last_value(CASE WHEN p_partkey % 3 = 0 THEN p_type END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY col_idx ROWS UNBOUNDED PRECEDING) AS parent, nullif(trim(p_name), '') AS child FROM p",
    "unique_headers": PARTS + """, b AS (SELECT table_id, col_idx, CASE WHEN p_partkey % 7 = 0 THEN 'Column ' || col_idx ELSE p_type END AS base FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY table_id, base ORDER BY col_idx) AS n FROM b)
      SELECT table_id, col_idx, CASE WHEN n = 1 THEN base ELSE base || ' (' || n || ')' END AS header FROM r""",
    "column_width_vectors": CELLS + VECTORS + "SELECT * FROM vec",
    "width_cosine": CELLS + VECTORS + "SELECT a.table_id, round(sum(a.width * b.width), 6) AS similarity FROM vec a JOIN vec b ON b.table_id = a.table_id + 1 AND a.col_idx = b.col_idx GROUP BY a.table_id",
    "table_quality": CELLS + """SELECT table_id, max(row_idx) - min(row_idx) AS n_rows, 4 AS n_columns, round(count_if(text <> '') / count(*), 3) AS cell_density, round(1 - count_if(text <> '') / count(*), 3) AS empty_cell_ratio FROM cells GROUP BY table_id""",
    "line_item_arithmetic": CELLS + """SELECT l_orderkey AS table_id, CAST(n * 10 AS INTEGER) AS row_idx, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS quantity, round(p_retailprice, 2) AS price, round(l_extendedprice, 2) AS total,
      abs(CAST(l_quantity AS INTEGER) * round(p_retailprice, 2) - round(l_extendedprice, 2)) > greatest(0.01, abs(round(l_extendedprice, 2)) * 0.01) AS conflict FROM li""",
    "table_continuation": """WITH t AS (SELECT l_suppkey AS doc_id, year(l_shipdate) * 12 + month(l_shipdate) AS page, max(l_returnflag) AS header, count(*) AS n_rows FROM lineitem GROUP BY ALL),
      s AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND header = lag(header) OVER w THEN 0 ELSE 1 END AS start FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
      r AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM s)
      SELECT doc_id, CAST(min(page) AS INTEGER) AS first_page, CAST(max(page) AS INTEGER) AS last_page, count(*) AS n_parts, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM r GROUP BY doc_id, run""",
    "sheet_names": """WITH k AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'Payments' ELSE 'Table' END || '_Page' || (c_custkey % 5 + 1) AS base FROM customer),
      r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, base ORDER BY c_custkey) AS n FROM k)
      SELECT c_custkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS sheet FROM r""",
}
