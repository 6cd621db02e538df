"""Tables that only the alignment of words shows: columns begin where words of several lines begin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.layout import numbered_words

#: How far apart the left edges of a column's words may be, and how many lines must share one.
EDGE, SUPPORT = 3.0, 2


def column_edges(words: DataFrame, tolerance: float = EDGE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, page_number, edges): left edges of columns, ascending: runs of words' left edges, no gap above ``tolerance``, over ``support`` lines at least. ``words``: those of numbered_words."""
    across = Window.partitionBy("doc_id", "page_number").orderBy("x0")
    starts = words.select("doc_id", "page_number", "line_no", "x0").withColumn("new", F.when(F.col("x0") - F.lag("x0").over(across) <= tolerance, 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(across.rangeBetween(Window.unboundedPreceding, 0)))
    edges = runs.groupBy("doc_id", "page_number", "run").agg(F.min("x0").alias("edge"), F.countDistinct("line_no").alias("lines")).filter(F.col("lines") >= support)
    return edges.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def text_tables(words: DataFrame, tolerance: float = EDGE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, page, place, strategy, rows): the table of each page whose words stand in two columns and two lines at least.

    ``words``: doc_id, page_number, text, x0, top, x1, bottom. A word belongs to the last edge that it doesn't begin before, one before all edges to the first. A page without edges has none.
    """
    numbered = numbered_words(words)
    edges = column_edges(numbered, tolerance, support).filter(F.size("edges") >= 2).withColumnsRenamed({"doc_id": "d", "page_number": "p"})
    on = numbered.join(edges, (F.col("doc_id") == F.col("d")) & (F.col("page_number") == F.col("p")))
    column = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e <= F.col("x0"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda w: w["text"]), " ")
    cells = on.groupBy("doc_id", "page_number", "line_no", column.alias("c")).agg(text.alias("text"), F.max(F.size("edges")).alias("n"))
    found = F.map_from_entries(F.collect_list(F.struct("c", "text")))
    rows = cells.groupBy("doc_id", "page_number", "line_no").agg(found.alias("held"), F.max("n").alias("n"))
    row = F.transform(F.sequence(F.lit(1), F.col("n")), lambda c: F.coalesce(F.try_element_at("held", c), F.lit("")))
    tables = rows.select("doc_id", "page_number", "line_no", row.alias("row")).groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "row"))), lambda r: r["row"]).alias("rows"))
    return eligible(tables.select("doc_id", F.col("page_number").alias("page"), F.lit(1).alias("place"), F.lit("text").alias("strategy"), "rows"))


def eligible(tables: DataFrame, rows: int = 2, columns: int = 2) -> DataFrame:
    """Tables with so many rows and columns at least; rows without any text don't count and go."""
    solid = F.filter("rows", lambda r: F.exists(r, lambda x: F.coalesce(x, F.lit("")) != ""))
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    return tables.withColumn("rows", solid).filter((F.size("rows") >= rows) & (width >= columns))


def one_of_each(tables: DataFrame, order: list[str]) -> DataFrame:
    """Of tables of a page that several strategies found alike, the one of the first strategy in ``order``.

    Alike: the same number of rows and columns, the same first three and last two rows. ``tables``: doc_id, page, place, strategy, rows.
    """
    n, width = F.size("rows"), F.array_max(F.transform("rows", lambda r: F.size(r)))
    sign = F.struct(n.alias("n"), width.alias("w"), F.slice("rows", 1, 3).alias("top"), F.slice("rows", F.greatest(n - 1, F.lit(1)), F.lit(2)).alias("end"))
    rank = F.coalesce(*[F.when(F.col("strategy") == s, k) for k, s in enumerate(order)], F.lit(len(order)))
    first = Window.partitionBy("doc_id", "page", F.xxhash64("sign"), "sign").orderBy(rank, "place")
    return tables.withColumn("sign", sign).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "sign")
