"""Table operators on cells in long form (doc_id, page, row_idx, col_idx, text) or on rows as arrays."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foliant.functions.text import clean, header_key, let
from foliant.functions.values import breaks_tolerance, parse_money


def pad_rows(rows: DataFrame) -> DataFrame:
    """Clean every cell and fill rows up to the table's widest; rows without text go. ``rows``: table_id, row_idx, cells."""
    # cells are cleaned below the window and looked at above it, where the optimizer can't clean them twice; its order is that of later steps
    table = Window.partitionBy("table_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("cells", F.transform("cells", clean)).withColumn("width", F.max(F.size("cells")).over(table))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    return rows.filter(F.exists("cells", lambda x: x != "")).withColumn("cells", F.when(F.size("cells") < F.col("width"), filled).otherwise(F.col("cells"))).drop("width")


def unique_headers(cells: DataFrame) -> DataFrame:
    """Header cells (table_id, col_idx, text) with a name of their own: blanks by number, repeats with a count."""
    base = F.coalesce(F.nullif(clean(F.col("text")), F.lit("")), F.concat(F.lit("Column "), F.col("col_idx").cast("string")))
    n = F.row_number().over(Window.partitionBy("table_id", "base").orderBy("col_idx"))
    rows = cells.withColumn("base", base).withColumn("n", n)
    return rows.select("table_id", "col_idx", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("header"))


def with_header(rows: DataFrame) -> DataFrame:
    """Rows with their table's header_idx and header: the first of the first three rows that is at least half and two cells full, else the first.

    Windows over the table alone, so that its rows are dealt once.
    """
    table = Window.partitionBy("table_id")
    place = F.row_number().over(table.orderBy("row_idx"))
    full = F.size(F.filter("cells", lambda x: x != ""))
    good = F.when((F.col("__place") <= 3) & (full >= F.greatest(F.lit(2), F.floor(F.size("cells") / 2))), F.col("row_idx"))
    rows = rows.withColumn("__place", place).withColumn("header_idx", F.coalesce(F.min(good).over(table), F.min("row_idx").over(table))).drop("__place")
    return rows.withColumn("header", F.first(F.when(F.col("row_idx") == F.col("header_idx"), F.col("cells")), ignorenulls=True).over(table))


def of_header(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` of ``with_header`` with what is worked out of their table's header, once for each table, at the header's own row."""
    own = F.when(F.col("row_idx") == F.col("header_idx"), value)
    return rows.withColumn(name, F.first(own, ignorenulls=True).over(Window.partitionBy("table_id")))


def drop_repeated_headers(rows: DataFrame) -> DataFrame:
    """Rows from the header on, without later rows that equal it but for case."""
    first = lambda c: F.lower(F.get(c, F.lit(0)))
    # the first cell decides for almost all rows
    again = first("cells").eqNullSafe(first("header")) & (F.transform("cells", F.lower) == F.transform("header", F.lower))
    kept = with_header(rows).filter((F.col("row_idx") == F.col("header_idx")) | ((F.col("row_idx") > F.col("header_idx")) & ~again))
    return kept.drop("header", "header_idx")


def collapse_lines(rows: DataFrame) -> DataFrame:
    """Rows that hold a description only join the row before, but never the header: (table_id, item_no, description, cells)."""
    w = Window.partitionBy("table_id").orderBy("row_idx")
    rest_empty = ~F.exists(F.slice("cells", F.lit(2), F.size("cells")), lambda x: F.trim(x) != "")
    rows = rows.withColumn("place", F.row_number().over(w))
    new = F.when((F.col("place") > 2) & rest_empty & (F.trim(F.col("cells")[0]) != ""), 0).otherwise(1)
    rows = rows.withColumn("item_no", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_sort(F.collect_list(F.struct("row_idx", "cells")))
    items = rows.groupBy("table_id", "item_no").agg(held.alias("held"))
    return items.select("table_id", "item_no", F.array_join(F.transform("held", lambda r: r["cells"][0]), "\n").alias("description"), F.col("held")[0]["cells"].alias("cells"))


def numbered_names(row: Column) -> Column:
    """Names of a header row: blanks by their place, the second and later ones of a name with a count."""
    named = F.transform(row, lambda x, k: F.coalesce(F.nullif(clean(x), F.lit("")), F.concat(F.lit("Column "), (k + 1).cast("string"))))

    def counted(names: Column) -> Column:
        many = lambda x, k: F.size(F.filter(F.slice(names, 1, k + 1), lambda y: y == x))
        return F.transform(names, lambda x, k: let(many(x, k), lambda n: F.when(n == 1, x).otherwise(F.concat(x, F.lit(" ("), n.cast("string"), F.lit(")")))))

    return let(named, counted)


def normalized(rows: DataFrame) -> DataFrame:
    """Whole tables as they are worked on: (table_id, rows), the header first, its names made unique, then the lines under it.

    ``rows``: table_id, row_idx, cells. Rows are cleaned and filled up, empty ones go; the header is the first of the first three rows that is half full; rows above it and rows that repeat
    it but for case go; rows with a description alone join the one before.
    """
    is_head = F.col("row_idx") == F.col("header_idx")
    kept = of_header(with_header(pad_rows(rows)).filter("row_idx >= header_idx"), "header", numbered_names(F.col("header")))
    kept = kept.withColumn("cells", F.when(is_head, F.col("header")).otherwise(F.col("cells"))).filter(is_head | (F.transform("cells", F.lower) != F.transform("header", F.lower)))
    items = collapse_lines(kept.select("table_id", "row_idx", "cells"))
    row = F.concat(F.array("description"), F.slice("cells", F.lit(2), F.size("cells")))
    return items.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", row.alias("row")))), lambda r: r["row"]).alias("rows"))


def header_repeated(rows: Column) -> Column:
    """Whether a later row of a table (an array of rows, the header first) equals its header."""
    return F.when(F.size(rows) > 1, F.exists(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), lambda r: r == F.get(rows, F.lit(0)))).otherwise(False)


def header_hierarchy(rows: DataFrame) -> DataFrame:
    """Two header rows as cells (table_id, col_idx, parent, child): an empty parent takes the one to its left."""
    w = Window.partitionBy("table_id").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)
    parent = F.last(F.nullif(F.trim("parent"), F.lit("")), ignorenulls=True).over(w)
    return rows.select("table_id", "col_idx", parent.alias("parent"), F.nullif(F.trim("child"), F.lit("")).alias("child"))


def width_vectors(cells: DataFrame) -> DataFrame:
    """Share of each column in a table's text: lengths as a vector of length 1, 6 decimals."""
    sums = cells.groupBy("table_id", "col_idx").agg(F.sum(F.length(F.trim("text"))).cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("table_id")))
    return sums.select("table_id", "col_idx", F.round(F.col("n") / F.when(norm == 0, 1.0).otherwise(norm), 6).alias("width"))


def table_quality(cells: DataFrame) -> DataFrame:
    solid = F.sum(F.when(F.col("text") != "", 1).otherwise(0))
    return cells.groupBy("table_id").agg(
        (F.max("row_idx") - F.min("row_idx")).cast("int").alias("n_rows"), (F.max("col_idx") + 1).cast("int").alias("n_columns"),
        F.round(solid / F.count("*"), 3).alias("cell_density"), F.round(1 - solid / F.count("*"), 3).alias("empty_cell_ratio"))


#: What a header may contain, letters and digits only, to be a quantity, a unit price or a total.
ROLES = {"quantity": ("qty", "quantity", "soluong"), "price": ("unitprice", "price", "dongia"), "total": ("linetotal", "total", "amount", "thanhtien")}


def role_column(header: Column, role: str) -> Column:
    """Place, from 0, of the first header of a role; a header may have several roles; null if none has it."""
    is_role = lambda x: let(header_key(x), lambda key: F.greatest(*[key.contains(a) for a in ROLES[role]]))
    return F.array_min(F.transform(header, lambda x, k: F.when(is_role(x), k)))


def role_numbers(cells: Column, place: Callable[[str], Column]) -> Column:
    """Rows (a column for each role) for ``inline``: the amounts at the roles' places, if all of them are numbers. A filter on columns would have the optimizer read amounts twice."""
    numbers = F.struct(*[parse_money(F.get(cells, place(r))).alias(r) for r in ROLES])
    return F.filter(F.array(numbers), lambda n: n["quantity"].isNotNull() & n["price"].isNotNull() & n["total"].isNotNull())


def line_arithmetic(rows: DataFrame) -> DataFrame:
    """Per line under a table's header whether quantity times price is its total: (table_id, row_idx, quantity, price, total, conflict)."""
    roles = F.struct(*[role_column(F.col("header"), r).alias(r) for r in ROLES])
    under = of_header(with_header(rows), "roles", roles).filter("row_idx > header_idx").dropna(subset=[f"roles.{r}" for r in ROLES])
    lines = under.select("table_id", "row_idx", F.inline(role_numbers(F.col("cells"), lambda r: F.col(f"roles.{r}"))))
    return lines.withColumn("conflict", breaks_tolerance(F.col("quantity") * F.col("price"), F.col("total")))


def ratio_of(left: list[str], right: list[str]) -> float:
    """Mean Ratcliff-Obershelp ratio of two lists of header keys; 0 for lists of different length, or without headers."""
    if not len(left) or len(left) != len(right):
        return 0.0
    return sum(SequenceMatcher(None, x, y).ratio() if x and y else float(x == y) for x, y in zip(left, right)) / len(left)


def likeness(left: list[str], right: list[str], left_widths: list[float], right_widths: list[float], tolerance: float = 0.20) -> float:
    """How alike two tables are: headers count .7 and column widths .3; widths may differ twice as much under nearly equal headers."""
    ratio = ratio_of(left, right)
    if not len(left_widths) or len(left_widths) != len(right_widths):
        return 0.75 * ratio
    gap = sum(abs(a - b) for a, b in zip(left_widths, right_widths)) / len(left_widths)
    return round(0.7 * ratio + 0.3 * max(0.0, 1 - gap / (tolerance if ratio > 0.85 else tolerance / 2)), 4) if len(left) == len(right) and len(left) else 0.0


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([0.0 if a is None or b is None else ratio_of(a, b) for a, b in zip(left, right)], dtype="float64")


def header_ratio(left: Column | str, right: Column | str) -> Column:
    """``ratio_of`` two lists of header keys; 0 for null."""
    return F.pandas_udf(_ratios, DoubleType())(left, right)


def table_similarity(left: Column | str, right: Column | str, left_widths: Column | str, right_widths: Column | str) -> Column:
    """``likeness`` of two tables; 0 for null."""

    def score(a: pd.Series, b: pd.Series, v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([0.0 if any(x is None for x in four) else likeness(*four) for four in zip(a, b, v, w)], dtype="float64")

    return F.pandas_udf(score, DoubleType())(left, right, left_widths, right_widths)


def cosine(left: Column, right: Column) -> Column:
    """Dot product of two unit vectors; 0 if their lengths differ."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), dot).otherwise(0.0)


def continued_on_next_page(tables: DataFrame) -> DataFrame:
    """Tables with equal headers on consecutive pages as one: (doc_id, first_page, last_page, n_parts, n_rows).

    ``tables``: doc_id, page, header, n_rows. A table goes on where the page before has one with the same header.
    """
    w = Window.partitionBy("doc_id").orderBy("page")
    goes_on = (F.col("page") == F.lag("page").over(w) + 1) & (F.col("header") == F.lag("header").over(w))
    rows = tables.withColumn("start", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_parts"), F.sum("n_rows").alias("n_rows")).drop("run")
