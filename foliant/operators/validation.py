"""Rules that a document's objects are held against, their results, and what a reviewer is asked to look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.functions.values import breaks_tolerance, parse_money
from foliant.operators.audit import FIRST_REVIEWED, UNCERTAIN_FROM, VALID_FROM
from foliant.operators.provenance import EVIDENCE, TABLE_CONFIDENCE, cell_evidence
from foliant.operators.tables import ROLES, role_column, role_numbers

RESULT = ("doc_id", "rule", "object_id", "status", "message")
TASK = ("doc_id", "task_id", "field", "value", "priority", "confidence", "reason", "evidence")
#: Fixed value: what is below this asks for a look.
LOW = 0.70
#: What the arithmetic of a document reads, by kind of entity.
VAT_KINDS = {"Subtotal": "subtotal", "Grand_Total": "total", "VAT_Rate": "rate"}


def union(parts: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def evidence_coverage(*objects: DataFrame) -> DataFrame:
    """The share of a document's objects (doc_id, evidence) that have evidence."""
    rows = union(list(objects), ("doc_id", "evidence")).groupBy("doc_id").agg(F.count("evidence").alias("covered"), F.count("*").alias("total"))
    share = F.col("covered") / F.col("total")
    status = F.when(share >= VALID_FROM, "valid").when(share >= UNCERTAIN_FROM, "uncertain").otherwise("invalid")
    return rows.select("doc_id", F.round(share, 4).alias("coverage"), F.lit("evidence_coverage").alias("rule"), F.lit(None).cast("string").alias("object_id"), status.alias("status"), F.concat("covered", F.lit("/"), "total", F.lit(" extracted objects have evidence.")).alias("message"))


def column_consistency(tables: DataFrame) -> DataFrame:
    """A table whose rows differ in length is uncertain. ``tables``: doc_id, table_id, rows."""
    widths = F.transform("rows", lambda r: F.size(r))
    same = F.size(F.array_distinct(widths)) <= 1
    message = F.concat(F.lit("Table "), "table_id", F.lit(" has row widths ["), F.array_join(widths.cast("array<string>"), ", "), F.lit("]."))
    return tables.select("doc_id", F.lit("table_column_consistency").alias("rule"), F.col("table_id").alias("object_id"), F.when(same, "valid").otherwise("uncertain").alias("status"), message.alias("message"))


def line_checks(tables: DataFrame) -> DataFrame:
    """The lines of each table whose header has a quantity, a price and a total, all three being numbers: doc_id, page, table_id, row_no, col_no (of the total), the numbers, shown, conflict.

    ``tables``: doc_id, page, table_id, rows (the header first); document_id is carried along if there is one.
    """
    own = [c for c in ("document_id",) if c in tables.columns]
    of = tables.filter(F.size("rows") >= 2).select(*own, "doc_id", "page", "table_id", "rows", *[role_column(F.get("rows", F.lit(0)), r).alias(r) for r in ROLES]).dropna(subset=list(ROLES))
    lines = of.select(*own, "doc_id", "page", "table_id", F.struct(*ROLES).alias("at"), F.posexplode("rows").alias("k", "cells")).filter("k > 0")
    numbers = lines.select(*own, "doc_id", "page", "table_id", (F.col("k") + 1).alias("row_no"), (F.col("at.total") + 1).alias("col_no"), F.get("cells", F.col("at.total")).alias("shown"), F.inline(role_numbers(F.col("cells"), lambda r: F.col(f"at.{r}"))))
    return numbers.withColumn("conflict", breaks_tolerance(F.col("quantity") * F.col("price"), F.col("total")))


def line_results(checks: DataFrame) -> DataFrame:
    """The checks and failures of each table, as one result."""
    rows = checks.groupBy("doc_id", "table_id").agg(F.count("*").alias("checks"), F.count_if("conflict").alias("failures"))
    message = F.concat(F.lit("Checked "), "checks", F.lit(" line item relationship(s); "), "failures", F.lit(" conflict(s)."))
    return rows.select("doc_id", "checks", "failures", F.lit("line_item_arithmetic").alias("rule"), F.col("table_id").alias("object_id"), F.when(F.col("failures") > 0, "invalid").otherwise("valid").alias("status"), message.alias("message"))


def vat_checks(found: DataFrame) -> DataFrame:
    """doc_id, subtotal, total, rate, inferred, used, conflict (null: can't be told), from each document's last numbers of those kinds.

    ``found``: entities. A missing rate is inferred where it would be 0 to 30 percent.
    """
    place = F.struct("page_number", "line_no", "pattern_idx", "match_idx")
    number = F.coalesce("number", parse_money(F.col("raw_value")))
    rows = found.filter(F.col("entity_type").isin(*VAT_KINDS)).select("doc_id", "entity_type", number.alias("n"), place.alias("place")).filter("n IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(*[F.max_by("n", F.when(F.col("entity_type") == kind, F.col("place"))).alias(name) for kind, name in VAT_KINDS.items()])
    guess = F.when(F.col("subtotal") != 0, F.col("total") / F.col("subtotal") - 1)
    rows = rows.filter("subtotal IS NOT NULL AND total IS NOT NULL").withColumn("inferred", F.when(F.col("rate").isNull() & guess.between(0, 0.30), guess))
    rows = rows.withColumn("used", F.coalesce("rate", "inferred"))
    return rows.withColumn("conflict", breaks_tolerance(F.col("subtotal") + F.col("subtotal") * F.col("used"), F.col("total")))


def vat_results(checks: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string").alias("object_id")
    guessed = checks.filter("inferred IS NOT NULL").select("doc_id", F.lit("vat_rate_inference").alias("rule"), none, F.lit("valid").alias("status"), F.concat(F.lit("Inferred VAT rate "), F.format_number(F.col("inferred") * 100, 4), F.lit("% from subtotal and grand total.")).alias("message"))
    known = checks.filter("conflict IS NOT NULL").select("doc_id", F.lit("vat_arithmetic").alias("rule"), none, F.when(F.col("conflict"), "invalid").otherwise("valid").alias("status"), F.concat(F.lit("Subtotal + VAT "), F.when(F.col("conflict"), "does not equal").otherwise("equals"), F.lit(" grand total.")).alias("message"))
    return guessed.unionByName(known)


def results(documents: DataFrame, coverage: DataFrame, tables: DataFrame, lines: DataFrame, vat: DataFrame) -> DataFrame:
    """All results of all rules (RESULT). A document of ``documents`` (doc_id) without any other result has an uncertain one; one without objects covers nothing, which is invalid."""
    nothing = documents.join(coverage.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("evidence_coverage").alias("rule"), F.lit(None).cast("string").alias("object_id"), F.lit("invalid").alias("status"), F.lit("0/0 extracted objects have evidence.").alias("message"))
    money = union([line_results(lines), vat_results(vat)], RESULT)
    silent = documents.join(money.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("invoice_arithmetic").alias("rule"), F.lit(None).cast("string").alias("object_id"), F.lit("uncertain").alias("status"), F.lit("No sufficiently labeled financial table relationship was found.").alias("message"))
    return union([coverage, nothing, column_consistency(tables), money, silent], RESULT)


def entity_tasks(known: DataFrame) -> DataFrame:
    """Facts of low confidence or without evidence; amounts and invoice numbers come first."""
    low = F.coalesce(F.col("confidence"), F.lit(0.0)) < LOW
    rows = known.filter(low | F.col("evidence").isNull())
    return rows.select(
        "doc_id", F.concat(F.lit("review-entity-"), "fact_no").alias("task_id"), F.col("entity_type").alias("field"), F.col("raw_value").alias("value"), F.when(F.col("entity_type").isin(*FIRST_REVIEWED), "high").otherwise("normal").alias("priority"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"), F.when(low, "low_confidence").otherwise("missing_evidence").alias("reason"), F.array_compact(F.array("evidence")).alias("evidence"))


def line_tasks(checks: DataFrame, cells: DataFrame | None) -> DataFrame:
    """A line that doesn't add up, shown by the cell of its total. ``cells``: those of provenance.cells; without them that cell's evidence is made from the check, which has the document_id then."""
    at = F.concat(F.lit("r"), "row_no", F.lit("c"), "col_no")
    rows = checks.filter("conflict")
    if cells is None:
        rows = rows.withColumns({"confidence": F.lit(TABLE_CONFIDENCE), "__e": cell_evidence(F.col("page"), F.col("shown"), F.col("table_id"), F.concat("table_id", F.lit("-r"), "row_no", F.lit("-c"), "col_no"))})
    else:
        rows = rows.join(cells.select("doc_id", "table_id", "row_no", "col_no", "confidence", F.col("evidence").alias("__e")), ["doc_id", "table_id", "row_no", "col_no"], "left")
    said = message_evidence(F.col("page"), F.concat(F.format_string("%s × %s ≠ %s", *[plain(F.col(r)) for r in ROLES])), F.col("table_id"))
    return rows.select(
        "doc_id", F.concat(F.lit("review-conflict-"), "table_id", F.lit("-"), "row_no", F.lit("-"), at).alias("task_id"), F.concat("table_id", F.lit(":"), at).alias("field"), F.col("shown").alias("value"), F.lit("high").alias("priority"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit("arithmetic_conflict").alias("reason"), F.array_compact(F.array("__e", said)).alias("evidence"))


def vat_tasks(checks: DataFrame) -> DataFrame:
    said = F.format_string("%s + (%s × %s) ≠ %s", *[plain(F.col(c)) for c in ("subtotal", "subtotal", "used", "total")])
    return checks.filter("conflict").select(
        "doc_id", F.lit("review-vat-arithmetic").alias("task_id"), F.lit("Grand_Total").alias("field"), plain(F.col("total")).alias("value"), F.lit("high").alias("priority"), F.lit(0.0).alias("confidence"),
        F.lit("arithmetic_conflict").alias("reason"), F.array(message_evidence(F.lit(None), said, F.lit(None))).alias("evidence"))


def plain(number: Column) -> Column:
    """A number with up to four decimals, none of them trailing zeros."""
    return F.regexp_replace(F.regexp_replace(number.cast("decimal(38,4)").cast("string"), "0+$", ""), r"\.$", "")


def message_evidence(page: Column, quote: Column, table_id: Column) -> Column:
    names = [f.split(":", 1)[0] for f in EVIDENCE.removeprefix("struct<").removesuffix(">").split(",")]
    given = {"page": page, "quote": quote, "table_id": table_id}
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(EVIDENCE)


def tasks(known: DataFrame, lines: DataFrame, cells: DataFrame | None, vat: DataFrame) -> DataFrame:
    """All review tasks (TASK)."""
    return union([entity_tasks(known), line_tasks(lines, cells), vat_tasks(vat)], TASK)


def remaining(open_tasks: DataFrame, verified: DataFrame) -> DataFrame:
    """Per document its tasks, how many are verified (doc_id, task_id, value) and how many remain; raw values stay as they are."""
    hit = verified.select("doc_id", "task_id", F.col("value").alias("verified")).dropDuplicates(["doc_id", "task_id"])
    rows = open_tasks.join(hit, ["doc_id", "task_id"], "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tasks"), F.count("verified").alias("n_verified"), (F.count("*") - F.count("verified")).alias("remaining"), F.count_if(F.col("priority") == "high").alias("n_high"))


def mean_of_four(total: Column, n: Column) -> Column:
    """A mean to four decimals, halves rounded up, from a sum in units of the fourth decimal: whole numbers, so that it is the same everywhere. Null of nothing."""
    return F.floor((2 * total + n) / F.nullif(2 * n, F.lit(0))) / 10000


def dimensions(found: DataFrame, coverage: DataFrame, known: DataFrame, source: float = 1.0, ocr: float = 1.0, layout: float = 1.0) -> DataFrame:
    """(doc_id, consistency, semantic, evidence_coverage, overall): the share of valid results, the mean confidence of facts, the coverage, and the mean of all six dimensions that are known. ``known``: facts, or their mean as (doc_id, semantic)."""
    valid = found.groupBy("doc_id").agg(mean_of_four(F.count_if(F.col("status") == "valid") * 10000, F.count("*")).alias("consistency"))
    mean = known if "semantic" in known.columns else known.groupBy("doc_id").agg(mean_of_four(F.sum(F.round(F.col("confidence") * 10000).cast("long")), F.count("confidence")).alias("semantic"))
    rows = valid.join(mean, "doc_id", "left").join(coverage.select("doc_id", F.col("coverage").alias("evidence_coverage")), "doc_id", "left").fillna(0.0, ["evidence_coverage"])
    return rows.withColumn("overall", overall(source, ocr, layout))


def overall(source: float = 1.0, ocr: float = 1.0, layout: float = 1.0) -> Column:
    """The mean of all dimensions that are known; those of the document are in semantic, consistency and evidence_coverage."""
    known_ = F.array_compact(F.array(F.lit(source), F.lit(ocr), F.lit(layout), "semantic", "consistency", "evidence_coverage"))
    return mean_of_four(F.aggregate(known_, F.lit(0).cast("long"), lambda s, x: s + F.round(x * 10000).cast("long")), F.size(known_))


def result_metadata(files: DataFrame, tables: DataFrame, cells: DataFrame, known: DataFrame, edges: DataFrame, found: DataFrame, open_tasks: DataFrame, quality: DataFrame) -> DataFrame:
    """(doc_id, metadata): what a finished job says of a file, as JSON: counts, state, quality, results, tasks, facts and edges.

    ``files``: doc_id, name, page_count; the others as the functions of this module and of provenance give them. A document's facts and edges are part of its one text.
    """
    parts = [
        tables.groupBy("doc_id").agg(F.count("*").alias("tables")), cells.groupBy("doc_id").agg(F.count_if(F.col("confidence") < LOW).alias("low_confidence_count")),
        held(known, "truth_facts", "fact_id", F.col("entity_type").alias("name"), "raw_value", F.coalesce(F.col("number").cast("string"), "normal_text").alias("normalized_value"), "status", "confidence", "page_number", order=["fact_no"]),
        held(edges, "truth_graph_edges", "subject", "predicate", "object", "confidence", order=["subject_no", "object_no"]),
        held(found, "validation_results", "rule", "status", "message", order=["rule", "object_id"]), held(open_tasks, "review_tasks", "task_id", "field", "value", "priority", "confidence", "reason", order=["task_id"]),
        quality.select("doc_id", F.struct("consistency", "semantic", "evidence_coverage", "overall").alias("quality_dimensions")),
        known.groupBy("doc_id").agg(F.countDistinct(F.when(F.col("confidence") < LOW, F.col("page_number"))).alias("ocr_pages"))]
    rows = files.select("doc_id", "name", F.col("page_count").alias("pages"))
    for p in parts:
        rows = rows.join(p, "doc_id", "left")
    return metadata_texts(rows)


def held(rows: DataFrame, c: str, *fields: str | Column, order: list[str]) -> DataFrame:
    """A document's rows as an array ``c`` of their ``fields``, in order."""
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("x")))), lambda r: r["x"]).alias(c))


def task_array(facts: Column) -> Column:
    """``entity_tasks`` of a document's facts (an array of those of ``page_facts``), without their evidence."""
    at = F.transform(facts, lambda f, k: F.struct(f.alias("f"), k.alias("k")))
    low = lambda f: F.coalesce(f["confidence"], F.lit(0.0)) < LOW

    def task(x: Column) -> Column:
        f = x["f"]
        return F.struct(
            F.concat(F.lit("review-entity-"), x["k"] + 1).alias("task_id"), f["entity_type"].alias("field"), f["raw_value"].alias("value"), F.when(f["entity_type"].isin(*FIRST_REVIEWED), "high").otherwise("normal").alias("priority"),
            F.coalesce(f["confidence"], F.lit(0.0)).alias("confidence"), F.when(low(f), "low_confidence").otherwise("missing_evidence").alias("reason"))

    return F.transform(F.filter(at, lambda x: low(x["f"]) | x["f"]["evidence"].isNull()), task)


def fact_array(facts: Column) -> Column:
    """What metadata says of a document's facts."""
    value = lambda f: F.coalesce(f["number"].cast("string"), f["normal_text"])
    return F.transform(facts, lambda f, k: F.struct(
        F.concat(F.lit("fact-"), k + 1).alias("fact_id"), f["entity_type"].alias("name"), f["raw_value"].alias("raw_value"), value(f).alias("normalized_value"), f["status"].alias("status"), f["confidence"].alias("confidence"), f["page_number"].alias("page_number")))


def edge_array(facts: Column) -> Column:
    """What metadata says of the edges between them."""
    ends = F.transform(facts, lambda f, k: F.struct(f["entity_type"].alias("kind"), F.concat(F.lit("fact-"), k + 1).alias("id"), f["confidence"].alias("confidence")))
    edge = lambda a, z: F.struct(a["id"].alias("subject"), F.lit("has_amount").alias("predicate"), z["id"].alias("object"), F.least(a["confidence"], z["confidence"]).alias("confidence"))
    return let(F.filter(ends, lambda x: x["kind"] == "MONEY"), lambda amounts: F.flatten(F.transform(F.filter(ends, lambda x: x["kind"] == "INVOICE_NUMBER"), lambda a: F.transform(amounts, lambda z: edge(a, z)))))


def metadata_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, metadata) of documents as rows: doc_id, name, pages, tables, low_confidence_count, ocr_pages, quality_dimensions and, as arrays in order, truth_facts, truth_graph_edges, validation_results and review_tasks."""
    rows = rows.fillna(0, ["tables", "low_confidence_count", "ocr_pages"])
    n = F.coalesce(F.size("review_tasks"), F.lit(0))
    todo = F.when(F.col("review_tasks").isNotNull(), n).otherwise(0)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    listed = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), next(f.dataType.simpleString() for f in rows.schema.fields if f.name == c))).alias(c)
    return rows.select("doc_id", F.to_json(F.struct(
        F.lit(".xlsx").alias("output_extension"), F.sha2("name", 256).alias("source_fingerprint"), "pages", "tables", "ocr_pages", "low_confidence_count",
        F.when(todo > 0, F.array(F.concat(F.lit("review_required:"), todo))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(todo > 0, "review_required").otherwise("ready").alias("document_state"), "quality_dimensions",
        listed("validation_results"), listed("review_tasks"), size("truth_facts").alias("facts_count"), size("truth_graph_edges").alias("graph_edges_count"), listed("truth_facts"), listed("truth_graph_edges"), (todo > 0).alias("review_required"), F.lit(True).alias("audit_available"))).alias("metadata"))
