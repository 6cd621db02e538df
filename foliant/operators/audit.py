"""Evidence, coverage, quality, diagnostics and the audit relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators import provenance as PR

#: Coverage from which on a document is valid or uncertain; length of a quote; entities that are reviewed first.
VALID_FROM, UNCERTAIN_FROM, QUOTE = 0.95, 0.70, 500
FIRST_REVIEWED = ("MONEY", "INVOICE_NUMBER", "Grand_Total", "Subtotal")
AUDIT = ("doc_id", "kind", "page_number", "object_id", "raw_value", "confidence", "engine", "evidence")


def evidence(page: Column, object_id: Column, quote: Column, engine: Column) -> Column:
    """Where a value stands: page, object and the beginning of its text; null without text."""
    return F.when(F.trim(quote) != "", F.struct(page.alias("page"), object_id.alias("object_id"), F.substring(quote, 1, QUOTE).alias("quote"), engine.alias("engine")))


def coverage(*kinds: DataFrame) -> DataFrame:
    """(doc_id, covered, total, coverage, status) over objects of all ``kinds`` (doc_id, evidence); nothing at all is invalid."""
    rows = kinds[0].select("doc_id", "evidence")
    for k in kinds[1:]:
        rows = rows.unionByName(k.select("doc_id", "evidence"))
    share = F.col("covered") / F.greatest(F.col("total"), F.lit(1))
    out = rows.groupBy("doc_id").agg(F.count("evidence").alias("covered"), F.count("*").alias("total"))
    return out.withColumn("coverage", F.round(share, 4)).withColumn("status", F.when(share >= VALID_FROM, "valid").when(share >= UNCERTAIN_FROM, "uncertain").otherwise("invalid"))


def equal_widths(rows: DataFrame) -> DataFrame:
    """(table_id, n_widths, status): a table whose rows differ in length is uncertain. ``rows``: table_id, cells."""
    n = F.countDistinct(F.size("cells"))
    return rows.groupBy("table_id").agg(n.alias("n_widths"), F.when(n <= 1, "valid").otherwise("uncertain").alias("status"))


def diagnostics(blocks: DataFrame, cells: DataFrame, low: float = 0.7) -> DataFrame:
    """Per document its pages, blocks, recognised pages, cells of low confidence and mean confidence of cells.

    ``blocks``: doc_id, page_number, engine; ``cells``: doc_id, confidence.
    """
    of_blocks = blocks.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"), F.count("*").alias("blocks"), F.countDistinct(F.when(F.col("engine") == "ocr", F.col("page_number"))).alias("ocr_pages"))
    of_cells = cells.groupBy("doc_id").agg(F.count_if(F.col("confidence") < low).alias("low_confidence_cells"), F.round(F.avg("confidence"), 3).alias("cell_confidence"))
    return of_blocks.join(of_cells, "doc_id", "left").fillna(0, ["low_confidence_cells"])


def merged_settings(*layers: Column) -> Column:
    """Maps as one; of a key in several the last one counts."""
    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    return reduce(over, layers)


def audit_rows(order: list[str] | None = None, **kinds: DataFrame) -> DataFrame:
    """The union of documents, facts, edges, blocks and cells as audit rows; evidence as JSON.

    Each has doc_id, page_number, object_id, raw_value, confidence, engine, evidence (a struct), and the columns of ``order`` if they are wanted.
    """
    out = None
    for kind, d in kinds.items():
        rows = d.select("doc_id", F.lit(kind).alias("kind"), F.col("page_number").cast("int").alias("page_number"), F.col("object_id").cast("string").alias("object_id"), "raw_value", F.round("confidence", 4).alias("confidence"), "engine", F.to_json("evidence").alias("evidence"), *(order or []))
        out = rows if out is None else out.unionByName(rows)
    return out.select(*AUDIT, *(order or []))


ROW = "struct<page_number:int,object_id:string,raw_value:string,confidence:double,engine:string,evidence:string>"


def row(page: Column | None, object_id: Column, raw_value: Column, confidence: Column, engine: Column, evidence: Column) -> Column:
    """An audit row (ROW) as a struct; ``evidence`` is JSON."""
    page = F.lit(None).cast("int") if page is None else page.cast("int")
    return F.struct(page.alias("page_number"), object_id.alias("object_id"), raw_value.alias("raw_value"), F.round(confidence, 4).alias("confidence"), engine.alias("engine"), evidence.alias("evidence"))


def fact_rows(facts: Column, conflicting: Column) -> Column:
    """Rows of a document's facts (an array of those of ``page_facts``, in order) and of its edges: (facts, edges).

    An edge joins an invoice number with an amount; evidence becomes text once for each fact, not for each edge.
    """

    def with_text(f: Column, k: Column) -> Column:
        return F.struct(F.concat(F.lit("fact-"), k + 1).alias("id"), f.alias("fact"), F.coalesce(F.to_json(f["evidence"]), F.lit("null")).alias("json"))

    def fact(x: Column) -> Column:
        f = x["fact"]
        value = F.coalesce(F.round(f["number"], 6).cast("string"), f["normal_text"])
        # as to_json would write {"normalized_value": value, "evidence": [...]}, without a value that is null
        known = F.to_json(F.struct(value.alias("normalized_value")))
        opened = F.when(value.isNull(), "{").otherwise(F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(",")))
        text = F.concat(opened, F.lit('"evidence":['), x["json"], F.lit("]}"))
        return row(f["page_number"], x["id"], F.concat(f["entity_type"], F.lit(": "), f["raw_value"]), f["confidence"], F.when(conflicting, "conflicting").otherwise(f["status"]), text)

    def edge(a: Column, z: Column) -> Column:
        text = F.concat(F.lit('{"evidence":['), a["json"], F.lit(","), z["json"], F.lit("]}"))
        return row(None, a["id"], F.concat(F.lit("has_amount → "), z["id"]), F.least(a["fact"]["confidence"], z["fact"]["confidence"]), F.lit("derived"), text)

    def of(held: Column) -> Column:
        kind = lambda name: F.filter(held, lambda x: x["fact"]["entity_type"] == name)
        edges = let(kind("MONEY"), lambda amounts: F.flatten(F.transform(kind("INVOICE_NUMBER"), lambda a: F.transform(amounts, lambda z: edge(a, z)))))
        return F.struct(F.transform(held, fact).alias("facts"), edges.alias("edges"))

    return let(F.transform(facts, with_text), of)


def block_rows(blocks: Column, page: Column, confidence: Column, engine: Column) -> Column:
    """Rows of a page's blocks (those of ``page_blocks``); the document's own name is in ``document_id``."""
    found = lambda b: PR.evidence(page, F.substring(b["text"], 1, QUOTE), F.coalesce(engine, F.lit("unknown")), confidence, b["bbox"], b["block_id"])
    return F.transform(blocks, lambda b: row(page, b["block_id"], b["text"], confidence, engine, F.to_json(found(b))))


def cell_rows(table: Column) -> Column:
    """Rows of a table's cells; ``table``: page, table_id, rows."""

    def one(text: Column, r: Column, c: Column) -> Column:
        cell_id = F.concat(table["table_id"], F.lit("-r"), r + 1, F.lit("-c"), c + 1)
        found = PR.cell_evidence(table["page"], text, table["table_id"], cell_id)
        return row(table["page"], cell_id, text, F.lit(PR.TABLE_CONFIDENCE), F.lit(PR.TABLE_ENGINE), F.to_json(found))

    return F.flatten(F.transform(table["rows"], lambda cells, r: F.transform(cells, lambda x, c: let(F.coalesce(x, F.lit("")), lambda text: one(text, r, c)))))
