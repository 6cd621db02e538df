"""Provenance, validation, workbooks, golden JSON, clusters, automata and the upsert stream on known cases."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import clusters, entities, evaluation, provenance, states, validation, workbook
from foliant.sources.kept import new_folder
from foliant.streaming.upsert import LatestTable, keep_latest, landed_once

LINE = "Invoice No: INV-2026-001 | Date: 09/09/2026 | MST: 0312345678 | VAT: 10% | Subtotal: 1.000.000 VNĐ | Grand Total: 1.100.000 VNĐ"


def blocks(spark, *texts, confidence=0.94):
    rows = [(1, "f.pdf", 1, k + 1, k + 1, t, 10.0, 20.0, 500.0, 40.0, confidence, "pdf-text") for k, t in enumerate(texts)]
    schema = "doc_id long, document_id string, page_number int, place int, line_no int, text string, x0 double, top double, x1 double, bottom double, confidence double, engine string"
    return provenance.with_blocks(spark.createDataFrame(rows, schema))


def facts_of(spark, *texts, confidence=0.94, strict=False):
    b = blocks(spark, *texts, confidence=confidence).withColumn("block", F.struct("block_id", "text", provenance.box().alias("bbox"), "confidence", "document_id"))
    return provenance.facts(provenance.entity_evidence(entities.entities(b, carry=("block",), strict=strict)))


def test_entities_of_the_known_line(spark):
    got = {f.entity_type: f for f in facts_of(spark, LINE).collect()}
    assert (got["Invoice_Number"].raw_value, got["Tax_Code"].raw_value, got["Subtotal"].number) == ("INV-2026-001", "0312345678", 1000000.0)
    # one line with both: the pattern of the total finds the subtotal first, and that of the number its own label
    assert (got["Grand_Total"].number, got["INVOICE_NUMBER"].raw_value) == (1000000.0, "oice")
    e = got["Grand_Total"].evidence
    assert (e.bbox, e.block_id, e.page, e.engine, e.document_id, e.confidence) == ([10.0, 20.0, 500.0, 40.0], "p1-b1", 1, "invoice-kvp-regex", "f.pdf", 0.94)
    assert [got[k].fact_id for k in ("INVOICE_NUMBER", "PHONE")] == ["fact-1", "fact-2"]


def test_strict_entities_of_the_known_line(spark):
    got = {f.entity_type: f for f in facts_of(spark, LINE, strict=True).collect()}
    assert {k: f.number or f.normal_text for k, f in got.items()} == {"Invoice_Number": "INV-2026-001", "Date": "2026-09-09", "Tax_Code": "0312345678", "VAT_Rate": 0.1, "Subtotal": 1000000.0, "Grand_Total": 1100000.0}
    more = {(f.entity_type, f.raw_value) for f in facts_of(spark, "Invoice Date: 1/2/2026 pays $5 or 7 € or 1,000 USD", strict=True).collect()}
    assert more == {("Date", "1/2/2026"), ("MONEY", "$5"), ("MONEY", "7 €"), ("MONEY", "1,000 USD")}


def test_evidence_of_blocks_without_confidence_or_text(spark):
    got = facts_of(spark, "mail a@b.io", "Date: 1/2/2026", confidence=None).collect()
    assert {(f.entity_type, f.confidence) for f in got} == {("EMAIL", 0.72), ("DATE", 0.72), ("Date", 0.86)}
    assert [b.evidence.quote for b in blocks(spark, "", "x" * 600).orderBy("place").collect()] == ["", "x" * 500]


def test_edges_carry_the_lower_confidence_and_both_ends(spark):
    b = blocks(spark, "Inv 123 Net 5 USD", "9 EUR").withColumn("confidence", F.when(F.col("place") == 2, 0.5).otherwise(F.col("confidence")))
    known = provenance.facts(provenance.entity_evidence(entities.entities(b.withColumn("block", F.struct("block_id", "text", provenance.box().alias("bbox"), "confidence", "document_id")), carry=("block",))))
    got = provenance.edges(known).orderBy("object_no").collect()
    assert [(e.subject, e.object, e.confidence, [x.block_id for x in e.evidence]) for e in got] == [("fact-1", "fact-2", 0.94, ["p1-b1", "p1-b1"]), ("fact-1", "fact-4", 0.5, ["p1-b1", "p1-b2"])]


def tables(spark, *rows):
    return provenance.with_tables(spark.createDataFrame([(1, "f.pdf", 1, k, r) for k, r in enumerate(rows)], "doc_id long, document_id string, page int, place int, rows array<array<string>>"))


def test_a_line_that_does_not_add_up_flips_all_facts(spark):
    t = tables(spark, [["Item", "Qty", "Unit Price", "Line Total"], ["A", "2", "100", "250"], ["B", "2", "100", "200"], ["C", "", "1", "1"]], [["Name"], ["x"]])
    lines, known = validation.line_checks(t), facts_of(spark, "Net 5 USD")
    assert [(r.checks, r.failures, r.status, r.object_id) for r in validation.line_results(lines).collect()] == [(2, 1, "invalid", "p1-t1")]
    tasks = validation.tasks(known, lines, provenance.cells(t), validation.vat_checks(known)).collect()
    assert [(x.task_id, x.field, x.value, x.priority, x.reason, x.confidence) for x in tasks] == [("review-conflict-p1-t1-2-r2c4", "p1-t1:r2c4", "250", "high", "arithmetic_conflict", 0.9)]
    assert [e.quote for e in tasks[0].evidence] == ["250", "2 × 100 ≠ 250"] and tasks[0].evidence[0].cell_id == "p1-t1-r2-c4"
    flipped = provenance.conflicting(known, validation.tasks(known, lines, provenance.cells(t), validation.vat_checks(known)))
    assert {f.status for f in flipped.collect()} == {"conflicting"}


@pytest.mark.parametrize("texts, rules, inferred", [
    (("Subtotal: 1000000", "VAT: 10%", "Total due: 1100000"), {"vat_arithmetic": "valid"}, None),
    (("Subtotal: 1000000", "Total due: 1080000"), {"vat_rate_inference": "valid", "vat_arithmetic": "valid"}, 0.08),
    (("Subtotal: 1000000", "VAT: 10%", "Total due: 1200000"), {"vat_arithmetic": "invalid"}, None),
    (("Subtotal: 100", "Total due: 900"), {"invoice_arithmetic": "uncertain"}, None),
])
def test_vat(spark, texts, rules, inferred):
    known, none = facts_of(spark, *texts), tables(spark)
    vat = validation.vat_checks(known)
    found = validation.results(known.select("doc_id").distinct(), validation.evidence_coverage(known), none, validation.line_checks(none), vat).collect()
    assert {r.rule: r.status for r in found if r.rule != "evidence_coverage"} == rules
    got = vat.head()
    assert (None if got.inferred is None else round(got.inferred, 6)) == inferred
    assert [t.task_id for t in validation.vat_tasks(vat).collect()] == ["review-vat-arithmetic"] * ("invalid" in rules.values())


def test_low_confidence_asks_for_a_look_and_nothing_covers_nothing(spark):
    known = facts_of(spark, "Net 5 USD a@b.io", confidence=0.5)
    assert {(t.task_id, t.field, t.priority) for t in validation.entity_tasks(known).collect()} == {("review-entity-1", "EMAIL", "normal"), ("review-entity-2", "MONEY", "high")}
    left = validation.remaining(validation.entity_tasks(known), spark.createDataFrame([(1, "review-entity-1", "c@d.io")], "doc_id long, task_id string, value string")).head()
    assert (left.n_tasks, left.n_verified, left.remaining) == (2, 1, 1)
    none = tables(spark)
    found = validation.results(spark.createDataFrame([(4,)], "doc_id long"), validation.evidence_coverage(known.limit(0)), none, validation.line_checks(none), validation.vat_checks(known.limit(0))).collect()
    assert {(r.rule, r.status) for r in found} == {("evidence_coverage", "invalid"), ("invoice_arithmetic", "uncertain")}


TABLE = "doc_id long, whole int, first_page int, source_pages array<int>, index int, strategy string, rows array<array<string>>"


def book(spark, found, routes, lines=(), **options):
    files = spark.createDataFrame([(1, "in/f.pdf", 4, False), (2, "g.pdf", 1, True)], "doc_id long, name string, page_count int, ocr_used boolean")
    t = spark.createDataFrame([(1, k + 1, k + 1, [k + 1], 1, "lines", r) for k, r in enumerate(found)], TABLE)
    r = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(routes)], "doc_id long, place_in_document int, route string")
    text = spark.createDataFrame([(1, *x) for x in lines], "doc_id long, page_number int, line_no int, text string")
    return workbook.workbook_cells(files, t, r, text, **options)


def test_workbook_order_names_and_rows(spark):
    head = [["Item", "Qty"], ["a 1", "2"]]
    got = book(spark, [head, [["Qty", "Weight"], ["b", "1.5"]], [["Qty", "weight"], ["c", "3"]], [["Paid", "Bank"], ["x", "5%"]]], [None, "p", "p", "q"], [(1, 1, "one"), (1, 2, "two"), (3, 3, "three")]).collect()
    sheets = dict(sorted({(c.sheet_no, c.sheet) for c in got if c.doc_id == 1}))
    assert list(sheets.values()) == ["Overview", "Line Items", "Packing_List_Page2", "Payments_Page4", "Document_Text", "Audit", "Document Text", "Page 1 - Table 1"]
    def of(sheet, doc=1):
        rows = {}
        for c in got:
            if c.doc_id == doc and c.sheet == sheet:
                rows.setdefault(c.row, {})[c.col] = c.text if c.number is None else c.number
        return rows
    assert of("Line Items") == {1: {1: "Source pages: 1", 2: "Detection: lines"}, 3: {1: "Item", 2: "Qty"}, 4: {1: 1.0, 2: 2.0}}
    assert of("Packing_List_Page2") == {1: {1: "Source pages: 2", 2: "Detection: lines"}, 3: {1: "Qty", 2: "Weight"}, 4: {1: "b", 2: 1.5}, 6: {1: "Additional table from page 3"}, 7: {1: "Qty", 2: "weight"}, 8: {1: "c", 2: 3.0}}
    assert of("Page 1 - Table 1") == {k: v for k, v in of("Packing_List_Page2").items() if k < 6} and of("Document_Text") == of("Document Text")
    assert of("Document_Text") == {1: {1: "Page", 2: "Line", 3: "Text"}, 2: {1: 1.0, 3: "--- Page 1 ---"}, 3: {1: 1.0, 2: 1.0, 3: "one"}, 4: {1: 1.0, 2: 2.0, 3: "two"}, 5: {1: 3.0, 3: "--- Page 3 ---"}, 6: {1: 3.0, 2: 3.0, 3: "three"}}
    assert of("Overview")[2] == {1: "Source file", 2: "f.pdf"} and of("Overview")[10][1] == "Invoice metadata" and of("Overview")[12][1] == "Table" and of("Overview")[13] == {1: "Table 1", 2: "1", 3: "lines", 4: 1.0, 5: 2.0}
    assert of("Line Items", 2) == {1: {1: "No primary invoice table detected"}} and of("Overview", 2)[6][2] == workbook.OCR_USED
    assert of("Audit")[2] == {1: "legacy_cell", 2: 1.0, 3: "p1-t1-r1-c1", 4: "Item", 6: "lines", 7: '{"page":1}'}


def test_workbook_options(spark):
    sheets = lambda **o: [s for _, s in sorted({(c.sheet_no, c.sheet) for c in book(spark, [[["a"], ["b"]], [["c"], ["d"]]], [None, "x"], [(1, 1, "t")], **o).filter("doc_id = 1").collect()})]
    assert sheets(extraction="tables") == ["Overview", "Line Items", "Table_Page2", "Audit", "Page 1 - Table 1"] == sheets(include_text=False)
    assert sheets(extraction="text") == ["Overview", "Line Items", "Document_Text", "Audit", "Document Text"]
    with pytest.raises(ValueError):
        sheets(extraction="images")


def test_sheet_names_are_settled_in_order(spark):
    long = "x" * 28
    row = spark.range(1).select(workbook.settled_names(F.array(*map(F.lit, ["Table", "Table", long, long, "Overview", "Table-2", "x" * 25 + "-2"])), ["Overview"]).alias("n")).head()
    assert row.n == ["Table", "Table-2", long, "x" * 25 + "-2", "Overview-2", "Table-2-2", "x" * 25 + "-3"]


GOLD = {"rows": [["Revenue", "", "Cost"], ["Q1", "Q2", "Total"], ["100", "120", "220"]], "merged_cells": [{"row": 1, "column": 1, "row_span": 1, "col_span": 2}], "header_hierarchy": [{"parent": "Revenue", "child": "Q1"}, {"parent": "Cost", "child": "Total"}]}


def test_golden_json(spark):
    worse = GOLD | {"rows": [["revenue ", None, "Cost"], ["Q1"], [100, 120, 220]], "merged_cells": [], "header_hierarchy": GOLD["header_hierarchy"][:1]}
    good = {"name": "same", "expected": GOLD, "actual": GOLD}
    payloads = {"whole": json.dumps({"pass_threshold": 0.5, "cases": [good, {"expected": GOLD, "actual": worse}]}), "list": json.dumps([good]), "cut": "{", "number": "3", "none": None, "empty": "{}", "odd": json.dumps([3, {"expected": []}, {"expected": {"rows": 5}}, {}])}
    sets = evaluation.golden_datasets(spark.createDataFrame(list(payloads.items()), "dataset string, payload string"))
    assert {r.dataset: r.broken for r in sets.collect() if r.broken} == {"cut": "no JSON", "none": "no JSON", "number": "no cases"}
    cases = evaluation.golden_json_cases(sets)
    assert {r.case_id for r in cases.filter("broken").collect()} == {"odd#1", "odd#2", "odd#3"}
    scores = evaluation.golden_json_scores(cases)
    got = {r.case_id: r for r in scores.collect()}
    assert got["list#1"].structural_accuracy == 1.0 and (got["whole#2"].name, got["whole#2"].cell_accuracy, got["whole#2"].merged_cell_recall, got["whole#2"].header_accuracy) == ("unnamed", round(7 / 9, 4), 0.0, 0.5)
    results = {r.dataset: (r.n_cases, r.average, r.passed) for r in evaluation.golden_json_results(sets, scores).collect()}
    assert results["list"] == (1, 1.0, True) and results["empty"] == (0, 0.0, False) and results["whole"][2] and results["odd"] == (1, 0.0, False)


def dense_by_lists(x, tolerance, least):
    out, held, now = [], [], 0
    for v in x:
        if held and sum(v - h <= tolerance for h in held) < least and abs(v - sum(held) / len(held)) > tolerance:
            held, now = [], now + 1
        held.append(v)
        out.append(now)
    return out


def test_dense_clusters(spark):
    rows = spark.createDataFrame([("p", k, x) for k, x in enumerate([10.0, 12.0, 11.0, 100.0, 102.0, 180.0, None])], "page string, k int, x double")
    got = clusters.dense_clusters(rows, "page", "x", "k", tolerance=4).collect()
    assert [sorted(r.k for r in got if r.cluster == c) for c in range(3)] == [[0, 1, 2], [3, 4], [5]] and len(got) == 6
    rng = np.random.default_rng(5)
    for least, tolerance in itertools.product(range(1, 5), (0.0, 3.0, 12.0)):
        x = np.sort(np.round(rng.uniform(0, 300, 80)))
        assert clusters.dense_runs(x, tolerance, least).tolist() == dense_by_lists(x.tolist(), tolerance, least)
    with pytest.raises(ValueError):
        clusters.dense_clusters(rows, "page", "x", "k", min_samples=0)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_gap_clusters_go_over_blocks(spark, block_rows):
    rng = random.Random(4)
    rows = [(rng.choice("ab") if k % 9 else None, rng.choice(["x", None]), k, None if k % 17 == 0 else float(rng.randint(0, 900))) for k in range(300)] + [("hot", "x", k, 5.0 * (k // 3) + 100 * (k // 40)) for k in range(1000, 1200)]
    got = clusters.gap_clusters(spark.createDataFrame(rows, "g string, h string, k int, v double"), ["g", "h"], "v", "k", block_rows=block_rows).collect()
    want = {}
    for key in {r[:2] for r in rows}:
        now, last = 0, None
        for i, (_, _, k, v) in enumerate(sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3] is not None, r[3] or 0, r[2]))):
            now += bool(i and v is not None and (last is None or v - last > 12))
            want[k], last = now, v
    assert {r.k: r.cluster for r in got} == want


def test_job_automaton(spark):
    rng, rows = random.Random(6), []
    for job in range(12):
        rows += [(job, k, rng.choice([*states.STATES[1:], "QUEUED", "ODD", None])) for k in sorted(rng.sample(range(4000), 0 if job == 11 else 150))]
    want = {}
    for job, version, status in rows:
        now, n, bad, first = want.get(job, ("NEW", 0, 0, None))
        good = status in states.LEGAL[now]
        want[job] = (status if good else now, n + 1, bad + (not good), first if good or first is not None else version)
    log = spark.createDataFrame(rows, "job int, v long, status string").repartition(5)
    for stretch in (1, 64, 10**9):
        assert {r.job: tuple(r)[1:] for r in states.run_log(log, "job", "v", stretch).collect()} == want


def test_upsert_stream(spark):
    folder, schema = new_folder(spark), "k long, v long, s string"
    table = LatestTable(spark, f"{folder}/t", "k", "v", schema, buckets=8)
    rng, rows = random.Random(7), []
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(3):
        new = [(rng.randint(0, 40) if k else None, rng.randint(0, 99), rng.choice(["a", "b", None])) for k in range(30)]
        rows += new
        spark.createDataFrame(new, schema).repartition(2).write.mode("append").parquet(f"{folder}/in")
        assert keep_latest(stream(), table, f"{folder}/c") == 2
    best = {}
    for k, v, s in rows:
        best[k] = max(best.get(k, (-1, False, "")), (v, s is not None, s or ""))
    want = {(k, v, s if there else None) for k, (v, there, s) in best.items()}
    assert {tuple(r) for r in table.read().collect()} == want
    # a batch that is repeated, or one without rows, changes nothing; one key rewrites one bucket
    last = max(table.versions().values())
    table.merge(table.read().filter("k = 1"), last + 1)
    assert sum(v == last + 1 for v in table.versions().values()) == 1
    table.merge(table.read().filter("k = 1"), last + 1)
    table.merge(table.read().limit(0), last + 2)
    assert {tuple(r) for r in table.read().collect()} == want and table.drop_old() and not table.drop_old() and {tuple(r) for r in table.read().collect()} == want
    # half a batch, without its mark, is not seen
    spark.createDataFrame([(1, 1000, "half", 0)], schema + ", bucket int").write.partitionBy("bucket").parquet(f"{folder}/t/batch={last + 9}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/t/batch={last + 9}/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert {tuple(r) for r in table.read().collect()} == want


def test_landing_files_come_once(spark):
    folder = new_folder(spark)
    rows = [("a", "2026-01-01 00:00:00", "f1"), ("b", "2026-01-01 01:00:00", "f1"), ("c", "2026-01-02 00:00:00", "f2")]
    spark.createDataFrame(rows, "name string, modified string, fingerprint string").write.json(f"{folder}/in")
    stream = landed_once(spark.readStream.schema("name string, modified timestamp, fingerprint string").json(f"{folder}/in"))
    run = lambda: stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([("d", "2026-01-02 02:00:00", "f2"), ("e", "2026-01-02 03:00:00", "f3")], "name string, modified string, fingerprint string").write.mode("append").json(f"{folder}/in")
    run()
    assert sorted(r.fingerprint for r in spark.read.parquet(f"{folder}/out").collect()) == ["f1", "f2", "f3"]
