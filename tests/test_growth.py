"""Steps whose cost must not outgrow the tables: no broadcast of cases, no call for each small group."""

import numpy as np

import __spark_entry__ as entry
from foliant.functions import values

from foliant.operators import clusters, folds, layout
from foliant.operators import evaluation as EV
from foliant.plans import files


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_golden_cases_are_never_broadcast(spark):
    text = '[{"expected":{"rows":[["a","b"]],"header_hierarchy":[{"parent":"p","child":"c"},{"parent":"p","child":"c"},{"parent":"p"}]},"actual":{"rows":[[" A","x"]],"header_hierarchy":[{"parent":"p","child":"c"}]}}]'
    sets = EV.golden_datasets(spark.createDataFrame([("s", text)], "dataset string, payload string"))
    scores = EV.golden_json_scores(EV.golden_json_cases(sets))
    assert "Broadcast" not in plan(scores)
    row = scores.head()
    assert (row.cell_accuracy, row.merged_cell_recall, row.header_accuracy) == (0.5, 0.0, 0.6667)


def test_nulls_and_marks_of_golden_keys(spark):
    cases = spark.createDataFrame([(1,)], "case_id int")
    spans = spark.createDataFrame([(1, None, 0, 1, 1), (1, 2, 0, 1, 1), (1, 2, 0, 1, 1)], "case_id int, row int, col int, row_span int, col_span int")
    heads = spark.createDataFrame([(1, "a:1=b", "c"), (1, "a", "b")], "case_id int, parent string, child string")
    found = spark.createDataFrame([(1, "a", "1=b:c"), (1, "a", "b")], "case_id int, parent string, child string")
    cells = spark.createDataFrame([], "case_id int, row_idx int, col_idx int, text string")
    row = EV.case_scores(cases, (cells, cells), (spans, spans), (heads, found)).head()
    assert (row.cell_accuracy, row.merged_cell_recall, row.header_accuracy) == (0.0, 0.5, 0.5)


def test_small_groups_share_calls(spark):
    words = spark.range(40).selectExpr("id % 7 AS doc_id", "IF(id % 7 = 3, NULL, 1) AS page_number", "CAST(id AS string) AS text", "id * 3 AS x0", "id * 3 + 2 AS x1", "id % 5 * 10 AS top", "id % 5 * 10 + 8 AS bottom", "id")
    tables = spark.range(20).selectExpr("id % 3 AS doc_id", "id AS page", "1 AS place", "array(array('Item', 'Qty'), array('x', '1')) AS rows")
    steps = {
        "numbered": layout.numbered_words(words), "visual": layout.visual_lines(words), "routes": folds.route_tables(tables), "wholes": folds.merge_continuations(tables).select("doc_id", "whole", "first_page", "last_page"),
        "dense": clusters.dense_clusters(words, "doc_id", "x0", "id")}
    for rows in steps.values():
        assert "FlatMapGroupsInArrow" not in plan(rows)
    whole = {k: sorted(map(str, rows.collect())) for k, rows in steps.items()}
    assert len(whole["numbered"]) == 40 and len(whole["routes"]) == 20
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 7):  # groups that reach over batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert {k: sorted(map(str, rows.collect())) for k, rows in steps.items()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_few_fragments_as_many(monkeypatch):
    draw = np.random.default_rng(7)
    for n in range(1, 60):
        top, x0 = draw.integers(0, 60, n).astype(float), draw.integers(0, 300, n).astype(float)
        bottom = top + draw.integers(1, 15, n)
        few = layout.cluster_lines(top, bottom, x0)
        with monkeypatch.context() as m:
            m.setattr(layout, "SMALL_PAGE", 0)
            assert layout.cluster_lines(top, bottom, x0).tolist() == few.tolist()


def test_coverage_is_of_documents(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").count()
    rows = entry.queries()["evidence_coverage"](spark, d)
    assert n * 0.9 <= rows.count() <= n and rows.filter("covered < total").count() > 0


def test_facts_stay_where_their_lines_are(spark):
    assert plan(files.Understood(spark, "/root/testdata/sf0.001").found_facts()).count("Exchange") == 1


def test_dates_of_each_notation(spark):
    rows = spark.createDataFrame([("2024-1-2",), ("2/1/2024",), ("02-01-2024",), ("01/13/2024",), ("1/2-3",), (None,)], "t string")
    assert [str(r.d) for r in rows.select(values.parse_date(rows.t).alias("d")).collect()] == ["2024-01-02", "2024-01-02", "2024-01-02", "2024-01-13", "None", "None"]
