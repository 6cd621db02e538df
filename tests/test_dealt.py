"""Steps with much work a byte: their rows are dealt to all tasks first, and nothing is worked out twice."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliant.operators import entities as E
from foliant.plans import files

FOLDER = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entities_strict", "vat_arithmetic", "vat_inference", "conflicting_facts"])
def test_orders_are_dealt_before_anything_is_found(spark, name):
    shown = plan(entry.queries()[name](spark, FOLDER))
    assert shown.count("REPARTITION_BY_NUM") == 1  # and the lines are looked at once
    assert "ENSURE_REQUIREMENTS" not in shown  # entities and facts stay where their order is


def test_spans_of_texts_that_hold_the_mark(spark):
    rows = spark.createDataFrame([("ab1c22",), ("1",), ("",), ("x",), (f"{E.MARK}1{E.MARK}{E.MARK}23",), ("7 é 8",)], "t string")
    got = [[tuple(s) for s in r.s] for r in rows.select(E.spans(F.col("t"), r"\d+").alias("s")).collect()]
    assert got == [[(2, 1), (4, 2)], [(0, 1)], [], [], [(1, 1), (4, 2)], [(0, 1), (4, 1)]]


@pytest.mark.parametrize("name", ["typed_cells", "line_item_arithmetic", "multiline_collapse", "table_quality", "column_width_vectors", "whole_tables"])
def test_cells_are_cleaned_once_and_tables_dealt(spark, name):
    shown = plan(entry.queries()[name](spark, FOLDER))
    assert "REPARTITION_BY_NUM" in shown
    below = [x for x in shown.splitlines() if "exists(" in x and "Filter" in x]
    assert below and not any("regexp_replace" in x for x in below)


def test_roles_are_read_once_a_table(spark):
    shown = plan(entry.queries()["line_item_arithmetic"](spark, FOLDER)).splitlines()
    assert not any("Filter" in x and "try_cast" in x for x in shown)
    assert sum("unitprice" in x for x in shown) == 1


@pytest.mark.parametrize("name", ["noise_lines", "kept_lines", "text_with_placeholder"])
def test_documents_are_dealt_before_noise_is_looked_for(spark, name):
    assert "REPARTITION_BY_NUM" in plan(entry.queries()[name](spark, FOLDER))


def test_files_are_read_without_joining_orders_to_themselves(spark):
    assert "Join" not in plan(files.blocks(spark, FOLDER))


def test_results_work_out_amounts_only_and_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(files, "kept", lambda rows, keep=files.kept: written.append(plan(rows)) or keep(rows))
    rows = entry.queries()["validation_results"](spark, FOLDER)
    assert sum("Subtotal" in x and "REPARTITION_BY_NUM" in x for x in written) > 0
    assert not any("EMAIL" in x for x in [*written, plan(rows)])
    assert "subtotal" in plan(rows) and "rlike" not in plan(rows).lower()
