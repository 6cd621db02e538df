"""Order-dependent operators on known cases."""

import re

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import audit, evaluation, folds, layout, tables
from foliant.plans import layout as layout_plans


def test_merged_cells():
    assert folds.spans_of([["Revenue", "", "Cost"], ["Q1", "Q2", "Total"], ["100", "120", "220"]]) == [(0, 0, 1, 2)]
    assert folds.spans_of([]) == [] and folds.spans_of([["", ""], ["", "x"]]) == []


TABLES = "doc_id long, page int, place int, rows array<array<string>>"


def merged(spark, *tables):
    got = folds.merge_continuations(spark.createDataFrame([(1, page, 1, rows) for page, rows in tables], TABLES)).orderBy("whole").collect()
    return [(g.first_page, g.last_page, [list(r) for r in g.rows]) for g in got]


def test_continuations(spark):
    head, other = [["Item", "Amount"], ["A", "10"]], [["Item", "Total"], ["B", "20"]]
    assert merged(spark, (1, head), (2, [["B", "20"]])) == [(1, 2, head + [["B", "20"]])]
    assert merged(spark, (1, head), (2, [[" item ", "AMOUNT"], ["B", "20"]])) == [(1, 2, head + [["B", "20"]])]
    assert len(merged(spark, (1, head), (3, other))) == 2
    assert len(merged(spark, (1, head), (2, [["one"], ["two"]]))) == 2
    assert merged(spark, (1, head), (2, [["item", "amount"], ["B", "20"]]), (3, [["C", "30"]]), (5, head)) == [(1, 3, head + [["B", "20"], ["C", "30"]]), (5, 5, head)]
    assert merged(spark, (1, None), (2, []), (3, [None, [None, "x"]]), (4, [[None, "2"], ["a", None]])) == [(1, 1, []), (2, 2, []), (3, 3, [[], ["", "x"]]), (4, 4, [["", "2"], ["a", ""]])]
    assert folds.merge_continuations(spark.createDataFrame([], TABLES)).count() == 0


def test_likeness_of_skewed_tables():
    keys = lambda *names: [n.lower().replace(".", "") for n in names]
    assert tables.likeness(keys("Description", "Qty", "Weight"), keys("Descript.", "Qty", "Weight"), [0.55, 0.25, 0.20], [0.43, 0.32, 0.25]) >= 0.78
    assert tables.likeness([], [], [], []) == 0.0 and tables.likeness(["a"], ["a"], [], []) == 0.75
    assert tables.likeness(["a"], ["a", "b"], [1.0], [0.6, 0.8]) == 0.0


def routed(spark, *found):
    got = folds.route_tables(spark.createDataFrame([(1, k + 1, 1, rows) for k, rows in enumerate(found)], TABLES)).orderBy("place_in_document").collect()
    return [g.route for g in got]


def test_routes(spark):
    first = [["x", "y"], ["1", "2"]]
    assert routed(spark, first, [["Name", "Total"], ["a", "1"]], [["Name", "Totals"], ["b", "2"]], [["Other", "Thing", "More"]]) == [None, "2:name|total", "2:name|total", "3:other|thing|more"]
    # headers that differ by case alone are one structure, however unlike the widths
    assert routed(spark, first, [["Name", "Total"], ["a", "1"]], [["NAME", " TOTAL"], ["a very long description of it", "1"]]) == [None, "2:name|total", "2:name|total"]
    assert routed(spark, first, [], None, [[None, "a"]]) == [None, "0:", "0:", "2:|a"]


def plain_parts(tables_):
    """Continuations by keeping whole tables of rows and measuring them again at every step."""
    def measured(rows):
        n = max(map(len, rows), default=0)
        return folds.unit([sum(len(r[c].strip()) for r in rows if c < len(r)) for c in range(n)])

    def kind(x):
        x = " ".join(x.split())
        return "empty" if not x else "number" if re.search(r"[$€£₫%]|\b(VND|USD|EUR)\b", x, re.I) or re.fullmatch(r"[-+]?\d[\d.,]*", x.replace(" ", "")) else "text"

    fold = lambda row: [" ".join(x.split()).lower() for x in row]
    keys = lambda row: [re.sub("[^a-z0-9]", "", x.lower()) for x in row]
    out = []
    for page, rows in tables_:
        if out and page == out[-1][1] + 1:
            held = out[-1][2]
            n = len(held[0])
            same = fold(held[0]) == fold(rows[0])
            v, w = measured(held[1:] or held), measured(rows)
            like = tables.likeness(keys(held[0]), keys(rows[0]), v, w) >= 0.78 or (len(v) == len(w) and sum(a * b for a, b in zip(v, w)) >= 0.82)
            agree = [kind(a) == kind(b) or "empty" in (kind(a), kind(b)) for a, b in zip((held[1:2] or held)[0], rows[0])]
            if n > 1 and max(map(len, rows)) == n and (same or (like and sum(agree) / n >= 0.75)):
                out[-1] = (out[-1][0], page, held + rows[same:])
                continue
        out.append((page, page, rows))
    return out


def test_continuations_of_order_tables(spark):
    rows = layout_plans.order_tables(spark, "/root/testdata/sf0.001").collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.page)):
        held.setdefault(r.doc_id, []).append((r.page, [list(x) for x in r.rows]))
    got = {}
    for g in folds.merge_continuations(spark.createDataFrame([(r.doc_id, r.page, r.place, r.rows) for r in rows], TABLES)).orderBy("whole").collect():
        got.setdefault(g.doc_id, []).append((g.first_page, g.last_page, [list(x) for x in g.rows]))
    want = {doc: plain_parts(t) for doc, t in held.items()}
    assert got == want and any(a != z for t in want.values() for a, z, _ in t)


def test_visual_lines(spark):
    rows = [(1, 1, "Widget", 10.0, 100.0, 112.0), (1, 1, "2", 210.0, 101.0, 112.0), (1, 1, "with premium support", 10.0, 116.0, 128.0), (1, 1, "200", 260.0, 101.0, 112.0), (2, 1, "alone", 0.0, 0.0, 0.0)]
    got = layout.visual_lines(spark.createDataFrame(rows, "doc_id long, page_number int, text string, x0 double, top double, bottom double")).collect()
    assert {(g.doc_id, g.line_no, g.text) for g in got} == {(1, 1, "Widget 2 200"), (1, 2, "with premium support"), (2, 1, "alone")}
    tied = [(3, 1, t, 5.0, 1.0, b) for t, b in (("b", 9.0), ("a", 9.0), ("c", 8.0))] + [(3, 1, None, None, 2.0, 9.0)]
    for parts in (1, 3):
        got = layout.visual_lines(spark.createDataFrame(tied, "doc_id long, page_number int, text string, x0 double, top double, bottom double").repartition(parts)).collect()
        assert [g.text for g in got] == [" c a b"]
    assert list(layout.cluster_lines(*map(np.array, ([0.0, 30.0], [10.0, 40.0], [5.0, 1.0])))) == [0, 1]


def test_lines_follow_the_first_word(spark):
    rows = [(1, 1, t, float(k), float(top), float(k) + 1, float(top) + 9) for k, (t, top) in enumerate([("a", 0), ("b", 3), ("c", 6), ("d", 9)])]
    got = layout.word_lines(spark.createDataFrame(rows, "doc_id long, page_number int, text string, x0 double, top double, x1 double, bottom double")).orderBy("line_no").collect()
    assert [(g.text, g.x0, g.top, g.x1, g.bottom) for g in got] == [("a b", 0, 0, 2, 12), ("c d", 2, 6, 4, 18)]


def test_golden_scores(spark):
    cell = [(1, r, c, t) for r, row in enumerate([["Revenue", "", "Cost"], ["Q1", "Q2", "Total"]]) for c, t in enumerate(row)]
    cells = spark.createDataFrame(cell, "case_id int, row_idx int, col_idx int, text string")
    found = cells.withColumn("text", F.when(F.col("text") == "Q2", "q3").otherwise(F.upper("text")))
    spans = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 2, 2, 1, 2)], "case_id int, row int, col int, row_span int, col_span int")
    heads = spark.createDataFrame([(1, "Revenue", "Q1"), (1, "Revenue", "Q2"), (1, "Cost", "Total")], "case_id int, parent string, child string")
    cases = cells.select("case_id").distinct()
    perfect = evaluation.case_scores(cases, (cells, cells), (spans, spans), (heads, heads))
    assert perfect.first().structural_accuracy == 1.0 and evaluation.dataset_score(perfect, []).first().passed
    got = evaluation.case_scores(cases, (cells, found), (spans, spans.limit(1)), (heads, heads)).first()
    assert (got.cell_accuracy, got.merged_cell_recall, got.header_accuracy) == (round(5 / 6, 4), 0.5, 1.0)
    nothing = evaluation.case_scores(cases, (cells.limit(0), found), (spans.limit(0), spans), (heads.limit(0), heads)).first()
    assert nothing.structural_accuracy == 0.0


def test_settings(spark):
    both = spark.range(1).select(audit.merged_settings(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert both == {"a": "1", "b": "3"}


FOLDER = "/root/testdata/sf0.001"


def order_tables(spark):
    return [(r.doc_id, r.page, r.l_orderkey, [list(x) for x in r.rows]) for r in sorted(layout_plans.order_tables(spark, FOLDER).collect(), key=lambda r: (r.doc_id, r.page))]


def test_overview_of_order_tables(spark):
    held = {}
    for doc, page, _, rows in order_tables(spark):
        held.setdefault(doc, []).append((page, rows))
    want = sorted((doc, ", ".join(map(str, range(a, z + 1))), len(rows) - 1, max(map(len, rows))) for doc, t in held.items() for a, z, rows in plain_parts(t))
    assert sorted((r.doc_id, r.source_pages, r.n_rows, r.n_columns) for r in layout_plans.overview(spark, FOLDER).collect()) == want


def test_routes_of_order_tables(spark):
    keys = lambda row: [re.sub("[^a-z0-9]", "", x.lower()) for x in row]
    width = lambda rows: folds.unit([sum(len(r[c].strip()) for r in rows) for c in range(3)])
    want, groups, first = [], {}, {}
    for doc, page, _, rows in order_tables(spark):
        if first.setdefault(doc, page) == page:
            want.append((doc, page, None))
            continue
        for name, other in groups.setdefault(doc, {}).items():
            if tables.likeness(keys(other[0]), keys(rows[0]), width(other[1:] or other), width(rows[1:] or rows)) >= 0.78:
                break
        else:
            name = "3:" + "|".join(" ".join(x.split()).lower() for x in rows[0])
            groups[doc].setdefault(name, rows)
        want.append((doc, page, name))
    got = sorted(((r.doc_id, r.page, r.route) for r in layout_plans.QUERIES["table_routes"](spark, FOLDER).collect()), key=lambda r: r[:2])
    assert got == want and len({r for *_, r in want}) > 5


def test_merged_cells_of_order_tables(spark):
    want = set()
    for _, _, order, rows in order_tables(spark):
        taken, at = set(), {(r, c): x for r, row in enumerate(rows) for c, x in enumerate(row)}
        free = lambda r, c: (r, c) in at and not at[r, c] and (r, c) not in taken
        for (r, c), x in sorted(at.items()):
            if x:
                n, m = 1, 1
                while free(r, c + n):
                    n += 1
                while all(free(r + m, c + k) for k in range(n)):
                    m += 1
                if n * m > 1:
                    want.add((order, r, c, m, n))
                    taken |= {(r + i, c + k) for i in range(m) for k in range(n)}
    assert {tuple(r) for r in layout_plans.merged_cells(spark, FOLDER).collect()} == want and want


def test_visual_lines_of_order_words(spark):
    pages = {}
    for w in layout_plans.words(spark, FOLDER).select("doc_id", "top", "x0", "bottom", "text").collect():
        pages.setdefault(w.doc_id, []).append(tuple(w)[1:])
    want = set()
    for doc, words in pages.items():
        words.sort()
        near, held = max(2.0, sorted(max(1.0, b - t) for t, _, b, _ in words)[len(words) // 2] * 0.45), []
        for t, x, b, text in words:
            centre = lambda line: sum((u + v) / 2 for u, _, v, _ in line) / len(line)
            def overlap(line):
                low, high = min(u for u, *_ in line), max(v for _, _, v, _ in line)
                return max(0.0, min(high, b) - max(low, t)) / max(1.0, min(high - low, b - t))
            fits = [line for line in held if overlap(line) >= 0.35 or abs(centre(line) - (t + b) / 2) <= near]
            if fits:
                min(fits, key=lambda line: abs(centre(line) - (t + b) / 2)).append((t, x, b, text))
            else:
                held.append([(t, x, b, text)])
        want |= {(doc, 1, n, " ".join(w[3] for w in sorted(line, key=lambda w: w[1]))) for n, line in enumerate(held, 1)}
    assert {tuple(r) for r in layout_plans.QUERIES["visual_lines"](spark, FOLDER).collect()} == want
