"""Aligned words, header similarity, landing files as a source, page ranges as a table function."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

from foliant.functions import page_ranges, values
from foliant.functions.text import header_key
from foliant.operators import grids, headers, jobs, layout, lines, profile, tables
from foliant.plans import tables as table_plans
from foliant.sources.landing import FilteredLandingReader, LandingSource
from foliant.sources.tables import table

WORDS = "doc_id long, page_number int, text string, x0 double, top double, x1 double, bottom double"


def word(doc, text, x0, top):
    return (doc, 1, text, x0, top, (x0 or 0.0) + 5, (top or 0.0) + 9)


def test_lines_follow_their_first_word():
    assert layout.line_numbers(np.array([0.0, 3.0, 6.0, 9.0, 13.1]), 4).tolist() == [1, 1, 2, 2, 3] and not len(layout.line_numbers(np.zeros(0), 4))


def test_pages_without_words_keep_their_text_lines(spark):
    words = spark.createDataFrame([word(1, "b", 9.0, 1.0), word(1, None, None, 2.0), word(1, "a", 3.0, 2.0)], WORDS)
    lines = spark.createDataFrame([(1, 1, 1, "not used"), (2, 1, 1, " kept "), (2, 1, 2, " ")], "doc_id long, page_number int, line_no int, text string")
    got = sorted((r.doc_id, r.line_no, r.text, r.x0) for r in layout.native_blocks(words, lines).collect())
    assert got == [(1, 1, " a b", 0.0), (2, 1, "kept", None)]


def table_by_hand(words, tolerance=3.0, support=2):
    """Rows of the table that a page's words show, step by step."""
    lines, anchor = [], None
    for t, x, text in sorted((w[4], w[3], w[2]) for w in words):
        if anchor is None or abs(t - anchor) > 4:
            anchor = t
            lines.append([])
        lines[-1].append((x, t, text))
    edges, run = [], []
    for x, k in [*sorted((x, k) for k, line in enumerate(lines) for x, _, _ in line), (float("inf"), -1)]:
        if run and x - run[-1][0] > tolerance:
            if len({k for _, k in run}) >= support:
                edges.append(run[0][0])
            run = []
        run.append((x, k))
    if len(edges) < 2 or len(lines) < 2:
        return None
    rows = []
    for line in lines:
        row = [[] for _ in edges]
        for x, _, text in sorted(line):
            row[max(0, sum(e <= x for e in edges) - 1)].append(text)
        rows.append([" ".join(c) for c in row])
    return rows


def test_text_tables(spark):
    rng, pages = random.Random(3), {}
    for doc in range(40):
        pages[doc] = [word(doc, f"w{doc}.{k}", float(rng.choice([10, 80, 150, 151, 152, 300]) + rng.choice([0, 1, 2])), float(20 * rng.randint(0, 3) + rng.randint(0, 3))) for k in range(rng.randint(0, 9))]
    got = {r.doc_id: [list(x) for x in r.rows] for r in grids.text_tables(spark.createDataFrame([w for p in pages.values() for w in p], WORDS).repartition(5)).collect()}
    want = {d: t for d, p in pages.items() if (t := table_by_hand(p))}
    assert got == want and 5 < len(want) < 40
    assert grids.text_tables(spark.createDataFrame([], WORDS)).count() == 0


def test_one_strategy_of_each_table_and_eligible_ones(spark):
    a, b = [["h", "i"], ["1", "2"], ["3", "4"], ["x", "y"], ["5", "6"], ["7", "8"]], [["h", "i"], ["1", "2"], ["3", "4"], ["other", "y"], ["5", "6"], ["7", "8"]]
    rows = [(1, 1, 1, "text", a), (1, 1, 2, "lines", b), (1, 2, 1, "text", a), (1, 1, 3, "text", a[:2]), (1, 1, 4, "lines", [["one", "row"], ["", None]]), (1, 1, 5, "lines", [["c"], ["d"]])]
    t = spark.createDataFrame(rows, "doc_id long, page int, place int, strategy string, rows array<array<string>>")
    assert sorted((r.page, r.place) for r in grids.eligible(grids.one_of_each(t, ["lines", "text"])).collect()) == [(1, 2), (1, 3), (2, 1)]


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_similar_headers_are_those_of_all_pairs(spark, least):
    rng = random.Random(2)
    names = ["item", "items", "iten", "qty", "quantity", "amount", "amuont", "total", "totals", "", "a", "b", "ab", "price", "unitprice"]
    made = [[rng.choice(names) for _ in range(n)] for n in (1, 2, 3, 3, 4) for _ in range(40)] + [[], None]
    frame = spark.createDataFrame([(k,) for k in made], "k array<string>")
    got = {(tuple(r.left), tuple(r.right)): r.ratio for r in headers.similar_headers(frame, least).collect()}
    every = sorted({tuple(k) for k in made if k})
    want = {(a, b): r for a in every for b in every if a < b and len(a) == len(b) and (r := tables.ratio_of(a, b)) >= least}
    assert got == pytest.approx(want) and want


def test_few_candidates_of_part_headers(spark):
    p = table(spark, "/root/testdata/sf0.01", "part")
    keys = p.select(F.transform(F.split("p_name", " "), header_key).alias("k")).unionByName(p.select(F.transform(F.split("p_type", " "), header_key).alias("k"))).distinct()
    every = [tuple(r.k) for r in keys.collect()]
    pairs = [(a, b) for a in every for b in every if a < b and len(a) == len(b)]
    found = headers.header_candidates(keys, 0.8).count()
    want = {(" ".join(a), " ".join(b)) for a, b in pairs if tables.ratio_of(a, b) >= 0.8}
    assert found < len(pairs) / 4 and {(r.left_header, r.right_header) for r in table_plans.header_similarity(spark, "/root/testdata/sf0.01").collect()} == want


def test_landing_source_opens_no_file_that_a_filter_leaves_out(spark, tmp_path):
    held = {"a.pdf": b"one", "b.PDF": b"", "c.exe": b"bad", "d.pdf": b"x" * 50, "sub/e.txt": b"deep", ".hidden": b"no", "_mark": b"no"}
    for name, content in held.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(LandingSource)
    files = spark.read.format("landing").option("extensions", "pdf,txt").option("maxBytes", 40).load(f"file://{tmp_path}")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(tuple, files.collect()), key=str) == [("a.pdf", "pdf", 3, sha(b"one"), None), ("b.PDF", "pdf", 0, None, "empty"), ("c.exe", "exe", 3, None, "extension"), ("d.pdf", "pdf", 50, None, "size"), ("e.txt", "txt", 4, sha(b"deep"), None)]
    reader = FilteredLandingReader(f"file://{tmp_path}", (), 40)
    every = len(reader.partitions())
    left = list(reader.pushFilters([EqualTo(("extension",), "pdf"), GreaterThan(("length",), 0), StringContains(("fingerprint",), "a")]))
    assert every == 5 and [f.name for f in reader.partitions()] and {f.name for f in reader.partitions()} == {"a.pdf", "d.pdf"} and len(left) == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("landing").option("pushdown", "true").load(f"file://{tmp_path}").filter("extension = 'pdf' AND length > 0")
    assert some.rdd.getNumPartitions() == 2 and {r.name for r in some.collect()} == {"a.pdf", "d.pdf"}
    os.makedirs(tmp_path / "none")
    assert spark.read.format("landing").load(f"file://{tmp_path}/none").count() == 0


def test_page_ranges(spark):
    page_ranges.register(spark)
    rows = [(1, "3, 1-2, 2", 5), (2, "4-2", 5), (3, None, 5), (4, "9", 5), (5, "x", 5), (6, "1", None)]
    spark.createDataFrame(rows, "doc_id long, ranges string, n_pages int").createOrReplaceTempView("wanted")
    got = [tuple(r) for r in spark.sql("SELECT * FROM page_ranges(TABLE(wanted)) ORDER BY doc_id, page").collect()]
    assert [g[:2] for g in got] == [(1, 1), (1, 2), (1, 3), (2, None), (4, None), (5, None), (6, None)] and all(g[2] for g in got[3:]) and not any(g[2] for g in got[:3])


def test_signals_of_pages(spark):
    rows = [(1, 1, "x" * 30, 0, 0, 0), (1, 2, "short", 0, None, 9), (1, 3, None, 0, 0, 0), (2, 1, "", 1, 2, 0), (2, 2, "y" * 60, 3, 0, 0)]
    s = profile.full_signals(spark.createDataFrame(rows, "doc_id int, page_number int, text string, images int, tables int, vectors int"))
    got = {(r.doc_id, r.page_number): (r.native_text, r.image_heavy, r.blank, r.table_signal, r.warnings, r.ocr_recommended) for r in s.collect()}
    assert got == {(1, 1): (True, False, False, False, [], False), (1, 2): (False, False, False, True, ["sparse_native_text"], True), (1, 3): (False, False, True, False, ["blank_page"], True),
                   (2, 1): (False, True, False, True, ["image_heavy"], True), (2, 2): (True, True, False, False, ["image_heavy"], True)}
    p = {r.doc_id: r for r in profile.full_profile(s).collect()}
    assert (p[1].source_type, p[1].label, p[1].ocr_page_numbers, p[1].complexity_score, p[1].warnings) == ("mixed", "low", [2, 3], 6 + 5 + 4 + 20, ["low_native_text_quality_on_some_pages"])
    assert (p[2].label, p[2].score, p[2].warnings) == ("low", 0.0, ["ocr_required_on_image_pages", "low_native_text_quality_on_some_pages"])


def test_whole_tables(spark):
    rows = [(1, 0, [None, " ", ""]), (1, 1, ["title"]), (1, 2, ["Item", "Qty", "Qty", ""]), (1, 3, ["a", "1", None, "x"]), (1, 4, [" more "]), (1, 5, ["ITEM", "QTY", "QTY (2)", "column 4"]), (1, 6, ["b", "2", "3"]), (2, 0, ["one"])]
    got = {r.table_id: [list(x) for x in r.rows] for r in tables.normalized(spark.createDataFrame(rows, "table_id int, row_idx int, cells array<string>")).collect()}
    assert got == {1: [["Item", "Qty", "Qty (2)", "Column 4"], ["a\nmore", "1", "", "x"], ["b", "2", "3", ""]], 2: [["one"]]}
    again = spark.createDataFrame([([["a"], ["b"], ["a"]],), ([["a"]],), ([],)], "rows array<array<string>>").select(tables.header_repeated(F.col("rows")).alias("r")).collect()
    assert [x.r for x in again] == [True, False, False]


def test_times_and_json(spark):
    d = spark.createDataFrame([("2026-01-02T03:04:05+00:00",), ("2026-01-02T03:04:05.120000+00:00",), ("2026-01-02T05:04:05+02:00",), ("2026-01-02T03:04:05Z",), ("2026-01-02",), ("x",), (None,)], "t string")
    got = [r.s for r in d.select(values.iso_time(values.parse_iso(F.col("t"))).alias("s")).collect()]
    assert got == ["2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.120000+00:00", "2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05+00:00", None, None, None]
    row = spark.range(1).select(values.json_safe(F.struct(F.lit(float("nan")).alias("a"), F.lit(None).cast("int").alias("b"), F.array(F.lit(1.5), F.lit(float("inf"))).alias("c"), F.lit('say "NaN"').alias("d"))).alias("j")).head()
    assert row.j == '{"a":null,"b":null,"c":[1.5,null],"d":"say \\"NaN\\""}'


def test_flags_and_lookup(spark):
    b = spark.createDataFrame([(1, "@#$$%^^&&"), (2, "Invoice"), (3, None)], "k int, text string")
    assert [r.is_noise for r in lines.flagged_blocks(b).orderBy("k").collect()] == [True, False, False] and [r.k for r in lines.filter_blocks(b).orderBy("k").collect()] == [2, 3]
    j = spark.createDataFrame([("a", "u"), ("b", "v")], "job_id string, user_id string")
    assert jobs.job_of(j, "a").count() == 1 == jobs.job_of(j, "a", "u").count() and jobs.job_of(j, "a", "v").count() == 0
