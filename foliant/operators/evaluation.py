"""Golden evaluation: how much of the expected cells, merged cells and headers was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the score from which on a data set passes.
PASS_FROM = 0.9


def normal(text: Column) -> Column:
    """Without differences of case and blanks; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def exact_key(columns: list[str], rows: DataFrame) -> Column:
    """The values of ``columns`` as one text, other values another text."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit("="), F.col(c)) if isinstance(kinds[c], StringType) else F.col(c).cast("string")
    return F.concat_ws(":", *[F.coalesce(part(c), F.lit("-")) for c in columns])


def case_scores(cases: DataFrame, cells: tuple, spans: tuple, headers: tuple) -> DataFrame:
    """Per case the shares of its expected rows that were found too, and their mean; each pair is (expected, found). A share of nothing expected is 0.

    ``cases``: case_id, each once; ``cells``: case_id, row_idx, col_idx, text. Spans count once, cells and headers as often as they are expected; a null is like nothing.
    Expected and found rows meet in a sum by case and key, so that nothing is joined or broadcast.
    """
    cells = tuple(d.withColumn("text", normal(F.col("text"))) for d in cells)
    shares = (("cell_accuracy", cells, ["row_idx", "col_idx", "text"], False), ("merged_cell_recall", spans, ["row", "col", "row_span", "col_span"], True), ("header_accuracy", headers, ["parent", "child"], False))
    names = [name for name, *_ in shares]
    rows = cases.select("case_id", F.lit(-1).alias("part"), F.lit("").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("hit"))
    for k, (_, pair, keys, _) in enumerate(shares):
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])
        for d, wanted in zip(pair, (True, False)):
            d = d.filter("case_id IS NOT NULL")
            rows = rows.unionByName(d.select("case_id", F.lit(k).alias("part"), exact_key(keys, d).alias("key"), F.lit(int(wanted)).cast("long").alias("n"), F.lit(False).alias("hit") if wanted else known.alias("hit")))
    # dealt by case once, which both sums go by
    rows = rows.repartition("case_id").groupBy("case_id", "part", "key").agg(F.sum("n").alias("n"), F.max("hit").alias("hit"))
    own = lambda k, once: F.when(F.col("part") == k, F.least("n", F.lit(1)) if once else F.col("n"))
    share = lambda k, once: F.coalesce(F.sum(F.when(F.col("hit"), own(k, once))), F.lit(0)) / F.greatest(F.sum(own(k, once)), F.lit(1))
    rows = rows.groupBy("case_id").agg(F.max(F.col("part") == -1).alias("asked"), *[share(k, once).alias(name) for k, (name, _, _, once) in enumerate(shares)])
    return rows.filter("asked").select("case_id", *[F.round(n, 4).alias(n) for n in names], F.round(sum((F.col(n) for n in names[1:]), F.col(names[0])) / 3, 4).alias("structural_accuracy"))


def dataset_score(scores: DataFrame, group: list[str], pass_from: float = PASS_FROM) -> DataFrame:
    mean = F.sum("structural_accuracy") / F.greatest(F.count("*"), F.lit(1))
    return scores.groupBy(*group).agg(F.count("*").alias("n_cases"), F.round(mean, 4).alias("average"), (mean >= pass_from).alias("passed"))


#: Types of what a golden case holds.
ROWS, SPANS, HEADERS = "array<array<string>>", "array<struct<row:int,column:int,row_span:int,col_span:int>>", "array<struct<parent:string,child:string>>"


def golden_datasets(payloads: DataFrame) -> DataFrame:
    """(dataset, pass_from, cases, broken) from JSON texts (dataset, payload): an object with ``cases`` and perhaps ``pass_threshold``, or a bare list of cases.

    ``cases`` are variants; ``broken`` says why there are none: the text is no JSON, or neither shape.
    """
    v = F.try_parse_json("payload")
    rows = payloads.select("dataset", v.alias("v"))
    cases = F.coalesce(F.try_variant_get("v", "$.cases", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    of_object = F.try_variant_get("v", "$", "map<string,variant>")
    cases = F.when(of_object.isNotNull() & ~F.map_contains_key(of_object, "cases"), F.array().cast("array<variant>")).otherwise(cases)
    rows = rows.select("dataset", "v", cases.alias("cases"), F.coalesce(F.try_variant_get("v", "$.pass_threshold", "double"), F.lit(PASS_FROM)).alias("pass_from"))
    return rows.select("dataset", "pass_from", "cases", F.when(F.col("v").isNull(), "no JSON").when(F.col("cases").isNull(), "no cases").alias("broken"))


def golden_json_cases(datasets: DataFrame) -> DataFrame:
    """(dataset, case_id, name, expected and actual rows, spans and headers, broken): a row for each case, numbered in its dataset from 1.

    A case that is no object, or one of whose parts can't be read, is broken; what it lacks is empty.
    """
    rows = datasets.filter("broken IS NULL").select("dataset", F.posexplode("cases").alias("k", "case"))
    rows = rows.select("dataset", F.concat("dataset", F.lit("#"), F.col("k") + 1).alias("case_id"), "case")
    parts, bad = [], F.try_variant_get("case", "$", "map<string,variant>").isNull()
    for side in ("expected", "actual"):
        for field, name, kind in (("rows", "rows", ROWS), ("merged_cells", "spans", SPANS), ("header_hierarchy", "headers", HEADERS)):
            path = f"$.{side}.{field}"
            value, there = F.try_variant_get("case", path, kind), F.try_variant_get("case", path, "variant")
            parts.append(F.coalesce(value, F.array().cast(kind)).alias(f"{side}_{name}"))
            bad = bad | (value.isNull() & there.isNotNull() & ~F.coalesce(F.is_variant_null(there), F.lit(True)))
        given = F.try_variant_get("case", f"$.{side}", "variant")
        bad = bad | (given.isNotNull() & F.try_variant_get("case", f"$.{side}", "map<string,variant>").isNull())
    return rows.select("dataset", "case_id", F.coalesce(F.try_variant_get("case", "$.name", "string"), F.lit("unnamed")).alias("name"), *parts, F.coalesce(bad, F.lit(True)).alias("broken"))


def golden_json_scores(cases: DataFrame) -> DataFrame:
    """The scores of the cases that aren't broken: (dataset, case_id, name, and what case_scores gives)."""
    good = cases.filter("NOT broken")

    def cells(side):
        rows = good.select("case_id", F.posexplode(f"{side}_rows").alias("row_idx", "row"))
        return rows.select("case_id", "row_idx", F.posexplode("row").alias("col_idx", "text"))

    def spans(side):
        rows = good.select("case_id", F.explode(f"{side}_spans").alias("s"))
        return rows.select("case_id", "s.row", F.col("s.column").alias("col"), F.coalesce("s.row_span", F.lit(1)).alias("row_span"), F.coalesce("s.col_span", F.lit(1)).alias("col_span"))

    def headers(side):
        return good.select("case_id", F.explode(f"{side}_headers").alias("h")).select("case_id", F.coalesce("h.parent", F.lit("")).alias("parent"), F.coalesce("h.child", F.lit("")).alias("child"))

    both = [(f("expected"), f("actual")) for f in (cells, spans, headers)]
    # cases are many, however small their file: no side may be broadcast
    return good.select("dataset", "case_id", "name").hint("merge").join(case_scores(good.select("case_id"), *both), "case_id")


def golden_json_results(datasets: DataFrame, scores: DataFrame) -> DataFrame:
    """(dataset, n_cases, average, passed) of each dataset that isn't broken, by its own threshold."""
    rows = scores.groupBy("dataset").agg(F.count("*").alias("n_cases"), F.sum(F.round(F.col("structural_accuracy") * 10000).cast("long")).alias("sum"))  # in units of the fourth decimal
    all_ = datasets.filter("broken IS NULL").select("dataset", "pass_from").join(rows, "dataset", "left").fillna(0, ["n_cases", "sum"])
    n = F.greatest(F.col("n_cases"), F.lit(1))
    mean = F.floor((2 * F.col("sum") + n) / (2 * n)) / 10000
    return all_.select("dataset", "n_cases", mean.alias("average"), (F.col("sum") / n / 10000 >= F.col("pass_from")).alias("passed"))
