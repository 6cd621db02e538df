"""Entities, facts and edges from lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import digits, let
from foliant.functions.values import parse_date, parse_money, parse_percent

#: Patterns matched as often as they occur, in this order, with the group that is the value.
PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),
    ("URL", r"https?://[^\s]+", 0),
    ("INVOICE_NUMBER", r"(?iu)\b(?:invoice|inv|hoá đơn|hoa don)\s*(?:no|number|#|:)?\s*([A-Z0-9][A-Z0-9/-]{2,})", 1),
    ("PHONE", r"(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)", 0),
    ("DATE", r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b", 0),
    ("PERCENT", r"\b\d+(?:[.,]\d+)?\s?%", 0),
    ("MONEY", r"(?U)(?<!\w)(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d{1,2})?\s?(?:VND|VNĐ|VNn|VNN|USD|EUR|GBP|₫|\$|€|£)\b", 0),
)
#: Labelled values, of which the first in a line counts.
LABELLED = (
    ("Invoice_Number", r"(?iu)(?:invoice\s*(?:no|number|#)?|inv\.?|ho[aó]\s*đơn\s*(?:số|so)?)\s*[:#-]?\s*([A-Z0-9][A-Z0-9./-]{2,})"),
    ("Date", r"(?iu)(?:invoice\s*date|date|ngày|ngay)\s*[:#-]?\s*(\d{1,4}[/-]\d{1,2}[/-]\d{1,4})"),
    ("Tax_Code", r"(?iu)(?:tax\s*(?:code|id)|mst|mã\s*số\s*thuế|ma\s*so\s*thue)\s*[:#-]?\s*([0-9 -]{8,20})"),
    ("VAT_Rate", r"(?iu)(?:vat|tax|thuế|thue)\s*(?:rate|%)?\s*[:#-]?\s*(\d{1,2}(?:[.,]\d+)?)\s*%"),
    ("Subtotal", r"(?iu)(?:subtotal|sub-total|tạm\s*tính|tam\s*tinh)\s*[:#-]?\s*([^\n|]+)"),
    ("Grand_Total", r"(?iu)(?:grand\s*total|total\s*due|total|tổng\s*cộng|tong\s*cong|tổng\s*tiền|tong\s*tien)\s*[:#-]?\s*([^\n|]+)"),
)
MONEY_TYPES, RATE_TYPES, DATE_TYPES = ("MONEY", "Subtotal", "Grand_Total"), ("PERCENT", "VAT_Rate"), ("DATE", "Date")


#: What a text must hold for a pattern to have a chance: a mark, or one of some parts of words in lower case; cheaper than the pattern itself.
NEEDS = {
    "EMAIL": "@", "URL": "://", "PERCENT": "%", "VAT_Rate": "%", "INVOICE_NUMBER": ("nv", "ho"), "Invoice_Number": ("nv", "ho"), "PHONE": r"[0-9]", "DATE": r"[0-9]", "Date": r"[0-9]", "Tax_Code": r"[0-9]",
    "MONEY": r"(?U)\d", "Subtotal": ("total", "nh"), "Grand_Total": ("total", "ng"),
}
#: Stricter patterns, with the group that is the value: numbers of invoices hold a digit, a total is no subtotal, currency marks may stand first and end an amount.
STRICT = {
    "INVOICE_NUMBER": (r"(?iu)\b(?:invoice|inv|hoá đơn|hoa don)\b\s*(?:no\b|number\b)?[\s.:#]*((?=[A-Z/-]*\d)[A-Z0-9][A-Z0-9/-]{2,})", 1),
    "Invoice_Number": (r"(?iu)\b(?:invoice\b\s*(?:no\b|number\b|#)?|inv\b\.?|ho[aó]\s*đơn\s*(?:số|so)?)\s*[.:#-]?\s*((?=[A-Z./-]*\d)[A-Z0-9][A-Z0-9./-]{2,})", 1),
    "Grand_Total": (r"(?iu)(?<!sub)(?<!sub-)(?:grand\s*total|total\s*due|total|tổng\s*cộng|tong\s*cong|tổng\s*tiền|tong\s*tien)\s*[:#-]?\s*([^\n|]+)", 1),
    "MONEY": (r"(?U)(?<!\w)(?:[₫$€£]\s?(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d{1,2})?|(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d{1,2})?\s?(?:(?:VND|VNĐ|VNn|VNN|USD|EUR|GBP)\b|[₫$€£]))", 0),
}
#: A character that no text is meant to hold; one that does is still read right.
MARK = "\uffff"
FOUND = "array<struct<entity_type:string,pattern_idx:int,match_idx:int,raw_value:string>>"


def _chance(kind: str, text: Column, low: Column) -> Column:
    need = NEEDS[kind]
    if isinstance(need, tuple):
        return F.greatest(*[low.contains(part) for part in need])
    return text.contains(need) if need in ("@", "://", "%") else text.rlike(need)


def _value(kind: str, value: Column) -> Column:
    value = F.btrim(value, F.lit(" :;,.\t"))
    return digits(value) if kind == "Tax_Code" else value


def first_labelled(kind: str, pattern: str, text: Column) -> Column:
    """The first value of a label as an array; none of these patterns has an empty value, so that one look tells whether there is a match."""
    return let(F.regexp_extract(text, pattern, 1), lambda v: F.when(v != "", F.array(_value(kind, v))).otherwise(F.array().cast("array<string>")))


def matches(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """All matches of all patterns (or of those of some ``kinds``) as one array, so that a text is read once and exploded once."""

    def found(kind: str, number: int, values: Column, text: Column, low: Column) -> Column:
        rows = F.transform(values, lambda v, k: F.struct(F.lit(kind).alias("entity_type"), F.lit(number).alias("pattern_idx"), k.alias("match_idx"), v.alias("raw_value")))
        return F.when(_chance(kind, text, low), rows).otherwise(F.array().cast(FOUND))

    def of(text: Column, low: Column) -> Column:
        every = [found(kind, k, F.regexp_extract_all(text, F.lit(p), F.lit(g)), text, low) for k, (kind, p, g) in enumerate(PATTERNS) if kinds is None or kind in kinds]
        for k, (kind, p) in enumerate(LABELLED, len(PATTERNS)):
            if kinds is None or kind in kinds:
                every.append(found(kind, k, first_labelled(kind, p, text), text, low))
        return F.concat(*every)

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), lambda both: of(both["text"], both["low"]))


def spans(text: Column, pattern: str, held: Column | None = None) -> Column:
    """(start, size) of all matches of a pattern without empty matches, from what it splits the text into. ``held``: the matches, where they are known.

    A pattern that splits is compiled anew for each text, a single character is not; so matches become MARK first, unless the text holds one.
    """
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if held is None else held
    between = F.when(text.contains(MARK), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, MARK), MARK, -1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))

    def step(s: Column, pair: Column) -> Column:
        begin, size = s["at"] + F.length(pair["between"]), F.coalesce(F.length(pair["held"]), F.lit(0))
        return F.struct((begin + size).alias("at"), F.when(pair["held"].isNotNull(), F.concat(s["out"], F.array(F.struct(begin.alias("start"), size.alias("size"))))).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(between.alias("between"), held.alias("held")), start, step)["out"]


def strict_matches(text: Column) -> Column:
    """Matches of the stricter patterns of which none overlaps another: from the left, the longest at a place, on a tie the labelled one."""
    kind_of_rows = "array<struct<start:int,less:int,plain:int,pattern_idx:int,match_idx:int,entity_type:string,raw_value:string>>"

    def rows(k: int, kind: str, values: Column, label: bool) -> Column:
        def one(v: Column, n: Column) -> Column:
            raw = _value(kind, v["value"]) if label else v["value"]
            return F.struct(v["span"]["start"].alias("start"), (-v["span"]["size"]).alias("less"), F.lit(0 if label else 1).alias("plain"), F.lit(k).alias("pattern_idx"), n.alias("match_idx"), F.lit(kind).alias("entity_type"), raw.alias("raw_value"))

        return F.transform(values, one)

    def found(k: int, kind: str, p: str, g: int, text: Column, low: Column) -> Column:
        p, g = STRICT.get(kind, (p, g))
        held = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        of = lambda held: rows(k, kind, F.arrays_zip(spans(text, p, held).alias("span"), (F.regexp_extract_all(text, F.lit(p), F.lit(g)) if g else held).alias("value")), k >= len(PATTERNS))
        return F.when(_chance(kind, text, low) & text.rlike(p), let(held, of)).otherwise(F.array().cast(kind_of_rows))

    taken = F.struct(F.lit(0).alias("end"), F.array().cast(FOUND).alias("out"))

    def take(s: Column, m: Column) -> Column:
        own = F.struct(*[m[c].alias(c) for c in ("entity_type", "pattern_idx", "match_idx", "raw_value")])
        free = m["start"] >= s["end"]
        return F.struct(F.when(free, m["start"] - m["less"]).otherwise(s["end"]).alias("end"), F.when(free, F.concat(s["out"], F.array(own))).otherwise(s["out"]).alias("out"))

    def of(text: Column, low: Column) -> Column:
        every = [found(k, kind, p, g, text, low) for k, (kind, p, g) in enumerate([*PATTERNS, *[(kind, p, 1) for kind, p in LABELLED]])]
        return F.aggregate(F.array_sort(F.concat(*every)), taken, take)["out"]

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), lambda both: of(both["text"], both["low"]))


def entities(lines: DataFrame, kinds: tuple[str, ...] | None = None, carry: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """One row per entity with its normalised value as number, date or text; of repeats on a page the first stays.

    ``lines``: doc_id, line_no, page_number, text, and the columns to ``carry`` along. ``strict``: stricter patterns without overlaps.
    """
    found = strict_matches(F.col("text")) if strict else matches(F.col("text"), kinds)
    rows = lines.select("doc_id", "page_number", "line_no", *carry, F.explode(found).alias("e")).select("doc_id", "page_number", "line_no", *carry, "e.*")
    if strict and kinds is not None:
        rows = rows.filter(F.col("entity_type").isin(*kinds))
    first = F.min_by(F.struct("line_no", "pattern_idx", "match_idx", *carry), F.struct("line_no", "pattern_idx", "match_idx"))
    rows = rows.groupBy("doc_id", "page_number", "entity_type", "raw_value").agg(first.alias("first")).select("doc_id", "page_number", "entity_type", "raw_value", "first.*")
    return with_values(rows)


def with_values(rows: DataFrame) -> DataFrame:
    """Entities (entity_type, raw_value, pattern_idx) with number, normal_text and labelled."""
    kind, raw = F.col("entity_type"), F.col("raw_value")
    number = number_of(kind, raw)
    return rows.withColumn("number", number).withColumn("normal_text", text_of(kind, raw, number, day_of(kind, raw))).withColumn("labelled", F.col("pattern_idx") >= len(PATTERNS))


def number_of(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin(*MONEY_TYPES), parse_money(raw)).when(kind.isin(*RATE_TYPES), parse_percent(raw))


def day_of(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin(*DATE_TYPES), parse_date(raw))


def text_of(kind: Column, raw: Column, number: Column, day: Column) -> Column:
    return F.when(kind.isin(*MONEY_TYPES), None).when(kind.isin(*RATE_TYPES) & number.isNotNull(), None).when(day.isNotNull(), F.date_format(day, "yyyy-MM-dd")).otherwise(F.trim(raw))


MATCH = ("entity_type", "pattern_idx", "match_idx", "raw_value")


def page_matches(lines: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """What ``entities`` finds on one page, of repeats the first, as an array in reading order: (line, entity_type, pattern_idx, match_idx, raw_value).

    ``lines``: array of structs with text, in order; each is carried along as ``line``. Nothing is dealt or sorted, so pages that are rows stay where they are.
    """
    every = F.flatten(F.transform(lines, lambda x: F.transform(matches(x["text"], kinds), lambda m: F.struct(x.alias("line"), *[m[c].alias(c) for c in MATCH]))))
    key = lambda m: F.concat(m["entity_type"], F.lit(":"), m["raw_value"])
    return let(every, lambda found: let(F.transform(found, key), lambda keys: F.filter(found, lambda m, k: F.array_position(keys, F.get(keys, k)) == k + 1)))


def page_entities(found: Column) -> Column:
    """``page_matches`` with number, normal_text and labelled, as ``with_values`` has them for rows."""

    def one(m: Column) -> Column:
        kind, raw = m["entity_type"], m["raw_value"]
        values = F.struct(number_of(kind, raw).alias("number"), day_of(kind, raw).alias("day"))
        return let(values, lambda v: F.struct(m["line"].alias("line"), *[m[c].alias(c) for c in MATCH], v["number"].alias("number"), text_of(kind, raw, v["number"], v["day"]).alias("normal_text"), (m["pattern_idx"] >= len(PATTERNS)).alias("labelled")))

    return F.transform(found, one)


def facts(found: DataFrame) -> DataFrame:
    """Entities numbered per document in reading order, with the status of their value."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "line_no", "pattern_idx", "match_idx")
    same = F.coalesce(F.col("normal_text") == F.col("raw_value"), F.lit(False))
    return found.withColumn("fact_no", F.row_number().over(w)).withColumn("status", F.when(same, "EXTRACTED").otherwise("NORMALIZED"))


def amount_edges(known: DataFrame) -> DataFrame:
    """Each invoice number of a document with each of its amounts."""
    left = known.filter("entity_type = 'INVOICE_NUMBER'").select("doc_id", F.col("fact_no").alias("subject"))
    right = known.filter("entity_type = 'MONEY'").select("doc_id", F.col("fact_no").alias("object"))
    return left.join(right, "doc_id").select("doc_id", "subject", F.lit("has_amount").alias("predicate"), "object")


def last_numbers(found: DataFrame, **kinds: str) -> DataFrame:
    """Per document with entities, for each kind, the last one of it that is a number, under the name given for the kind; null if there is none."""
    place = F.struct("page_number", "line_no", "pattern_idx", "match_idx")
    value = F.coalesce("number", parse_money(F.col("raw_value")))
    return found.withColumn("__value", value).groupBy("doc_id").agg(
        *[F.max_by("__value", F.when((F.col("entity_type") == kind) & F.col("__value").isNotNull(), place)).alias(name) for kind, name in kinds.items()])
