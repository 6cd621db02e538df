"""Numbers, dates, types and confidence from text, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import clean, let

#: Currency marks that an amount may carry.
CURRENCY = r"(?iu)(vnđ|vnd|đ|usd|eur|gbp|[$€£₫])"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _without(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(""))


def _later_mark_is_decimal(raw: Column) -> Column:
    """With both marks, the one further right is the decimal mark and the other goes."""
    dot_later = F.instr(F.reverse(raw), ".") < F.instr(F.reverse(raw), ",")
    return F.when(dot_later, _without(raw, ",")).otherwise(F.replace(_without(raw, "."), F.lit(","), F.lit(".")))


def parse_money(text: Column) -> Column:
    """An amount in any of the usual notations as a double; null where it is none."""
    def of(raw: Column) -> Column:
        dots, commas = _count(raw, "."), _count(raw, ",")
        tail = lambda mark: F.substring_index(raw, mark, -1)
        plain = (
            F.when((dots > 0) & (commas > 0), _later_mark_is_decimal(raw))
            .when(dots > 1, _without(raw, "."))
            .when(commas > 1, _without(raw, ","))
            .when(commas == 1, F.when(F.length(tail(",")) <= 2, F.replace(raw, F.lit(","), F.lit("."))).otherwise(_without(raw, ",")))
            .when((dots == 1) & (F.length(tail(".")) == 3) & F.substring_index(raw, ".", 1).rlike("^[0-9]+$"), _without(raw, "."))
            .otherwise(raw)
        )
        return plain.try_cast("double")

    return let(F.regexp_replace(F.regexp_replace(text, CURRENCY, ""), "[^0-9,.-]", ""), of)


def parse_percent(text: Column) -> Column:
    return F.trim(F.replace(_without(text, "%"), F.lit(","), F.lit("."))).try_cast("double") / 100


def parse_date(text: Column) -> Column:
    """ISO, then day first with slashes or dashes, then month first. A format whose mark the text lacks isn't tried, since a failure costs far more than a look."""
    return F.coalesce(*[F.when(text.contains(f.strip("yMd")[0]), F.try_to_date(text, f)) for f in ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy")])


def data_type(text: Column) -> Column:
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(_without(text, " ").rlike(r"^[-+]?\d+(?:[.,]\d+)?$"), "number")
        .when(text.rlike(r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}$"), "date")
        .when(text.rlike(r"(?i)[$€£₫%]|\b(?:VND|USD|EUR)\b"), "currency")
        .otherwise("text")
    )


def cell_type(text: Column) -> Column:
    value = clean(text)
    number = value.rlike(r"(?i)[$€£₫%]|\b(?:VND|USD|EUR)\b") | _without(value, " ").rlike(r"^[-+]?\d[\d.,]*$")
    return F.when(value == "", "empty").when(number, "number").otherwise("text")


def typed_value(text: Column) -> Column:
    """(number, text) of a cell: everything but digits and marks goes before a number is tried; what fails stays text."""
    def of_bare(raw: Column, bare: Column) -> Column:
        money = raw.rlike(r"(?iu)[$€£₫]|\b(?:VND|USD|EUR)\b|VNĐ")
        dots, commas = _count(bare, "."), _count(bare, ",")
        plain = (
            F.when((dots > 0) & (commas > 0), _later_mark_is_decimal(bare))
            .when(money & (dots > 1) & ~bare.endswith("."), _without(bare, "."))
            .when(commas > 1, _without(bare, ","))
            .otherwise(bare)
        )
        return let(F.when(bare.rlike(r"^[-+]?\d[\d.,]*$"), plain.try_cast("double")), lambda n: of_number(raw, F.when(F.abs(n) <= 1e15, n)))

    def of_number(raw: Column, number: Column) -> Column:
        return F.struct(number.alias("number"), F.when(number.isNull(), raw).alias("text"))

    return let(clean(text), lambda raw: let(F.regexp_replace(_without(raw, " "), "[^0-9,.-]", ""), lambda bare: of_bare(raw, bare)))


def confidence(score: Column) -> Column:
    """(value, level): the score held within 0 and 1; high from .90, medium from .70."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.struct(value.alias("value"), F.when(value >= 0.9, "high").when(value >= 0.7, "medium").otherwise("low").alias("level"))


def field_status(value: Column, score: Column, n_evidence: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "not_found").when(score.isNull() | (score < 0.7) | (n_evidence == 0), "uncertain").otherwise("valid")


def breaks_tolerance(expected: Column, stated: Column) -> Column:
    """Two amounts differ by more than a cent and by more than one percent of the stated one."""
    return F.abs(expected - stated) > F.greatest(F.lit(0.01), F.abs(stated) * 0.01)


#: Kinds of files by extension.
MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "txt": "text/plain", "csv": "text/csv", "json": "application/json",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def mime_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(kinds, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))), F.lit("application/octet-stream"))


def parse_options(text: Column) -> Column:
    """Options as a map of strings; what isn't a JSON object gives an empty one."""
    broken = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.when(F.size(broken) > 0, F.from_json(text, "map<string,string>")).otherwise(F.create_map().cast("map<string,string>"))


def iso_time(moment: Column) -> Column:
    """A time (the session's zone is taken to be UTC) in ISO 8601 with its offset; microseconds only where there are some."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(moment, "SSSSSS")
    return F.concat(whole, F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit("+00:00"))


def parse_iso(text: Column) -> Column:
    """The time that an ISO 8601 text with an offset, or with Z, names; null where it is none."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?([+-]\d\d:\d\d|Z)$"), F.try_to_timestamp(text))


def json_safe(value: Column) -> Column:
    """A value as JSON with its nulls, whatever is inside; numbers that JSON hasn't (NaN, infinities) become null, dates ISO texts."""
    return F.regexp_replace(F.to_json(value, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}), r'(?<=[:\[,])"(?:NaN|Infinity|-Infinity)"(?=[,\]}])', "null")
