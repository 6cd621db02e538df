import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions import values as V
from foliant.functions.text import is_noise, sheet_kind
from foliant.operators.lines import page_numbers


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).head().y


@pytest.mark.parametrize("text, amount", [
    ("1.000.000 VNĐ", 1000000.0), ("1,000,000.00 USD", 1000000.0), ("1.234,56 €", 1234.56), ("1,5", 1.5), ("1,500", 1500.0), ("1.500", 1500.0), ("1.50", 1.5), ("-1.000", -1.0), ("abc", None),
])
def test_money(spark, text, amount):
    assert one(spark, V.parse_money, text) == amount


@pytest.mark.parametrize("text, number, kept", [("1.250.000 VNĐ", 1250000.0, None), ("1,250,000.50", 1250000.5, None), ("INV-2026-001", None, "INV-2026-001"), ("10kg", 10.0, None), ("1,5", None, "1,5")])
def test_typed_value(spark, text, number, kept):
    got = one(spark, V.typed_value, text)
    assert (got.number, got.text) == (number, kept)


@pytest.mark.parametrize("text, noise", [("@#$$%^^&&", True), ("XyZzZz", True), ("Invoice INV-2026-001", False), ("1111111", True), ("###", False), (None, False)])
def test_noise(spark, text, noise):
    assert one(spark, is_noise, text) is noise


def test_dates_days_come_first(spark):
    assert one(spark, V.parse_date, "09/10/2026") == datetime.date(2026, 10, 9)
    assert one(spark, V.parse_date, "12/31/2026") == datetime.date(2026, 12, 31)
    assert one(spark, V.parse_date, "99/99/2026") is None


def test_sheet_kind(spark):
    assert one(spark, sheet_kind, "Description Qty Weight") == "Packing_List"
    assert one(spark, sheet_kind, "Something") == "Table"


def test_page_numbers():
    assert page_numbers("3, 1-2", 5) == [1, 2, 3]
    for bad in ("4-2", "0", "9"):
        with pytest.raises(ValueError):
            page_numbers(bad, 5)
