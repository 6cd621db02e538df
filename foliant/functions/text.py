"""Text functions, all as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Runs of white space, the no-break space included, become one blank; ends are trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\S ]\s*|\s\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def header_key(text: Column) -> Column:
    """What is left of a header for matching: ASCII letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


#: Vowels of Latin script and Vietnamese; a plain y is a consonant.
VOWELS = "aeiouàáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it and wherever the optimizer moves a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_noise(text: Column, least: int = 6, symbols: float = 0.40, consonants: float = 0.85, cleaned: bool = False) -> Column:
    """Text that is mostly symbols, unpronounceable with few distinct letters, or one character again and again. ``cleaned``: the text comes from ``clean``."""

    def of_letters(letters: Column) -> Column:
        n = F.length(letters)
        hard = F.length(F.regexp_replace(letters, f"[{VOWELS}]+", ""))
        kinds = F.size(F.array_distinct(F.split(letters, "")))
        # the number of kinds is dear and only taken where the share of consonants leaves it open
        return F.when((n >= least) & (hard / n >= consonants), kinds <= F.greatest(F.lit(3), F.floor(n / 2))).otherwise(False)

    def of_value(value: Column) -> Column:
        solid = F.length(F.replace(value, F.lit(" "), F.lit("")))
        odd = F.length(F.regexp_replace(value, r"[\p{L}\p{N}_\s]+", ""))
        letters = F.lower(F.regexp_replace(value, r"[^\p{L}]+", ""))
        return F.when(F.length(value) < least, False).when(odd / solid > symbols, True).when(let(letters, of_letters), True).otherwise(value.rlike(r"(?s)^(.)\1*$"))

    return let(text if cleaned else clean(text), of_value)


#: Keyword rules that name a sheet; the first rule with two hits wins.
SHEET_RULES = (
    ("Packing_List", ("description", "item", "qty", "quantity", "weight", "mô tả", "số lượng", "trọng lượng")),
    ("Fee_Schedule", ("fee", "cost", "tax", "charge", "phí", "chi phí", "thuế")),
    ("Contacts", ("name", "email", "phone", "address", "tên", "điện thoại", "địa chỉ")),
    ("Inventory", ("sku", "stock", "warehouse", "inventory", "tồn kho", "mã hàng", "kho")),
    ("Payments", ("payment", "paid", "bank", "amount", "thanh toán", "ngân hàng", "số tiền")),
)


def sheet_kind(header: Column) -> Column:
    """The name of the first rule with two keywords in the header, else Table."""
    low, out = F.lower(header), F.lit("Table")
    for name, words in reversed(SHEET_RULES):
        hits = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
        out = F.when(hits >= 2, name).otherwise(out)
    return out


def sheet_base(name: Column) -> Column:
    """A name without the characters a sheet can't have, at most 28 long."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(name, r"[\\/*?:\[\]]", "-"), 1, 28), F.lit("")), F.lit("Table"))
