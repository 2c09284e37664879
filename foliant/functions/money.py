"""Money, currencies and keyword maps of receipts and invoices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.arrays import let

# Currency markers in order of priority. Letters match anywhere in lower-cased text, other marks in the text.
CURRENCIES = [("฿", "THB"), ("thb", "THB"), ("บาท", "THB"), ("₺", "TRY"), ("try", "TRY"), ("tl", "TRY"), ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP")]
# Words that name a way to pay.
PAYMENT = [("cash", ["cash", "nakit", "เงินสด"]), ("credit_card", ["credit card", "kredi kartı", "บัตรเครดิต"]), ("bank_transfer", ["bank transfer", "havale", "โอนเงิน"])]
# Words that name a kind of document.
TITLES = [("invoice", ["invoice", "fatura", "ใบแจ้งหนี้"]), ("receipt", ["receipt", "fiş", "fis", "ใบเสร็จ"])]

# An amount with or without a currency, and the marks that are no part of the number.
MONEY = r"(?i)(?:(?:THB|TRY|USD|EUR|GBP|฿|₺|\$|€|£)\s*)?[-+]?\d[\d.,\s]*\d(?:\s*(?:THB|TRY|USD|EUR|GBP|฿|₺|\$|€|£))?"


def normal_money(raw: Column) -> Column:
    """Text of an amount with two decimals, or null.

    With both marks the later one is decimal; one comma before two or three digits is decimal ("1,234" is 1.23);
    other commas go. Rounds half to even, once; amounts may have 24 digits before the point and count 14 after it.
    """
    def number(x: Column) -> Column:
        comma_last = F.length(x) - F.locate(",", F.reverse(x))
        dot_last = F.length(x) - F.locate(".", F.reverse(x))
        both = F.when(comma_last > dot_last, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit("")))
        plain = F.when(~x.contains(","), x).when(x.contains("."), both).when(x.rlike(r"^[^,]*,[^,]{2,3}$"), F.replace(x, F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit("")))
        return F.bround(plain.try_cast("decimal(38,14)"), 2).cast("decimal(38,2)").cast("string")

    return let(F.regexp_replace(raw, r"(?i)(?:THB|TRY|USD|EUR|GBP|฿|₺|\$|€|£|\s)", ""), number)


def first_marked(text: Column, pairs: list[tuple[str, list[str]]]) -> Column:
    low, out = F.lower(text), None
    for value, words in pairs:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def currency(text: Column) -> Column:
    """The first marker's code: by order of markers, not of place ("country" holds "try")."""
    low, out = F.lower(text), None
    for mark, code in CURRENCIES:
        hit = (low if mark.isalpha() else text).contains(mark)
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out


def payment_method(text: Column) -> Column:
    return first_marked(text, PAYMENT)


def document_title(text: Column) -> Column:
    return first_marked(text, TITLES)
