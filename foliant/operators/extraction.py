"""Fields of receipts and invoices from lines of text, by patterns and keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.arrays import let
from foliant.functions.money import CURRENCIES, MONEY, PAYMENT, TITLES, normal_money

# Patterns of what stands in a line.
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
WEBSITE = r"(?i)\b(?:https?://|www\.)[^\s<>()]+"
PHONE = r"(?U)(?<!\w)(?:\+?\d[\d\s().\-]{6,}\d)(?!\w)"
DATE = r"(?i)\b(?:\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}|\d{1,2}[\-\s](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\-\s]\d{2,4})\b"
TIME = r"(?i)\b(?:[01]?\d|2[0-3]):[0-5]\d(?:\s?[AP]M)?\b"
NUMBER = r"(?i)[:#]\s*([A-Z0-9][A-Z0-9/_.\-]{2,})"

# Words of headings, which are no organisation.
HEADING = r"(?i)invoice|receipt|date|total|tax|fatura|ใบเสร็จ"

# Keywords of each field in English, Turkish and Thai.
KEYWORDS = {
    "invoice_number": ["invoice no", "invoice number", "invoice #", "fatura no", "เลขที่ใบแจ้งหนี้"],
    "receipt_number": ["receipt no", "receipt number", "transaction no", "transaction number", "fiş no", "เลขที่ใบเสร็จ"],
    "reference_number": ["reference no", "reference number", "referans no", "เลขอ้างอิง"],
    "subtotal": ["subtotal", "sub total", "ara toplam", "ยอดรวมก่อนภาษี"],
    "discount": ["discount", "indirim", "ส่วนลด"],
    "service_charge": ["service charge", "hizmet bedeli", "ค่าบริการ"],
    "tax": ["tax", "vat", "kdv", "ภาษี", "ภาษีมูลค่าเพิ่ม"],
    "total_amount": ["grand total", "total amount", "amount due", "total", "genel toplam", "toplam", "ยอดรวม", "รวมทั้งสิ้น"],
    "paid_amount": ["paid amount", "amount paid", "paid", "ödenen", "ชำระแล้ว", "ยอดชำระ"],
    "balance": ["balance due", "balance", "remaining", "bakiye", "ยอดคงเหลือ"],
    "payment_method": ["payment method", "paid by", "cash", "credit card", "nakit", "kredi kartı", "ชำระโดย", "เงินสด", "บัตรเครดิต"],
    "address": ["address", "adres", "ที่อยู่"],
    "tax_identification_number": ["tax id", "tax number", "vat no", "vergi no", "เลขประจำตัวผู้เสียภาษี"],
    "customer_account_number": ["customer no", "customer number", "account no", "account number", "müşteri no", "เลขที่ลูกค้า"],
    "vendor_name": ["vendor", "merchant", "seller", "supplier", "satıcı", "ผู้ขาย", "ร้านค้า"],
    "customer_name": ["customer", "buyer", "client", "müşteri", "ลูกค้า", "ผู้ซื้อ"],
    "person_name": ["full name", "name", "ad soyad", "ชื่อ-นามสกุล", "ชื่อ"],
    "bank_name": ["bank name", "bank", "banka", "ธนาคาร"],
    "account_reference": ["iban", "bank account", "account reference", "hesap", "เลขที่บัญชี"],
}
NUMBERED = ["invoice_number", "receipt_number", "reference_number", "tax_identification_number", "customer_account_number"]
AMOUNTS = ["subtotal", "discount", "service_charge", "tax", "total_amount", "paid_amount", "balance"]
LABELLED = ["address", "vendor_name", "customer_name", "person_name", "bank_name", "account_reference"]

# Words of questions for each field, in order.
QUESTIONS = [
    (["store name", "merchant", "company"], "organization_name"),
    (["invoice number"], "invoice_number"),
    (["receipt number", "transaction number"], "receipt_number"),
    (["reference number", "account number"], "reference_number"),
    (["due date", " date", "date?"], "date"),
    (["subtotal"], "subtotal"),
    (["tax", "vat"], "tax"),
    (["total", "amount due"], "total_amount"),
    (["address"], "address"),
    (["email"], "email"),
    (["phone", "telephone"], "phone_number"),
]


def holds(text: Column, words: list[str]) -> Column:
    """Lower-cased text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out


def after_label(text: Column) -> Column:
    """What follows the first colon, or null."""
    return let(F.trim(F.regexp_extract(text, r"(?s)^.*?[:：](.*)$", 1)), lambda x: F.when(x != "", x))


def _signs() -> dict[str, list[str]]:
    """Each word that says something about a line, with all that it says: fields and, marked and numbered by rank, currencies, ways to pay and titles.

    Words that hold another one with the same meaning are left out; a word says also what its beginnings say.
    """
    told: dict[str, list[str]] = {}

    def tell(meaning: str, words: list[str]) -> None:
        for w in words:
            if not any(o != w and o in w for o in words):
                told.setdefault(w.lower(), []).append(meaning)

    for f, words in KEYWORDS.items():
        tell(f, words)
    for kind, pairs in (("~c", [(code, [mark]) for mark, code in CURRENCIES]), ("~p", PAYMENT), ("~t", TITLES)):
        for rank, (value, words) in enumerate(pairs):
            tell(f"{kind}{rank:02d}{value}", words)
    return {w: sorted({m for o in told if w.startswith(o) for m in told[o]}) for w in told}


SIGNS = _signs()


def _longest_words(words: list[str]) -> str:
    """A pattern for the longest of the words at a place, letter by letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(w for w in words if w):
        heads.setdefault(w[0], []).append(w[1:])
    inner = "|".join(re.escape(c) + _longest_words(rest) for c, rest in heads.items())
    return f"(?:{inner}){'?' if '' in words else ''}" if inner else ""


def _by_range(words: list[str]) -> str:
    """The pattern in parts by ranges of first letters, so that a place tries a few letters only."""
    ranges = [("a", "b"), ("c", "d"), ("e", "h"), ("i", "m"), ("n", "q"), ("r", "s"), ("t", "t"), ("u", "z")]
    parts = [(f"[{a}-{b}]", [w for w in words if a <= w[0] <= b]) for a, b in ranges]
    parts.append(("[^a-z]", [w for w in words if not "a" <= w[0] <= "z"]))
    return "|".join(f"(?={head}){_longest_words(some)}" for head, some in parts if some)


# At every place the longest word, so that words may overlap.
SIGN = f"(?=({_by_range(list(SIGNS))}))"


def line_fields(text: Column, confidence: Column) -> Column:
    """Array of (field, value, raw, confidence, status) that the patterns find on a line.

    It is one expression on a line, so that it also runs on the elements of an array of lines. All keywords are found in
    one pass, and each pattern runs once and only where a sign of it is there.
    """
    kind = "array<struct<field:string,value:string,raw:string,confidence:double,status:string>>"
    says = F.create_map(*[x for w, ms in SIGNS.items() for x in (F.lit(w), F.array(*map(F.lit, ms)))])

    def one(field: str | Column, value: Column, raw: Column, conf: Column, status: str = "validated") -> Column:
        name = F.lit(field) if isinstance(field, str) else field
        return F.struct(name.alias("field"), value.alias("value"), raw.alias("raw"), conf.alias("confidence"), F.lit(status).alias("status"))

    def rows(on: Column, found: Column) -> Column:
        return F.when(on, found).otherwise(F.array().cast(kind))

    def filled(x: Column) -> Column:
        return let(x, lambda v: F.when(v != "", v))

    def known(v: Column) -> Column:
        t, low, c, far, digit, mark, said = (v[n] for n in ("t", "low", "c", "far", "digit", "mark", "said"))

        def sure(pattern: str) -> Column:
            return filled(F.regexp_extract(t, pattern, 0))

        def where(value: Column, row) -> Column:
            return let(value, lambda x: F.when(x.isNotNull(), row(x)))

        def same(field: str, value: Column) -> Column:
            return where(value, lambda x: one(field, x, x, c))

        site = filled(F.regexp_replace(F.regexp_extract(t, WEBSITE, 0), r"[.,;)]+$", ""))
        signs = [
            F.when(t.contains("@"), same("email", sure(EMAIL))),
            F.when(low.contains("http") | low.contains("www."), same("website", site)),
            F.when((digit | far) & t.rlike(r"(?U)\d.{6}"), where(sure(PHONE), lambda x: one("phone_number", F.regexp_replace(x, r"(?U)[^+\d]", ""), x, c))),
            F.when(digit, same("date", sure(DATE))),
            F.when(digit & t.contains(":"), same("time", sure(TIME))),
        ]

        def each(fields: list[str], on: Column, value: Column, made) -> Column:
            """A row of each field said of the line, if there is a value for them."""
            return let(F.filter(said, lambda f: f.isin(*fields)), lambda fs: rows(on & (F.size(fs) > 0), let(value, lambda x: rows(x.isNotNull(), made(fs, x)))))

        def numbers(fs: Column, n: Column) -> Column:
            return let(F.regexp_extract(n, NUMBER, 1), lambda x: F.transform(fs, lambda f: one(f, x, n, c)))

        def amounts(fs: Column, money: Column) -> Column:
            def priced(a: Column) -> Column:
                # "Subtotal" holds "total", and "tax id" holds "tax".
                fine = F.filter(fs, lambda f: ~((f == "total_amount") & F.array_contains(fs, "subtotal")) & ~((f == "tax") & F.array_contains(said, "tax_identification_number")))
                bonus = F.when(low.contains("grand") | low.contains("due"), 0.06).otherwise(0.0)
                return rows(a.isNotNull(), F.transform(fine, lambda f: one(f, a, money, F.least(F.lit(1.0), c + F.when(f == "total_amount", bonus).otherwise(0.06)))))

            return let(normal_money(money), priced)

        def first(mark: str) -> Column:
            return F.substring(F.array_min(F.filter(said, lambda m: m.startswith(mark))), 5, 100)

        def from_words() -> Column:
            money = F.trim(F.try_element_at(F.regexp_extract_all(t, F.lit(MONEY), F.lit(0)), F.lit(-1)))
            whole = [
                F.when(F.array_contains(said, "payment_method"), where(first("~p"), lambda x: one("payment_method", x, t, c, "unvalidated"))),
                where(first("~c"), lambda x: one("currency", x, t, c)),
                where(first("~t"), lambda x: one("document_title", x, t, c)),
            ]
            labels = each(LABELLED, mark, after_label(t), lambda fs, x: F.transform(fs, lambda f: one(f, x, t, c, "unvalidated")))
            return F.flatten(F.array(each(NUMBERED, mark, sure(NUMBER), numbers), each(AMOUNTS, digit, money, amounts), labels, F.array(*whole)))

        return F.array_compact(F.flatten(F.array(F.array(*signs), rows(F.size(said) > 0, from_words()))))

    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.cast("double"), F.lit(0.5))))

    def marked(v: Column) -> Column:
        t, low = v["t"], v["low"]
        said = let(F.regexp_extract_all(low, F.lit(SIGN), F.lit(1)), lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: F.try_element_at(says, w)))))
        parts = {"t": t, "low": low, "c": conf, "far": F.octet_length(t) != F.length(t), "digit": t.rlike("[0-9]"), "mark": t.contains(":") | t.contains("#") | t.contains("："), "said": said}
        return let(F.struct(*[x.alias(n) for n, x in parts.items()]), known)

    return let(F.trim(text), lambda t: let(F.struct(t.alias("t"), F.lower(t).alias("low")), marked))


def page_winners(lines: Column) -> Column:
    """Array of (field, value, raw, confidence, status, line, values) of a page's lines, an array of (line, text, confidence).

    The same winners as those of ``extract_fields``. A page in one row needs no shuffle and no more memory than its lines.
    """

    def line_rows(l: Column) -> Column:
        return F.transform(line_fields(l["text"], l["confidence"]), lambda x: F.struct(x["confidence"].alias("confidence"), (-l["line"]).alias("at"), *[x[n].alias(n) for n in ("field", "value", "raw", "status")]))

    def best(found: Column) -> Column:
        def winner(f: Column) -> Column:
            def top(same: Column) -> Column:
                values = F.size(F.array_distinct(F.transform(same, lambda x: x["value"]))).cast("long")
                return let(F.array_max(same), lambda b: F.struct(f.alias("field"), b["value"].alias("value"), b["raw"].alias("raw"), b["confidence"].alias("confidence"), b["status"].alias("status"), (-b["at"]).alias("line"), values.alias("values")))

            return let(F.filter(found, lambda x: x["field"] == f), top)

        return F.transform(F.array_distinct(F.transform(found, lambda x: x["field"])), winner)

    kept = F.filter(lines, lambda l: l["text"].isNotNull() & (F.trim(l["text"]) != ""))
    return let(F.flatten(F.transform(kept, line_rows)), best)


def extract_fields(lines: DataFrame, by: list[str], line: str, text: str, confidence: str) -> DataFrame:
    """(by..., field, value, raw, confidence, status, line, values): the winner of each field.

    The highest confidence wins, on a tie the first line. ``values`` above 1 is a conflict to report.
    """
    known = lines.where(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    c = known.select(*by, F.col(line).alias("line"), F.explode_outer(line_fields(F.col(text), F.col(confidence))).alias("x")).where("x is not null").select(*by, "line", "x.*")
    return winners(c, by)


def page_evidence(lines: Column) -> Column:
    """Array of (field, value, raw, confidence, status, line, values, method, box) of a page's lines, an array of (line, text, confidence, box).

    All rule fields with their evidence as in ``page_fields``, for a page in one row.
    """

    def organisation(l: Column, top: Column) -> Column:
        t = l["text"]
        letters = F.length(F.regexp_replace(t, r"(?U)[^\p{L}]", ""))
        capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
        return (l["box"][1] <= top * 0.25) & (F.length(t) >= 3) & ~t.rlike(HEADING) & let(letters, lambda n: (n > 0) & (capitals / F.greatest(F.lit(1), n) >= 0.5))

    def first_line(ls: Column) -> Column:
        high = F.array_max(F.transform(ls, lambda l: l["box"][3]))
        kept = let(high, lambda top: F.filter(ls, lambda l: organisation(l, top)))
        # Nulls come first, as in an order by place.
        placed = F.transform(kept, lambda l: F.struct(F.struct(l["box"][1].alias("y"), l["box"][0].alias("x"), l["line"].alias("line")).alias("at"), F.struct(F.lit("organization_name").alias("field"), F.trim(l["text"]).alias("value"), F.trim(l["text"]).alias("raw"), (l["confidence"].cast("double") * 0.75).alias("confidence"), F.lit("unvalidated").alias("status"), l["line"].alias("line"), F.lit(1).cast("long").alias("values")).alias("x")))
        return F.transform(F.slice(F.sort_array(placed), 1, 1), lambda p: p["x"])

    def statuses(found: Column) -> Column:
        def amount(f: str) -> Column:
            return F.get(F.filter(found, lambda x: x["field"] == f), F.lit(0))["value"].try_cast("decimal(28,4)")

        def checked(a: Column) -> Column:
            v = totals_check(*(a[c] for c in ("subtotal", "tax", "service_charge", "discount", "total_amount", "paid_amount", "balance")))

            def each(v: Column) -> Column:
                def told(x: Column) -> Column:
                    old = F.when(x["values"] > 1, "conflict").otherwise(x["status"])
                    new = new_status(x["field"], v["low_total"], v["sum_conflict"], v["balance_conflict"])
                    method = F.when(x["field"] == "organization_name", "rule:top_header_organization").otherwise(F.concat(F.lit("rule:"), x["field"]))
                    box = F.get(F.filter(lines, lambda l: l["line"] == x["line"]), F.lit(0))["box"]
                    return F.struct(*[x[n].alias(n) for n in ("field", "value", "raw", "confidence")], F.coalesce(new, old).alias("status"), x["line"].alias("line"), x["values"].alias("values"), method.alias("method"), box.alias("box"))

                return F.transform(found, told)

            return let(F.struct(*[v[k].alias(k) for k in v]), each)

        return let(F.struct(*[amount(f).alias(f) for f in AMOUNTS]), checked)

    return let(F.flatten(F.array(page_winners(lines), first_line(lines))), statuses)


def winners(candidates: DataFrame, by: list[str]) -> DataFrame:
    best = F.max_by(F.struct("value", "raw", "confidence", "status", "line"), F.struct(F.col("confidence"), -F.col("line")))
    return candidates.groupBy(*by, "field").agg(best.alias("b"), F.count_distinct("value").alias("values")).select(*by, "field", "b.*", "values")


def organization(lines: DataFrame, by: list[str], text: str, box: list[str], confidence: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(by..., value, confidence, also...): the first line from the top, in the top quarter, that is mostly capitals and no heading."""
    x0, y0, y1 = (F.col(box[i]) for i in (0, 1, 3))
    t = F.col(text)
    top = F.max(y1).over(Window.partitionBy(*by))
    letters = F.length(F.regexp_replace(t, r"(?U)[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    fine = (F.length(t) >= 3) & (letters > 0) & ~t.rlike(HEADING) & (capitals / F.greatest(F.lit(1), letters) >= 0.5)
    kept = lines.withColumn("_top", top).where((y0 <= F.col("_top") * 0.25) & fine)
    w = Window.partitionBy(*by).orderBy(y0, x0)
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, F.trim(t).alias("value"), (F.col(confidence) * 0.75).alias("confidence"), *also)


def key_value_entities(lines: DataFrame, by: list[str], text: str, box: list[str], confidence: str) -> DataFrame:
    """Two rows, KEY and VALUE, of each line with a colon; the line's box is cut in proportion, 0.2 to 0.8."""
    t = F.trim(F.col(text))
    parts = F.split(t, r"\s*[:：]\s*", 2)
    share = F.greatest(F.lit(0.2), F.least(F.lit(0.8), F.length(parts[0]) / F.greatest(F.lit(1), F.length(t))))
    k = lines.where(t.rlike("[:：]")).withColumns({"_p": parts, "_share": share}).where("size(_p) = 2 and _p[0] <> '' and _p[1] <> ''")
    x0, y0, x1, y1 = (F.col(b).cast("double") for b in box)
    cut = x0 + (x1 - x0) * F.col("_share")
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(confidence), F.lit(0.5)) * 0.8))
    both = F.array(F.struct(F.lit("KEY").alias("label"), F.col("_p")[0].alias("text"), x0.alias("x0"), cut.alias("x1")), F.struct(F.lit("VALUE").alias("label"), F.col("_p")[1].alias("text"), cut.alias("x0"), x1.alias("x1")))
    return k.select(*by, F.explode(both).alias("e"), y0.alias("y0"), y1.alias("y1"), c.alias("confidence")).select(*by, "e.*", "y0", "y1", "confidence")


def totals_check(subtotal: Column, tax: Column, service: Column, discount: Column, total: Column, paid: Column, balance: Column) -> dict[str, Column]:
    """Verdicts on amounts: low_total, sum_conflict and balance_conflict; null where parts are missing."""
    room = F.greatest(F.lit(0.05), F.abs(total) * 0.02)
    zero = F.lit(0)
    return {
        "low_total": total < subtotal,
        "sum_conflict": F.abs(subtotal + tax + F.coalesce(service, zero) - F.coalesce(discount, zero) - total) > room,
        "balance_conflict": F.abs(total - paid - balance) > room,
    }


def new_status(field: Column, low: Column, wrong: Column, balance: Column) -> Column:
    """The status that a page's sums give a field, by the verdicts of ``totals_check``; null where they say nothing."""
    new = F.when(field == "total_amount", F.when(wrong, "conflict").when(~wrong, "validated").when(low, "conflict"))
    return new.when(field.isin("subtotal", "tax", "discount", "service_charge") & ~wrong, "validated").when((field == "balance") & balance, "conflict").when(field.isin("paid_amount", "balance") & ~balance, "validated")


def totals_status(fields: DataFrame, by: list[str]) -> DataFrame:
    """``fields`` (by..., field, value, status, ...) with the status that the sums of a page's amounts give; others stay as they are.

    Parts and total that agree are validated and a total that they contradict is a conflict; so are a balance and what was
    paid. A total under its subtotal is a conflict where tax is missing.
    """
    named = {f: F.max(F.when(F.col("field") == f, F.col("value").try_cast("decimal(28,4)"))).alias(f) for f in AMOUNTS}
    x = fields.where(F.col("field").isin(AMOUNTS)).groupBy(*by).agg(*named.values())
    v = totals_check(*(F.col(c) for c in ("subtotal", "tax", "service_charge", "discount", "total_amount", "paid_amount", "balance")))
    x = x.select(*by, v["low_total"].alias("_low"), v["sum_conflict"].alias("_sum"), v["balance_conflict"].alias("_balance"))
    new = new_status(F.col("field"), F.col("_low"), F.col("_sum"), F.col("_balance"))
    return fields.join(x, by, "left").withColumn("status", F.coalesce(new, "status")).drop("_low", "_sum", "_balance")


def page_fields(lines: DataFrame, by: list[str], line: str, text: str, box: list[str], confidence: str) -> DataFrame:
    """(by..., field, value, raw, confidence, status, line, values, method, box): all rule fields of a page with their evidence.

    The winners of ``extract_fields``, the organisation at the top, statuses by the totals, a conflict where several
    values of one field were found, and for each field its line's box and the rule that found it.
    """
    found = extract_fields(lines, by, line, text, confidence).withColumn("method", F.concat(F.lit("rule:"), "field"))
    top = organization(lines, by, text, box, confidence, (line,))
    top = top.select(*by, F.lit("organization_name").alias("field"), "value", F.col("value").alias("raw"), "confidence", F.lit("unvalidated").alias("status"), F.col(line).alias("line"), F.lit(1).cast("long").alias("values"), F.lit("rule:top_header_organization").alias("method"))
    whole = totals_status(found.unionByName(top).withColumn("status", F.when(F.col("values") > 1, "conflict").otherwise(F.col("status"))), by)
    places = lines.select(*by, F.col(line).alias("line"), F.array(*[F.col(c).cast("double") for c in box]).alias("box"))
    return whole.join(places, [*by, "line"], "left").select(*by, "field", "value", "raw", "confidence", "status", "line", "values", "method", "box")


def question_field(question: Column) -> Column:
    low, out = F.lower(question), None
    for words, field in QUESTIONS:
        out = F.when(holds(low, words), field) if out is None else out.when(holds(low, words), field)
    return out
