"""Pages and documents in one row each: the same results as over rows of lines, and nothing dealt out."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import money
from foliant.operators import assembly, extraction, fusion, reading
from foliant.plans import registry

QUERIES = registry.queries()
TEXTS = [
    "ACME COMPANY", "Invoice No: #INV-2026-7", "Date: 2026-01-02 14:35", "Subtotal: 100.00 TRY", "KDV: 7.00", "Grand total: 107.00 TRY", "Total: 99.00", "Paid by: nakit cash", "Tax id: #99887", "Balance due: 0.00",
    "ops@acme.example, www.acme.example;", "", None, "   ", "ยอดรวม: 12,50 บาท", "ชื่อ: สมชาย", "Tel +90 (212) 555 44 33", "müşteri no: 77ab", "country vat no # AB-1 fiş", "Bank account: TR12 3456", "ödenen 5.00", "toplam 1.234,50 €",
]


def by_keywords(text):
    """Currency, title and way to pay by looking for each word by itself."""
    t = F.trim(F.col(text))
    return F.struct(money.currency(t).alias("currency"), money.document_title(t).alias("document_title"), F.when(extraction.holds(F.lower(t), extraction.KEYWORDS["payment_method"]), money.payment_method(t)).alias("payment_method"))


def test_all_words_are_found_in_one_pass(spark):
    words = [w for ws in extraction.KEYWORDS.values() for w in ws]
    texts = [f"{a}{b}: x12.50" for a in words for b in (" ", "", words[(7 * len(a)) % len(words)])]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    held = F.array(*[F.when(extraction.holds(F.lower("t"), ws), f) for f, ws in extraction.KEYWORDS.items()])
    said = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower("t"), F.lit(extraction.SIGN), F.lit(1)), lambda w: F.create_map(*[x for k, ms in extraction.SIGNS.items() for x in (F.lit(k), F.array(*map(F.lit, ms)))])[w])))
    for r in d.select("t", F.array_compact(held).alias("want"), said.alias("got"), by_keywords("t").alias("one"), extraction.line_fields(F.col("t"), F.lit(0.5)).alias("f")).collect():
        assert set(r["want"]) == {m for m in r["got"] if m[0] != "~"}, r["t"]
        found = {f["field"]: f["value"] for f in r["f"]}
        assert {k: found.get(k) for k in r["one"].asDict()} == r["one"].asDict(), r["t"]


def test_page_in_a_row_equals_rows(spark):
    rows = [(p, i, t, 0.5 + (i * p) % 4 / 10, 0.0, 10.0 * i, 50.0, 10.0 * i + 8) for p in (1, 2, 3) for i, t in enumerate(TEXTS[p - 1 :])]
    d = spark.createDataFrame(rows, "p int, line int, text string, c double, x0 double, y0 double, x1 double, y1 double")
    names = ["field", "value", "raw", "confidence", "status", "line", "values"]
    line = F.struct("line", "text", F.col("c").alias("confidence"), F.array("x0", "y0", "x1", "y1").alias("box"))
    pages = d.groupBy("p").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    want = extraction.extract_fields(d, ["p"], "line", "text", "c").select("p", *names)
    got = pages.select("p", F.explode(extraction.page_winners(F.col("lines"))).alias("x")).select("p", *[f"x.{n}" for n in names])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = extraction.page_fields(d, ["p"], "line", "text", ["x0", "y0", "x1", "y1"], "c")
    got = pages.select("p", F.explode(extraction.page_evidence(F.col("lines"))).alias("x")).select("p", "x.*").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_documents_in_rows_equal_rows(spark):
    rows = [(k, p, i, t, 0.5 + (i * p + k) % 4 / 10) for k in (1, 2, 3) for p in (1, 2, 3) for i, t in enumerate(TEXTS) if t and (i * 7 + k * p) % 3] + [(9, 1, 0, "...", 0.5)]
    d = spark.createDataFrame(rows, "document_id int, page int, line int, text string, confidence double")
    pages = d.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text", "confidence"))).alias("lines"))
    docs = pages.groupBy("document_id").agg(F.collect_list(F.struct("page", "lines")).alias("pages"))
    want, _ = reading.extract_documents(d)
    got = reading.document_rows(docs, "document_id", F.col("pages"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r[0] for r in got.select("document_id").collect()} == {1, 2, 3}


def test_field_structs_refuse_unknown_fields(spark):
    d = spark.createDataFrame([(1, [("colour", "red", 0.5)])], "doc int, f array<struct<field:string,value:string,confidence:double>>")
    with pytest.raises(Exception, match="unsupported field colour"):
        assembly.field_structs(d, "doc", F.col("f")).collect()


@pytest.mark.parametrize("name", ["rendered_invoice_fields", "result_fields", "document_results", "rule_evidence"])
def test_fields_come_without_aggregates(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_fused_value_is_the_best_pages(spark):
    d = spark.createDataFrame([([("f", "A b", 0.5, 1), ("f", "a  B", 0.6, 2), ("f", "c", 0.2, 3), ("g", "x", 0.5, 1), ("g", "y", 0.45, 2)],)], "f array<struct<field:string,value:string,confidence:double,page:int>>")
    got = {r["field"]: (r["value"], r["confidence"]) for r in d.select(F.inline(fusion.fused_fields(F.col("f")))).collect()}
    assert got == {"f": ("a  B", pytest.approx(0.63)), "g": (None, None)}
