"""Golden values and brute force for operators without an SQL twin."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import angles, arrays, geometry, ids, money, text
from foliant.operators import extraction, fusion, graph, matching, metrics, quality, relational, sequences, splits, tables


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_angles(spark):
    given = [0.0, 360.0, 720.0, -360.0, -1.0, 361.5, -450.0]
    assert values(spark, angles.normal_angle(F.col("a")), [(a,) for a in given], "a double") == [0, 0, 0, 0, 359, 1.5, 270]
    z = [(0.0, 1), (89.999, 1), (90.0, 2), (179.999, 2), (180.0, 3), (269.999, 3), (270.0, 4), (359.999, 4), (360.0, 1), (-1.0, 4)]
    assert values(spark, angles.zone(F.col("a")), z, "a double, z int") == [x for _, x in z]
    e = [(359.0, 1.0, 2), (1.0, 359.0, 2), (0.0, 180.0, 180), (45.0, 405.0, 0), (-10.0, 10.0, 20)]
    assert values(spark, angles.circular_error(F.col("a"), F.col("b")), e, "a double, b double, e int") == [x for *_, x in e]
    assert values(spark, angles.rotation_name(F.lit("page_a"), F.col("a")), [(90.0,), (-1.0,), (12.5,)], "a double") == ["page_a_angle_090_zone_2.png", "page_a_angle_359_zone_4.png", "page_a_angle_012p500_zone_1.png"]
    assert values(spark, angles.normal_angle(F.col("a")), [(float("nan"),), (float("inf"),)], "a double") == [None, None]


def test_money_and_currency(spark):
    cases = [("1,234.50", "1234.50"), ("1.234,50", "1234.50"), ("1,234", "1.23"), ("USD 12", "12.00"), ("2.345", "2.34"), ("x", None), ("12,34,56", "123456.00"), ("", None)]
    assert values(spark, money.normal_money(F.col("m")), cases, "m string, e string") == [e for _, e in cases]
    assert values(spark, money.currency(F.col("m")), [("country",), ("99 $",), ("none",), ("฿5",)], "m string") == ["TRY", "USD", None, "THB"]


def test_ids(spark):
    assert values(spark, ids.human_bytes(F.col("n")), [(512,), (1536,), (35459126772,)], "n long") == ["512.00 B", "1.50 KiB", "33.02 GiB"]
    assert values(spark, ids.normal_path(F.col("p")), [("./../a\\b",)], "p string") == ["a/b"]
    assert values(spark, ids.as_bool(F.col("p")), [("TRUE ",), ("0",), (None,), ("y",)], "p string") == [True, False, False, True]
    assert values(spark, ids.safe_stem(F.col("p")), [("a b/ç.pdf",)], "p string") == ["a_b_.pdf"]


def test_text(spark):
    rows = [("kitten", "sitting"), ("the cat", "The  Cat"), ("ﬁne Straße", "fine strasse")]
    got = spark.createDataFrame(rows, "a string, b string").select(F.levenshtein("a", "b"), text.fuzzy_ratio("a", "b"), text.metric_text("a"), text.annotation_text("b")).collect()
    assert got[0][0] == 3
    assert [r[1] for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows]
    assert got[2][2] == "fine strasse" and got[1][3] == "thecat"
    w = spark.createDataFrame([("the cat sat down", "the dog sat"), (" ".join(map(str, range(700))), "x")], "a string, b string")
    assert [r[0] for r in w.select(text.word_distance(F.split("a", " "), F.split("b", " "))).collect()] == [2, 700]


def test_arrays(spark):
    d = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>")
    got = d.select(arrays.argmax(F.col("x")), arrays.softmax(F.col("x")), arrays.entropy(F.array(F.lit(1.0), F.lit(1.0))), arrays.resample(F.col("x"), 5)).first()
    assert got[0] == 1 and sum(got[1]) == pytest.approx(1) and got[2] == pytest.approx(1.0)
    assert got[3] == [1.0, 2.0, 3.0, 3.0, 3.0]


def test_rotation_goes_back(spark):
    t = geometry.page_rotation(F.lit(100.0), F.lit(50.0), F.col("a"))
    x, y = t.apply(F.lit(0.0), F.lit(0.0))
    bx, by = t.restore(x, y)
    rows = spark.createDataFrame([(0.0,), (90.0,), (37.0,)], "a double").select(t.width, t.height, bx, by, x, y).collect()
    assert (rows[0][0], rows[0][1]) == (100, 50) and (rows[1][0], rows[1][1]) == (50, 100)
    assert (rows[1][4], rows[1][5]) == (pytest.approx(0), pytest.approx(100))
    for r in rows:
        assert r[2] == pytest.approx(0, abs=1e-9) and r[3] == pytest.approx(0, abs=1e-9)


def test_rule_fields(spark):
    lines = ["ACME COMPANY", "Invoice No: #INV-2026-7", "Date: 2026-01-02 14:35", "Subtotal: 100.00 TRY", "KDV: 7.00", "Grand total: 107.00 TRY", "Paid by: nakit cash", "Tax id: #99887", "Balance due: 0.00", "ops@acme.example, www.acme.example;"]
    d = spark.createDataFrame([(1, i, t, 0.9) for i, t in enumerate(lines)], "doc int, line int, text string, c double")
    got = {r["field"]: r["value"] for r in extraction.extract_fields(d, ["doc"], "line", "text", "c").collect()}
    want = {"invoice_number": "INV-2026-7", "date": "2026-01-02", "time": "14:35", "subtotal": "100.00", "tax": "7.00", "total_amount": "107.00", "payment_method": "cash", "currency": "TRY", "tax_identification_number": "99887", "balance": "0.00", "email": "ops@acme.example", "website": "www.acme.example", "document_title": "invoice"}
    assert {k: got.get(k) for k in want} == want
    boxes = spark.createDataFrame([(1, t, 0.0, 20.0 * i, 100.0, 20.0 * i + 15, 0.8) for i, t in enumerate(lines)], "doc int, text string, x0 double, y0 double, x1 double, y1 double, c double")
    assert extraction.organization(boxes, ["doc"], "text", ["x0", "y0", "x1", "y1"], "c").first()["value"] == "ACME COMPANY"


def test_fusion_abstains(spark):
    schema = "k string, value string, confidence double"
    model = spark.createDataFrame([("a", "X", 0.8), ("b", "X", 0.9), ("c", "X", 0.6), ("d", "x  y", 0.5)], schema)
    rule = spark.createDataFrame([("b", "Y", 0.5), ("c", "Y", 0.55), ("d", "X Y", 0.5), ("e", "Z", 0.1)], schema)
    got = {r["k"]: (r["value"], r["note"]) for r in fusion.fuse_page(model, rule, ["k"]).collect()}
    assert got == {"a": ("X", None), "b": ("X", "conflict_selected"), "c": (None, "conflict_abstained"), "d": ("x  y", None), "e": ("Z", None)}


def test_thresholds_and_calibration(spark):
    d = spark.createDataFrame([(0.95, 1, 1), (0.80, 1, 1), (0.30, 1, 0)], "c double, p int, t int")
    assert metrics.best_f1_threshold(d, "c", "p", "t").first()[:] == (0.8, 1.0)
    e = spark.createDataFrame([(0.95, True), (0.85, True), (0.45, False), (0.30, False)], "c double, ok boolean")
    assert metrics.calibration_error(e, "c", "ok", bins=4).first()[0] == pytest.approx(0.2375)
    assert metrics.best_f1_threshold(d.limit(0), "c", "p", "t").first()[:] == (0.5, 0.0)


def test_bio(spark):
    labels = ["KEY", "KEY", "VALUE", "OTHER", "ANSWER", "ANSWER"]
    d = spark.createDataFrame([(1, i, x, "e") for i, x in enumerate(labels)], "d int, i int, label string, e string")
    got = [r["bio"] for r in sequences.bio_encode(d, ["d"], "i", "label", "e").orderBy("i").collect()]
    assert got == ["B-KEY", "I-KEY", "B-VALUE", "O", "B-ANSWER", "I-ANSWER"]
    stray = spark.createDataFrame([(1, i, x) for i, x in enumerate(["I-KEY", "I-KEY", "I-VALUE", "O", "I-KEY", "B-KEY"])], "d int, i int, t string")
    assert sorted((r["label"], r["first"], r["last"]) for r in sequences.bio_spans(stray, ["d"], "i", "t").collect()) == [("KEY", 0, 1), ("KEY", 4, 4), ("KEY", 5, 5), ("VALUE", 2, 2)]


def test_greedy_pairs(spark):
    d = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.7), (1, 1, 1, 0.6)], "p int, a int, b int, s double")
    assert sorted((r["a"], r["b"]) for r in matching.greedy_pairs(d, ["p"], "a", "b", "s").collect()) == [(0, 0), (1, 1)]


def test_components_by_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if x != find(x)}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_leakage_safe_split(spark):
    rows = [(i, f"d{i % 3}", f"k{i // 2}", "") for i in range(200)]
    d = spark.createDataFrame(rows, "id long, ds string, a string, b string")
    out = splits.leakage_safe_split(d, "id", "ds", ["a", "b"], held_out=["d2"])
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 200
    for i in range(0, 200, 2):
        assert got[i]["project_split"] == got[i + 1]["project_split"]
    assert all(got[i]["project_split"] == "unseen_domain_test" for i in range(200) if i % 3 == 2)
    rest = [x["project_split"] for x in got.values() if x["project_split"] != "unseen_domain_test"]
    assert 0.55 < rest.count("train") / len(rest) < 0.85


def test_table_grid(spark):
    cells = [(1, f"{r}{c}", t, c * 100.0, r * 20.0 + c, c * 100.0 + 80, r * 20.0 + 15) for r, row in enumerate([["Item", "Qty"], ["1", "2"]]) for c, t in enumerate(row)]
    g = tables.head_semantics(tables.table_grid(spark.createDataFrame(cells, "p int, id string, text string, x0 double, y0 double, x1 double, y1 double"), "p"), "p")
    assert tables.grid_text(g, "p").first()["table_text"] == "Item | Qty\n1 | 2"
    assert {(r["semantic"], r["row_type"]) for r in g.collect()} == {("description", "header"), ("quantity", "header"), ("description", "item"), ("quantity", "item")}


def test_required_join_fails(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no row"):
        relational.required_join(a, b, ["k"]).collect()


def test_guard(spark):
    d = spark.createDataFrame([(1, True)], "k int, private boolean")
    with pytest.raises(Exception, match="private row"):
        quality.require_none(d, F.col("private"), "private row").collect()


def test_deskew(spark):
    poly = [[[0.0, 0.0], [100.0, 5.0], [100.0, 25.0], [0.0, 20.0]]] * 6 + [[[0.0, 0.0], [5.0, 0.0], [5.0, 5.0], [0.0, 5.0]]]
    d = spark.createDataFrame([(1, p, 0.9) for p in poly], "p int, poly array<array<double>>, c double")
    r = quality.deskew(d, ["p"], "poly", "c").first()
    assert r["angle"] == pytest.approx(2.8624, abs=1e-3) and r["words"] == 6 and r["dispersion"] == pytest.approx(0)


def test_near_hashes_by_brute_force(spark):
    r = random.Random(5)
    h = [r.getrandbits(16) - (1 << 15) for _ in range(200)]
    got = {(x["a"], x["b"]) for x in matching.near_hashes(spark.createDataFrame(list(enumerate(h)), "id int, h long"), "id", "h", 3, bits=64).collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if ((h[i] ^ h[j]) & (2**64 - 1)).bit_count() <= 3}


def test_relation_pairs(spark):
    e = [(1, "key", "KEY", 0.0, 0.0, 40.0, 10.0), (1, "near", "VALUE", 50.0, 0.0, 90.0, 10.0), (1, "far", "VALUE", 900.0, 900.0, 950.0, 910.0), (2, "other", "VALUE", 50.0, 0.0, 90.0, 10.0)]
    d = spark.createDataFrame(e, "page int, id string, label string, x0 double, y0 double, x1 double, y1 double")
    got = matching.infer_relations(d, ["page"]).collect()
    assert [(x["source"], x["target"], x["type"]) for x in got] == [("key", "near", "KEY_VALUE")] and got[0]["confidence"] > 0.8


def test_align(spark):
    def row(i, t, x):
        return (1, i, t, x, 0.0, x + 40, 10.0)

    s = [row(0, "total", 0.0), row(1, "amount", 50.0), row(2, "istanbul", 100.0), row(3, "lost", 150.0)]
    o = [row(0, "totalamount", 0.0), row(1, "istanbul", 100.0), row(2, "zzz", 400.0)]
    schema = "p int, id int, text string, x0 double, y0 double, x1 double, y1 double"
    got = {(x["source"], x["ocr"]) for x in matching.align_tokens(spark.createDataFrame(s, schema), spark.createDataFrame(o, schema), ["p"]).collect()}
    assert got == {(0, 0), (1, 0), (2, 1)}


def test_normal_words(spark):
    from foliant.operators import reading

    rows = [("p", 0, "Total", None, "0.9", None, [0.0, 0.0, 10.0, 5.0], None), ("p", 1, None, " 12 ", None, "1.7", None, [[0.0, 0.0], [9.0, 1.0], [9.0, 6.0], [0.0, 5.0]]), ("p", 2, " ", None, "0.1", None, [0.0, 0.0, 1.0, 1.0], None), ("p", 3, "x", None, "nan", None, [5.0, 5.0, 5.0, 5.0], None)]
    d = spark.createDataFrame(rows, "page string, at int, rec_text string, text string, rec_score string, score string, box array<double>, poly array<array<double>>")
    words, problems = reading.normal_words(d, "page", "at", ["rec_text", "text"], ["rec_score", "score"], "box", "poly")
    assert [(r["text"], r["confidence"], r["x1"], r["y1"]) for r in words.orderBy("at").collect()] == [("Total", 0.9, 10.0, 5.0), ("12", 1.0, 9.0, 6.0)]
    assert [(r["at"], r["problem"]) for r in problems.collect()] == [(3, "bad_geometry")]
