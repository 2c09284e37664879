"""Queries that cover whole tables: equal to their SQL on the rows it covers, to brute force on the others."""

import math
import statistics
import unicodedata

import pytest

from foliant.plans import registry
from tests.oracle import connect, difference

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def ocr_total(t):
    words = [w for w in t.split(" ") if w.strip(" ")]
    n, c = len(words), [len(w) * 37 % 100 / 100 for w in words]
    kind = [[unicodedata.category(k)[0] for k in w] for w in words]
    bad = sum(not any(k in "LN" for k in kinds) or max(map(w.count, w)) / len(w) > 0.8 for w, kinds in zip(words, kind))
    chars, mean = sum(map(len, words)), sum(c) / n
    script = sum(k == "L" for kinds in kind for k in kinds)
    thai = sum("฀" <= k <= "๿" for w in words for k in w)
    valid = sum(k != "C" for kinds in kind for k in kinds) / chars
    total = 0.22 * min(1, math.log1p(n) / math.log(41)) + 0.22 / (1 + math.exp(-(mean - 0.75) / 0.2)) + 0.08 * statistics.median(c) + 0.10 * min(1, 8 * min(1, chars * 12 / 100_000))
    total += 0.13 * valid + 0.10 * (1 - thai / max(1, script)) + 0.10 - 0.025 * (n - len({w.strip(" ").lower() for w in words})) / n - 0.025 * bad / n - 0.025 * sum(x < 0.25 for x in c) / n
    return n, round(max(0, min(1, total)), 6)


def test_ocr_quality_of_all_documents(spark, tmp_path):
    texts = {1: "plain words here", 3: "naïve café — déjà vu !!!", 10: "aaaaaaaa ok Ok", 12: "ภาษา and more"}
    folder = save(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["words"], r["total"]) for r in QUERIES["ocr_quality_score"](spark, folder).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n, total = ocr_total(t)
        assert got[i][0] == n and got[i][1] == pytest.approx(total, abs=2e-6)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_of_all_turns(spark, sf_dir, tmp_path):
    texts = ["plain", "déjà vu, naïve", "ab" * 600 + "é", "𝒳y日本語", "", "é"]
    folder = save(spark, tmp_path, "conversations", [(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string")
    got = {r["turn"]: (r["char_edits"], r["cer"]) for r in QUERIES["text_error_rates"](spark, folder).collect()}
    want = {k: edits(t, t[2:]) for k, t in enumerate(texts)}
    assert got == {k: (n, pytest.approx(n / max(1, len(texts[k])), abs=1e-6)) for k, n in want.items()}
    all_turns = QUERIES["text_error_rates"](spark, sf_dir)
    assert all_turns.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()


@pytest.mark.parametrize("name, key, source, column", [("table_grid", "l_orderkey", "lineitem", "l_orderkey"), ("document_results", "document_id", "orders", "o_orderkey"), ("image_features", "id", "pages", "page_id"), ("image_hashes", "id", "pages", "page_id")])
def test_every_order_and_page(spark, name, key, source, column):
    small = "/root/testdata/sf0.001"
    want = {r[0] for r in spark.read.parquet(f"{small}/{source}.parquet").select(column).distinct().collect()}
    got = QUERIES[name](spark, small)
    assert {r[0] for r in got.select(key).distinct().collect()} == want
    if name == "document_results":
        assert difference(got, connect(small), SQL[name]) == ""


def test_images_hold_whole_pages(spark, tmp_path):
    html = {1: "<p>é</p>", 2: "", 3: "x" * 5000 + "end"}
    folder = save(spark, tmp_path, "pages", list(html.items()), "page_id long, html string")
    for r in registry.results._page_images(spark, folder).collect():
        assert len(r["pixels"]) == r["height"] * r["width"] > 0 and bytes(r["pixels"]).rstrip(b"\0") == html[r["id"]].encode()


def test_whole_turns_are_aligned(spark, tmp_path):
    turns = [(c, k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word{i}" for i in range(n))) for c, k, n in ((1, 0, 130), (2, 0, 5), (4, 1, 70), (7, 3, 61))]
    folder = save(spark, tmp_path, "conversations", turns, "conv_id long, turn int, text string")
    pages = {}
    for r in QUERIES["token_alignment"](spark, folder).collect():
        pages.setdefault(r["page"], {})[r["source"]] = r["ocr"]
    assert set(pages) == {f"{c}-{k}" for c, k, _ in turns}
    for c, k, text in turns:
        for i in range(len(text.split(" "))):
            if i % 9 != 8:  # the others are lost
                assert pages[f"{c}-{k}"][i] == i
