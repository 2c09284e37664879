"""Files, annotation formats, sinks, readers and streams on small generated inputs."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from foliant.backends import FixedReader, read_pages, with_cache
from foliant.sources import annotations, files, sinks
from foliant.streaming import evidence


def png(w, h):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IEND", b"")


def tree(root):
    for path, data in {
        "alpha_set/img/a.png": png(100, 80), "alpha_set/img/b.png": b"", "alpha_set/box/a.txt": b"1,2,3,4,5,6,7,8,caf\xe9",
        "alpha_set/meta/x.json": b'{"a": 1}', "alpha_set/meta/bad.json": b"{", "beta/list.csv": b"h1,h2\n1,2\n", "beta/doc.pdf": b"%PDF-1.4 /Type /Pages /Type /Page",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)


def test_inventory_and_discovery(spark, tmp_path):
    tree(tmp_path)
    f = files.walk(spark, str(tmp_path), content=True).unionByName(files.empty_files(spark, str(tmp_path)))
    rows, errors = files.inventory(f, "set")
    got = {r["path"]: r for r in rows.collect()}
    assert (got["alpha_set/img/a.png"]["width"], got["alpha_set/img/a.png"]["height"]) == (100, 80)
    assert got["alpha_set/box/a.txt"]["encoding"] == "windows-1252" and got["beta/doc.pdf"]["pages"] == 1
    assert {r["path"]: r["error_type"] for r in errors.collect()} == {"alpha_set/img/b.png": "empty_file", "alpha_set/meta/bad.json": "invalid_json"}
    sig = spark.createDataFrame([("alpha", "alpha", ["/box/"], ["png"]), ("beta", "beta", ["none"], ["csv"]), ("gamma", "gamma", ["none"], ["gif"])], "dataset string, name_hint string, markers array<string>, extensions array<string>")
    level = {(r["root"], r["dataset"]): r["confidence"] for r in files.discover(f, sig).collect()}
    assert level[("alpha_set", "alpha")] == "high" and level[("beta", "beta")] == "medium" and level[("beta", "gamma")] == "low"
    p = {r["path"]: r for r in files.pages(f).collect()}
    assert p["alpha_set/img/a.png"]["page"] == 1 and p["beta/doc.pdf"]["error"] == "no_pdf_reader" and p["beta/list.csv"]["error"] == "unsupported_type"


def test_manifest_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", 'x,"y"', True, float("nan"), [1, 2])], "id string, t string, b boolean, v double, l array<int>")
    sinks.write_manifest(d, str(tmp_path / "m"), ["id", "t", "b", "v", "l", "lost"])
    r = files.manifest(spark, str(tmp_path / "m"), ["id", "t", "b", "v", "l", "lost", "never"]).first()
    assert r[:] == ("a", 'x,"y"', "true", None, "[1,2]", None, None)


def test_polygon_lines(spark):
    box = "0,0,50,0,50,10,0,10,ACME, Inc\nbad,row\n1,1,1,1,1,1,1,1,flat\n0,20,50,20,50,30,0,30,9.00"
    d = spark.createDataFrame([("p", box, json.dumps({"company": "Acme Inc", "total": "9.00", "none": "x"}))], "page string, box string, ent string")
    tokens, skipped, fields = annotations.polygon_lines(d, "box", "ent")
    assert [(r["text"], r["label"]) for r in tokens.orderBy("at").collect()] == [("ACME, Inc", "VALUE"), ("9.00", "VALUE")]
    assert {(r["line"], r["reason"]) for r in skipped.collect()} == {(2, "fewer_than_9_values"), (3, "degenerate_geometry")}
    assert {(r["field"], r["value"], tuple(r["token_at"])) for r in fields.collect()} == {("organization_name", "Acme Inc", (0,)), ("total_amount", "9.00", (1,))}


def test_form_json(spark):
    form = {"form": [
        {"id": 0, "text": "Name:", "label": "question", "box": [0, 0, 10, 10], "words": [{"text": "Name:", "box": [0, 0, 10, 10]}], "linking": [[0, 1]]},
        {"id": 1, "text": "", "label": "answer", "box": [20, 0, 40, 10], "words": [{"text": "Ann", "box": [20, 0, 30, 10]}, {"text": "Lee", "box": [31, 0, 40, 10]}], "linking": [[0, 1], [1, 9]]},
    ]}
    d = spark.createDataFrame([("p", json.dumps(form))], "page string, doc string")
    tokens, entities, relations = annotations.form_json(d, "doc")
    assert tokens.count() == 3 and {r["text"] for r in entities.collect()} == {"Name:", "Ann Lee"}
    assert [(r["type"], r["source"], r["target"]) for r in relations.collect()] == [("QUESTION_ANSWER", 0, 1)]
    assert annotations.violations(tokens, relations, entities, 100, 100).count() == 0
    assert annotations.violations(tokens, relations, entities, 35, 100).count() == 1


def test_parallel_json(spark):
    doc = {"words": ["A", "B", "C", ""], "bboxes": [[0, 0, 10, 10], [12, 0, 20, 10], [90, 10, 120, 20], [0, 0, 5, 5]], "ner_tags": [1, 1, 10, 13]}
    d = spark.createDataFrame([("p", json.dumps(doc), json.dumps({"TOTAL": {"text": "5"}, "X": {"text": "1"}}), 100, 80)], "page string, doc string, orig string, w int, h int")
    tokens, entities, fields = annotations.parallel_json(d, "doc", "orig", "w", "h")
    assert [(r["text"], r["x1"], r["clipped"]) for r in tokens.orderBy("at").collect()] == [("A", 10, False), ("B", 20, False), ("C", 100, True)]
    assert {r["text"] for r in entities.collect()} == {"A B", "C"} and [(r["field"], r["value"]) for r in fields.collect()] == [("total_amount", "5")]


def test_question_json(spark):
    d = spark.createDataFrame([("p", json.dumps([{"question": "What is the total?", "answer": "5"}, {"question": "Total again, amount due?", "answer": "6"}, {"question": "", "answer": "x"}]))], "page string, doc string")
    q, f = annotations.question_json(d, "doc")
    assert q.count() == 2 and [(r["field"], r["value"]) for r in f.collect()] == [("total_amount", "5")]


def test_reader_and_cache(spark):
    d = spark.createDataFrame([("a", b"one", False), ("b", b"", False), ("c", b"two", True)], "page_id string, content binary, private boolean")
    got = {r["page_id"]: r for r in read_pages(d, FixedReader()).collect()}
    assert got["a"]["ok"] and len(got["a"]["words"]) == 8 and not got["b"]["ok"] and "empty page" in got["b"]["error"]
    empty = spark.createDataFrame([], "cache_key string, ok boolean, error string, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>")
    results, fresh = with_cache(d, empty, FixedReader())
    assert results.count() == 3 and fresh.count() == 1
    again, more = with_cache(d, fresh, FixedReader())
    assert again.count() == 3 and more.count() == 0


def test_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(500).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in/e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/e"))
    once = evidence.without_repeats(stream, ["user_id", "event_type"], "ts", "3650 days")
    q = evidence.each_batch(once, lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    total = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(str(tmp_path / "in/e")).select("user_id", "event_type").distinct().count()
    w = evidence.windowed(spark.read.parquet(str(tmp_path / "in/e")), ["event_type"], "value", "ts", "1 day", "12 hours")
    assert w.count() > 0
