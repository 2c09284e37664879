"""Guards, rotated annotations, convex polygons and split checks by small cases and brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.geometry import hull_iou
from foliant.operators import guards, matching, rotation, splits


def test_hull_iou_against_points():
    r = random.Random(1)
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert hull_iou(square, square) == pytest.approx(1.0) and hull_iou(square, [(5, 5), (6, 5), (6, 6)]) == 0.0
    assert hull_iou(square, [(2, 0), (6, 0), (6, 4), (2, 4)]) == pytest.approx(8 / 24)
    assert hull_iou(square, [(0, 0), (1, 1), (2, 2)]) is None and hull_iou(square, [(0, 0), (1, float("nan")), (2, 2)]) is None
    for _ in range(5):
        a, b = ([(r.random() * 10, r.random() * 10) for _ in range(6)] for _ in range(2))

        def holds(p, x, y):
            from foliant.functions.geometry import _hull

            h = _hull(p)
            return all((q[0] - o[0]) * (y - o[1]) - (q[1] - o[1]) * (x - o[0]) >= 0 for o, q in zip(h, h[1:] + h[:1], strict=True))

        both = either = 0
        for k in range(250):
            for j in range(250):
                x, y = (k + 0.5) / 25, (j + 0.5) / 25
                p, q = holds(a, x, y), holds(b, x, y)
                both += p and q
                either += p or q
        assert hull_iou(a, b) == pytest.approx(both / either, abs=0.02)


def test_turned_polygons_meet(spark):
    diamond = [[5.0, 0.0], [10.0, 5.0], [5.0, 10.0], [0.0, 5.0]]
    far = [[50.0, 0.0], [60.0, 0.0], [60.0, 10.0]]
    a = spark.createDataFrame([(1, 1, diamond), (1, 2, far)], "page int, id int, polygon array<array<double>>")
    b = spark.createDataFrame([(1, 7, [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]), (2, 8, diamond)], "page int, id int, polygon array<array<double>>")
    got = matching.overlapping_polygons(a, b, ["page"], 0.3, 4.0).collect()
    assert [(r["ref"], r["pred"]) for r in got] == [(1, 7)] and got[0]["iou"] == pytest.approx(0.5)


def test_rotation_of_annotations(spark):
    r = random.Random(2)
    rows = []
    for k in range(40):
        w, h = r.uniform(50, 90), r.uniform(50, 90)
        x, y = r.uniform(5, 20), r.uniform(5, 20)
        rows.append((k, w, h, r.uniform(-180, 180), [("a", [[x, y], [x + 20, y], [x + 20, y + 15], [x, y + 15]])]))
    d = spark.createDataFrame(rows, "k int, width double, height double, angle double, tokens array<struct<id:string,polygon:array<array<double>>>>")
    for got, (_, w, h, a, items) in zip(rotation.rotate_annotation(d, ["tokens"], "width", "height", "angle").orderBy("k").collect(), rows, strict=True):
        c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
        wide, high = abs(c) * w + abs(s) * h, abs(c) * h + abs(s) * w
        assert got["width"] == math.ceil(wide - 1e-9) and got["height"] == math.ceil(high - 1e-9)
        for (x, y), q in zip(items[0][1], got["tokens"][0]["polygon"], strict=True):
            assert q == pytest.approx([c * (x - w / 2) + s * (y - h / 2) + wide / 2, -s * (x - w / 2) + c * (y - h / 2) + high / 2], abs=1e-9)
        step = got["transformation_history"][0]
        assert (step["angle"], step["width"], step["height"]) == (a, w, h)
    again = rotation.rotate_annotation(rotation.rotate_annotation(d, ["tokens"], "width", "height", "angle"), ["tokens"], "width", "height", "angle")
    assert again.where("size(transformation_history) = 2").count() == 40
    flat = spark.createDataFrame([(10.0, 10.0, 0.0, [("a", [[50.0, 50.0], [60.0, 60.0]])])], "width double, height double, angle double, tokens array<struct<id:string,polygon:array<array<double>>>>")
    with pytest.raises(Exception, match="no extent"):
        rotation.rotate_annotation(flat, ["tokens"], "width", "height", "angle").collect()


def test_private_inputs(spark):
    d = spark.createDataFrame([("/open/a.pdf",), ("/private/x/../b.pdf",), ("/privateer/c.pdf",), ("C:\\private\\d.pdf",), ("/private",)], "path string")
    got = [r[0] for r in d.select(guards.within(F.col("path"), ["/private/", "C:/private"])).collect()]
    assert got == [False, True, False, True, True]
    assert guards.require_private_mode(d.limit(1), "path", ["/private"], False).count() == 1
    assert guards.require_private_mode(d, "path", ["/private"], True).count() == 5
    with pytest.raises(Exception, match="private input"):
        guards.require_private_mode(d, "path", ["/private"], False).collect()


def test_manifest_and_hashes(spark):
    inv = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, None)], "id int, readable boolean")
    ex = spark.createDataFrame([(1, ["a"], ["x", "y"]), (2, ["a"], []), (4, [], ["x"])], "id int, tokens array<string>, fields array<string>")
    got = {r["id"]: (r["n_tokens"], r["n_fields"], r["usable"], r["exclusion_reason"]) for r in guards.manifest(inv, ex, "id", [], ["tokens", "fields"]).collect()}
    assert got == {1: (1, 2, True, None), 2: (1, 0, False, "unreadable"), 3: (0, 0, False, "no_annotation"), 4: (0, 1, False, "no_tokens"), 5: (0, 0, False, "unreadable")}
    a = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "id int, split string")
    good = guards.content_hash(a.where("split = 'train'"), ["id"])
    assert guards.load_split(a.repartition(3), "split", "train", ["id"], good).count() == 2
    with pytest.raises(ValueError, match="stale"):
        guards.load_split(a.withColumn("id", F.col("id") + 1), "split", "train", ["id"], good)
    assert guards.hash_mismatches(a.limit(0).select("id", F.lit("x").alias("h")), a.select("id", F.lit("x").alias("h")), "id", "h").count() == 0


def test_split_checks_and_orders(spark):
    rows = [(1, "train", False, "g"), (2, "test", False, "g"), (3, "private_test", True, None), (4, "train", True, ""), (5, "private_test", None, "h"), (6, None, False, "h")]
    d = spark.createDataFrame(rows, "id int, split string, private boolean, grp string")
    got = sorted((r["problem"], r["n"]) for r in rotation.split_violations(d, "split", "private", {"group": "grp"}).collect())
    assert got == [("group in several splits", 2), ("private in a public split", 1), ("public in the private split", 1), ("without a split", 1)]
    docs = spark.range(400).select("id", F.concat(F.lit("d"), F.col("id") % 2).alias("dataset"), F.concat(F.lit("k"), F.floor(F.col("id") / 3)).alias("key"))
    made = splits.leakage_safe_split(docs, "id", "dataset", ["key"], ratios=splits.ROTATION_SPLITS, order="hash")
    n = {r["project_split"]: r["count"] for r in made.groupBy("project_split").count().collect()}
    assert sum(n.values()) == 400 and abs(n["train"] - 280) <= 6 and abs(n["validation"] - 60) <= 6 and abs(n["test"] - 60) <= 6
    assert rotation.split_violations(made.join(docs, "id").withColumn("private", F.lit(False)), "project_split", "private", {"key": "key", "group": "split_group"}).count() == 0


def test_money_rounds_once(spark):
    from foliant.functions.money import normal_money

    d = spark.createDataFrame([("1.00500001",), ("1.005",), ("1.015",), ("1234567890123456789.10",)], "t string")
    assert [r[0] for r in d.select(normal_money(F.col("t"))).collect()] == ["1.01", "1.00", "1.02", "1234567890123456789.10"]
