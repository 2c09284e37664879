"""Grids of many pages at once against the fold of one page, cell by cell."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import tables
from foliant.plans import registry


def one_page(cells):
    """{id: (row, column)}: each cell from the top joins the first row whose mean centre is near."""
    near = max(2.0, statistics.median(max(1.0, y1 - y0) for _, _, y0, y1 in cells) * 0.7)
    rows, at = [], {}
    for c, x0, i in sorted(((y0 + y1) / 2, x0, i) for i, x0, y0, y1 in cells):
        k = next((k for k, v in enumerate(rows) if abs(c - sum(v) / len(v)) <= near), len(rows))
        rows += [[]] if k == len(rows) else []
        rows[k].append(c)
        at[i] = (k, x0)
    return {i: (k, sorted((x, j) for j, (r, x) in at.items() if r == k).index((x0, i))) for i, (k, x0) in at.items()}


def drawn(pages, seed=5):
    r = random.Random(seed)
    return {p: [(f"c{i}", float(r.randrange(6) * 10), y, y + r.choice([4.0, 8.0, 12.0])) for i in range(r.choice([0, 1, 2, 3, 9, 40])) for y in [r.randrange(60) * 2.5]] for p in range(pages)}


def test_many_pages_at_once():
    pages = drawn(300)
    flat = [c for p in pages for c in pages[p]]
    row, column = tables.places(np.array([len(c) for c in pages.values()]), *(np.array([c[k] for c in flat]) for k in (1, 2, 3)), np.array([c[0] for c in flat]))
    got = iter(zip(row, column, strict=True))
    for cells in pages.values():
        want = one_page(cells) if cells else {}
        assert {c[0]: tuple(map(int, next(got))) for c in cells} == want


def test_long_page_takes_no_room_of_others():
    n = 3000
    y = np.arange(n) * 30.0
    row, column = tables.places(np.array([2] * 5000 + [n]), np.zeros(n + 10_000), np.r_[np.zeros(10_000), y], np.r_[np.full(10_000, 8.0), y + 8], np.zeros(n + 10_000, int))
    assert (row[10_000:] == np.arange(n)).all() and (column[10_000:] == 0).all() and row[:10_000].max() == 0


def test_grid_and_semantics_in_rows(spark):
    words = ["Item", "Qty", "unit price", "Total", "x", "ürün", None]
    r = random.Random(1)
    rows = [(p, i, r.choice(words), x0, y0, x0 + 8, y1) for p, cells in drawn(60, 8).items() for i, x0, y0, y1 in cells]
    d = spark.createDataFrame(rows, "p int, id string, text string, x0 double, y0 double, x1 double, y1 double")
    grid = tables.table_grid(d, "p")
    assert {x["p"] for x in grid.select("p").distinct().collect()} == {p for p, c in drawn(60, 8).items() if len(c) > 1}
    want = tables.head_semantics(grid, "p").select("p", "id", "row_index", "column_index", "semantic", "row_type")
    pages = grid.groupBy("p").agg(F.collect_list(F.struct("id", "text", "row_index", "column_index")).alias("c"))
    got = pages.select("p", F.explode(tables.page_semantics(F.col("c"))).alias("x")).select("p", "x.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.where("row_type = 'header'").count()


def test_one_exchange(spark):
    plan = registry.queries()["table_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
