"""What a batch or an exchange holds doesn't grow with the input."""

import pytest

from foliant.operators import imaging
from foliant.plans import registry


def test_image_results_go_out_in_small_batches(spark, monkeypatch):
    import pandas as pd

    seen = {}
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInPandas", lambda df, fn, schema: seen.setdefault("fn", fn))
    imaging.over_images(spark.createDataFrame([(1, b"ab", 1, 2)], "id int, pixels binary, height int, width int"), lambda g: float(g.sum()), "s", "double")
    n = 1000
    sizes = [len(b) for b in seen["fn"](iter([pd.DataFrame({"id": range(n), "pixels": [b"ab"] * n, "height": 1, "width": 2})]))]
    assert sum(sizes) == n and max(sizes) <= imaging.OUT


@pytest.mark.parametrize("name", ["word_entropy", "ocr_quality_score"])
def test_only_texts_are_dealt_out(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line and "text" not in line.split("hashpartitioning")[0] for line in exchanges)
