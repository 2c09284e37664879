"""The pipeline's toxicity stage where nothing can be learnt."""

import pytest

import corpus_pipeline
from foliant.llm import toxicity


@pytest.mark.parametrize("sample", [[], [("a", 1)] * 9, [("a", 0)] * 9])
def test_one_class_is_never_toxic(sample):
    machine = toxicity.train(sample)
    assert all(machine.probability(toxicity.np.array([v]))[0] < corpus_pipeline.TOXIC for v in (-1.0, 0.0, 1.0))


def test_stage_keeps_all_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, ""), (3, None)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 3
