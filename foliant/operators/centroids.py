"""Nearest centroids of scaled features."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import arrays


def fit_centroids(df: DataFrame, features: str, label: str) -> DataFrame:
    """(mean, std, cs: array of (label, c)) in one row: a scaler to mean 0 and population deviation 1 and each label's mean in its space.

    One pass: a row of sums for each label, of which the scaler and all centroids follow; labels are classes, so few.
    A feature without deviation is only centred. Rows without a label count for the scaler alone.
    """
    one = df.where(F.col(features).isNotNull()).select(F.col(label).alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    parts = one.groupBy("label").agg(F.count("*").alias("n"), Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).collect()
    n = np.array([r["n"] for r in parts], float)
    means = np.array([r["s"]["mean"].toArray() for r in parts])
    sums = np.array([r["s"]["variance"].toArray() * max(0, r["n"] - 1) for r in parts])
    mean = (n[:, None] * means).sum(0) / n.sum()
    std = np.sqrt((sums + n[:, None] * (means - mean) ** 2).sum(0) / n.sum())
    std = np.where(std > 0, std, 1.0)
    cs = sorted((r["label"], ((m - mean) / std).tolist()) for r, m in zip(parts, means, strict=True) if r["label"] is not None)
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame([(mean.tolist(), std.tolist(), cs)], f"mean array<double>, std array<double>, cs array<struct<label:{kind},c:array<double>>>")


def assign_centroids(df: DataFrame, fit: DataFrame, features: str) -> DataFrame:
    """``df`` with centroid, distance and confidence: the nearest centroid (ties: the smaller label) and how far the next one is behind it."""
    z = F.transform(F.arrays_zip(F.col(features).alias("x"), F.col("mean"), F.col("std")), lambda t: (t["x"].cast("double") - t["mean"]) / t["std"])
    x = df.crossJoin(F.broadcast(fit)).withColumn("_z", z)  # fit is one row
    near = F.array_sort(F.transform("cs", lambda c: F.struct(F.sqrt(arrays.squared_distance(F.col("_z"), c["c"])).alias("d"), c["label"].alias("label"))))
    x = x.withColumn("_n", near)
    d, d2 = F.try_element_at("_n", F.lit(1))["d"], F.try_element_at("_n", F.lit(2))["d"]
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(d2 - d, d2)))
    return x.withColumns({"centroid": F.try_element_at("_n", F.lit(1))["label"], "distance": d, "confidence": margin}).drop("mean", "std", "cs", "_z", "_n")
