"""Evaluation: confusion, matching counts, calibration, thresholds, clustering, angles."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.angles import circular_error
from foliant.operators.relational import ratio


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1, accuracy): one against the rest, from the confusion counts."""
    c = confusion(df, truth, predicted)
    sides = F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), (F.col("predicted") == F.col("truth")).cast("int").alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    x = c.select("n", (F.col("truth") == F.col("predicted")).alias("same"), F.explode(sides).alias("s")).select("n", "same", "s.*").where("t = 1 or not same")
    out = x.groupBy("class").agg(F.sum(F.when((F.col("t") == 1) & (F.col("p") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("t") == 0, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when((F.col("t") == 1) & (F.col("p") == 0), F.col("n")).otherwise(0)).alias("fn"))
    total = c.agg(F.sum("n").alias("_total"))
    out = out.crossJoin(F.broadcast(total))  # one row
    out = out.withColumns({"support": F.col("tp") + F.col("fn"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumns({"f1": f1(F.col("tp"), F.col("fp"), F.col("fn")), "accuracy": ratio(F.col("_total") - F.col("fp") - F.col("fn"), F.col("_total"))}).drop("_total")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def positive_counts(truth: Column, predicted: Column, ignored: int = -100) -> dict[str, Column]:
    """tp, fp, fn over positive classes; two different positives are both a false positive and a miss; ignored truth counts for nothing."""
    live = truth != ignored
    hit = live & (truth > 0) & (truth == predicted)
    return {"tp": F.count_if(hit), "fp": F.count_if(live & (predicted > 0) & ~hit), "fn": F.count_if(live & (truth > 0) & ~hit)}


def multiset_prf(expected: DataFrame, found: DataFrame, by: list[str], item: list[str]) -> DataFrame:
    """(by..., tp, expected, found, precision, recall, f1): shared items with their repeats; null ratios where a side is empty."""
    e = expected.groupBy(*by, *item).agg(F.count("*").alias("_e"))
    p = found.groupBy(*by, *item).agg(F.count("*").alias("_p"))
    both = e.join(p, [*by, *item], "full")
    e_, p_ = F.coalesce("_e", F.lit(0)), F.coalesce("_p", F.lit(0))
    out = both.groupBy(*by).agg(F.sum(F.least(e_, p_)).alias("tp"), F.sum(e_).alias("expected"), F.sum(p_).alias("found"))
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("found")), "recall": ratio(F.col("tp"), F.col("expected")), "f1": ratio(2 * F.col("tp"), F.col("expected") + F.col("found"))})


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """(ece): equal bins, the last closed."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    b = df.select(F.least(F.lit(bins - 1), F.floor(c * bins)).alias("bin"), c.alias("c"), F.col(correct).cast("double").alias("y")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("y").alias("y"))
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("y"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def best_f1_threshold(df: DataFrame, confidence: str, predicted: str, truth: str) -> DataFrame:
    """(threshold, f1): the best micro F1 of positive classes; ties to the higher threshold; 1.0 if none helps, 0.5 of no rows.

    Rows combine to one for each distinct confidence before these are put in order.
    """
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    whole = df.agg(F.count_if(F.col(truth) > 0).alias("positives"), F.count("*").alias("rows"))
    t = df.where(F.col(predicted) > 0).groupBy(c.alias("threshold")).agg(F.count_if((F.col(truth) > 0) & (F.col(predicted) == F.col(truth))).alias("hit"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"tp": F.sum("hit").over(w), "all": F.sum("n").over(w)}).crossJoin(F.broadcast(whole))
    score = F.coalesce(ratio(2 * F.col("tp"), F.col("all") + F.col("positives")), F.lit(0.0))
    best = t.agg(F.max(F.struct(score.alias("f1"), F.col("threshold"))).alias("x"))
    out = best.crossJoin(F.broadcast(whole))
    none = F.col("x.f1").isNull() | (F.col("x.f1") <= 0)
    return out.select(F.when(F.col("rows") == 0, 0.5).when(none, 1.0).otherwise(F.col("x.threshold")).alias("threshold"), F.when(none, 0.0).otherwise(F.col("x.f1")).alias("f1"))


def best_coverage_threshold(df: DataFrame, confidence: str, correct: str, coverage: float = 0.9) -> DataFrame:
    """(threshold, accuracy, coverage): the best accuracy of what is kept while coverage is reached; ties to the higher threshold."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    t = df.groupBy(c.alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("hit"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"kept": F.sum("n").over(w), "hits": F.sum("hit").over(w), "all": F.sum("n").over(Window.partitionBy())})
    t = t.withColumns({"accuracy": F.col("hits") / F.col("kept"), "coverage": F.col("kept") / F.col("all")}).where(F.col("coverage") + 1e-12 >= coverage)
    return t.agg(F.max(F.struct("accuracy", "threshold", "coverage")).alias("x")).select("x.threshold", "x.accuracy", "x.coverage")


def circular_summary(df: DataFrame, by: list[str], estimate: str, truth: str) -> DataFrame:
    """Mean, median, population deviation, root of the mean square and maximum of the angle error, and the shares within some degrees."""
    e = df.withColumn("_e", circular_error(F.col(estimate), F.col(truth)))
    within = [F.avg((F.col("_e") <= d).cast("double")).alias(f"within_{d}") for d in (1, 2, 3, 5, 10)]
    return e.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_e").alias("mae"), F.percentile("_e", 0.5).alias("median"), F.stddev_pop("_e").alias("std"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.max("_e").alias("largest"), *within)


def clustering_indices(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """ari, nmi, homogeneity, completeness, v_measure, purity from the contingency counts."""
    cell = confusion(df, truth, cluster)
    a = cell.groupBy("truth").agg(F.sum("n").alias("n"))
    b = cell.groupBy("predicted").agg(F.sum("n").alias("n"), F.max("n").alias("most"))

    def pairs(x: Column) -> Column:
        return F.sum(x.cast("double") * (x - 1) / 2)

    def plog(x: Column) -> Column:
        return F.sum(x.cast("double") * F.ln(x.cast("double")))

    s = cell.agg(pairs(F.col("n")).alias("s_ij"), plog(F.col("n")).alias("l_ij"), F.sum("n").alias("n"))
    s = s.crossJoin(a.agg(pairs(F.col("n")).alias("s_a"), plog(F.col("n")).alias("l_a"))).crossJoin(b.agg(pairs(F.col("n")).alias("s_b"), plog(F.col("n")).alias("l_b"), F.sum("most").alias("most")))  # one row each
    n = F.col("n").cast("double")
    expected = F.col("s_a") * F.col("s_b") / (n * (n - 1) / 2)
    h_a, h_b = F.ln(n) - F.col("l_a") / n, F.ln(n) - F.col("l_b") / n
    mutual = F.ln(n) + (F.col("l_ij") - F.col("l_a") - F.col("l_b")) / n
    homogeneity, completeness = F.coalesce(F.try_divide(mutual, h_a), F.lit(1.0)), F.coalesce(F.try_divide(mutual, h_b), F.lit(1.0))
    return s.select(
        ((F.col("s_ij") - expected) / ((F.col("s_a") + F.col("s_b")) / 2 - expected)).alias("ari"), (2 * mutual / (h_a + h_b)).alias("nmi"),
        homogeneity.alias("homogeneity"), completeness.alias("completeness"), (2 * homogeneity * completeness / (homogeneity + completeness)).alias("v_measure"), (F.col("most") / n).alias("purity"),
    )


def best_assignment(df: DataFrame, truth: str, cluster: str, k: int = 4) -> DataFrame:
    """(cluster, truth, n, total): the permutation of k classes 0..k-1 with the most agreement; ties to the first in order."""
    cells = df.groupBy(F.col(cluster).cast("int").alias("c"), F.col(truth).cast("int").alias("t")).agg(F.count("*").alias("n"))
    rows = [(i, c, t) for i, p in enumerate(itertools.permutations(range(k))) for c, t in enumerate(p)]
    ways = df.sparkSession.createDataFrame(rows, "way int, c int, t int")  # k! * k rows
    scored = ways.join(cells, ["c", "t"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = scored.groupBy("way").agg(F.sum("n").alias("total"))
    best = total.agg(F.max(F.struct("total", -F.col("way"))).alias("x")).select(F.col("x.total").alias("total"), (-F.col("x")[F.lit("col2")]).alias("way"))
    return scored.join(F.broadcast(best), "way").select(F.col("c").alias("cluster"), F.col("t").alias("truth"), "n", "total")


def class_weights(df: DataFrame, label: str, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """(label, weight): root of total over classes times count, clipped, then divided by the mean."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()
    raw = F.sqrt(F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n")))
    n = n.withColumn("_w", F.least(F.lit(high), F.greatest(F.lit(low), raw)))
    return n.select("label", "n", (F.col("_w") / F.avg("_w").over(all_)).alias("weight"))


def temperature_grid(df: DataFrame, logits: str, label: str, steps: int = 21, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """(temperature, nll) of a logarithmic grid: mean negative log likelihood of the labels."""
    grid = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
    t = F.explode(F.array(*map(F.lit, grid))).alias("temperature")
    x = df.select(F.col(logits).alias("_x"), F.col(label).cast("int").alias("_y"), t)
    scaled = F.transform("_x", lambda v: v.cast("double") / F.col("temperature"))
    top = F.array_max(scaled)
    norm = top + F.ln(F.aggregate(scaled, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    return x.withColumn("_nll", norm - F.get(scaled, F.col("_y"))).groupBy("temperature").agg(F.avg("_nll").alias("nll"))
