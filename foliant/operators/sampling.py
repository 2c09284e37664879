"""Deterministic selection of rows in strata. Ranks are hashes of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.ids import hash_rank


def first_n(df: DataFrame, by: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of each group in hash order, with their place."""
    w = Window.partitionBy(*by).orderBy(hash_rank(seed, F.col(id_col)))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def apportioned(strata: DataFrame, size: str, total: Column, over: list[str], tie: list[Column]) -> DataFrame:
    """Adds quota: ``total`` shared by ``size`` within ``over``, floors and then the largest fractions."""
    all_ = Window.partitionBy(*over)
    exact = total * F.col(size) / F.sum(size).over(all_)
    out = strata.withColumn("_exact", exact).withColumn("_floor", F.least(F.col(size), F.floor("_exact")))
    by_fraction = Window.partitionBy(*over).orderBy((F.col("_exact") - F.col("_floor")).desc(), *tie)
    out = out.withColumn("_left", total - F.sum("_floor").over(all_)).withColumn("_open", (F.col("_floor") < F.col(size)).cast("int"))
    out = out.withColumn("_nth", F.sum("_open").over(by_fraction.rowsBetween(Window.unboundedPreceding, 0)))
    extra = ((F.col("_open") == 1) & (F.col("_nth") <= F.col("_left"))).cast("long")
    return out.withColumn("quota", F.col("_floor") + extra).drop("_exact", "_floor", "_left", "_nth", "_open")


def proportional(df: DataFrame, stratum: str, id_col: str, cap: int, seed: int = 42) -> DataFrame:
    """``cap`` rows, strata in proportion (largest remainder), each stratum's first in hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    quotas = apportioned(sizes, "_size", F.lit(cap), [], [F.col(stratum)]).select(F.col(stratum).alias("_s"), "quota")
    w = Window.partitionBy(stratum).orderBy(hash_rank(seed, F.col(id_col)))
    ranked = df.withColumn("place", F.row_number().over(w))
    return ranked.join(quotas, ranked[stratum].eqNullSafe(quotas["_s"])).where("place <= quota").drop("_s", "quota")


def round_robin(df: DataFrame, stratum: str, id_col: str, cap: int, seed: int = 42) -> DataFrame:
    """One row of each stratum after another, until ``cap``: adds depth (from 0) and turn (from 1)."""
    w = Window.partitionBy(stratum).orderBy(hash_rank(seed, F.col(id_col)))
    ranked = df.withColumn("depth", F.row_number().over(w) - 1)
    # A stratum can't give more than cap rows: the sort below sees strata times cap rows at most.
    ranked = ranked.where(F.col("depth") < cap).orderBy("depth", stratum).limit(cap)
    return ranked.withColumn("turn", F.row_number().over(Window.orderBy("depth", stratum)))


def two_level(df: DataFrame, part: str, stratum: str, id_col: str, cap: int, seed: int = 42) -> DataFrame:
    """Equal shares of ``cap`` to the parts (the remainder to the first names), then in proportion inside."""
    sizes = df.groupBy(part, stratum).agg(F.count("*").alias("_size"))
    names = Window.orderBy(part)
    parts = df.select(part).distinct().withColumn("_i", F.row_number().over(names) - 1)
    n = F.count("*").over(Window.partitionBy())
    parts = parts.withColumn("_n", n).withColumn("_cap", F.floor(F.lit(cap) / F.col("_n")) + (F.col("_i") < F.lit(cap) % F.col("_n")).cast("long"))
    sizes = sizes.join(parts.select(part, "_cap"), part)
    quotas = apportioned(sizes, "_size", F.col("_cap"), [part], [F.col(stratum)]).select(part, stratum, "quota")
    w = Window.partitionBy(part, stratum).orderBy(hash_rank(seed, F.col(id_col)))
    return df.withColumn("place", F.row_number().over(w)).join(quotas, [part, stratum]).where("place <= quota")


def best_one(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
