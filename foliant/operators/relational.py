"""Joins, duplicates, roll-ups and ordered set operations over any tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import dealt


def unmatched(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Keys that only one side has: (keys..., side)."""
    both = left.select(*on, F.lit(True).alias("_left")).unionByName(right.select(*on, F.lit(False).alias("_left")))
    keys = dealt(both, *on).groupBy(*on).agg(F.max("_left").alias("_a"), F.max(~F.col("_left")).alias("_b"))
    lone = reduce(lambda x, k: x | F.col(k).isNull(), on, F.lit(False))  # a null equals nothing
    sides = F.array_compact(F.array(F.when(F.col("_a") & (lone | ~F.col("_b")), names[0]), F.when(F.col("_b") & (lone | ~F.col("_a")), names[1])))
    return keys.where(lone | (F.col("_a") != F.col("_b"))).select(*on, F.explode(sides).alias("side"))


def required_join(left: DataFrame, right: DataFrame, on: list[str], what: str = "row") -> DataFrame:
    """Inner join that fails where a left row has no partner."""
    mark = right.withColumn("_there", F.lit(True))
    out = left.join(mark, on, "left")
    return out.withColumn("_there", F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), F.to_json(F.struct(*on)))).cast("boolean"))).where("_there").drop("_there")


def longest_prefix_join(left: DataFrame, key: str, right: DataFrame, prefix: str, sep: str = "_") -> DataFrame:
    """Each left row with the longest prefix of its key, cut at separators, that the right side has; left outer."""
    parts = F.split(F.col(key), sep)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    tried = left.select("*", F.posexplode(cuts).alias("_at", "_cut"))
    found = tried.join(right.select(F.col(prefix).alias("_cut")).distinct(), "_cut")
    best = found.groupBy(key).agg(F.max(F.struct("_at", "_cut")).alias("_best")).select(key, F.col("_best._cut").alias("matched_prefix"))
    return left.join(best, key, "left")


def exact_duplicates(df: DataFrame, content: Column, order: str, dataset: str) -> DataFrame:
    """Groups of equal content: hash, members, the first by order, and whether they cross datasets."""
    hashed = df.where(content.isNotNull() & (F.trim(content) != "")).withColumn("content_hash", F.sha2(content, 256))
    groups = hashed.groupBy("content_hash").agg(F.count("*").alias("members"), F.min(order).alias("canonical"), (F.count_distinct(dataset) > 1).alias("crosses"))
    return groups.where("members > 1")


def last_by_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the last in the order given (ascending columns)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ordered_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with each key once, the first's before the second's: adds origin 0 or 1."""
    both = first.withColumn("origin", F.lit(0)).unionByName(second.withColumn("origin", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("origin", *[c for c in first.columns if c not in keys])
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def difference_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repeats, that one side has more often: (columns..., side)."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))
