"""Train, validation and test splits that no identity crosses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.ids import hash_fraction, hash_rank
from foliant.operators.graph import components_by_keys

# Splits in their order with their shares.
SPLITS = [("train", 0.70), ("dev_select", 0.10), ("dev_calibration", 0.05), ("test_in_domain", 0.15)]

ROTATION_SPLITS = [("train", 0.70), ("validation", 0.15), ("test", 0.15)]


def hash_split(df: DataFrame, group: str, seed: int = 42, share: float = 0.15) -> DataFrame:
    """project_split: validation where the group's hash fraction is under ``share``, else train."""
    return df.withColumn("project_split", F.when(hash_fraction(seed, F.col(group)) < share, "validation").otherwise("train"))


def target_counts(totals: DataFrame, by: list[str], total: str = "total", ratios: list[tuple[str, float]] = SPLITS) -> DataFrame:
    """(by..., split, target): floors of total times ratio, the rest to the largest fractions, then in split order."""
    shares = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("split"), F.lit(r).alias("ratio")) for i, (s, r) in enumerate(ratios)])
    t = totals.select(*by, total, F.explode(shares).alias("x")).select(*by, total, "x.*")
    t = t.withColumn("_exact", F.col(total) * F.col("ratio")).withColumn("_floor", F.floor("_exact"))
    w = Window.partitionBy(*by)
    nth = F.row_number().over(w.orderBy((F.col("_exact") - F.col("_floor")).desc(), "at"))
    left = F.col(total) - F.sum("_floor").over(w)
    return t.withColumn("target", (F.col("_floor") + (nth <= left).cast("long"))).select(*by, "split", "target")


def leaks(df: DataFrame, split: str, identities: list[str]) -> DataFrame:
    """(kind, value, splits): identities that stand in more than one split."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in identities])
    long = df.select(split, F.explode(kinds).alias("x")).select(split, "x.*").where("value is not null and value <> ''")
    return long.groupBy("kind", "value").agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def leakage_safe_split(
    df: DataFrame, id_col: str, dataset: str, keys: list[str], held_out: list[str] | None = None, seed: int = 42, ratios: list[tuple[str, float]] = SPLITS, order: str = "size"
) -> DataFrame:
    """(id, split_group, project_split): components of shared keys, each wholly in one split.

    Components with a row of a held-out dataset are the unseen test. The others go, large ones first and
    then in hash order, to the split whose squared relative distance from its targets grows least (ties: the
    earlier split), or with ``order`` "hash" in hash order alone. That choice follows all earlier ones, so it runs in one task, over one short
    row for each component.
    """
    group = components_by_keys(df, id_col, keys).withColumnRenamed("root", "split_group")
    rows = df.select(F.col(id_col).alias("id"), F.col(dataset).alias("dataset")).join(group, "id")
    unseen = rows.groupBy("split_group").agg(F.max(F.col("dataset").isin(held_out or []).cast("int")).alias("unseen"))
    counts = rows.groupBy("split_group", "dataset").count()
    contents = counts.groupBy("split_group").agg(F.sum("count").alias("size"), F.sort_array(F.collect_list(F.struct("dataset", "count"))).alias("contents"))
    open_ = contents.join(unseen.where("unseen = 0"), "split_group", "left_semi").withColumn("rank", hash_rank(seed, F.col("split_group")))
    names, share = [s for s, _ in ratios], dict(ratios)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        totals: dict[str, int] = {}
        for contents in pdf["contents"]:
            for x in contents:
                totals[x["dataset"]] = totals.get(x["dataset"], 0) + x["count"]
        targets = {}
        for d, n in totals.items():
            floor = {s: int(n * share[s]) for s in names}
            rest = n - sum(floor.values())
            for s in sorted(names, key=lambda s: (floor[s] - n * share[s], names.index(s)))[:rest]:
                floor[s] += 1
            targets[d] = {s: max(1, v) for s, v in floor.items()}
        filled = {d: dict.fromkeys(names, 0) for d in totals}
        out = []
        for key, contents in pdf.sort_values(["size", "rank"] if order == "size" else ["rank"], ascending=[False, True] if order == "size" else [True])[["split_group", "contents"]].itertuples(index=False):
            def cost(s: str) -> float:
                change = 0.0
                for x in contents:
                    target, before = targets[x["dataset"]][s], filled[x["dataset"]][s]
                    change += ((before + x["count"] - target) / target) ** 2 - ((before - target) / target) ** 2
                return change

            best = min(names, key=cost)
            for x in contents:
                filled[x["dataset"]][best] += x["count"]
            out.append((key, best))
        return pd.DataFrame(out, columns=["split_group", "project_split"])

    kind = dict(group.dtypes)["split_group"]
    assigned = open_.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(assign, f"split_group {kind}, project_split string")
    out = rows.select("id", "split_group").join(assigned, "split_group", "left")
    return out.withColumn("project_split", F.coalesce("project_split", F.lit("unseen_domain_test")))
