"""Connected components of an edge table, by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every
round joins edges to one row per node and takes minima, which combine
before the shuffle. The edges of a hub, a node with over ``HUB`` edges and over a thousandth of all, stay where
they are and get the hub's row by broadcast (at most 2,000 rows), so no node needs a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import stage


HUB = 100_000


def _with_least(edges: DataFrame, n: int, hub: int) -> DataFrame:
    """``edges`` (u, v; about ``n`` of them) with m, the least v of each u."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    most = max(hub, n // 1000)
    if n <= most:  # no node can be a hub
        return edges.join(low.drop("d"), "u")
    low = stage(low)
    hubs = low.where(F.col("d") > most).drop("d")
    if hubs.isEmpty():
        return edges.join(low.drop("d"), "u")
    hubs = F.broadcast(hubs)
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(low.where(F.col("d") <= most).drop("d"), "u"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, max_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """``edges`` (u, v: both of one orderable type) -> (node, root), root the smallest node reachable.

    Only nodes with an edge to a smaller node or path to one appear, so no root has a row. Null ends, loops and
    repeated edges are ignored; an empty table gives an empty result.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(max_rounds if mark[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0], hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = _with_least(large, 2 * mark[0], hub).select("u", "v", "m")
        small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stage(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components_by_keys(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, root): rows that share a value of any key column, directly or through others.

    Null and blank keys join nothing. Edges are stars around each value's smallest id,
    so a value of many rows makes as many edges, not their pairs. Ids must be unique.
    """
    edges, n = None, df.count()
    for k in keys:
        named = df.where(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).isNotNull())
        star = _with_least(named.select(F.col(k).alias("u"), F.col(id_col).alias("v")), n, HUB).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = star if edges is None else edges.unionByName(star)
    roots = connected_components(edges)
    ids = df.select(F.col(id_col).alias("id"))
    return ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"))
