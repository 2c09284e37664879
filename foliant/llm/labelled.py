"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0: such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: dict[int, int], seed: int = 42) -> list[tuple[str, int]]:
    """At most ``most[v]`` (text, v) pairs for each label value v, in an order of their own.

    The documents are the first by a seeded hash of their ids, whatever the size of the
    corpus. Ids that are null, held out or have contradicting labels are left out; null texts count as empty.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_max")).where("y = _max").select("doc_id", F.col("y").cast("int").alias("y"))
    one = one.join(documents.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64(F.lit(seed), "doc_id")
    parts = [one.where(F.col("y") == v).orderBy(order, "doc_id").limit(n) for v, n in sorted(most.items())]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # sum(most.values()) ids: a bound that doesn't grow with the corpus. An id with several texts has its first.
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = sorted(found.collect(), key=lambda r: str(r["doc_id"]))
    return [(r["text"] or "", r["y"]) for r in rows]
