"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters whole records evenly into buckets that fit in memory, by a seeded
hash. Pass 2 lays each bucket out in hash order and shuffles it by Fisher and Yates
(SQL's ``shuffle``). Buckets in a row, the records have one global order, which is cut into shards of
equal counts (law ``rows``).

The bucket counts come from a pass over ids and hashes alone and give each bucket its first
position, so no task sees more than one bucket and nothing is sorted as a whole. Rows that repeat
id and text are numbered first, so that they scatter like any others. Buckets lie in a number of partitions that follows from
the records' bytes alone, in order, which fixes the shuffle's random numbers: the session's partitioning has no part in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read, running, stage

BUCKET_BYTES = 16 << 20
MOST_PARTITIONS = 1 << 15


def shard_records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with size, text_crc32, law, shard and slot: a seeded random order in equal shards.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8. Shards differ by one row at
    most; slots have no gaps from 0. With fewer rows than shards, some shards stay empty. Null ids and texts are
    records like any other. Rows that repeat id and text, any number of them, are spread over all buckets; which of
    them has which of their places is open. Else the order depends on seed, ids, texts and
    ``bucket_bytes`` alone. Columns with the five names are replaced. Empty in, empty out.
    """
    own = ["size", "text_crc32", "law", "shard", "slot"]
    keep = [c for c in df.columns if c.lower() not in own]
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    known = df.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(F.lit(seed), id_col, data).alias("_k"))
    light = stage(known.select("_k", "size"))
    total = light.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64("_k", "_j"), F.lit(buckets)).cast("long").alias("_bucket")
    # Ids and hashes are enough to count; both passes number alike rows from 0 on.
    counts = numbered(light, light.select("_k"), "_k", "_j").groupBy(bucket).agg(F.count("*").alias("_n"))
    first = stage(running(counts, "_bucket", "_n", "_first").drop("_n"))

    record = F.struct(F.xxhash64(F.lit("order"), "_k", "_j").alias("h"), "id", "_j", "row", "size", "text_crc32")
    scattered = numbered(known, light.select("_k"), "_k", "_j").select(bucket, record.alias("_r")).repartition(min(buckets, MOST_PARTITIONS), "_bucket")
    filled = scattered.groupBy("_bucket").agg(F.collect_list("_r").alias("_records"))
    total_order = " ".join(f"when a.{c} < b.{c} then -1 when a.{c} > b.{c} then 1" for c in ("h", "id", "_j"))
    fixed = F.expr(f"array_sort(_records, (a, b) -> case {total_order} else 0 end)")
    # The shuffle's generator runs on through a partition: its buckets come in order.
    filled = filled.select("_bucket", fixed.alias("_records")).sortWithinPartitions("_bucket")
    dealt = filled.select("_bucket", F.expr(f"shuffle(_records, {seed}L)").alias("_records"))
    dealt = dealt.select("_bucket", F.posexplode("_records").alias("_at", "_r"))
    placed = dealt.join(F.broadcast(first), "_bucket") if buckets <= 4096 else dealt.join(first, "_bucket")
    n = total["n"]
    position = F.col("_first") + F.col("_at")
    small, larger = divmod(n, shards)  # the first `larger` shards have one row more
    if small:
        edge = larger * (small + 1)
        shard = F.when(position < edge, F.floor(position / (small + 1))).otherwise(larger + F.floor((position - edge) / small))
    else:
        shard = position
    start = shard * small + F.least(shard, F.lit(larger))
    columns = [F.col("_r.row")[c].alias(c) for c in keep]
    return placed.select(*columns, "_r.size", "_r.text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (position - start).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the records as one folder for each shard, in the order of their slots."""
    out = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").mode("errorifexists").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    placed = shard_records(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
