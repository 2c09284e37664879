"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.session import ensure_checkpoint_dir, map_arrow, shared_folder, spread, stage

__all__ = ["WORD", "WS_CLASS", "Seen", "ensure_checkpoint_dir", "fresh", "joined_hot", "kept", "map_arrow", "map_texts", "numbered", "read", "running", "shared_folder", "slices", "stage", "string_hashes", "text_columns"]

#: A word is a longest run of characters outside these six (written for regex classes).
WS_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{WS_CLASS}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (extra columns may clash)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``map_arrow`` over long rows, a small scan dealt out first.

    Spark ends an Arrow batch at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set otherwise, one longer row
    is a batch), so long texts don't add up; functions work on ``slices`` of a batch.
    """
    return map_arrow(spread(df), fn, schema)


def text_columns(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns ``keep`` and, where it isn't one of them, the text after them."""
    return df.select(*keep, *([] if text_col in keep else [text_col]))


def running(counts: DataFrame, at: str, n: str, out: str, group: int = 4096) -> DataFrame:
    """``counts`` (one row for each whole number ``at`` from 0) with ``out``: the sum of ``n`` over smaller ``at``.

    Sums run within groups of numbers and over the groups' totals, so that no task sorts all numbers.
    """
    part = F.floor(F.col(at) / group).alias("_g")
    inside = Window.partitionBy("_g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(part).agg(F.sum(n).alias("_t")).select("_g", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_o"))
    each = counts.withColumn("_g", part).withColumn(out, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return each.join(totals, "_g").withColumn(out, (F.col(out) + F.col("_o")).cast("long")).drop("_g", "_o")


def joined_hot(rows: DataFrame, one: DataFrame, key: str, n: str, total: int, hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``one``, a row for each value of ``key`` that says how many of the ``total`` rows hold it (``n``, dropped).

    Values of over ``hot`` rows and over a thousandth of all, at most 1,000, go to every task, and their rows stay where they are.
    """
    most = max(hot, total // 1000)
    often, seldom = F.broadcast(one.where(F.col(n) > most).drop(n)), one.where(F.col(n) <= most).drop(n)
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(seldom, key))


def numbered(rows: DataFrame, keys: DataFrame, key: str, out: str, salt_rows: int = 10_000, broadcast_rows: int = 500_000) -> DataFrame:
    """``rows`` with ``out``: 0 where ``key`` is there once, else 0, 1, 2 and so on over the rows of a key.

    ``keys``: the key column of the same rows. Only rows of repeated keys move: those of one key are dealt into
    salts of about ``salt_rows``, numbered within each and set off by the counts of the salts before, so a key of
    any number of rows needs no task of its own. Rows of a key should be alike: which of them gets which number is left open.
    """
    often = stage(keys.groupBy(key).agg(F.count("*").alias("_m")).where("_m > 1"))
    n = often.count()
    if not n:
        return rows.withColumn(out, F.lit(0).cast("long"))
    often = F.broadcast(often) if n <= broadcast_rows else often
    many = rows.join(often, key).withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("_m") / salt_rows)).cast("long"))
    many = stage(many)
    sizes = many.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # a row for each salt_rows rows of a key
    sizes = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(F.lit(0))) - 1
    many = many.withColumn(out, place).join(sizes, [key, "_salt"]).withColumn(out, (F.col(out) + F.col("_o")).cast("long"))
    lone = rows.join(often, key, "left_anti").withColumn(out, F.lit(0).cast("long"))
    return lone.unionByName(many.select(*lone.columns))


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """A worker process's one model or cache: made at its first use, dropped when another is asked for.

    Tasks of one operator that run in a worker share it; the next operator starts with its memory free.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library
        _KEPT[key] = make()
    return _KEPT[key]


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first position, number) of runs of texts with about ``most`` bytes or one text each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(upto):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to - at
        at = to


WIDE = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def string_hashes(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, short): two independent 64-bit hashes of each string, good where it has ``WIDE`` bytes at most."""
    if pa.types.is_large_string(x.type):
        x = x.cast(pa.string())
    n = len(x)
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + n + 1].astype(np.int64)
    size = np.diff(ends)
    short = size <= WIDE
    wide = np.zeros((n, WIDE), np.uint8)
    row = np.repeat(np.arange(n), np.where(short, size, 0))
    first = np.cumsum(np.where(short, size, 0)) - np.where(short, size, 0)
    into = np.arange(len(row)) - first[row]
    if len(row):
        wide[row, into] = np.frombuffer(x.buffers()[2], np.uint8)[ends[:-1][row] + into]
    words = wide.view(np.uint64)
    out = []
    for mix in (_MIX[:4], _MIX[4:]):
        h = size.astype(np.uint64) * mix[3]
        for k in range(WIDE // 8):
            h = (h ^ words[:, k]) * mix[k]
            h ^= h >> np.uint64(29)
            h *= mix[(k + 1) % 4]
            h ^= h >> np.uint64(32)
        out.append(h)
    return out[0], out[1], short


class Seen:
    """Values of strings, found by 128 bits of hash: some twenty bytes a string and no Python objects."""

    def __init__(self, kind: type):
        self.h1, self.h2, self.value = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.value)

    def values(self, x: pa.Array, learn: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
        """Values of distinct strings; ``learn`` gives those of the strings that are new. Strings over ``WIDE`` bytes stay new."""
        h1, h2, short = string_hashes(x)
        known = np.zeros(len(x), bool)
        out = np.zeros(len(x), np.result_type(self.value, np.int64))
        if len(self):
            at = np.minimum(np.searchsorted(self.h1, h1), len(self) - 1)
            known = short & (self.h1[at] == h1) & (self.h2[at] == h2)
            out[known] = self.value[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = learn(x.take(pa.array(new)))
            new = new[short[new]]
            new = new[np.argsort(h1[new], kind="stable")]
            at = np.searchsorted(self.h1, h1[new])
            self.h1, self.h2, self.value = np.insert(self.h1, at, h1[new]), np.insert(self.h2, at, h2[new]), np.insert(self.value, at, out[new].astype(self.value.dtype))
        return out
