"""Sessions, and storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "foliant", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # The JVM never compiles methods of more than 8000 bytes: wider expressions run faster in several.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder named in ``spark.checkpoint.dir``.

    A temporary folder is used only by a single-machine session (``local[...]``)
    that names none; a cluster session without the setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this context's checkpoints, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The files survive lost executors, and nothing upstream is computed twice.
    Pass only what later steps need: rows are stored uncompressed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_code(spark: SparkSession) -> None:
    """Put this package's folder on the Python path of the workers, and let them give large freed arrays back at once."""
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [here, env.get("PYTHONPATH")]))
        # With fixed limits glibc maps every array of four megabytes by itself instead of growing a heap that stays.
        env.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
        env.setdefault("MALLOC_ARENA_MAX", "2")
        # Each core has a task of its own: threads inside numpy would only compete with them.
        env.setdefault("OPENBLAS_NUM_THREADS", "1")
        env.setdefault("OMP_NUM_THREADS", "1")


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers' path."""
    ship_code(df.sparkSession)
    return df.mapInArrow(fn, schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to more cores if it is a plain scan of fewer splits than cores, else as it is.

    For work that costs much more than moving the rows: a small input in one file would keep one core busy.
    It makes eight tasks of a split at most.
    """
    plan = df._jdf.queryExecution()
    shown = plan.executedPlan().toString()
    if "AdaptiveSparkPlan" in shown or "Exchange" in shown:
        return df
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, plan.toRdd().getNumPartitions()
    return df.repartition(min(cores, 8 * max(1, splits))) if splits < cores else df


def dealt(df: DataFrame, *keys: str, megabytes: int = 16) -> DataFrame:
    """``df`` dealt out by keys, about so many megabytes a task by the plan's estimate, and no fewer tasks than usual.

    What follows by the same keys needs no other exchange, and what a task holds doesn't grow with the input.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 50  # Spark takes rows that don't come from files for endless
    return df.repartition(max(usual, size // (megabytes << 20)) if known else usual, *keys)
