"""Every query of the engine: name -> (function of (spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.session import ship_code

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def keep(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return fn(spark, sf_dir)

        _QUERIES[name] = (run, sql)
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["rule_field_winners"][0](spark, sf_dir)


from foliant.plans import corpus, documents, evaluation, guards, results  # noqa: E402, F401  registers its queries
