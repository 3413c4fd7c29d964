"""Registry of plans that run on the driver's tables.

Each plan is a function ``(spark, sf_dir) -> DataFrame`` registered with
the DuckDB SQL that computes the same result (``None`` where SQL cannot
express it, e.g. look-around regular expressions, which DuckDB's engine
lacks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def register(name: str, ops: tuple[str, ...] = (), sql: str | None = None):
    def deco(fn):
        PLANS[name] = fn
        OPERATORS[name] = ops
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
