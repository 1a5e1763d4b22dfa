"""Queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module with query(spark, sf_dir) and ORACLE (SQL or None).
OPERATORS = {
    "op1_mixing": "mixing",
    "op2_sharding": "sharding",
    "op3_subword": "subword",
    "op4_secret_scan": "secret_scan",
    "op5_quality": "quality",
    "op6_exact_dedup": "exact_dedup",
    "op7_chat": "chat",
    "op8_toxicity": "toxicity",
    "op9_near_dedup": "near_dedup",
    "op10_imatch": "fingerprint",
}


def _module(name: str):
    return import_module(f"{__package__}.{OPERATORS[name]}")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(f"{__package__}.pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in OPERATORS} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in OPERATORS if (sql := _module(name).ORACLE)}
