
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "agg20_pair_calibration"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register f(tables) under its own name, with its SQL if there is one."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    from . import analytics, conditions, extended, nulls, relational, series, states  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
