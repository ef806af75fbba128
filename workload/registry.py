from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millspark import fixtures
from millspark.session import configure, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Views used by oracle statements only.
ORACLE_VIEWS: dict[str, str] = {}


class Tables:
    """Fixture views and driver tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._written = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name if name in fixtures.TABLES else f"fx_{name}", self._written)

    def write_once(self, name: str) -> Tables:
        """From now on the views of this query start from one written copy of a view that several of them reach."""
        if f"fx_{name}" not in self._written:
            self._written[f"fx_{name}"] = staged(getattr(self, name))
        return self


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its own name, with its oracle when SQL can express it."""
    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(configure(spark), sf_dir))

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return build
    return register


def oracle_sql() -> dict[str, str]:
    return {key: fixtures.oracle(sql, ORACLE_VIEWS) for key, sql in ORACLES.items()}
