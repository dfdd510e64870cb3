"""The registered queries: a name, the tables it reads, a plan over them, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline import fixtures

Tables = Callable[[str], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register plan(t), where t gives a table by name. sql: for DuckDB, over the tables in needs and those of the files."""

    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(lambda table: fixtures.table(spark, sf_dir, table))
        if sql is not None:
            ORACLES[name] = fixtures.duckdb_sql(needs, sql)
        return plan

    return register
