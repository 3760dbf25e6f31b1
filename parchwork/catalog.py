"""Registry of the engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchwork.plans import batch_queries, format_queries, layout_queries, more_queries, rule_queries, text_queries
from parchwork.plans.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_modules = [text_queries, layout_queries, batch_queries, rule_queries, format_queries, more_queries]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    return queries()["document_audit"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {name: _shipped(q) for m in _modules for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules for name, sql in m.SQL.items()}
