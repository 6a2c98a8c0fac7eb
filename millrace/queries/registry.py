"""Queries over the given tables, each with the SQL that states its result."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""
    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def with_views(*views: str, select: str) -> str:
    return "with " + ",\n".join(views) + "\n" + select
