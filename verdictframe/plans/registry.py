"""All queries over the shared tables, each with its equivalent for an independent SQL engine where SQL has one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictframe.errors import RegistryError
from verdictframe.operators.cluster import bound_batches

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("text", "runs", "comparisons", "ranking", "stress", "agents", "safety", "ingest", "more", "further", "recorded", "custom")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def keep(f: Query) -> Query:
        if f.__name__ in _queries:
            raise RegistryError(f"two queries named {f.__name__}")
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a view: SQL that both engines understand, with tables as {name}."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def plain(sql: str) -> str:
    """The same SQL with bare table names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"verdictframe.plans.{m}")
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
