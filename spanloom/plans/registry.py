"""Every query of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import catalog, evaluation, retrieval, service

QUERIES = retrieval.QUERIES | catalog.QUERIES | service.QUERIES | evaluation.QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
