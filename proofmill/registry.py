"""Collects the queries of all operator families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import artifacts, completion, evaluation, evidence, grants, hygiene, ingestion, intake, lineage, policies, sessions
from .plans import states
from .plans.relations import Reader, duckdb
from .sources import adapters, documents, envelopes, evaluations

FAMILIES = (evidence, sessions, grants, evaluation, states, lineage, artifacts, policies, intake, ingestion, hygiene, completion, adapters, envelopes, documents, evaluations)


def _bound(query: Callable[[Reader], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Reader(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(query) for family in FAMILIES for name, (query, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duckdb(sql) for family in FAMILIES for name, (_, sql) in family.QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.flagship(spark, sf_dir)
