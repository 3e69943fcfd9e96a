"""Registered queries and their SQL, by operator family."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FAMILIES = ("sources", "activations", "cooccurrence", "similarity", "matching", "probes", "hierarchy", "prevalence", "text", "sampling", "linalg", "quality", "streams", "workflow", "extras")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of (spark, sf_dir), with the SQL that gives the same rows where there is one."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"featlake.plans.{family}")
