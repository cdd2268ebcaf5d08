"""Registry of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelops.plans.inputs import Inputs, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register a function of Inputs under a name, with SQL over the same inputs if there is any."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_inputs(sql, *ctes, recursive=recursive)
        return build

    return register
