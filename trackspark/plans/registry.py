"""Registry of runnable queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.plans.fixtures import Inputs


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]          # survey ids
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Inputs(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, sql)
        return build
    return register


def r6(name: str) -> Column:
    """Column rounded to six decimals (sums of doubles differ in the last bits)."""
    return F.round(F.col(name), 6).alias(name)
