"""Registry of plans: a Spark build, the operators it covers and, where SQL can say it, the DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from annolytics.sources.standins import Tables


@dataclass(frozen=True)
class Plan:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


PLANS: dict[str, Plan] = {}


def plan(name: str, covers: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = Plan(name, covers, build, sql)
        return build

    return register
