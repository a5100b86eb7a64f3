"""Where queries are registered: a name, a Spark callable and, where SQL can say it, the twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from haulmark.operators.curation import curate_star, star_core
from haulmark.operators.deliveries import build_deliveries
from haulmark.operators.sla import analytic_cut
from haulmark.plans.ctes import with_ctes
from haulmark.session import written
from haulmark.sources.star import AdaptedStar, adapt_star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Twins before the shared definitions are put in front, for twins that are made of others.
TWINS: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}
#: The callables as registered, for queries made of others: they share one set of inputs.
ON_INPUTS: dict[str, Callable[[Inputs], DataFrame]] = {}


class Inputs:
    """Lazy tables of one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def star(self) -> AdaptedStar:
        return adapt_star(self.spark, self.folder)

    @cached_property
    def deliveries(self) -> DataFrame:
        """Written once for all that a query curates."""
        return written(build_deliveries(self.star))[0]

    @cached_property
    def core(self) -> DataFrame:
        return star_core(self.star, deliveries=self.deliveries)

    @property
    def analytic(self) -> DataFrame:
        return analytic_cut(self.core)

    @cached_property
    def curated(self) -> DataFrame:
        return curate_star(self.star, deliveries=self.deliveries)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs)`` under a name, with its SQL twin if there is one."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        ON_INPUTS[name] = fn
        MODULE_OF[name] = fn.__module__
        if sql is not None:
            ORACLES[name], TWINS[name] = with_ctes(sql), sql
        return fn

    return register
