"""Registry of the named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from specgrade.session import materialise


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.kept: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several branches of a query read, stored by the first of them."""
        if name not in self.kept:
            self.kept[name] = materialise(build(), name)
        return self.kept[name]

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table as another branch stored it by ``once``; built in place when none has."""
        return self.kept[name] if name in self.kept else build()

    def parts(self, name: str, rows_per_task: int) -> int:
        """Tasks for the rows of a table, so that a task's share does not grow with the table; short tables still use the cores."""
        if name not in self.sizes:
            self.sizes[name] = getattr(self, name).count()
        rows, cores = self.sizes[name], self.spark.sparkContext.defaultParallelism
        return max(1, -(-rows // rows_per_task), min(cores, rows // 20_000))

    def spread(self, name: str, *columns: str, rows_per_task: int = 20_000) -> DataFrame:
        """A table whose few files would leave cores idle, dealt out to more tasks.

        For queries that do much work per row. A table with at least as many partitions as the
        cluster has cores is returned as it is.
        """
        df = getattr(self, name)
        if columns:
            df = df.select(*columns)
        cores, parts = self.spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
        if parts >= cores:
            return df
        wanted = min(cores, -(-df.count() // rows_per_task))
        return df.repartition(wanted) if wanted > parts else df


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query, the inventory ids it covers, and its SQL check."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return add
