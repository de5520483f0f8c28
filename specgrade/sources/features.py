"""Feature tables, the incremental feature cache and stored splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specgrade.functions.columns import names, require_columns
from specgrade.functions.vectors import l2_normalize


def read_features(spark: SparkSession, path: str, ranks: tuple[str, ...] = ("family", "genus", "species")) -> DataFrame:
    """Feature table keyed by image: vector, one label column per rank, individual."""
    return require_columns(spark.read.parquet(path), ["embedding", *ranks], "features")


def missing_features(records: DataFrame, cached: DataFrame, keys: str | list[str]) -> DataFrame:
    """Records whose key and label are not in the cache yet."""
    return records.join(cached.select(*names(keys)).distinct(), names(keys), "left_anti")


def extend_cache(
    records: DataFrame,
    path: str,
    keys: str | list[str],
    embed: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
    normalize: bool = True,
) -> DataFrame:
    """Embed only what the cache lacks and append it.

    ``embed`` is the caller's model, run by ``mapInPandas``. A rerun finds nothing to do.
    """
    spark = records.sparkSession
    todo = records
    try:
        todo = missing_features(records, spark.read.parquet(path), keys)
    except Exception as exc:  # no cache yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    made = todo.mapInPandas(embed, schema)
    if normalize:
        made = made.withColumn("embedding", l2_normalize(F.col("embedding")))
    made.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def validity(model: str, normalize: bool, *columns: str) -> Column:
    """What a cached vector depends on: the model, its normalisation and columns of the record
    (label, file size, modification time). Null differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(normalize)), *parts), 256)


@dataclass(frozen=True)
class FeatureCache:
    """A feature table bucketed by (keys, validity).

    Records look their vectors up by both, so a row whose label, file or model changed finds no
    stale vector. The table's buckets are the partitions of that join: only the records are
    shuffled, whatever the size of the cache. ``schema`` lists what ``embed`` returns, keys first.
    """

    spark: SparkSession
    table: str
    path: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    def open(self) -> DataFrame:
        """The cached rows; the table is registered over its folder if this session lacks it."""
        by = ", ".join(f"`{k}`" for k in (*self.keys, "validity"))
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.schema}, validity string) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self.spark.table(self.table)

    def missing(self, records: DataFrame) -> DataFrame:
        """Records (with ``validity``) that have no vector yet; repeated ones once."""
        by = [*self.keys, "validity"]
        return records.dropDuplicates(by).join(self.open().select(*by), by, "left_anti")

    def extend(self, records: DataFrame, embed: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], normalize: bool = True) -> None:
        """Embed what is missing and append it. ``embed`` keeps the columns of its rows."""
        made = self.missing(records).mapInPandas(embed, f"{self.schema}, validity string")
        if normalize:
            made = made.withColumn("embedding", l2_normalize(F.col("embedding")))
        by = [*self.keys, "validity"]
        made.write.format("parquet").mode("append").bucketBy(self.buckets, *by).sortBy(*by).saveAsTable(self.table)

    def lookup(self, records: DataFrame) -> DataFrame:
        """Records with their vectors; those without one drop out."""
        by = [*self.keys, "validity"]
        rest = [c for c in self.open().columns if c in by or c not in records.columns]
        return records.join(self.open().select(*rest), by)

    def compacted(self, records: DataFrame, table: str, path: str) -> "FeatureCache":
        """A new cache with the rows that ``records`` still need."""
        new = FeatureCache(self.spark, table, path, self.keys, self.schema, self.buckets)
        by = [*self.keys, "validity"]
        new.open()
        kept = self.open().join(records.select(*by).distinct(), by, "left_semi")
        kept.write.format("parquet").mode("append").bucketBy(self.buckets, *by).sortBy(*by).saveAsTable(table)
        return new


def save_split(split: DataFrame, path: str, label: str) -> None:
    """Split rows partitioned by seed, and the row counts per part next to them."""
    split.write.mode("overwrite").partitionBy("seed").parquet(f"{path}/rows")
    split.groupBy("seed", "split_part", label).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(
        f"{path}/counts"
    )


def load_split(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return rows if seed is None else rows.where(F.col("seed") == seed)
