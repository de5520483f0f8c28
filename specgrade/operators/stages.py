"""User-pluggable stages over a specimen table, and user value sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

STAGE_TYPE = "struct<data:string,skipped:boolean,error:string,elapsed_ms:double>"


@dataclass(frozen=True)
class Stage:
    """A named transform from specimens to (key, data, error, elapsed_ms).

    ``run`` gets the specimen table with the columns of the stages in ``needs`` (struct column
    ``stages`` as a map) and returns one row per specimen it handled; ``error`` isolates a
    failure to its specimen.
    """

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = field(default=())


def run_stages(specimens: DataFrame, key: str, stages: list[Stage], skip: set[str] = frozenset()) -> DataFrame:
    """Add ``stages map<string,struct<data,skipped,error,elapsed_ms>>``, in stage order.

    A stage sees only the specimens whose needed stages succeeded; the others get an error
    entry. Later stages read the successful output of earlier ones.
    """
    table = specimens.withColumn("stages", F.create_map().cast(f"map<string,{STAGE_TYPE}>"))
    for stage in stages:
        if stage.name in skip:
            entry = F.struct(
                F.lit(None).cast("string").alias("data"), F.lit(True).alias("skipped"),
                F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("elapsed_ms"),
            )
            table = table.withColumn("stages", F.map_concat("stages", F.create_map(F.lit(stage.name), entry)))
            continue
        ready, message = F.lit(True), F.lit(None).cast("string")
        for need in stage.needs:
            s = F.try_element_at(F.col("stages"), F.lit(need))
            ok = s.isNotNull() & ~F.coalesce(s["skipped"], F.lit(False)) & s["error"].isNull()
            ok = F.coalesce(ok, F.lit(False))
            message = F.concat_ws("; ", message, F.when(~ok, F.lit(f"Missing required '{need}' data")))
            ready = ready & ok
        table = table.withColumn("_ready", ready).withColumn("_missing", message)
        done = stage.run(table.where("_ready").drop("_ready", "_missing")).select(
            key, F.struct("data", F.lit(False).alias("skipped"), "error", "elapsed_ms").cast(STAGE_TYPE).alias("_out")
        )
        gone = F.struct(
            F.lit(None).cast("string").alias("data"), F.lit(False).alias("skipped"),
            F.when(F.col("_ready"), F.lit(f"Stage {stage.name} returned no result")).otherwise(F.col("_missing")).alias("error"),
            F.lit(0.0).alias("elapsed_ms"),
        ).cast(STAGE_TYPE)
        table = (
            table.join(done, key, "left")
            .withColumn("stages", F.map_concat("stages", F.create_map(F.lit(stage.name), F.coalesce("_out", gone))))
            .drop("_out", "_ready", "_missing")
        )
    return table


def stage_rows(results: DataFrame, key: str) -> DataFrame:
    """One row per (specimen, stage)."""
    return results.select(key, F.explode("stages").alias("stage", "s")).select(key, "stage", "s.*")


def values_from_function(specimens: DataFrame, key: str, traits: list[str], fn: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """A value source from a vectorised user function over (specimen, trait)."""
    value = F.pandas_udf(fn, "string")
    rows = specimens.select(key, F.explode(F.array(*[F.lit(t) for t in traits])).alias("trait"))
    return rows.withColumn("token", value(F.col(key), F.col("trait")))


def values_from_table_function(
    rows: DataFrame, key: str, fn: Callable[[list[Row]], Iterable[tuple[str, str | None]]], order: str | None = None
) -> DataFrame:
    """(key, trait, token) from a user function that sees all rows of a specimen once.

    ``fn`` gets the rows in ``order`` and yields (trait, token); it decides itself which traits a
    specimen has. The function runs as a table function that asks Spark for the partitioning: rows
    meet in the task of their key, and no product of specimens and traits is made. A specimen's rows
    are held in memory while it is read.
    """

    class Values:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            fields = [T.StructField(key, table.dataType[key].dataType), T.StructField("trait", T.StringType()), T.StructField("token", T.StringType())]
            return AnalyzeResult(T.StructType(fields), partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(order)] if order else [])

        def __init__(self) -> None:
            self.rows: list[Row] = []

        def eval(self, row: Row):
            self.rows.append(row)

        def terminate(self):
            if self.rows:
                for trait, token in fn(self.rows):
                    yield self.rows[0][key], trait, token

    return F.udtf(Values)(rows.asTable())
