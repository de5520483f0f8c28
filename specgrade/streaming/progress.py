"""Streams over arriving results: run progress and incremental grading."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from specgrade.operators.conditions import completeness
from specgrade.session import new_path

# Folders by key of each batch of a graded output.
KEY_PARTS = 16


def result_stream(spark: SparkSession, folder: str, schema: StructType, glob: str, files_per_trigger: int = 8) -> DataFrame:
    """File stream over result tables as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append what a stream yields to Parquet files until what has arrived is read; state on disk."""
    with state_on_disk(rows.sparkSession):
        _run(rows.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def progress(
    stream: DataFrame, expected: int, by: list[str], time: str, keys: list[str], conditions: DataFrame | None = None
) -> DataFrame:
    """Completeness per condition over everything that has arrived, however late.

    The stream only appends status rows and keeps no state. A resent result counts once, with the
    status it arrived with first by ``time``; this is settled when counting, with map-side
    combine, so the answer does not depend on how the files fell into batches.
    """
    spark = stream.sparkSession
    out, log = new_path(spark, "progress"), new_path(spark, "progress-log")
    rows = stream.select(*by, "status", *keys, F.col(time).cast("timestamp").alias("_time"))
    _run(rows.writeStream.format("parquet").option("path", out).outputMode("append"), log)
    seen = spark.read.schema(rows.schema).parquet(out)
    first = seen.groupBy(*keys).agg(F.min_by(F.struct(*by, "status"), F.struct("_time", "status")).alias("_first")).select("_first.*")
    return completeness(first, expected, by, conditions)


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# The state store that keeps its rows on disk.
DISK_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in a store on disk."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, DISK_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def grade_incrementally(
    stream: DataFrame,
    grade: Callable[[DataFrame], DataFrame],
    keys: list[str],
    path: str,
    checkpoint: str,
    remember: str | None = None,
) -> None:
    """Grade each key once and append it below ``path``, in a folder by run and batch.

    The stream's state, on disk, holds the keys seen under this checkpoint, so a batch costs its own
    rows, not the output's. ``remember`` (an interval such as "7 days") bounds that state: a key leaves
    it so long after it arrived. A repeat that comes later still does not count: keys new to a
    bounded state are looked up in the stored output, in those of its key partitions that the batch
    touches. A replayed batch writes its folder again. Keys that other checkpoints graded are read
    once, when the run starts.
    """
    spark = stream.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    held = _table_or_none(spark, path)
    done = held.where(F.col("run") != run).select(*keys) if held is not None else None
    part = F.pmod(F.xxhash64(*keys), F.lit(KEY_PARTS)).cast("int").alias("part")

    def graded_keys(fresh: DataFrame, batch_id: int) -> DataFrame | None:
        """Keys of the earlier batches of this run, in the partitions of the new ones."""
        table = _table_or_none(spark, f"{path}/run={run}")
        if table is None:
            return None
        parts = [r[0] for r in fresh.select(part).distinct().collect()]  # at most KEY_PARTS
        return table.where((F.col("batch") < batch_id) & F.col("part").isin(parts)).select(*keys)

    def append(batch: DataFrame, batch_id: int) -> None:
        fresh = batch if done is None else batch.join(done, keys, "left_anti")
        if remember:
            fresh = fresh.drop("_arrived")
            earlier = graded_keys(fresh, batch_id)
            fresh = fresh if earlier is None else fresh.join(earlier, keys, "left_anti")
        out = grade(fresh)
        to = f"{path}/run={run}/batch={batch_id}"
        if remember:
            out.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(to)
        else:
            out.write.mode("overwrite").parquet(to)

    if remember:
        # The time of arrival never runs backwards, so no row is late and none is dropped.
        timed = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
        unique = timed.dropDuplicatesWithinWatermark(keys)
    else:
        unique = stream.dropDuplicates(keys)
    with state_on_disk(spark):
        _run(unique.writeStream.foreachBatch(append), checkpoint)


class _Silence(StatefulProcessor):
    """Per condition the spells (first, last, n) that rows have made so far; a spell ends with silence.

    A timer fires when silence after a spell is certain. A row that arrives out of order can still
    lengthen or join spells until then.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait = wait_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getListState("spells", "first long, last long, n long")

    def _due(self, last: int) -> int:
        return -(-(last + self.wait) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        # The time is the last column, whatever name it arrives under.
        times = np.concatenate([pdf.iloc[:, -1].to_numpy("datetime64[us]").astype(np.int64) for pdf in rows])
        moments, n = np.unique(times, return_counts=True)
        held = sorted([*[tuple(s) for s in self.spells.get()], *zip(moments.tolist(), moments.tolist(), n.tolist())])
        joined = [held[0]]
        for first, last, n in held[1:]:
            before = joined[-1]
            if first - before[1] <= self.wait:
                joined[-1] = (before[0], max(before[1], last), before[2] + n)
            else:
                joined.append((first, last, n))
        self.spells.put(joined)
        # A timer of a spell that has grown since fires for nothing.
        for _, last, _ in joined:
            self.handle.registerTimer(self._due(last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(s) for s in self.spells.get()]
        over = [s for s in held if self._due(s[1]) <= now]
        if over:
            left = [s for s in held if self._due(s[1]) > now]
            self.spells.put(left) if left else self.spells.clear()
            yield pd.DataFrame({"condition": [key[0]] * len(over), "last_seen": pd.to_datetime([s[1] for s in over], unit="us"), "n": [s[2] for s in over]})

    def close(self) -> None:
        pass


def stalled(stream: DataFrame, condition: str, time: str, wait_ms: int, delay: str) -> DataFrame:
    """(condition, last_seen, n): a row each time a condition has stalled, silent for ``wait_ms``.

    ``n`` counts its rows since it last stalled. Event time trails the newest row by ``delay``; rows
    may arrive out of order within it, however they fall into batches, and later ones are dropped.
    The state, on disk, holds the spells that are not over. Runs until what has arrived is read,
    and returns what was reported.
    """
    spark = stream.sparkSession
    out, log = new_path(spark, "stalled"), new_path(spark, "stalled-log")
    schema = "condition string, last_seen timestamp, n long"
    timed = stream.select(F.col(condition).cast("string").alias("condition"), F.col(time).cast("timestamp").alias("_time")).withWatermark("_time", delay)
    reports = timed.groupBy("condition").transformWithStateInPandas(_Silence(wait_ms), schema, "Append", "EventTime")
    run_to(reports, out, log)
    return spark.read.schema(schema).parquet(out)


def windowed_progress(stream: DataFrame, by: list[str], time: str, width: str = "1 hour", delay: str = "30 minutes") -> DataFrame:
    """Arrivals per window and status, final once the watermark passes the window."""
    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .groupBy(F.window(time, width), *by, "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )
