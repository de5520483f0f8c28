"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key's text modulo ``n``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def text_of(column: str) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """Deal a table whose few file splits would leave cores idle out to all of them.

    The partition count is read from the plan; no rows are counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
