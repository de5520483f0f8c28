"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def names(columns: str | Iterable[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Fail at plan time when a required column is absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when the denominator is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def ratio0(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 when the denominator is 0."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that has a row for each key of the input, and is shuffled whatever its files' size.

    Spark plans a broadcast by the size of compressed files. A narrow table of a few megabytes unfolds to hundreds in
    the driver, once for each query that reads it.
    """
    return df.hint("merge")


def not_blank(col: Column) -> Column:
    return F.coalesce(F.length(F.trim(col)) > 0, F.lit(False))


def seeded_hash(seed: int | str | Column, *keys: Column) -> Column:
    """md5 of ``seed:key[:key]``, the order every sampling operator uses.

    The order does not depend on partitioning, so a rerun after an executor loss draws the
    same rows.
    """
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first.cast("string"), *[k.cast("string") for k in keys]))
