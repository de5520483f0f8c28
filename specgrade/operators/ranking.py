"""Exact row positions and percentiles that never put an unbounded group into one task.

``row_number`` over a group would sort the group in one task. Here the rows are dealt into sorted
ranges (or hash buckets); counts of the ranges give each its offset, and only the place inside a
range is counted row by row. The same plan serves tables of every size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from specgrade.functions.columns import names, seeded_hash
from specgrade.session import materialise

# Hexadecimal digits of the hash that name a bucket: 4,096 buckets in each group.
HASH_DIGITS = 3

_G, _B, _BEFORE, _AT = "_group", "_bucket", "_before", "_at"


def exact_rank(
    df: DataFrame,
    group: str | Iterable[str],
    order: Iterable[Column],
    bucket: Column | None,
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, ordered by ``order``.

    ``bucket`` must not decrease along ``order`` within a group; None means that the caller
    knows the groups to be small. ``total`` names a column for the size of the group.
    """
    group = names(group)
    if bucket is None:
        by = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
        out = df.withColumn(rank, F.row_number().over(by.orderBy(*order)).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(by)) if total else out
    # A struct key matches rows whose group columns are null and keeps one partitioning for
    # the join and the window.
    df = df.withColumn(_G, F.struct(*group) if group else F.lit(0)).withColumn(_B, bucket)
    sizes = df.groupBy(_G, _B).agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(_G).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        _G,
        _B,
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias(_BEFORE),
        *([F.sum("_n").over(W.partitionBy(_G)).alias(total)] if total else []),
    )
    inside = W.partitionBy(_G, _B).orderBy(*order)
    return (
        df.join(offsets, [_G, _B])
        .withColumn(rank, (F.col(_BEFORE) + F.row_number().over(inside)).cast("long"))
        .drop(_G, _B, _BEFORE)
    )


def hash_rank(
    df: DataFrame,
    group: str | Iterable[str],
    key: str | Iterable[str],
    seed: int | str | Column,
    rank: str = "rank",
    total: str | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Exact position of each row in its group under the seeded hash order.

    The buckets are the first hexadecimal digits of the hash, so they are even whatever the
    keys look like, and even if one group holds all rows.
    """
    key = names(key)
    df = df.withColumn("_hash", seeded_hash(seed, *[F.col(k) for k in key]))
    order = [F.col("_hash"), *[F.col(k) for k in key]]
    return exact_rank(df, group, order, F.substring("_hash", 1, digits), rank, total).drop("_hash")


def positions(
    df: DataFrame,
    group: str | Iterable[str],
    order: Iterable[Column],
    rank: str = "rank",
    total: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, for groups of any size, in one shuffle.

    Spark deals the rows into sorted ranges of (group, order). A row's position in the whole order is
    its ordinal in its range plus the sizes of the ranges before it, and its position in the group
    is the distance to the group's first row. No window runs over rows, and a large group is many
    ranges. The ranges are written once: their borders are samples, which a second evaluation
    could draw otherwise. The table of range sizes has one row for each range.
    """
    group, order = names(group), list(order)
    keys = [*[F.col(g) for g in group], *order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    stored = materialise(dealt.sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id()), "ranges")
    # The id holds the range in its upper bits and the ordinal in the lower 33.
    part = F.shiftright(_AT, 33).alias("_part")
    sizes = stored.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(_BEFORE),
        *([F.sum("_n").over(W.partitionBy(F.lit(0))).alias(total)] if total and not group else []),
    )
    whole = (
        stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(_AT, F.col(_BEFORE) + F.col(_AT).bitwiseAND((1 << 33) - 1) + 1).drop("_part", _BEFORE)
    )
    if not group:
        return whole.withColumnRenamed(_AT, rank)
    # A struct key matches rows whose group columns are null.
    keyed = whole.withColumn(_G, F.struct(*group))
    firsts = keyed.groupBy(_G).agg(F.min(_AT).alias("_first"), *([F.count(F.lit(1)).alias(total)] if total else []))
    return keyed.join(firsts, _G).withColumn(rank, F.col(_AT) - F.col("_first") + 1).drop(_G, _AT, "_first")


def ordered_rank(
    df: DataFrame,
    group: str | Iterable[str],
    lead: str,
    then: Iterable[Column] = (),
    rank: str = "rank",
    total: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Exact position of each row in its group, ordered by ``lead``, then by ``then``; nulls first.

    ``lead`` may be of any orderable type. ``parts`` sets the number of ranges.
    """
    return positions(df, group, [F.col(lead).asc(), *then], rank, total, parts)


def exact_percentile(
    df: DataFrame,
    group: str | Iterable[str],
    values: dict[str, tuple[str, float]],
    parts: int | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation per group; null values are left out.

    ``values``: output column -> (value column, fraction). A null group is a group; one
    without values has null percentiles. The built-in percentile keeps every distinct value of
    a group in one task; here equal values are counted on the map side, so a repeated value is
    one row for each task, the distinct values are dealt into ranges, and running sums of
    their counts find the two values around each position. All columns share one pass.
    """
    group = names(group)
    key = (F.struct(*group) if group else F.lit(0)).alias(_G)
    columns = sorted({column for column, _ in values.values()})
    value = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    rows = df.select(key, F.explode(value).alias("_m")).select(_G, "_m.*").where("_v is not null")
    counted = rows.groupBy(_G, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    keys = [F.col(c) for c in (_G, "_c", "_v")]
    dealt = counted.repartitionByRange(parts, *keys) if parts else counted.repartitionByRange(*keys)
    ranged = materialise(dealt.withColumn(_B, F.spark_partition_id()), "values")
    whole, ahead = W.partitionBy(_G, "_c"), W.unboundedPreceding
    offsets = ranged.groupBy(_G, "_c", _B).agg(F.sum("_n").alias("_s")).select(
        _G, "_c", _B, F.sum("_s").over(whole).alias("_total"),
        F.coalesce(F.sum("_s").over(whole.orderBy(_B).rowsBetween(ahead, -1)), F.lit(0)).alias(_BEFORE),
    )
    inside = W.partitionBy(_G, "_c", _B).orderBy("_v").rowsBetween(ahead, -1)
    first = F.col(_BEFORE) + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    placed = ranged.join(offsets, [_G, "_c", _B]).withColumn("_first", first)

    def weighed(column: str, fraction: float) -> Column:
        at = F.lit(fraction) * (F.col("_total") - 1)
        low, share = F.floor(at), at - F.floor(at)
        holds = lambda k: (F.col("_first") <= k) & (k < F.col("_first") + F.col("_n"))
        weight = F.when(holds(low) & holds(low + 1), 1.0).when(holds(low), 1 - share).when(holds(low + 1), share)
        return F.sum(F.when(F.col("_c") == column, F.col("_v") * weight))

    picked = placed.groupBy(_G).agg(*[weighed(c, f).alias(out) for out, (c, f) in values.items()])
    groups = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).select(*group, key)
    return groups.join(picked, _G, "left").drop(_G)


def top_per_group(
    df: DataFrame, group: str | Iterable[str], order: Iterable[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group with their position.

    The filter on ``row_number`` lets Spark keep ``k`` rows per group in each map task before
    the shuffle, so a large group costs one short list per task.
    """
    w = W.partitionBy(*names(group)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
