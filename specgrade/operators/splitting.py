"""Leakage-free splits and reproducible sampling.

Every draw is ordered by an md5 of seed and key (see ``seeded_hash``), so sizes and
invariants are exact while the drawn rows do not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions.columns import names, not_blank, require_columns, seeded_hash
from specgrade.operators.ranking import exact_rank, hash_rank, ordered_rank, top_per_group
from specgrade.session import materialise

PARTITIONS = ("train", "val", "test")
# Standard deviations of rows drawn for an episode beyond those needed: one pair in 10^8 is short.
EXTRA = 6


def _check_ratios(train: float, val: float, test: float) -> None:
    if not math.isclose(train + val + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"split ratios must sum to 1.0, got {train + val + test}")


def _two_pass_sizes(n: Column, train: float, val: float, test: float) -> tuple[Column, Column]:
    """Rows of test, then of val out of the rest; both round up."""
    n_test = F.ceil(F.lit(float(test)) * n)
    n_val = F.ceil(F.lit(val / (train + val)) * (n - n_test))
    return n_test, n_val


def _cut(rank: Column, n_test: Column, n_val: Column) -> Column:
    return (
        F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    )


def group_split(
    records: DataFrame,
    individual: str = "individual_id",
    train: float = 0.70,
    val: float = 0.15,
    test: float = 0.15,
    seeds: int | list[int] = 42,
    out: str = "split_part",
) -> DataFrame:
    """Split by individual: all rows of an individual share one part.

    Several seeds are drawn in one job; the result then holds every record once per seed. A
    blank individual id raises when the plan runs.
    """
    _check_ratios(train, val, test)
    seeds = [seeds] if isinstance(seeds, int) else list(seeds)
    require_columns(records, [individual], "records")
    key = F.col(individual)
    blank = ~not_blank(key.cast("string"))
    guarded = F.when(
        blank, F.raise_error(F.lit("records must carry an individual id"))
    ).otherwise(key)
    groups = (
        records.groupBy(guarded.alias(individual))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(individual, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    )
    ranked = hash_rank(groups, "seed", individual, F.col("seed"), "_rank", "_total")
    n_test, n_val = _two_pass_sizes(F.col("_total"), train, val, test)
    parts = ranked.select(individual, "seed", _cut(F.col("_rank"), n_test, n_val).alias(out))
    return records.join(parts, individual)


def hash_split(
    records: DataFrame,
    individual: str = "individual_id",
    train: float = 0.70,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    out: str = "split_part",
) -> DataFrame:
    """Shuffle-free group split by hash threshold; shares are approximate, leakage is still nil."""
    _check_ratios(train, val, test)
    point = F.conv(F.substring(seeded_hash(seed, F.col(individual)), 1, 8), 16, 10).cast("double")
    share = point / F.lit(float(0x100000000))
    return records.withColumn(
        out, F.when(share < test, "test").when(share < test + val, "val").otherwise("train")
    )


def _quota(classes: DataFrame, label: str, size: str, total: Column, quota: str) -> DataFrame:
    """Largest-remainder share of ``total`` draws for each class."""
    n = F.col(size).cast("double") / F.col("_all") * total
    base = classes.withColumn("_exact", n).withColumn("_floor", F.floor("_exact"))
    left = base.withColumn("_rest", F.col("_exact") - F.col("_floor"))
    # The remainder lies in [0, 1): its leading digits are an order-preserving bucket.
    ranked = exact_rank(
        left,
        [],
        [F.round("_rest", 9).desc(), F.col(label)],
        F.floor((1 - F.round("_rest", 9)) * 256),
        "_place",
    )
    return ranked.withColumn(
        quota,
        (F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("long"),
    ).drop("_exact", "_rest", "_place", "_floor")


def _with_left(classes: DataFrame, size: str, total: Column) -> DataFrame:
    """Draws left over once every class got the floor of its share."""
    share = F.floor(F.col(size).cast("double") / F.col("_all") * total)
    return classes.withColumn("_left", classes.agg(F.first(total) - F.sum(share)).scalar())


def stratified_split(
    records: DataFrame,
    label: str = "label",
    key: str = "record_id",
    train: float = 0.70,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    out: str = "split_part",
) -> DataFrame:
    """Row split in two passes with class shares kept by largest remainder."""
    _check_ratios(train, val, test)
    sizes = records.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_all", records.agg(F.count(F.lit(1))).scalar())
    n_test = F.ceil(F.lit(float(test)) * F.col("_all"))
    pass1 = _quota(_with_left(sizes, "_size", n_test), label, "_size", n_test, "_test")
    rest = pass1.select(
        label,
        "_test",
        (F.col("_size") - F.col("_test")).alias("_size"),
        (F.col("_all") - n_test).alias("_all"),
    )
    n_val = F.ceil(F.lit(val / (train + val)) * F.col("_all"))
    pass2 = _quota(_with_left(rest, "_size", n_val), label, "_size", n_val, "_val")
    ranked = hash_rank(records, label, key, seed, "_rank")
    return (
        ranked.join(pass2.select(label, "_test", "_val"), label)
        .withColumn(out, _cut(F.col("_rank"), F.col("_test"), F.col("_val")))
        .drop("_rank", "_test", "_val")
    )


def under_sampled_classes(records: DataFrame, label: str, min_samples: int = 3) -> DataFrame:
    """Classes too small to hold ``min_samples`` rows in each of the three parts."""
    return (
        records.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < 3 * min_samples)
    )


def support_set(
    records: DataFrame,
    k: int | Column,
    label: str = "label",
    key: str = "record_id",
    seed: int | Column = 42,
    by: str | list[str] = (),
    max_k: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """``k`` rows per class (and per ``by`` group), drawn without replacement.

    With ``strict`` a class with fewer than ``k`` rows raises when the plan runs. ``k`` may be
    a column for a whole grid; ``max_k`` then bounds it.
    """
    by = names(by)
    bound = k if isinstance(k, int) else max_k
    if bound is None:
        raise ValueError("max_k is needed when k is a column")
    order = [seeded_hash(seed, F.col(key)), F.col(key)]
    want = F.lit(k) if isinstance(k, int) else k
    top = top_per_group(records, [*by, label], order, bound, "support_pos").where(
        F.col("support_pos") <= want
    )
    if not strict:
        return top
    have = top.groupBy(*by, label).agg(F.max("support_pos").alias("_have"), F.max(want).alias("_want"))
    short = F.concat(
        F.lit("class "), F.col(label).cast("string"), F.lit(" has too few rows for the support set")
    )
    checked = have.select(
        *by,
        label,
        F.when(F.col("_have") < F.col("_want"), F.raise_error(short)).otherwise(F.col("_have")).alias("_have"),
    )
    return top.join(checked, [*by, label]).where(F.col("_have").isNotNull()).drop("_have")


def sample_individual(
    split: DataFrame, part: str = "test", seed: int = 0, individual: str = "individual_id", out: str = "split_part"
) -> DataFrame:
    """One individual of val or test; never of train."""
    if part not in ("test", "val"):
        raise ValueError("part must be 'test' or 'val'")
    return (
        split.where(F.col(out) == part)
        .select(individual)
        .distinct()
        .orderBy(seeded_hash(seed, F.col(individual)), individual)
        .limit(1)
        .withColumn("seed", F.lit(seed))
    )


def sample_episodes(
    records: DataFrame,
    episodes: int,
    n_way: int | None = None,
    k_shot: int = 5,
    n_query: int = 15,
    label: str = "label",
    key: str = "record_id",
    seed: int = 42,
) -> DataFrame:
    """Few-shot episodes: ``n_way`` classes, ``k_shot`` support and ``n_query`` query rows each.

    A class of n rows gives an episode its first rows in hash order, so only rows whose hash lies
    below a threshold are wanted: that share of n that holds a few more than the rows needed. The
    threshold is part of the join, and only rows below it leave it. (Episode, class) pairs that came
    out short are topped up with the rest of their class, so the result is exact.
    """
    need = k_shot + n_query
    wanted = max(0.0, need + EXTRA * (need**0.5 + 1))
    classes = records.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    short = F.concat(F.lit("class "), F.col(label).cast("string"), F.lit(" has too few rows"))
    drawn = classes.select(
        F.when(F.col("_n") < need, F.raise_error(short)).otherwise(F.col(label)).alias(label),
        "_n",
        F.explode(F.sequence(F.lit(0), F.lit(episodes - 1))).alias("episode"),
    )
    if n_way is not None:
        order = [seeded_hash(seed, F.col("episode"), F.col(label)), F.col(label)]
        drawn = top_per_group(drawn, "episode", order, n_way, "_way").drop("_way")
    # Eight hexadecimal digits; "g" is above all of them.
    share = F.floor(F.lit(wanted) / F.col("_n") * float(1 << 32)).cast("long")
    bound = F.when(F.col("_n") <= wanted, F.lit("g")).otherwise(F.lpad(F.lower(F.hex(share)), 8, "0"))
    drawn = materialise(drawn.select(label, "episode", bound.alias("_bound")), "drawn")
    hashed = seeded_hash(seed, F.col("episode"), F.col(key))
    below = F.substring(hashed, 1, 8) < F.col("_bound")
    rows = records.select(label, key)
    first = materialise(rows.join(drawn, label).where(below).select("episode", label, key), "first")
    enough = first.groupBy("episode", label).agg(F.count(F.lit(1)).alias("_have")).where(F.col("_have") >= need)
    lacking = drawn.join(enough, ["episode", label], "left_anti")
    rest = rows.join(lacking, label).where(~below).select("episode", label, key)
    return (
        top_per_group(first.union(rest), ["episode", label], [hashed, F.col(key)], need, "pos")
        .withColumn("role", F.when(F.col("pos") <= k_shot, "support").otherwise("query"))
        .select("episode", "role", label, key, "pos")
    )


def shard(df: DataFrame, key: str, index: int, count: int, limit: int | None = None) -> DataFrame:
    """Every ``count``-th row in key order, starting at ``index``, then the first ``limit`` rows."""
    ranked = ordered_rank(df, [], key, rank="_pos")
    mine = ranked.where(F.pmod(F.col("_pos") - 1, F.lit(count)) == index).drop("_pos")
    return mine.orderBy(key).limit(limit) if limit else mine


def class_statistics(split: DataFrame, label: str = "label", part: str = "split_part") -> DataFrame:
    """Rows per class in each part, summarised.

    The percentile runs over class sizes: few distinct numbers even for many classes.
    """
    counts = split.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(part).agg(
        F.min("n").alias("min_samples"),
        F.max("n").alias("max_samples"),
        F.avg("n").alias("mean_samples"),
        F.percentile("n", F.lit(0.5)).alias("median_samples"),
        F.stddev_pop("n").alias("std_samples"),
        F.count(F.lit(1)).alias("num_classes"),
    )


# The shot counts that are recommended when they fit.
SHOT_STEPS = (1, 5, 10, 20, 50)


def feasible_shots(split: DataFrame, label: str = "label", part: str = "split_part") -> DataFrame:
    """Largest k every train class supports, and the recommended steps below it."""
    train = class_statistics(split, label, part).where(F.col(part) == "train")
    steps = F.filter(F.array(*[F.lit(s) for s in SHOT_STEPS]), lambda s: s <= F.col("min_samples"))
    return train.select(
        F.col("min_samples").alias("guaranteed"),
        F.when(F.size(steps) > 0, steps)
        .otherwise(F.array(F.col("min_samples").cast("int")))
        .alias("recommended"),
        F.greatest(F.lit(5), F.col("min_samples")).alias("warning_threshold"),
    )


def small_classes(split: DataFrame, label: str = "label", part: str = "split_part") -> DataFrame:
    """Classes whose train part is below the warning threshold, with their counts per part."""
    counts = split.groupBy(label).agg(
        *[F.count(F.when(F.col(part) == p, 1)).alias(f"{p}_samples") for p in PARTITIONS]
    )
    limit = counts.where(F.col("train_samples") > 0).agg(
        F.greatest(F.lit(5), F.min("train_samples"))
    )
    return counts.where(F.col("train_samples") < limit.scalar()).withColumn(
        "max_feasible_k", F.col("train_samples")
    )


def shot_feasibility(split: DataFrame, ks: list[int], label: str = "label", part: str = "split_part") -> DataFrame:
    """For each k: whether every train class supports it, and a message."""
    feasible = feasible_shots(split, label, part)
    k = F.col("k")
    text = (
        F.when(
            k > F.col("guaranteed"),
            F.format_string("k=%d exceeds the guaranteed k=%d", k, F.col("guaranteed")),
        )
        .when(
            F.array_contains("recommended", k),
            F.format_string("k=%d is feasible and recommended", k),
        )
        .otherwise(F.format_string("k=%d is feasible", k))
    )
    return feasible.withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks]))).select(
        "k", "guaranteed", (k <= F.col("guaranteed")).alias("valid"), text.alias("message")
    )
