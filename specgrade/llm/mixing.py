"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent, which a search halves in on until the
mixture meets a target entropy or a limit on repetition. Each source then gives its share of the
token budget: whole epochs, each in a new order, and part of a last one. The orders are hashes, so
a task that runs again draws the same rows. Running sums over an order are taken in buckets of the hash,
so that a source that holds a third of all rows is spread over as many tasks as it needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from specgrade.session import materialise

# Rows of a source in one bucket of its order, about.
BUCKET_ROWS = 2_000
# Exponents tried at once, which is six halvings, and rounds.
_POINTS, _ROUNDS = 63, 6


def words(text: str) -> Column:
    """The number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"\S+")), F.lit(0)).cast("long")


def _sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a: the sum of share**a, and of share**a * log(share)."""
    log = F.log("share")
    row = sources.where("share > 0").agg(
        *[f for i, a in enumerate(exponents) for f in (F.sum(F.exp(a * log)).alias(f"z{i}"), F.sum(F.exp(a * log) * log).alias(f"l{i}"))]
    ).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]


def exponent(sources: DataFrame, evenness: float | None, max_repeats: float | None, budget_share: float | None) -> float:
    """The exponent in [0, 1] for a table with the token ``share`` of each source.

    ``evenness``: the largest exponent whose entropy is at least this part of the greatest
    possible one (1 if the shares already are as even; 0 if only equal weights are). ``max_repeats``:
    the smallest exponent at which no source is repeated more often. With both, the limit wins.
    ``budget_share``: the budget over all tokens, or None for the smallest budget that uses every
    row at least once.
    """
    k, low_share, high_share = sources.where("share > 0").agg(F.count(F.lit(1)), F.min("share"), F.max("share")).first()
    if not k:
        return 1.0

    def search(holds) -> float:
        """Where ``holds`` turns from true to false on [0, 1]; it is true at 0."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            points = [low + (high - low) * i / (_POINTS + 1) for i in range(1, _POINTS + 1)]
            good = [holds(a, z, s) for a, (z, s) in zip(points, _sums(sources, points))]
            turn = good.index(False) if False in good else _POINTS
            low, high = [low, *points][turn], [*points, high][turn]
        return low

    def repeats(a: float, z: float) -> float:
        if budget_share is None:
            return (high_share / low_share) ** (1 - a)
        return budget_share * low_share ** (a - 1) / z

    def even(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= evenness * math.log(k) - 1e-12

    (z0, s0), (z1, s1) = _sums(sources, [0.0, 1.0])
    found = 1.0 if max_repeats is None or evenness is not None else 0.0
    if evenness is not None and not even(1.0, z1, s1):
        found = search(even)
    if max_repeats is not None and repeats(found, _sums(sources, [found])[0][0]) > max_repeats:
        if repeats(1.0, z1) > max_repeats:
            return 1.0
        # The end of the last step is on the side where the limit holds.
        found = min(1.0, search(lambda a, z, s: repeats(a, z) > max_repeats) + (1 / (_POINTS + 1)) ** _ROUNDS)
    return found


def mix(
    docs: DataFrame,
    tokens: Column,
    key: str = "doc_id",
    source: str = "source",
    evenness: float | None = None,
    max_repeats: float | None = None,
    budget_tokens: float | None = None,
    keep_all: bool = False,
    block_tokens: int = 1_000_000,
    seed: int = 17,
) -> DataFrame:
    """The mixture: the rows of ``docs``, as often as their source's weight asks, with their place.

    Adds mix_epoch (the use of the row, from 0), mix_block and mix_order: the stream is sorted by
    block and order, and every block of ``block_tokens`` holds the sources at their weights.
    ``tokens`` counts the tokens of a row. The budget is ``budget_tokens``, or the tokens of the
    input, or with ``keep_all`` the least that uses every row at least once. A part of an epoch ends
    before the row that would exceed its budget.

    A null source is a source of its own. Rows without tokens count nothing and come once an
    epoch; so does every row of a source without tokens. Repeated rows are rows of their own. Null
    keys have equal places in the order. An input column that bears an output's name is replaced.
    No rows: no rows.
    """
    made = ("mix_epoch", "mix_block", "mix_order")
    kept = [c for c in docs.columns if c not in made]
    name = F.when(F.col(f"`{source}`").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(f"`{source}`").cast("string")))
    # The row travels as one struct, so that no name of a column can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    named = docs.select(whole, F.col(f"`{key}`").alias("_key"), name.alias("_source"), tokens.cast("long").alias("_tokens"))
    sizes = materialise(named.groupBy("_source").agg(F.sum("_tokens").alias("_t"), F.count(F.lit(1)).alias("_n")), "sources")
    total = sizes.agg(F.sum("_t")).first()[0] or 0
    shares = sizes.withColumn("share", F.col("_t") / F.lit(float(total or 1)))
    a = exponent(shares, evenness, max_repeats, None if keep_all else (budget_tokens or total) / (total or 1))
    norm = (_sums(shares, [a])[0][0] if total else None) or 1.0
    weight = F.when(F.col("_t") > 0, F.pow("share", F.lit(a)) / F.lit(norm)).otherwise(F.lit(0.0))
    weighed = shares.withColumn("_w", weight)
    budget = budget_tokens or float(total)
    if keep_all:
        budget = weighed.where("_w > 0").agg(F.max(F.col("_t") / F.col("_w"))).first()[0] or 0.0
    wanted = F.col("_w") * F.lit(float(budget))
    full = F.when(F.col("_t") > 0, F.floor(wanted / F.col("_t") + 1e-9)).otherwise(F.lit(0)).cast("int")
    plans = weighed.withColumn("_full", F.greatest(full, F.lit(int(keep_all and total > 0)) * (F.col("_t") > 0).cast("int"))).select(
        "_source", "_t", "_w", "_full",
        F.greatest(F.lit(0.0), wanted - F.col("_full") * F.col("_t")).alias("_rest"),
        F.ceil(F.col("_n") / F.lit(BUCKET_ROWS)).alias("_buckets"),
    )
    uses = named.join(F.broadcast(plans) if sizes.count() <= 10_000 else plans, "_source").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_full"))))
    order = F.xxhash64(F.lit(seed), "mix_epoch", "_key", "_tokens")
    ordered = uses.withColumn("_order", order).withColumn("_bucket", _bucket_of(F.col("_order"), F.col("_buckets")))
    slot = ["_source", "mix_epoch", "_bucket"]
    before = W.partitionBy("_source", "mix_epoch").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    narrow = ordered.groupBy(*slot).agg(F.sum("_tokens").alias("_sum"))
    offsets = narrow.select(*slot, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*slot).orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    placed = ordered.join(offsets, slot).withColumn("_upto", F.col("_offset") + F.sum("_tokens").over(inside))
    taken = placed.where((F.col("mix_epoch") < F.col("_full")) | (F.col("_upto") <= F.col("_rest")))
    reached = F.col("mix_epoch") * F.col("_t") + F.col("_upto") - F.col("_tokens")
    block = F.when(F.col("_w") > 0, F.floor(reached / (F.col("_w") * block_tokens))).otherwise(F.lit(0)).cast("long")
    return taken.select(
        "_row.*", F.col("mix_epoch"), block.alias("mix_block"),
        F.xxhash64(F.lit(seed + 1), "_order", "mix_epoch").alias("mix_order"),
    )


def _bucket_of(order: Column, buckets: Column) -> Column:
    """The bucket of a hash; buckets do not decrease along the hash."""
    top = F.shiftright(order, 32) + F.lit(2**31)
    return F.floor(top * buckets / F.lit(float(2**32))).cast("long")
