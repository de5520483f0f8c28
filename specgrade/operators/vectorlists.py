"""Nearest rows over inverted lists of vectors, exact by metric bounds or approximate by probes.

Centres are fitted on a bounded sample; every row goes to the list of its nearest centre, and a list
is cut into blocks of rows at similar distances from the centre (rings), whose borders come from the
same sample; a ring that turns out too full is dealt into salted blocks. A query knows its
distances to all centres. For the exact search it first scans one ring of its nearest lists, which
bounds its k-th best result; then it opens only the rings that the triangle inequality (or, for inner
products, a bound of centre, radius and norms) lets hold something as good. For the approximate search
it scans its nearest lists; with as many probes as lists that is exact too.

Queries meet blocks by an equi-join; the queries of one block are dealt into chunks, so neither a
popular list nor a large one becomes one task. Shipped to tasks are the centres and one row of
figures for each list, at most ``MAX_CENTRES`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from specgrade.functions.columns import names, seeded_hash
from specgrade.functions.vectors import as_double
from specgrade.operators.fewshot import match_schema, matrix, tiles
from specgrade.operators.ranking import top_per_group
from specgrade.session import materialise

MAX_CENTRES = 512
# Rows that the centres are fitted on: those with the smallest hashes of their keys.
SAMPLE_ROWS = 10_000
# Rows of a block and queries of a chunk. Every opened (query, block) pair sends the query to the block, and every
# chunk reads the block again, so what is shuffled falls with this size.
BLOCK_ROWS = 16_384
# By default there are up to so many lists, and more only when lists would outgrow a block.
FEW_LISTS = 64
# Rows of a block that are scored at once.
TILE_ROWS = 1_024
# Pairs that leave a Python task at once: a tile of queries may open every list.
PAIR_ROWS = 50_000
# What sums of doubles may lose, so that a bound never closes a ring too early.
SLACK = 1e-9
SEED = 42
PLACE = ["_list", "_block", "_salt"]


@dataclass(frozen=True)
class Lists:
    """Stored blocks of rows, their figures, and what queries need to know of each list."""

    rows: DataFrame  # _list, _block, item keys, _x
    blocks: DataFrame  # _list, _block, _salt, and of the ring _salts, _near, _far, _norm
    centres: np.ndarray
    sizes: np.ndarray  # rows of each list
    far: np.ndarray  # largest distance from the centre
    near: np.ndarray  # smallest
    norm: np.ndarray  # largest length of a vector
    block: np.ndarray  # mean rows of a block
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Found:
    """Result rows, the (query, block) pairs that were scanned, and the number of all pairs."""

    rows: DataFrame
    opened: DataFrame
    queries: DataFrame
    blocks: DataFrame

    def opened_share(self) -> float:
        """Scanned pairs as a share of all; reads the tables."""
        every = self.queries.count() * self.blocks.count()
        return self.opened.count() / every if every else 0.0


def default_lists(rows: int) -> int:
    return max(1, min(math.isqrt(rows), FEW_LISTS), math.ceil(rows / BLOCK_ROWS))


def fit_centres(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """``count`` centres by plain k-means over the rows of a sample."""
    centres = np.unique(x[:count], axis=0)
    for _ in range(rounds):
        own = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def ring_borders(x: np.ndarray, centres: np.ndarray, rows: int, block_rows: int) -> list[np.ndarray]:
    """For each centre the distances at which its list is cut, so that a ring has about ``block_rows`` of all ``rows``."""
    d = _distances(x, centres)
    own, near = d.argmin(axis=1), d.min(axis=1)
    out = []
    for i in range(len(centres)):
        mine = np.sort(near[own == i])
        parts = max(1, math.ceil(len(mine) * rows / len(x) / block_rows))
        out.append(np.unique(np.quantile(mine, np.arange(1, parts) / parts)) if parts > 1 else np.empty(0))
    return out


def _distances(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (q * q).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (q @ centres.T)
    return np.sqrt(np.maximum(square, 0.0))


def build(
    items: DataFrame, key: str | list[str], vector: str = "embedding", lists: int | None = None,
    sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
) -> Lists:
    """Deal all rows with a vector into lists; by default the root of their number or ``FEW_LISTS``, more for many blocks."""
    keys = names(key)
    items = materialise(items.select(*keys, as_double(F.col(vector)).alias("_x")).where("_x is not null"), "items")
    n = items.count()
    order = seeded_hash(SEED, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    sample = items.select(order.alias("_h"), "_x").orderBy("_h").limit(sample_rows).toPandas()
    x = matrix(sample["_x"]) if len(sample) else np.zeros((0, 0))
    centres = fit_centres(x, min(MAX_CENTRES, lists or default_lists(n))) if len(x) else x
    borders = ring_borders(x, centres, n, block_rows) if n else []

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile in tiles(pdf, len(centres)):
                x = matrix(tile["_x"])
                own = _distances(x, centres).argmin(axis=1)
                # The distance is taken again from the difference: rounding must not close a ring.
                apart = np.sqrt(((x - centres[own]) ** 2).sum(axis=1))
                ring = np.zeros(len(x), np.int32)
                for i in np.unique(own):
                    ring[own == i] = np.searchsorted(borders[i], apart[own == i], side="right")
                yield tile.assign(_list=own.astype(np.int32), _block=ring, _apart=apart, _length=np.sqrt((x * x).sum(axis=1)))

    made = [("_list", T.IntegerType()), ("_block", T.IntegerType()), ("_apart", T.DoubleType()), ("_length", T.DoubleType())]
    fields = [*items.schema.fields, *[T.StructField(c, k) for c, k in made]]
    dealt = items.mapInPandas(deal, T.StructType(fields)) if n else items.selectExpr("*", *[f"cast(0 as {k.simpleString()}) as {c}" for c, k in made])
    rows = materialise(dealt, "lists")
    rings = rows.groupBy("_list", "_block").agg(
        F.min("_apart").alias("_near"), F.max("_apart").alias("_far"), F.max("_length").alias("_norm"), F.count(F.lit(1)).alias("_n")
    )
    rings = materialise(rings.withColumn("_salts", F.ceil(F.col("_n") / (2 * block_rows)).cast("int")), "rings")
    whole = {
        r["_list"]: r
        for r in rings.groupBy("_list").agg(F.min("_near").alias("_near"), F.max("_far").alias("_far"), F.max("_norm").alias("_norm"), F.sum("_n").alias("_n"), (F.sum("_n") / F.sum("_salts")).alias("_mean")).collect()
    }
    column = lambda name: np.array([whole[i][name] if i in whole else 0 for i in range(len(centres))], np.float64)
    blocks = rings.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_n")
    return Lists(rows, blocks, centres, column("_n"), column("_far"), column("_near"), column("_norm"), column("_mean"), tuple(keys))


def _choose(lists: Lists, q: np.ndarray, tau: np.ndarray | None, k: int, probes: int | None, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(chosen [query, list], distance or product to the centre [query, list])."""
    c = lists.centres
    value = _distances(q, c) if metric == "l2" else q @ c.T
    filled = lists.sizes > 0
    if tau is not None:
        return _reachable(value, np.sqrt((q * q).sum(1))[:, None], lists.near, lists.far, lists.norm, tau[:, None], metric) & filled, value
    # Lists from the most to the least promising; empty ones last.
    rank = np.where(filled, value if metric == "l2" else -value, np.inf)
    order = np.argsort(rank, axis=1, kind="stable")
    if probes is not None:
        wanted = np.arange(c.shape[0])[None, :] < probes
    else:
        held = lists.block[order]  # one block of each list is scanned
        wanted = np.cumsum(held, axis=1) - held < k
    chosen = np.zeros_like(value, bool)
    np.put_along_axis(chosen, order, np.broadcast_to(wanted, order.shape), axis=1)
    return chosen & filled, value


def _reachable(value, length, near, far, norm, tau, metric):
    """Whether a ring can hold a row at least as good as ``tau``; numbers, arrays or columns."""
    slack = SLACK * (1 + (abs(tau) if isinstance(tau, np.ndarray) else F.abs(tau)))
    if metric == "l2":
        return (value - far <= tau + slack) & (near - value <= tau + slack)
    return (value + length * far >= tau - slack) & (length * norm >= tau - slack)


def _meet(queries: DataFrame, lists: Lists, keys: list[str], k: int, probes: int | None, metric: str) -> DataFrame:
    """Queries, by key and id, with each list they choose: adds _list, _value (to the centre) and _length.

    The vectors stay behind; the scan fetches them by id.
    """
    bounded = "_tau" in queries.columns
    kept = [c for c in queries.columns if c != "_q"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile in tiles(pdf, len(lists_only.centres)):
                q = matrix(tile["_q"])
                tau = tile["_tau"].to_numpy(np.float64) if bounded else None
                chosen, value = _choose(lists_only, q, tau, k, probes, metric)
                length, plain = np.sqrt((q * q).sum(axis=1)), tile[kept]
                rows, lists_at = np.nonzero(chosen)
                for start in range(0, len(rows), PAIR_ROWS):
                    row, at = rows[start : start + PAIR_ROWS], lists_at[start : start + PAIR_ROWS]
                    out = plain.iloc[row].reset_index(drop=True)
                    yield out.assign(_list=at.astype(np.int32), _value=value[row, at], _length=length[row])

    # Tasks get the figures of the lists, not the tables.
    lists_only = Lists(None, None, lists.centres, lists.sizes, lists.far, lists.near, lists.norm, lists.block, lists.keys)
    extra = [T.StructField("_list", T.IntegerType()), T.StructField("_value", T.DoubleType()), T.StructField("_length", T.DoubleType())]
    return queries.mapInPandas(choose, T.StructType([*queries.select(*kept).schema.fields, *extra]))


def _order(rows: np.ndarray, items: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest scores of each row, ties to the smaller item, row by row."""
    order = np.lexsort((items, score, rows))
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return order[rank < k]


def best_of_block(q: np.ndarray, x: np.ndarray, k: int, metric: str, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, dot, distance) of the best ``k`` rows of a block for each query that are no worse than its ``tau``.

    Scores that agree to 12 digits are ties, which go to the earlier row. The block is scored in tiles. A tile is
    never sorted: of its scores only those leave it that reach what the query's k-th best has been so far.
    """
    q2, x2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    far = lambda r, c, dot: np.sqrt(np.maximum(q2[r] + x2[c] - 2.0 * dot, 0.0))
    # Both metrics as values of which the largest is best: the product, or twice the product without the row's square.
    lower = lambda v: v - SLACK * (1 + np.abs(v) + (q2 if metric == "l2" else 0))
    odd = not (np.isfinite(q2).all() and np.isfinite(x2).all())
    bound = lower(q2 - tau * tau if metric == "l2" else tau)
    hits, held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    for start in range(0, len(x), TILE_ROWS):
        side = x[start : start + TILE_ROWS]
        dots = q @ side.T
        value = 2.0 * dots - x2[start : start + TILE_ROWS] if metric == "l2" else dots
        if odd:  # scores that are no numbers come last
            value = np.where(np.isnan(value), -np.inf, value)
        if not start and len(side) > k:
            bound = np.maximum(bound, lower(np.partition(value, len(side) - k, axis=1)[:, len(side) - k]))
        r, c = np.nonzero(value >= bound[:, None])
        hits.append((r, c + start, dots[r, c]))
        held += len(r)
        if held > 4 * k * len(q) or start + TILE_ROWS >= len(x):
            r, c, dot = (np.concatenate(part) for part in zip(*hits))
            kept = _order(r, c, np.round(far(r, c, dot) if metric == "l2" else -dot, 12), k)
            r, c, dot = r[kept], c[kept], dot[kept]
            hits, held = [(r, c, dot)], len(r)
            full = np.bincount(r, minlength=len(q)) == k
            worst, own = np.full(len(q), np.inf), 2.0 * dot - x2[c] if metric == "l2" else dot
            np.minimum.at(worst, r, np.where(np.isnan(own), -np.inf, own))
            worst = np.where(full, worst, -np.inf)
            # Of products, a later row must beat the k-th best in the twelfth digit; doubles of this size show it.
            beats = (metric == "dot") & (np.abs(worst) < 100)
            bound = np.maximum(bound, np.where(beats, np.round(np.where(beats, worst, 0.0), 12) + 4e-13, lower(worst)))
    r, c, dot = hits[0] if held else (np.concatenate(part) for part in zip(*hits))
    return r, c, dot, far(r, c, dot)


def _scan(pairs: DataFrame, asked: DataFrame, lists: Lists, keys: list[str], k: int, metric: str) -> DataFrame:
    """The best ``k`` rows of each (query, block) pair; ``pairs`` has _id and the place, ``asked`` the keys, _id and _q.

    With ``_tau`` in ``pairs``, rows worse than that score are left out.
    """
    items, tau = list(lists.keys), [c for c in pairs.columns if c == "_tau"]
    matches = match_schema(asked, keys, lists.rows, items)
    schema = T.StructType([f for f in matches if f.name not in ("pos", "next_l2", "exp_sum")])
    load = pairs.groupBy(*PLACE).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_chunks"))
    chunk = F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int").alias("_chunk")
    asked = pairs.select("_id", *PLACE, *tau).join(load, PLACE).select("_id", *PLACE, *tau, chunk).join(asked, "_id").drop("_id")
    salts = lists.blocks.where("_salt = 0").select("_list", "_block", "_salts")
    salted = lists.rows.join(salts, ["_list", "_block"]).withColumn("_salt", F.pmod(F.xxhash64(*items), F.col("_salts")).cast("int"))
    held = salted.join(load, PLACE).select(*PLACE, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), *items, "_x")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.fieldNames())
        right = right.sort_values(items, kind="stable").reset_index(drop=True)
        x = matrix(right["_x"])
        length, out = np.sqrt(np.einsum("ij,ij->i", x, x)), []
        for tile in tiles(left, min(len(right), TILE_ROWS)):
            q = matrix(tile["_q"])
            worst = tile["_tau"].to_numpy(np.float64) if tau else np.full(len(q), np.inf if metric == "l2" else -np.inf)
            rows, at, dot, apart = best_of_block(q, x, k, metric, worst)
            found = {c: tile[c].to_numpy()[rows] for c in keys} | {f"item_{c}": right[c].to_numpy()[at] for c in items}
            norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", q, q))[rows] * length[at], 1e-8)
            out.append(pd.DataFrame(found | {"l2_distance": apart, "dot": dot, "cosine": dot / norms}))
        return pd.concat(out)

    by = [*PLACE, "_chunk"]
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(score, schema)


def _best(found: DataFrame, keys: list[str], items: list[str], k: int, metric: str) -> DataFrame:
    lead = F.round("l2_distance", 12).asc() if metric == "l2" else F.round("dot", 12).desc()
    order = [lead, *[F.col(f"item_{c}") for c in items]]
    return top_per_group(found, keys, order, k, "pos")


def nearest(
    queries: DataFrame, lists: Lists, k: int, key: str | list[str], vector: str = "embedding", metric: str = "l2", probes: int | None = None
) -> Found:
    """The ``k`` best rows of each query: item keys, pos, l2_distance, dot and cosine.

    ``metric`` is "l2" or "dot". Scores that agree to 12 digits are ties, which go to the smaller item
    key. ``probes`` scans so many lists for each query (approximate unless it covers all); None is
    exact. Queries and rows without a vector take no part; fewer than ``k`` rows give what there is.
    """
    keys, items = names(key), list(lists.keys)
    wanted = queries.select(*keys, as_double(F.col(vector)).alias("_q")).where("_q is not null")
    asked = materialise(wanted.withColumn("_id", F.monotonically_increasing_id()), "asked")
    if not len(lists.centres):
        nothing = asked.sparkSession.createDataFrame([], match_schema(asked, keys, lists.rows, items)).drop("pos", "next_l2", "exp_sum")
        return Found(_best(nothing, keys, items, k, metric), asked.limit(0), asked, lists.blocks)
    chosen = _meet(asked, lists, keys, k, probes, metric)
    blocks = lists.blocks
    if probes is not None:
        pairs = materialise(chosen.join(blocks.select(*PLACE), "_list").select(*keys, "_id", *PLACE), "pairs")
        return Found(_best(_scan(pairs, asked, lists, keys, k, metric), keys, items, k, metric), pairs, asked, blocks)
    # One ring of each chosen list: the one that the query lies in, or next to.
    gap = F.greatest(F.col("_near") - F.col("_value"), F.col("_value") - F.col("_far"), F.lit(0.0)) if metric == "l2" else F.col("_far")
    ring = chosen.join(blocks, "_list").groupBy(*keys, "_id", "_list").agg(F.min(F.struct(gap.alias("gap"), "_block", "_salt")).alias("at"))
    first = materialise(ring.select(*keys, "_id", "_list", "at._block", "at._salt"), "pairs")
    seeds = materialise(_scan(first, asked, lists, keys, k, metric), "seeds")
    worst = F.max(F.round("l2_distance", 12)) if metric == "l2" else F.min(F.round("dot", 12))
    open_end = float("inf") if metric == "l2" else float("-inf")
    bound = _best(seeds, keys, items, k, metric).groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= k, worst).otherwise(open_end).alias("_tau"))
    bounded = asked.join(bound, keys)
    reach = _reachable(F.col("_value"), F.col("_length"), F.col("_near"), F.col("_far"), F.col("_norm"), F.col("_tau"), metric)
    able = _meet(bounded, lists, keys, k, None, metric).join(blocks, "_list").where(reach)
    rest = able.join(first.select("_id", *PLACE), ["_id", *PLACE], "left_anti")
    pairs = materialise(rest.select(*keys, "_id", *PLACE, "_tau"), "pairs")
    found = seeds.unionByName(_scan(pairs, asked, lists, keys, k, metric))
    return Found(_best(found, keys, items, k, metric), first.unionByName(pairs.drop("_tau")), asked, blocks)
