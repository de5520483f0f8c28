"""Nearest-centroid classification of embedding tables.

Scoring has two exact paths. A model whose size was checked is shipped to the tasks once and
applied as a block product per Arrow batch. A larger one is cut into hash blocks; query
blocks meet item blocks by an equi-join on the block pair and only the best ``k`` rows per
query leave each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from specgrade.functions.columns import names
from specgrade.functions.vectors import as_double, l2_normalize, mean_vector, subtract
from specgrade.operators.ranking import exact_percentile
from specgrade.session import materialise

# A model whose vectors take up to this many bytes is shipped to the tasks.
SHIP_BYTES = 64 << 20
BLOCK_ROWS = 4096
# Scores that are held at once: 2 MB for each of the ten or so arrays of them, so that a worker stays small.
TILE_SCORES = 250_000


def pool(images: DataFrame, group: str | list[str], vector: str = "embedding") -> DataFrame:
    """Mean image vector per specimen, normalised again, with the image count."""
    return images.groupBy(*names(group)).agg(
        l2_normalize(mean_vector(F.col(vector))).alias(vector),
        F.count(F.lit(1)).alias("num_images"),
    )


def majority_label(images: DataFrame, group: str | list[str], label: str, pos: str) -> DataFrame:
    """Most frequent label per group, first seen on ties, and whether labels were mixed."""
    group = names(group)
    counts = images.groupBy(*group, label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first")
    )
    return counts.groupBy(*group).agg(
        F.max_by(label, F.struct("_n", -F.col("_first"))).alias(label),
        (F.count(F.lit(1)) > 1).alias("mixed_labels"),
    )


def global_mean(support: DataFrame, by: str | list[str] = (), vector: str = "embedding") -> DataFrame:
    """Mean support vector per model (``by``)."""
    return support.groupBy(*names(by)).agg(mean_vector(F.col(vector)).alias("center"))


def center(df: DataFrame, means: DataFrame, by: str | list[str] = (), vector: str = "embedding") -> DataFrame:
    """Subtract the model mean and normalise."""
    by = names(by)
    joined = df.join(means, by) if by else df.withColumn("center", means.scalar())
    moved = subtract(F.col(vector), F.col("center"))
    return joined.withColumn(vector, l2_normalize(moved)).drop("center")


def centered_centroids(
    support: DataFrame, label: str = "label", by: str | list[str] = (), vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """Fit: (mean per model, centroid per model and class). Centroids keep their length."""
    by = names(by)
    means = global_mean(support, by, vector)
    fitted = center(support, means, by, vector).groupBy(*by, label).agg(
        mean_vector(F.col(vector)).alias("centroid"), F.count(F.lit(1)).alias("n_support")
    )
    return means, fitted


def unit_centroids(
    support: DataFrame, label: str = "label", by: str | list[str] = (), vector: str = "embedding"
) -> DataFrame:
    """Fit without centring: normalised mean of normalised vectors per class."""
    return (
        support.withColumn(vector, l2_normalize(F.col(vector)))
        .groupBy(*names(by), label)
        .agg(
            l2_normalize(mean_vector(F.col(vector))).alias("centroid"),
            F.count(F.lit(1)).alias("n_support"),
        )
    )


def match_schema(queries: DataFrame, query_keys: list[str], items: DataFrame, item_keys: list[str]) -> T.StructType:
    measures = ("l2_distance", "next_l2", "dot", "cosine", "exp_sum")
    return T.StructType(
        [queries.schema[k] for k in query_keys]
        + [T.StructField(f"item_{k}", items.schema[k].dataType) for k in item_keys]
        + [T.StructField("pos", T.IntegerType())]
        + [T.StructField(m, T.DoubleType()) for m in measures]
    )


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def score_block(
    pdf: pd.DataFrame, query_keys: list[str], items: pd.DataFrame, item_keys: list[str], x: np.ndarray, k: int, metric: str
) -> pd.DataFrame:
    """First ``k`` items per query row, in (score, item order)."""
    q = matrix(pdf["_q"])
    dots = q @ x.T
    q2 = np.einsum("ij,ij->i", q, q)[:, None]
    x2 = np.einsum("ij,ij->i", x, x)[None, :]
    dist = np.sqrt(np.maximum(q2 + x2 - 2.0 * dots, 0.0))
    score = np.round(dist if metric == "l2" else -dots, 12)
    depth = min(k + 1, x.shape[0])
    if depth < x.shape[0]:
        # Keep everything up to the last wanted value, ties included, then sort stably.
        last = np.partition(score, depth - 1, axis=1)[:, depth - 1 : depth]
        score = np.where(score <= last, score, np.inf)
    order = np.argsort(score, axis=1, kind="stable")[:, :depth]
    near = np.take_along_axis(dist, order, axis=1)
    after = np.full_like(near, np.nan)
    after[:, :-1] = near[:, 1:]
    kk = min(k, depth)
    n = len(pdf)
    rows, flat = np.repeat(np.arange(n), kk), order[:, :kk].ravel()
    norms = np.maximum(np.sqrt(q2) * np.sqrt(x2), 1e-8)
    out = {key: pdf[key].to_numpy()[rows] for key in query_keys}
    out |= {f"item_{key}": items[key].to_numpy()[flat] for key in item_keys}
    out["pos"] = np.tile(np.arange(1, kk + 1, dtype=np.int32), n)
    out["l2_distance"] = near[:, :kk].ravel()
    out["next_l2"] = after[:, :kk].ravel()
    out["dot"] = dots[rows, flat]
    out["cosine"] = dots[rows, flat] / norms[rows, flat]
    out["exp_sum"] = np.exp(-dist).sum(axis=1)[rows]
    return pd.DataFrame(out)


def nearest_items(
    queries: DataFrame,
    items: DataFrame,
    k: int | None,
    query_keys: str | list[str],
    item_keys: str | list[str],
    by: str | list[str] = (),
    query_vector: str = "embedding",
    item_vector: str = "centroid",
    metric: str = "l2",
    ship_bytes: int = SHIP_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest items per query with L2 distance, dot product and cosine.

    ``by`` names columns of both sides that must be equal (one model per value). ``exp_sum``
    is the sum of exp(-distance) over all items of the model of the query.
    ``k`` is clamped to the number of items, and ``None`` asks for all of them. Ties go to the
    smaller item key.
    """
    by, item_keys = names(by), names(item_keys)
    keys = [*by, *[c for c in names(query_keys) if c not in by]]
    # The model is stored, so that it is fitted once however often it is read.
    items = materialise(items.select(*by, *item_keys, as_double(F.col(item_vector)).alias("_x")), "model")
    queries = queries.select(*keys, as_double(F.col(query_vector)).alias("_q"))
    schema = match_schema(queries, keys, items, item_keys)
    # Width times rows bounds the bytes before anything is fetched; the vectors are as wide as the widest.
    rows, width = items.agg(F.count(F.lit(1)), F.max(F.size("_x"))).first()
    if rows * (width or 0) * 8 <= ship_bytes:
        return _shipped(queries, items.toPandas(), keys, item_keys, by, k or max(1, rows), metric, schema)
    return _blocked(queries, items, keys, item_keys, by, k or rows, metric, schema, block_rows)


def _split(pdf: pd.DataFrame, by: list[str]) -> dict:
    """Pieces of a batch by model; the key is always a tuple."""
    if not by:
        return {(): pdf}
    return {k if isinstance(k, tuple) else (k,): part for k, part in pdf.groupby(by, sort=False)}


def tiles(queries: pd.DataFrame, items: int) -> Iterator[pd.DataFrame]:
    """Runs of queries whose scores against all items fill a bounded array."""
    rows = max(1, TILE_SCORES // max(1, items))
    for start in range(0, len(queries), rows):
        yield queries.iloc[start : start + rows]


def _shipped(queries, model, keys, item_keys, by, k, metric, schema) -> DataFrame:
    """Score against a model whose size was checked: no shuffle at all."""
    model = model.sort_values(by + item_keys, kind="stable")
    parts = {
        key: (part[item_keys].reset_index(drop=True), matrix(part["_x"]))
        for key, part in _split(model, by).items()
        if len(part)
    }
    shared = queries.sparkSession.sparkContext.broadcast(parts)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, piece in _split(pdf, by).items():
                if key in shared.value and len(piece):
                    found, x = shared.value[key]
                    for tile in tiles(piece, len(found)):
                        yield score_block(tile, keys, found, item_keys, x, k, metric)

    return queries.mapInPandas(score, schema)


def _blocked(queries, items, keys, item_keys, by, k, metric, schema, block_rows) -> DataFrame:
    """Score a model of any size: query blocks meet item blocks on the block pair."""
    item_blocks = max(1, -(-items.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // block_rows))

    def block(columns: list[str], count: int) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    q = queries.withColumn("_qb", block(keys, query_blocks)).withColumn("_xb", every(item_blocks))
    # New column identities: both sides may come from one table.
    items = items.select(*[F.col(c).alias(c) for c in items.columns])
    x = items.withColumn("_xb", block(by + item_keys, item_blocks)).withColumn("_qb", every(query_blocks))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = _split(right, by)
        found = []
        for key, piece in _split(left, by).items():
            side = sides.get(key)
            if side is not None and len(side) and len(piece):
                side = side.sort_values(item_keys, kind="stable").reset_index(drop=True)
                x = matrix(side["_x"])
                found += [score_block(tile, keys, side, item_keys, x, k + 1, metric) for tile in tiles(piece, len(side))]
        return pd.concat(found) if found else pd.DataFrame(columns=schema.fieldNames())

    # Blocks of different models never meet.
    pairs = q.groupBy(*by, "_qb", "_xb").cogroup(x.groupBy(*by, "_qb", "_xb")).applyInPandas(score, schema)
    lead = F.round("l2_distance", 12).asc() if metric == "l2" else F.round("dot", 12).desc()
    # A query has at most (k + 1) rows per item block here.
    ranked = W.partitionBy(*keys).orderBy(lead, *[F.col(f"item_{c}") for c in item_keys])
    # Every row of a block pair carries the sum of its block: add the first one of each.
    total = F.sum(F.when(F.col("pos") == 1, F.col("exp_sum"))).over(W.partitionBy(*keys))
    merged = pairs.select(
        *keys,
        *[f"item_{c}" for c in item_keys],
        F.row_number().over(ranked).alias("pos"),
        "l2_distance",
        F.lead("l2_distance").over(ranked).alias("next_l2"),
        "dot",
        "cosine",
        total.alias("exp_sum"),
    )
    return merged.where(F.col("pos") <= k)


def classify(
    queries: DataFrame,
    centroids: DataFrame,
    query_keys: str | list[str],
    label: str = "label",
    by: str | list[str] = (),
    top_k: int | None = 5,
    vector: str = "embedding",
    metric: str = "l2",
    **options,
) -> DataFrame:
    """Ranked classes per query: label, softmax share of exp(-distance), L2 and cosine.

    ``margin``, on the first row, is its share minus that of the second; 1.0 with one class.
    """
    found = nearest_items(
        queries, centroids, top_k, query_keys, label, by, vector, "centroid", metric, **options
    )
    keys = [*names(by), *[c for c in names(query_keys) if c not in names(by)]]
    mass = F.col("exp_sum")
    gap = F.exp(-F.col("l2_distance")) - F.exp(-F.col("next_l2"))
    return found.select(
        *keys,
        F.col("pos").alias("rank_position"),
        F.col(f"item_{label}").alias("rank_value"),
        (F.exp(-F.col("l2_distance")) / mass).alias("softmax_score"),
        "l2_distance",
        F.col("cosine").alias("cosine_similarity"),
        F.when(F.col("pos") == 1, F.coalesce(gap / mass, F.lit(1.0))).alias("margin"),
    )


def calibrate_thresholds(
    top1: DataFrame, truth: str, predicted: str = "rank_value", rank: str = "rank", percentile: float = 95.0
) -> DataFrame:
    """Per rank, a percentile of the top-1 distance over correct rows; infinity when none."""
    right = F.when(F.col(predicted) == F.col(truth), F.col("l2_distance"))
    rows = top1.select(rank, right.alias("_d"))
    out = exact_percentile(rows, rank, {"threshold": ("_d", percentile / 100.0)})
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))


def distance_gate(top1: DataFrame, thresholds: DataFrame, rank: str = "rank") -> DataFrame:
    """Flag top-1 rows farther than the threshold of their rank."""
    inside = F.col("l2_distance") <= F.col("threshold")
    return top1.join(thresholds, rank).select(
        *top1.columns,
        inside.alias("in_distribution"),
        F.when(~inside, F.concat(F.col(rank), F.lit("_distance_exceeds_threshold"))).alias("flag"),
    )


def hierarchy_consistency(
    top1: DataFrame, parents: DataFrame, key: str, rank: str = "rank", value: str = "rank_value"
) -> DataFrame:
    """Whether the predicted genus and species belong to the predicted parents.

    ``parents`` holds (child_rank, child, parent_rank, parent). An unknown child agrees.
    """
    wide = top1.groupBy(key).pivot(rank, ["family", "genus", "species"]).agg(F.first(value))
    out = wide
    checks = (("genus", "family"), ("species", "genus"), ("species", "family"))
    notes = []
    for child, parent in checks:
        link = parents.where((F.col("child_rank") == child) & (F.col("parent_rank") == parent)).select(
            F.col("child").alias(child), F.col("parent").alias(f"_{child}_{parent}")
        )
        out = out.join(link, child, "left")
        expected = F.col(f"_{child}_{parent}")
        agree = F.coalesce(expected == F.col(parent), F.lit(True))
        both = F.col(child).isNotNull() & F.col(parent).isNotNull()
        out = out.withColumn(f"{parent}_{child}_agree" if child == "genus" else f"species_{parent}_agree", F.when(both, agree))
        note = F.format_string(
            f"{child.title()} '%s' belongs to {parent} '%s', but {parent} classifier predicted '%s'",
            F.col(child).cast("string"), expected.cast("string"), F.col(parent).cast("string"),
        )
        notes.append(F.when(both & ~agree, note))
    flags = ["family_genus_agree", "species_genus_agree", "species_family_agree"]
    consistent = F.lit(True)
    for f in flags:
        consistent = consistent & F.coalesce(F.col(f), F.lit(True))
    return out.select(
        key, "family", "genus", "species", *flags,
        consistent.alias("consistent"),
        F.filter(F.array(*notes), lambda n: n.isNotNull()).alias("notes"),
    )


def train_set_mismatch(splits: DataFrame, key: str, rank: str, part: str = "split_part") -> DataFrame:
    """Rows that train some ranks but not all of them, per rank that lacks them."""
    train = splits.where(F.col(part) == "train").select(rank, key)
    n_ranks = splits.select(rank).distinct().count()
    partial = train.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_ranks"), F.sort_array(F.collect_set(rank)).alias("ranks")
    )
    return partial.where(F.col("n_ranks") < n_ranks)
