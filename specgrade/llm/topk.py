"""Exact top-k inner products over norm buckets.

The vectors are dealt into buckets by length, longest first. Queries are grouped in blocks, and a block meets a bucket
in one task. The buckets of the longest vectors give each query a first threshold: the k-th score
among them. For any other bucket the threshold and the lengths give a local cosine threshold. Above 1
the bucket is skipped for the query. If it is high, coordinates prune: the product over the query's heaviest
coordinates, and the lengths of the remainders, bound the rest (Cauchy-Schwarz). Else lengths prune: only
vectors long enough to reach the threshold are candidates. Every candidate is verified by its exact product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from specgrade.session import materialise

BUCKET_ROWS, QUERY_ROWS = 8_192, 2_048
# Local cosine thresholds from which coordinates are tried, and the coordinates tried.
COORDINATES_FROM, FOCUS = 0.3, 16
_BLOCK = 256


def whole_vector(column: str, scale: int) -> Column:
    """The components times ``scale``, rounded down, as longs; null if any is null or not finite."""
    x = F.col(f"`{column}`")
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(ok, F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the lists, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    values = column.flatten().to_numpy()
    if len(values):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _keep_best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((uids[near], ids[near], -scores[near]))][:k]


def search_bucket(
    queries: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of the k best vectors of a bucket that reach the query's floor.

    ``vectors`` are sorted by length, longest first. ``own`` holds the rows of the queries, which are not
    candidates; ``floor`` their thresholds (least integer: none).
    """
    top = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(vectors).max(initial=0)), 1) * max(vectors.shape[1], 1)
    if top >= 2**63:
        raise ValueError("products beyond 64-bit integers")
    kind = np.float64 if top < 2**53 else np.int64  # float products of integers below 2**53 are exact
    v, q = vectors.astype(kind), queries.astype(kind)
    v_len = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    q_len = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    # Bounds are compared with a little room for rounding.
    room = 1 - 1e-9
    bounded = floor > np.iinfo(np.int64).min
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bounded & (floor > 0), floor * room / np.maximum(q_len * v_len[0], 1e-300), -np.inf)
    heavy = v.shape[1] > 2 * FOCUS
    for start in range(0, len(q), _BLOCK):
        chosen = np.flatnonzero(local[start : start + _BLOCK] <= 1) + start
        if not len(chosen):
            continue
        coordinate = chosen[local[chosen] >= COORDINATES_FROM] if heavy else chosen[:0]
        for i in coordinate:
            reach = int(np.searchsorted(-v_len, -(floor[i] * room / q_len[i]), side="right"))
            focus = np.argpartition(-np.abs(q[i]), FOCUS)[:FOCUS]
            part = v[:reach, focus]
            seen = part @ q[i, focus]
            rest_q = math.sqrt(max(0.0, q_len[i] ** 2 - float((q[i, focus].astype(np.float64) ** 2).sum())))
            rest_v = np.sqrt(np.maximum(0.0, v_len[:reach] ** 2 - (part.astype(np.float64) ** 2).sum(axis=1)))
            left = np.flatnonzero(seen + rest_q * rest_v * (1 + 1e-9) + 1e-6 >= floor[i])
            scores = (v[left] @ q[i]).astype(np.int64)
            good = (scores >= floor[i]) & (uids[left] != own[i])
            left, scores = left[good], scores[good]
            best = _keep_best(scores, ids[left], uids[left], k)
            yield int(i), left[best], scores[best]
        by_length = np.setdiff1d(chosen, coordinate, assume_unique=True)
        if len(by_length):
            least = floor[by_length] * room / np.maximum(q_len[by_length], 1e-300)
            reach = np.where(local[by_length] > -np.inf, np.searchsorted(-v_len, -least, side="right"), len(v))
            products = q[by_length] @ v[: reach.max()].T
            for row, i, n in zip(products, by_length, reach):
                scores = row[:n].astype(np.int64)
                left = np.flatnonzero((scores >= floor[i]) & (uids[:n] != own[i]))
                best = _keep_best(scores[left], ids[left], uids[left], k)
                yield int(i), left[best], scores[left[best]]


_FOUND = "query_uid long, vec_uid long, vec_id long, score long"


def _meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Best candidates for the queries of a block in a bucket, for all pairs of both that meet."""

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        columns = [np.empty(0, np.int64)] * 4
        if asked.num_rows and held.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (asked, held))
            v = _matrix(held.column("v"), width)
            order = np.argsort(-held.column("len2").to_numpy(), kind="stable")
            v, ids, uids = v[order], held.column("vec_id").to_numpy()[order], held.column("uid").to_numpy()[order]
            floor = asked.column("floor").to_numpy()
            own = asked.column("uid").to_numpy()
            found = list(search_bucket(_matrix(asked.column("v"), width), own, floor, v, ids, uids, k))
            if found:
                sizes = [len(p) for _, p, _ in found]
                places = np.concatenate([p for _, p, _ in found])
                columns = [np.repeat(own[[i for i, _, _ in found]], sizes), uids[places], ids[places], np.concatenate([s for _, _, s in found])]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_uid", "vec_uid", "vec_id", "score"), columns)})

    return queries.groupBy("bucket", "block").cogroup(vectors.groupBy("bucket", "block")).applyInArrow(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "vec_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding", scale: int = 64,
    bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row, without its own row.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part, nor
    do rows without an id. A shorter vector counts as filled up with zeros. Repeated rows are rows of
    their own: each is a query, and each is a candidate of the others. Fewer candidates than ``k``: all of
    them. Other columns are ignored. No vectors: no rows.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), is_query.alias("is_query"), whole_vector(column, scale).alias("v"))
    rows = rows.where("v is not null and vec_id is not null").withColumn("uid", F.monotonically_increasing_id())
    # Double lengths only order the buckets; scores do not depend on them.
    rows = materialise(rows.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    buckets, blocks = max(1, math.ceil(n / bucket_rows)), max(1, math.ceil(asked / query_rows))
    numbered = rows.repartitionByRange(buckets, F.desc("len2"), "uid").withColumn("bucket", F.spark_partition_id())
    dealt = materialise(numbered.select("uid", "vec_id", "v", "len2", "bucket"), "buckets")
    queries = rows.where("is_query").select("uid", F.col("vec_id").alias("query_id"), "v", "len2").withColumn(
        "block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    )
    replicated = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = queries.withColumn("bucket", F.lit(0)).withColumn("floor", F.lit(-(2**63)).cast("long"))
    head = materialise(_best(_meet(first, replicated.where("bucket = 0"), k), k).drop("rank"), "first")
    # The k-th score of the first bucket; none if it has fewer candidates.
    floors = head.groupBy("query_uid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-(2**63))).cast("long").alias("floor"))
    lengths = dealt.where("bucket > 0").groupBy("bucket").agg(F.max("len2").alias("longest"))
    known = queries.join(floors.withColumnRenamed("query_uid", "uid"), "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(-(2**63)).cast("long")))
    reachable = (F.col("floor") <= 0) | (F.col("floor") * (1 - 1e-9) <= F.sqrt(F.col("len2") * F.col("longest")))
    spread_out = (
        known.withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(buckets - 1)))) if buckets > 1 else known.withColumn("bucket", F.lit(0)).where(F.lit(False))
    )
    others = spread_out.join(lengths, "bucket").where(reachable).select("uid", "query_id", "v", "len2", "block", "bucket", "floor")
    rest = _meet(others, replicated.where("bucket > 0"), k)
    names = queries.select(F.col("uid").alias("query_uid"), "query_id")
    return _best(head.unionByName(rest), k).join(names, "query_uid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
