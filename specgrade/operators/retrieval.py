"""Vector search over description tables and its cross-check with class predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions.columns import names, not_blank, ratio0, require_columns
from specgrade.functions.vectors import l2_normalize
from specgrade.operators.ranking import top_per_group
from specgrade.operators.vectorlists import Lists, build, nearest

# Signal thresholds and cut-offs.
STRONG_SCORE, STRONG_SHARE = 0.5, 0.3
RECALL_CUTS = (1, 3, 5, 10, 20)


def search_table(descriptions: DataFrame, taxon: str, rank: str, description: str, vector: str | None = None) -> DataFrame:
    """Descriptions with text, one row each; vectors are normalised when given."""
    require_columns(descriptions, [taxon, rank, description], "descriptions")
    rows = descriptions.where(not_blank(F.col(description)))
    extra = [l2_normalize(F.col(vector)).alias("embedding")] if vector else []
    return rows.select(F.col(taxon).alias("taxon"), F.col(rank).alias("rank"), F.col(description).alias("description"), *extra)


def search(
    queries: DataFrame,
    index: DataFrame | Lists,
    query_key: str | list[str],
    index_key: str | list[str],
    top_k: int = 10,
    min_similarity: float = 0.0,
    query_vector: str = "embedding",
    index_vector: str = "embedding",
    probes: int | None = None,
) -> DataFrame:
    """Inner-product search: query keys, item keys, pos and score.

    The minimum similarity applies after the cut at ``top_k``. ``index`` may be stored lists, so that
    several searches share them. ``probes`` scans the nearest lists only (approximate); None is exact.
    """
    lists = index if isinstance(index, Lists) else build(index, index_key, index_vector)
    found = nearest(queries, lists, top_k, query_key, query_vector, "dot", probes).rows
    return found.withColumnRenamed("dot", "score").where(F.col("score") >= min_similarity).drop("l2_distance", "cosine")


def cross_reference(
    hits: DataFrame,
    predictions: DataFrame,
    key: str | list[str],
    taxon: str = "taxon",
    score: str = "score",
    label: str = "rank_value",
    share: str = "softmax_score",
    one_sided: int = 3,
) -> DataFrame:
    """Agreement of retrieval hits and predicted classes, by lower-case taxon.

    Keeps the best hit per taxon, then all shared taxa and up to ``one_sided`` taxa that occur
    on one side only, the highest score first.
    """
    key = names(key)
    low = F.lower(F.col(taxon))
    lit = hits.groupBy(*key, low.alias("_taxon")).agg(
        F.max(score).alias("rag_score"), F.max_by(taxon, F.struct(score, F.col(taxon))).alias("_hit")
    )
    vis = predictions.groupBy(*key, F.lower(F.col(label)).alias("_taxon")).agg(
        F.max(share).alias("visual_softmax_score"), F.max_by(label, F.struct(share, F.col(label))).alias("_pred")
    )
    both = F.col("rag_score").isNotNull() & F.col("visual_softmax_score").isNotNull()
    strong = (F.col("rag_score") >= STRONG_SCORE) & (F.col("visual_softmax_score") >= STRONG_SHARE)
    joined = lit.join(vis, [*key, "_taxon"], "full_outer").select(
        *key,
        F.coalesce("_hit", "_pred").alias("taxon"),
        F.when(both & strong, "strong")
        .when(both, "moderate")
        .when(F.col("rag_score").isNotNull(), "rag_only")
        .otherwise("visual_only")
        .alias("signal"),
        F.when(both, "both").when(F.col("rag_score").isNotNull(), "literature").otherwise("visual").alias("source"),
        F.coalesce("rag_score", F.lit(0.0)).alias("rag_score"),
        F.coalesce("visual_softmax_score", F.lit(0.0)).alias("visual_softmax_score"),
    )
    order = [F.greatest("rag_score", "visual_softmax_score").desc(), F.col("taxon")]
    lone = top_per_group(joined.where("source <> 'both'"), [*key, "source"], order, one_sided, "_p").drop("_p")
    return joined.where("source = 'both'").unionByName(lone)


def strongest_signal(signals: DataFrame, specimens: DataFrame, key: str | list[str]) -> DataFrame:
    """One signal group per specimen: strong > moderate > divergent > no_convergence."""
    level = (
        F.when(F.col("signal") == "strong", 3)
        .when(F.col("signal") == "moderate", 2)
        .when(F.col("signal").isin("rag_only", "visual_only"), 1)
        .otherwise(0)
    )
    top = signals.groupBy(*names(key)).agg(F.max(level).alias("_level"))
    name = F.element_at(
        F.array(*[F.lit(s) for s in ("no_convergence", "divergent", "moderate", "strong")]),
        F.coalesce(F.col("_level"), F.lit(0)) + 1,
    )
    return specimens.join(top, names(key), "left").withColumn("signal_group", name).drop("_level")


def accuracy_by_signal(grouped: DataFrame, correct: Column) -> DataFrame:
    n, right = F.count(F.lit(1)), F.count(F.when(correct, 1))
    return grouped.groupBy("signal_group").agg(
        n.alias("n"), right.alias("n_correct"), ratio0(right, n).alias("accuracy")
    )


def retrieval_quality(hits: DataFrame, specimens: DataFrame, key: str, pos: str, hit: Column) -> DataFrame:
    """MRR and recall at fixed cut-offs; a specimen without hits counts with 0."""
    first = hits.where(hit).groupBy(key).agg(F.min(pos).alias("_rank"))
    ranked = specimens.select(key).join(first, key, "left")
    return ranked.agg(
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.count(F.lit(1)).alias("n"),
        *[
            ratio0(F.count(F.when(F.col("_rank") <= k, 1)), F.count(F.lit(1))).alias(f"recall_at_{k}")
            for k in RECALL_CUTS
        ],
    )
