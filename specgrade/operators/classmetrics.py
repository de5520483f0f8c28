"""Classification metrics from label counts.

All metrics start from one count per (group, true, predicted), combined on the map side, so
the shuffled data has the size of the confusion matrix, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions.columns import names, ratio, ratio0


def pair_counts(df: DataFrame, by: str | list[str], a: str, b: str) -> DataFrame:
    """Rows per (group, a, b)."""
    return df.groupBy(*names(by), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def label_counts(pairs: DataFrame, by: str | list[str]) -> DataFrame:
    """Per (group, label): rows with it on side a, on side b, and on both."""
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), zero.alias("nb"), same.cast("long").alias("nab")),
        F.struct(F.col("b").alias("label"), zero.alias("na"), F.col("n").alias("nb"), zero.alias("nab")),
    )
    by = names(by)
    return (
        pairs.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.label")
        .agg(
            F.sum("s.na").alias("n_true"),
            F.sum("s.nb").alias("n_pred"),
            F.sum("s.nab").alias("n_both"),
        )
    )


def per_class(df: DataFrame, true: str, pred: str, by: str | list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; classes are the union of both sides."""
    return class_scores(pair_counts(df, by, true, pred), by)


def class_scores(pairs: DataFrame, by: str | list[str] = ()) -> DataFrame:
    """Class metrics from counts (by, a, b, n)."""
    counts = label_counts(pairs, by)
    p = ratio0(F.col("n_both"), F.col("n_pred"))
    r = ratio0(F.col("n_both"), F.col("n_true"))
    return counts.select(
        *names(by),
        "label",
        p.alias("precision"),
        r.alias("recall"),
        ratio0(2 * F.col("n_both"), F.col("n_true") + F.col("n_pred")).alias("f1"),
        F.col("n_true").alias("support"),
        "n_both",
        "n_pred",
    )


def summary(df: DataFrame, true: str, pred: str, by: str | list[str] = ()) -> DataFrame:
    """Accuracy, macro/micro/weighted F1, macro and weighted precision/recall, sizes."""
    return summarise(per_class(df, true, pred, by), by)


def summarise(classes: DataFrame, by: str | list[str] = ()) -> DataFrame:
    """Summary per group from the metrics of its classes."""
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return ratio0(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}")

    return classes.groupBy(*names(by)).agg(
        ratio0(F.sum("n_both"), total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        ratio0(2 * F.sum("n_both"), total + F.sum("n_pred")).alias("micro_f1"),
        weighted("f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        weighted("precision"),
        weighted("recall"),
        total.alias("num_samples"),
        F.count(F.lit(1)).alias("num_classes"),
    )


def confusion(df: DataFrame, true: str, pred: str, by: str | list[str] = (), dense: bool = False) -> DataFrame:
    """Confusion counts (true, pred, n); dense over the sorted union of labels.

    The dense form pairs labels with labels: its size is the square of the number of classes,
    which is the size of the requested matrix.
    """
    by = names(by)
    pairs = pair_counts(df, by, true, pred).withColumnsRenamed({"a": "true_label", "b": "pred_label"})
    if not dense:
        return pairs
    labels = (
        pairs.select(*by, F.explode(F.array("true_label", "pred_label")).alias("label"))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_set("label")).alias("labels"))
    )
    grid = labels.select(*by, F.explode("labels").alias("true_label"), "labels").select(
        *by, "true_label", F.explode("labels").alias("pred_label")
    )
    return grid.join(pairs, [*by, "true_label", "pred_label"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def kappa(pairs: DataFrame, by: str | list[str] = ()) -> DataFrame:
    """n, agreements, rate and Cohen's kappa per group, from pair counts.

    Kappa is null with fewer than two pairs or one label overall. A constant rater facing
    another label gives 0.0.
    """
    by = names(by)
    n = F.sum("n_true")
    chance = F.sum(F.col("n_true").cast("double") * F.col("n_pred")) / (n.cast("double") * n)
    observed = F.sum("n_both") / n
    return (
        label_counts(pairs, by)
        .groupBy(*by)
        .agg(
            n.alias("n_compared"),
            F.sum("n_both").alias("n_agree"),
            ratio(F.sum("n_both"), n).alias("agreement_rate"),
            F.when(
                (n >= 2) & (F.count(F.lit(1)) >= 2) & (chance < 1.0), (observed - chance) / (1.0 - chance)
            ).alias("cohen_kappa"),
        )
    )


def top_k_share(hit: Column, classes: Column, k: int) -> Column:
    """Aggregate: share of hits among the first ``k``, null where fewer than ``k`` classes can be
    predicted, since every class would be among them. ``classes`` is constant in a group."""
    return F.when(F.max(classes) >= k, F.avg(hit.cast("int")))


def top_k_accuracy(
    ranked: DataFrame, key: str | list[str], pos: str, predicted: str, truth: str, k: int, by=(), classes: Column | None = None
) -> DataFrame:
    """Share of keys whose truth is among the first ``k`` predictions; see ``top_k_share`` for ``classes``."""
    hit = F.max((F.col(pos) <= k) & (F.col(predicted) == F.col(truth)))
    known = F.lit(k) if classes is None else F.max(classes)
    per_key = ranked.groupBy(*names(by), *names(key)).agg(hit.alias("_hit"), known.alias("_classes"))
    return per_key.groupBy(*names(by)).agg(top_k_share(F.col("_hit"), F.col("_classes"), k).alias(f"top{k}_accuracy"))


def binary_metrics(df: DataFrame, tp: str, fp: str, support: str, n_specimens: str) -> DataFrame:
    """Precision, recall, F1 and prevalence with nulls on empty denominators."""
    p = ratio(F.col(tp), F.col(tp) + F.col(fp))
    r = ratio(F.col(tp), F.col(support))
    return (
        df.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("prevalence", ratio(F.col(support), F.col(n_specimens)))
    )
