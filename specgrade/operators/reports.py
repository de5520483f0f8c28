"""Report tables: learning curves, ranked tables, verdict bands, map summaries."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from specgrade.functions.columns import names, ratio
from specgrade.functions.stats import t_quantile_975
from specgrade.operators.ranking import exact_percentile, top_per_group


def learning_curve(runs: DataFrame, k: str, value: str, digits: int | None = None) -> DataFrame:
    """Mean, sample deviation, 95% interval, range and gain to the next k over runs.

    One row per k, so the window over all rows holds as many rows as the grid has k values.
    """
    n = F.count(value)
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    ci = F.when(n > 1, t_quantile_975(n - 1) * sd / F.sqrt(n)).otherwise(0.0)
    agg = runs.groupBy(k).agg(
        n.alias("num_seeds"),
        F.avg(value).alias(f"{value}_mean"),
        sd.alias(f"{value}_std"),
        ci.alias(f"{value}_ci"),
        F.min(value).alias(f"{value}_min"),
        F.max(value).alias(f"{value}_max"),
    )
    mean = F.col(f"{value}_mean")
    out = agg.withColumn("gain_to_next", F.lead(mean).over(W.partitionBy(F.lit(0)).orderBy(k)) - mean)
    if digits is None:
        return out
    ends = {f"{value}_ci": digits - 1}
    doubles = [f for f, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, ends.get(c, digits)).alias(c) if c in doubles else c for c in out.columns])


def accuracy_band(accuracy: Column, k: Column) -> Column:
    """excellent / good / moderate / below expectations, by shot count."""
    # Fixed values: (minimum k, excellent, good, moderate).
    bands = ((20, 0.60, 0.45, 0.30), (10, 0.55, 0.40, 0.25), (5, 0.50, 0.35, 0.20), (0, 0.40, 0.25, 0.15))

    def limit(i: int) -> Column:
        out = F.lit(bands[-1][i])
        for band in reversed(bands[:-1]):
            out = F.when(k >= band[0], F.lit(band[i])).otherwise(out)
        return out

    return (
        F.when(accuracy >= limit(1), "excellent")
        .when(accuracy >= limit(2), "good")
        .when(accuracy >= limit(3), "moderate")
        .otherwise("below expectations")
    )


def top5_band(top1: Column, top5: Column) -> Column:
    gap = top5 - top1
    return (
        F.when(top5 == 0, "not available")
        .when(gap > 0.25, "significant gap")
        .when(gap > 0.15, "moderate gap")
        .otherwise("small gap")
    )


def correlation_band(r: Column) -> Column:
    return (
        F.when(r.isNull(), "not available")
        .when(r > 0.3, "positive correlation")
        .when(r > 0.1, "weak positive correlation")
        .when(r > -0.1, "no correlation")
        .otherwise("weak negative correlation")
    )


def spread_band(gap: Column) -> Column:
    return (
        F.when(gap > 0.4, "large performance variation")
        .when(gap > 0.2, "moderate performance variation")
        .otherwise("consistent performance")
    )


def baseline_gains(runs: DataFrame, baselines: dict[str, Column], accuracy: str = "accuracy") -> DataFrame:
    """Relative gain over each baseline, only where the run is better."""
    rows = F.array(*[F.struct(F.lit(n).alias("baseline"), b.cast("double").alias("base")) for n, b in baselines.items()])
    gain = (F.col(accuracy) - F.col("base")) / F.col("base") * 100
    return (
        runs.withColumn("_b", F.explode(rows))
        .select(*runs.columns, "_b.baseline", "_b.base")
        .where(F.col(accuracy) > F.col("base"))
        .withColumn("gain_percent", gain)
    )


def support_correlation(classes: DataFrame, support: str = "support", score: str = "f1") -> DataFrame:
    """Pearson correlation of class support and F1, with its verdict."""
    r = F.corr(F.col(support).cast("double"), F.col(score))
    return classes.agg(r.alias("correlation")).withColumn("verdict", correlation_band(F.col("correlation")))


def support_ranking(df: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """Rows per label, most frequent first."""
    out = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)
    return out.limit(top) if top else out


def top_errors(df: DataFrame, true: str, pred: str, top: int = 15) -> DataFrame:
    """Most frequent (true, predicted) error pairs."""
    errors = df.where(F.col(true) != F.col(pred)).groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))
    return errors.orderBy(F.desc("n"), true, pred).limit(top)


def error_pattern(errors: DataFrame, true: str, pred: str) -> DataFrame:
    """Verdict on the most frequent confusion: single pair or several alike."""
    top = errors.orderBy(F.desc("n"), true, pred).limit(5)
    ends = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(true).alias("t"), F.col(pred).alias("p")))).alias("e"))
    e = F.col("e")
    tied = (F.size(e) > 1) & (F.try_element_at(e["m"], F.lit(1)) == F.try_element_at(e["m"], F.lit(2)))
    total = F.aggregate(e["m"], F.lit(0).cast("long"), lambda s, m: s - m)
    single = F.concat_ws(" -> ", F.try_element_at(e["t"], F.lit(1)), F.try_element_at(e["p"], F.lit(1)))
    return ends.where(F.size(e) > 0).select(
        F.when(tied, "multiple pairs").otherwise(single).alias("pattern"), total.alias("top5_errors")
    )


def extreme_classes(classes: DataFrame, label: str, score: str, n: int = 3) -> DataFrame:
    """Best and worst classes by score."""
    best = classes.orderBy(F.desc(score), label).limit(n).withColumn("side", F.lit("best"))
    worst = classes.orderBy(F.asc(score), label).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def flag_extremes(df: DataFrame, by: str | list[str], value: str, low_is_good: bool = False) -> DataFrame:
    """Mark the best and the worst value in each group."""
    by = names(by)
    hi, lo = (F.min, F.max) if low_is_good else (F.max, F.min)
    ends = df.groupBy(*by).agg(hi(value).alias("_best"), lo(value).alias("_worst"))
    return (
        df.join(ends, by)
        .withColumn("is_best", F.col(value) == F.col("_best"))
        .withColumn("is_worst", F.col(value) == F.col("_worst"))
        .drop("_best", "_worst")
    )


def group_sizes(df: DataFrame, group: str, individual: str, top: int = 10) -> DataFrame:
    """Rows and distinct individuals per group, with its place and a top flag.

    The places are given on one row per group.
    """
    sizes = df.groupBy(group, individual).agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg(
        F.sum("_n").alias("n_images"), F.count(F.lit(1)).alias("n_individuals")
    )
    leaders = sizes.orderBy(F.desc("n_images"), group).limit(top).select(F.col(group).alias("_lead"))
    flagged = sizes.join(leaders, F.col(group).eqNullSafe(F.col("_lead")), "left")
    return flagged.withColumn("is_top", F.col("_lead").isNotNull()).drop("_lead")


def map_ellipses(points: DataFrame, group: str, x: str, y: str, top: int = 10) -> DataFrame:
    """Median centre, mean and covariance per top group; the rest is 'Other'."""
    leaders = (
        points.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), group).limit(top).select(F.col(group).alias("_lead"))
    )
    named = points.join(leaders, F.col(group).eqNullSafe(F.col("_lead")), "left").withColumn(
        "grp", F.when(F.col("_lead").isNotNull(), F.col(group).cast("string")).otherwise("Other")
    )
    centers = exact_percentile(named, "grp", {"center_x": (x, 0.5), "center_y": (y, 0.5)})
    moments = named.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"),
        F.var_samp(y).alias("var_y"),
        F.covar_samp(x, y).alias("cov_xy"),
    )
    return moments.join(centers, "grp")


def principal_coordinates(df: DataFrame, vector: str) -> DataFrame:
    """First two principal components as columns x and y."""
    vec = df.withColumn("_v", array_to_vector(F.col(vector)))
    model = PCA(k=2, inputCol="_v", outputCol="_pc").fit(vec)
    return model.transform(vec).withColumn("_pc", vector_to_array("_pc")).select(
        *[c for c in df.columns if c != vector], F.col("_pc")[0].alias("x"), F.col("_pc")[1].alias("y")
    )


def best_per_group(df: DataFrame, group: str | list[str], score: str, *ties: str) -> DataFrame:
    return top_per_group(df, group, [F.desc(score), *[F.col(t) for t in ties]], 1, "_p").drop("_p")


def share_of_total(df: DataFrame, by: str | list[str], value: Column, total: Column) -> DataFrame:
    return df.groupBy(*names(by)).agg(value.alias("n"), ratio(value, total).alias("share"))
