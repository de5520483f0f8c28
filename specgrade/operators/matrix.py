"""Species by trait matrices: build, merge, consensus and match-any comparison.

Matrices are long inside Spark: (taxon, category, option_column, source, value). ``widen``
pivots for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions.columns import growing, names, ratio
from specgrade.operators.classmetrics import kappa, pair_counts


def build_matrix(species: DataFrame, members: DataFrame, options: DataFrame, taxon: str) -> DataFrame:
    """0/1 per (taxon, option) from membership sets, and an uncoded flag per category.

    ``options`` (category, option_column) is the schema of the page, ``members`` (taxon,
    option_column). Every taxon gets its row of options, as the dense matrix asks.
    """
    schema = options.groupBy().agg(F.collect_list(F.struct("category", "option_column")).alias("_o")).scalar()
    held = members.groupBy(taxon).agg(F.collect_set("option_column").alias("_held"))
    # A taxon has one row until its options are unfolded; one listed twice keeps its repeats, but has its flags once.
    rows = species.groupBy(taxon).agg(F.count(F.lit(1)).cast("int").alias("_n")).join(growing(held), taxon, "left").withColumn("_o", schema)
    has = lambda o: F.coalesce(F.array_contains("_held", o["option_column"]), F.lit(False)).cast("int")

    def entry(category: Column, option: Column, value: Column) -> Column:
        return F.struct(category.alias("category"), option.alias("option_column"), value.alias("value"))

    values = F.flatten(F.transform("_o", lambda o: F.array_repeat(entry(o["category"], o["option_column"], has(o)), F.col("_n"))))
    categories = F.array_distinct(F.transform("_o", lambda o: o["category"]))
    coded = lambda c: F.exists("_o", lambda o: o["category"].eqNullSafe(c) & (has(o) == 1))
    flags = F.transform(categories, lambda c: entry(c, F.concat(c, F.lit("__uncoded")), (~coded(c)).cast("int")))
    return rows.select(taxon, F.explode(F.concat(values, flags)).alias("_e")).select(taxon, "_e.*")


def widen(matrix: DataFrame, key: str | list[str], columns: list[str], column: str = "option_column", value: str = "value") -> DataFrame:
    """Wide form with the given columns (named, so no extra pass finds them)."""
    return matrix.groupBy(*names(key)).pivot(column, columns).agg(F.max(value))


def unpivot_matrix(wide: DataFrame, key: str, source: str | None = None) -> DataFrame:
    """Wide ``category__option`` columns to the long form."""
    traits = [c for c in wide.columns if "__" in c]
    rows = F.array(*[F.struct(F.lit(c).alias("option_column"), F.col(f"`{c}`").cast("double").alias("value")) for c in traits])
    long = wide.select(key, F.explode(rows).alias("r")).select(
        key, F.substring_index("r.option_column", "__", 1).alias("category"), "r.option_column", "r.value"
    )
    return long.withColumn("source", F.lit(source)) if source else long


def species_index(matrices: DataFrame, taxon: str, *info: str) -> DataFrame:
    """Each taxon once, with the attributes of its first source."""
    return matrices.groupBy(taxon).agg(
        *[F.min_by(c, "source").alias(c) for c in info], F.countDistinct("source").alias("n_sources")
    )


def merge_report(long: DataFrame, taxon: str) -> DataFrame:
    """Taxa and trait columns per source."""
    per = long.groupBy("source", taxon, "option_column").agg(F.count(F.lit(1)).alias("_n"))
    taxa = per.groupBy("source", taxon).agg(F.count(F.lit(1)).alias("_c")).groupBy("source").agg(F.count(F.lit(1)).alias("n_taxa"))
    cols = per.groupBy("source", "option_column").agg(F.count(F.lit(1)).alias("_c")).groupBy("source").agg(F.count(F.lit(1)).alias("n_columns"))
    return taxa.join(cols, "source")


def consensus(long: DataFrame, taxon: str) -> DataFrame:
    """1 when any source says 1; 0 when some source is coded; else null.

    A source is coded for a taxon and category when its value is present and its uncoded flag
    is not 1. Every (taxon, option) that any source lists is kept.
    """
    is_flag = F.col("option_column").endswith("__uncoded")
    flags = long.where(is_flag & (F.col("value") == 1)).select(taxon, "category", "source").distinct().withColumn("_off", F.lit(True))
    traits = long.where(~is_flag).join(flags, [taxon, "category", "source"], "left")
    coded = F.col("value").isNotNull() & F.col("_off").isNull()
    return traits.groupBy(taxon, "category", "option_column").agg(
        F.when(F.max(F.coalesce(F.col("value") == 1, F.lit(False))), 1).when(F.max(coded), 0).alias("consensus"),
        F.count(F.lit(1)).alias("n_sources"),
    )


def allowed_values(matrix: DataFrame, taxon: str, tokens: DataFrame) -> DataFrame:
    """Allowed tokens per (taxon, trait); null when the category is uncoded.

    ``tokens`` (trait, category, option_column, token) is a short vocabulary, so the collected
    set is bounded by it.
    """
    value = F.col("value") == 1
    flag = F.col("option_column") == F.concat("category", F.lit("__uncoded"))
    off = matrix.groupBy(taxon, "category").agg(F.coalesce(F.max(flag & value), F.lit(False)).alias("_off"))
    named = tokens.drop("category").withColumnRenamed("trait", "_trait")
    hits = (
        matrix.join(named, "option_column")
        .groupBy(taxon, "category", F.col("_trait").alias("trait"))
        .agg(F.sort_array(F.collect_set(F.when(value, F.col("token")))).alias("allowed"))
    )
    return hits.join(off, [taxon, "category"]).select(
        taxon, "trait", F.when(~F.col("_off"), F.col("allowed")).alias("allowed")
    )


def match_any(values: DataFrame, allowed: DataFrame, keys: str | list[str], value: str = "token") -> DataFrame:
    """Values against the allowed set; uncoded traits and missing values drop out."""
    joined = values.where(F.col(value).isNotNull()).join(allowed.where("allowed is not null"), names(keys))
    return joined.withColumn("correct", F.array_contains("allowed", F.col(value)))


def match_any_accuracy(details: DataFrame, by: str | list[str], value: str = "token") -> DataFrame:
    """Accuracy over all comparable rows, kappa over rows with one allowed value."""
    by = names(by)
    n, ok = F.count(F.lit(1)), F.count(F.when(F.col("correct"), 1))
    acc = details.groupBy(*by).agg(n.alias("n_compared"), ok.alias("n_correct"), ratio(ok, n).alias("accuracy"))
    single = details.where(F.size("allowed") == 1).withColumn("_only", F.col("allowed")[0])
    k = kappa(pair_counts(single, by, value, "_only"), by).select(*by, F.col("n_compared").alias("n_kappa"), "cohen_kappa")
    return acc.join(k, by, "left").withColumn("n_kappa", F.coalesce("n_kappa", F.lit(0).cast("long")))
