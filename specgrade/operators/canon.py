"""Canonical trait tokens from raw values in several spellings and languages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions import fixed_values as fv
from specgrade.functions.text import normalize
from specgrade.session import materialise


def trait_dimension(traits: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per trait with its vocabulary as a map; an alias overrides a canonical value.

    ``traits``: key, canonical_values (pipe-separated), gradable and further columns.
    ``aliases``: trait, alias, token.
    """
    own = traits.select(F.col("key").alias("trait"), F.explode(F.split("canonical_values", r"\|")).alias("alias")).select(
        "trait", "alias", F.col("alias").alias("token"), F.lit(0).alias("step")
    )
    given = aliases.select("trait", "alias", "token", F.lit(1).alias("step"))
    words = (
        own.unionByName(given)
        .groupBy("trait", "alias")
        .agg(F.max_by("token", "step").alias("token"))
        .groupBy("trait")
        .agg(F.map_from_entries(F.collect_list(F.struct("alias", "token"))).alias("vocabulary"))
    )
    return traits.join(words.withColumnRenamed("trait", "key"), "key")


def _token(norm: Column, vocabulary: Column) -> Column:
    words = F.filter(F.split(F.translate(norm, "-–—", "   "), " +"), lambda w: w != "")
    known = F.array_distinct(
        F.filter(F.transform(words, lambda w: F.try_element_at(vocabulary, w)), lambda v: v.isNotNull())
    )
    negated = F.arrays_overlap(words, F.array(*[F.lit(n) for n in fv.NEGATIONS]))
    agreed = F.when(~negated & (F.size(known) == 1), known[0])
    return F.when(norm.isin(*fv.MISSING_WORDS), None).otherwise(
        F.coalesce(F.try_element_at(vocabulary, norm), agreed)
    )


def to_tokens(long: DataFrame, dimension: DataFrame, gradable_only: bool = True) -> DataFrame:
    """Add ``token`` (null when missing or unmapped) and ``is_blank`` to (trait, raw, ...).

    Rows of unknown traits drop out. Raw values repeat heavily, so each distinct value is
    resolved once. The resolved values are stored: Spark then knows their size before it plans the
    join, sends small ones to the long rows instead of shuffling those by a few hot values, and
    shuffles and splits only beyond its broadcast threshold.
    """
    specs = dimension.where("gradable") if gradable_only else dimension
    keyed = long.withColumn("_raw", F.coalesce("raw", F.lit("")))
    values = materialise(canonical_values(keyed.select("trait", F.col("_raw").alias("raw")), specs), "values").withColumnRenamed("raw", "_raw")
    return keyed.join(values, ["trait", "_raw"]).select(*long.columns, "token", "is_blank")


def token_columns(rows: DataFrame, values: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace raw value columns (column -> trait) by their tokens, side by side.

    ``values`` are stored ``canonical_values``. The rows are not unfolded: Spark sends a small table of
    values to them, once for each trait.
    """
    for column, trait in columns.items():
        known = values.where(F.col("trait") == trait).select(F.col("raw").alias("_raw"), F.col("token").alias("_token"))
        rows = rows.join(known, F.coalesce(F.col(column), F.lit("")) == F.col("_raw"), "left").withColumn(column, F.col("_token")).drop("_raw", "_token")
    return rows


def _resolve(long: DataFrame, dimension: DataFrame) -> DataFrame:
    """Tokens row by row; the vocabulary travels with the short trait dimension."""
    words = dimension.select(F.col("key").alias("trait"), "vocabulary")
    return (
        long.join(words, "trait")
        .withColumn("_norm", normalize(F.col("raw")))
        .select(
            *long.columns,
            _token(F.col("_norm"), F.col("vocabulary")).alias("token"),
            F.col("_norm").isin(*fv.MISSING_WORDS).alias("is_blank"),
        )
    )


def canonical_values(raw: DataFrame, dimension: DataFrame, trait: str = "trait", value: str = "raw") -> DataFrame:
    """Distinct (trait, raw) pairs with their token."""
    pairs = raw.select(F.col(trait).alias("trait"), F.col(value).alias("raw")).distinct()
    return _resolve(pairs, dimension)


def unmapped_values(long: DataFrame, dimension: DataFrame, pos: str) -> DataFrame:
    """Raw values that are not blank but map to nothing, with their first position."""
    seen = long.groupBy("trait", "raw").agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("n"))
    gaps = _resolve(seen, dimension.where("gradable")).where(F.col("token").isNull() & ~F.col("is_blank"))
    return gaps.select("trait", "raw", "first_pos", "n")


def header_traits(columns: Iterable[str], prefixes: dict[str, str]) -> dict[str, str]:
    """Sheet column -> trait key, by prefix of the normalised header (plan-time, names only)."""
    import unicodedata

    out = {}
    for column in columns:
        text = unicodedata.normalize("NFKD", column)
        text = "".join(c for c in text if not unicodedata.combining(c))
        text = " ".join(text.translate(str.maketrans(fv.PUNCTUATION, " " * len(fv.PUNCTUATION))).lower().split())
        key = next((k for k, p in prefixes.items() if text and text.startswith(p)), None)
        if key:
            out[column] = key
    return out


def nested_traits(results: DataFrame, dimension: list[tuple[str, str, str]], traits: str = "traits") -> DataFrame:
    """Unpivot a nested traits struct to (specimen_id, trait, raw).

    ``dimension`` lists (trait, section, field); a path absent from the schema yields null.
    """
    schema = results.schema[traits].dataType
    values = []
    for key, section, field in dimension:
        present = section in schema.fieldNames() and field in schema[section].dataType.fieldNames()
        value = F.col(f"{traits}.{section}.{field}").cast("string") if present else F.lit(None).cast("string")
        values.append(F.struct(F.lit(key).alias("trait"), value.alias("raw")))
    return results.select("specimen_id", F.explode(F.array(*values)).alias("v")).select("specimen_id", "v.trait", "v.raw")
