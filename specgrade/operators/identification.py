"""Grading of identifications, with reviewable corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specgrade.functions import fixed_values as fv
from specgrade.functions.columns import count_where, names, not_blank
from specgrade.operators.classmetrics import class_scores, summarise
from specgrade.operators.taxonomy import compare_taxonomy


def _norm(c):
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def corrections_table(rows: DataFrame, pos: str) -> DataFrame:
    """Valid corrections keyed by (specimen_id, rank); the last row wins."""
    clean = rows.select(
        F.trim("specimen_id").alias("specimen_id"), F.lower(F.trim("rank")).alias("rank"),
        F.trim("original").alias("original"), F.trim("canonical").alias("canonical"),
        F.lower(F.trim("category")).alias("category"), pos,
    )
    valid = clean.where(
        F.col("rank").isin(*fv.RANKS) & F.col("category").isin(*fv.CORRECTION_CATEGORIES) & not_blank(F.col("specimen_id"))
    )
    return (
        valid.groupBy("specimen_id", "rank")
        .agg(F.max_by(F.struct("original", "canonical", "category"), pos).alias("_c"))
        .select("specimen_id", "rank", "_c.*")
    )


def curator_key(rows: DataFrame, pos: str) -> DataFrame:
    """anonymous_id -> specimen and true taxonomy; blank ids are dropped, the last row wins."""
    fields = ["specimen_id", "family", "genus", "species"]
    clean = rows.select(F.trim("anonymous_id").alias("anonymous_id"), *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields], pos)
    return (
        clean.where(not_blank(F.col("anonymous_id")))
        .groupBy("anonymous_id")
        .agg(F.max_by(F.struct(*fields), pos).alias("_r"))
        .select("anonymous_id", "_r.*")
    )


def join_key(annotations: DataFrame, key: DataFrame) -> DataFrame:
    return annotations.join(key, "anonymous_id", "left")


def unmatched_ids(annotations: DataFrame, key: DataFrame, pos: str) -> DataFrame:
    """Distinct ids absent from the key, with their first position."""
    return annotations.join(key, "anonymous_id", "left_anti").groupBy("anonymous_id").agg(F.min(pos).alias("first_pos"))


def grade_identification(records: DataFrame) -> DataFrame:
    """Correctness per rank; a failed or skipped stage is wrong at every rank."""
    ok = compare_taxonomy(
        F.col("true_family"), F.col("true_genus"), F.col("true_species"),
        F.col("pred_family"), F.col("pred_genus"), F.col("pred_species"),
    )
    failed = F.coalesce(F.col("stage_error"), F.lit(False))
    out = records.withColumn("_ok", ok)
    for rank in fv.RANKS:
        out = out.withColumn(f"pred_{rank}", F.when(~failed, F.col(f"pred_{rank}"))).withColumn(
            f"{rank}_correct", ~failed & F.col(f"_ok.{rank}_correct")
        )
    return out.drop("_ok").withColumn("stage_error", failed)


def identification_metrics(graded: DataFrame, part: str | None = None) -> DataFrame:
    """Accuracy and macro/weighted P/R/F1 per rank, overall ("all") and per part.

    Grouping sets count (part, rank, truth, guess) and (rank, truth, guess) in one aggregate, which is
    combined on the map side; all figures follow from that table of label pairs.
    """
    ranks = F.array(
        *[
            F.struct(
                F.lit(r).alias("rank"), _norm(F.col(f"true_{r}")).alias("a"),
                _norm(F.col(f"pred_{r}")).alias("b"), F.col(f"{r}_correct").alias("right"),
            )
            for r in fv.RANKS
        ]
    )
    # A failed stage is one row without a rank.
    none = ranks[0].withField("rank", F.lit(None).cast("string")).withField("a", F.lit(None).cast("string")).withField("b", F.lit(None).cast("string"))
    long = graded.select(
        (F.col(part).cast("string") if part else F.lit(None).cast("string")).alias("part"),
        F.explode(F.when(F.col("stage_error"), F.array(none)).otherwise(ranks)).alias("r"),
    ).select("part", "r.*")
    labels = ["rank", "a", "b"]
    counted = long.groupingSets([["part", *labels], labels], "part", *labels).agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("right")).alias("n_right"), F.grouping("part").alias("whole")
    )
    named = counted.where("whole = 1 or part is not null").withColumn("part_name", F.when(F.col("whole") == 1, "all").otherwise(F.col("part")))
    by = ["part_name", "rank"]
    some = named.where("rank is not null")
    scores = summarise(class_scores(some.select(*by, "a", "b", "n"), by), by).drop("accuracy", "num_classes", "micro_f1", "num_samples")
    acc = some.groupBy(*by).agg((F.sum("n_right") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n_graded"))
    errors = named.groupBy("part_name").agg(F.coalesce(F.sum(F.when(F.col("rank").isNull(), F.col("n"))), F.lit(0)).alias("n_stage_error"))
    return acc.join(scores, by).join(errors, "part_name")


def human_identifications(records: DataFrame, pos: str) -> DataFrame:
    """First record per anonymous id that carries an id and a truth."""
    has_id = not_blank(F.col("pred_family")) | not_blank(F.col("pred_genus")) | not_blank(F.col("pred_species"))
    known = F.col("true_family").isNotNull() | F.col("true_genus").isNotNull()
    rest = [c for c in records.columns if c != "anonymous_id"]
    return (
        records.where(has_id & known)
        .groupBy("anonymous_id")
        .agg(F.min_by(F.struct(*rest), pos).alias("_r"))
        .select("anonymous_id", "_r.*")
    )


def grade_with_corrections(firsts: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row per (record, rank): raw verdict, credited verdict and the correction used.

    The true species of a record is its epithet; the raw comparison uses the binomial.
    """
    binomial = F.trim(F.concat_ws(" ", F.trim(F.coalesce("true_genus", F.lit(""))), F.trim(F.coalesce("true_species", F.lit("")))))
    ok = compare_taxonomy(
        F.col("true_family"), F.col("true_genus"), binomial, F.col("pred_family"), F.col("pred_genus"), F.col("pred_species")
    )
    ranks = F.array(
        *[
            F.struct(
                F.lit(r).alias("rank"), F.col(f"_ok.{r}_correct").alias("raw_correct"),
                F.col(f"pred_{r}").alias("pred"), F.col(f"true_{r}").alias("truth"),
            )
            for r in fv.RANKS
        ]
    )
    long = firsts.withColumn("_ok", ok).select("anonymous_id", "specimen_id", F.explode(ranks).alias("r")).select(
        "anonymous_id", "specimen_id", "r.*"
    )
    joined = long.join(corrections, ["specimen_id", "rank"], "left")
    credit = (
        ~F.col("raw_correct")
        & F.col("category").isNotNull()
        & (_norm(F.col("original")) == _norm(F.col("pred")))
        & (_norm(F.col("canonical")) == _norm(F.col("truth")))
    )
    return joined.select(
        "anonymous_id", "specimen_id", "rank", "raw_correct",
        (F.col("raw_correct") | F.coalesce(credit, F.lit(False))).alias("corrected"),
        F.when(credit, F.col("category")).alias("credited_category"),
    )


def identification_accuracy(graded: DataFrame) -> DataFrame:
    """Raw and corrected accuracy per rank, and credits per category."""
    return graded.groupBy("rank").agg(
        F.count(F.lit(1)).alias("n_graded"),
        F.avg(F.col("raw_correct").cast("int")).alias("accuracy"),
        F.avg(F.col("corrected").cast("int")).alias("corrected_accuracy"),
        *[F.count(F.when(F.col("credited_category") == c, 1)).alias(f"n_{c}") for c in fv.CORRECTION_CATEGORIES],
    )


def stale_corrections(corrections: DataFrame, originals: DataFrame) -> DataFrame:
    """Corrections whose original text is gone or changed. ``originals``: (specimen_id, rank, pred)."""
    joined = corrections.join(originals.withColumn("_here", F.lit(True)), names(["specimen_id", "rank"]), "left")
    return joined.where(F.col("_here").isNull() | (_norm(F.col("original")) != _norm(F.col("pred")))).drop("_here", "pred")
