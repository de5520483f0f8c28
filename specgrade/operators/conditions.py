"""Tables over runs: final predictions, accuracy by condition, completeness, timings.

A result row holds one specimen under one condition: the fields of the reasoning step
(``reason_skipped, reason_error, reason_family, reason_genus, reason_species, confidence``), the
visual top lists per rank (``visual_family, visual_genus, visual_species``: arrays of at most
top-k names, ``visual_skipped``) and the truth (``true_family, true_genus, true_species``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions.columns import count_where, names, not_blank, ratio0
from specgrade.functions.text import after_segment, is_json
from specgrade.operators.ranking import exact_percentile

RESULT_SCHEMA = """
specimen_id string, condition string, image_paths array<string>, ground_truth struct<family:string>,
stages struct<
 reasoning:struct<skipped:boolean,error:string,data:struct<classification:struct<predicted_family:string,predicted_genus:string,predicted_species:string,confidence:string>>>,
 classification:struct<skipped:boolean,error:string,data:struct<predictions_by_rank:map<string,array<struct<rank_value:string,softmax_score:double,rank_position:int,l2_distance:double,cosine_similarity:double>>>>>,
 trait_retrieval:struct<skipped:boolean,error:string,data:struct<rag_matches:array<struct<taxon:string,rank:string,description:string,score:double>>,convergence:array<struct<taxon:string,signal:string,rag_score:double,visual_softmax_score:double,source:string>>>>>
"""


def flatten_results(results: DataFrame) -> DataFrame:
    """Nested result documents to the flat row described above."""
    s = F.col("stages")
    path = F.try_element_at(F.col("image_paths"), F.lit(1))
    genus, epithet = after_segment(path, "by_genus"), after_segment(path, "by_species")
    ranked = s["classification"]["data"]["predictions_by_rank"]
    clf = s["reasoning"]["data"]["classification"]
    return results.select(
        "condition",
        "specimen_id",
        F.coalesce(s["reasoning"]["skipped"], F.lit(True)).alias("reason_skipped"),
        s["reasoning"]["error"].alias("reason_error"),
        clf["predicted_family"].alias("reason_family"),
        clf["predicted_genus"].alias("reason_genus"),
        clf["predicted_species"].alias("reason_species"),
        clf["confidence"].alias("confidence"),
        F.coalesce(s["classification"]["skipped"], F.lit(True)).alias("visual_skipped"),
        *[F.coalesce(F.try_element_at(ranked, F.lit(r))["rank_value"], F.array().cast("array<string>")).alias(f"visual_{r}") for r in ("family", "genus", "species")],
        F.col("ground_truth.family").alias("true_family"),
        genus.alias("true_genus"),
        F.when(genus.isNotNull() & epithet.isNotNull(), F.concat_ws(" ", genus, epithet)).alias("true_species"),
    )


def _reasoned() -> Column:
    return ~F.coalesce("reason_skipped", F.lit(True)) & F.col("reason_error").isNull()


def final_family() -> Column:
    """Reasoning answer when usable and given, else the visual top-1."""
    visual = F.when(~F.coalesce("visual_skipped", F.lit(True)), F.try_element_at("visual_family", F.lit(1)))
    return F.coalesce(F.when(_reasoned() & not_blank(F.col("reason_family")), F.col("reason_family")), visual)


def multirank_prediction(rank: str) -> Column:
    """Reasoning answer when usable, even when blank; else the visual top-1 of the rank."""
    visual = F.coalesce(F.try_element_at(f"visual_{rank}", F.lit(1)), F.lit(""))
    return F.when(_reasoned(), F.coalesce(f"reason_{rank}", F.lit(""))).otherwise(visual)


def _known(results: DataFrame) -> DataFrame:
    return results.where(F.coalesce(F.col("true_family"), F.lit("")) != "")


def accuracy_by_condition(results: DataFrame) -> DataFrame:
    """Final accuracy and visual top-1/3/5 per condition; families compare by exact text."""
    n = F.count(F.lit(1))
    at = F.array_position("visual_family", F.col("true_family"))
    return _known(results).groupBy("condition").agg(
        ratio0(count_where(F.coalesce(final_family() == F.col("true_family"), F.lit(False))), n).alias("final_top1"),
        *[ratio0(count_where(at.between(1, k)), n).alias(f"visual_top{k}") for k in (1, 3, 5)],
        n.alias("n"),
    )


def accuracy_by_rank(results: DataFrame) -> DataFrame:
    """Case-insensitive accuracy at three ranks; a blank genus or species is wrong."""
    n = F.count(F.lit(1))

    def right(rank: str) -> Column:
        p, t = F.lower(multirank_prediction(rank)), F.lower(F.coalesce(F.col(f"true_{rank}"), F.lit("")))
        return (p == t) if rank == "family" else (p != "") & (t != "") & (p == t)

    return _known(results).groupBy("condition").agg(
        *[ratio0(count_where(right(r)), n).alias(r) for r in ("family", "genus", "species")], n.alias("n")
    )


def accuracy_by_family(results: DataFrame, conditions: list[str]) -> DataFrame:
    """Family by condition matrix of accuracy; null where a family has no result."""
    ok = F.coalesce(final_family() == F.col("true_family"), F.lit(False)).cast("int")
    return _known(results).groupBy(F.col("true_family").alias("family")).pivot("condition", conditions).agg(F.avg(ok))


def paired_correctness(results: DataFrame, a: str, b: str, correct: Column | None = None) -> DataFrame:
    """(specimen, a_correct, b_correct) on the specimens both conditions share.

    Truth comes from condition ``a``. One aggregation per specimen instead of a self-join.
    """
    ok = final_family()
    side = {c: F.max(F.when(F.col("condition") == c, ok)) for c in (a, b)}
    seen = {c: count_where(F.col("condition") == c) > 0 for c in (a, b)}
    truth = F.max(F.when(F.col("condition") == a, F.col("true_family")))
    rows = results.where(F.col("condition").isin(a, b)).groupBy("specimen_id").agg(
        truth.alias("truth"), side[a].alias("pred_a"), side[b].alias("pred_b"), (seen[a] & seen[b]).alias("_both")
    )
    hit = lambda c: F.coalesce(F.col(c) == F.col("truth"), F.lit(False))
    return rows.where("_both and coalesce(truth, '') <> ''").select(
        "specimen_id", "truth", "pred_a", "pred_b", hit("pred_a").alias("a_correct"), hit("pred_b").alias("b_correct")
    )


def impact_cases(paired: DataFrame) -> DataFrame:
    """Specimens that only one of the two conditions got right."""
    return paired.where("a_correct <> b_correct").withColumn(
        "effect", F.when(F.col("a_correct"), "helped").otherwise("hurt")
    )


def confidence_distribution(results: DataFrame) -> DataFrame:
    """Counts of confidence labels per condition; skipped rows are left out."""
    return (
        results.where(~F.coalesce("reason_skipped", F.lit(True)))
        .groupBy("condition", F.coalesce("confidence", F.lit("unknown")).alias("confidence"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def run_status(files: DataFrame, content: str = "content", errors: str | None = None) -> DataFrame:
    """Add ``status``: empty, error (bad JSON or a stage error) or valid."""
    text = F.coalesce(F.col(content), F.lit(""))
    bad = ~is_json(text)
    failed = F.coalesce(F.col(errors), F.lit(False)) if errors else F.lit(False)
    return files.withColumn("status", F.when(text == "", "empty").when(bad | failed, "error").otherwise("valid"))


def stage_failed(stages: Column) -> Column:
    """True when any stage of a ``map<string,struct<skipped,error>>`` failed and was not skipped."""
    return F.exists(F.map_values(stages), lambda s: not_blank(s["error"]) & ~F.coalesce(s["skipped"], F.lit(False)))


def completeness(statuses: DataFrame, expected: int, by: str | list[str] = "condition", conditions: DataFrame | None = None) -> DataFrame:
    """Valid, error, empty and missing outputs per condition.

    ``conditions`` lists the conditions of the run (columns ``by``); one without any output has
    all its outputs missing. Without the list only conditions with output have a row.
    """
    n = F.count(F.lit(1))
    if conditions is not None:
        found = completeness(statuses, expected, by)
        filled = conditions.select(*names(by)).distinct().join(found, names(by), "left")
        zeros = {c: 0 for c in ("n_valid", "n_error", "n_empty", "n_total")}
        return filled.na.fill(zeros).withColumn("n_missing", F.coalesce("n_missing", F.lit(expected).cast("long")))
    return statuses.groupBy(*names(by)).agg(
        *[count_where(F.col("status") == s).alias(f"n_{s}") for s in ("valid", "error", "empty")],
        n.alias("n_total"),
        F.greatest(F.lit(0).cast("long"), F.lit(expected) - n).alias("n_missing"),
    )


def pending(specimens: DataFrame, done: DataFrame, key: str | list[str], status: str | None = None) -> DataFrame:
    """Specimens without a usable output yet."""
    usable = done.where(F.col(status) != "empty") if status else done
    return specimens.join(usable.select(*names(key)).distinct(), names(key), "left_anti")


def stage_timings(rows: DataFrame, stage: str, elapsed: str) -> DataFrame:
    """Time per stage with its status counts."""
    sums = rows.groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(elapsed).alias("total_ms"),
        F.avg(elapsed).alias("mean_ms"),
        count_where(F.col("skipped")).alias("n_skipped"),
        count_where(F.col("error").isNotNull()).alias("n_error"),
    )
    return sums.join(exact_percentile(rows, stage, {"p95_ms": (elapsed, 0.95)}), stage)


def specimen_timings(rows: DataFrame, specimen: str, elapsed: str) -> DataFrame:
    return rows.groupBy(specimen).agg(F.sum(elapsed).alias("total_elapsed_ms"), F.count(F.lit(1)).alias("n_stages"))


def resolve_provenance(metadata: DataFrame, known_styles: list[str]) -> DataFrame:
    """Where the prompt of a run comes from, and why it is unavailable otherwise."""
    recorded = not_blank(F.col("prompt_text")) | not_blank(F.col("prompt_file"))
    external, style = F.coalesce("external", F.lit(False)), F.col("prompt_style")
    known = F.coalesce(style.isin(*known_styles), F.lit(False))
    return metadata.select(
        "*",
        F.when(not_blank(F.col("prompt_text")), "recorded")
        .when(recorded, "file")
        .when(external, None)
        .when(known, "style")
        .alias("prompt_source"),
        F.when(recorded, None)
        .when(external, "as-run cloud prompt not reconstructable")
        .when(~not_blank(style), "prompt style not recorded in this run")
        .when(~known, F.concat(F.lit("unknown prompt style '"), style, F.lit("'")))
        .alias("unavailable_reason"),
    )


def display_names(conditions: DataFrame, short: Column, qualifier: Column) -> DataFrame:
    """Short model name per condition; a repeated name gets its qualifier."""
    rows = conditions.withColumn("_short", short)
    counts = rows.groupBy("_short").agg((F.count(F.lit(1)) > 1).alias("_again"))
    name = F.when(F.col("_again"), F.concat(F.col("_short"), F.lit(" ("), qualifier, F.lit(")"))).otherwise(F.col("_short"))
    return rows.join(counts, "_short").withColumn("display_name", name).drop("_short", "_again")
