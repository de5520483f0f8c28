"""Grading of trait predictions against matrices and scored ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions import fixed_values as fv
from specgrade.functions.columns import count_where, growing, names, not_blank, ratio, ratio0
from specgrade.functions.text import classify_prediction, is_abstention, normalize_prediction, truth_values
from specgrade.operators.classmetrics import binary_metrics
from specgrade.session import local_table


def rule_table(spark, rules=fv.MATRIX_RULES) -> DataFrame:
    """Rule rows (rule_order, option_column, category, section, field, words)."""
    rows = [(i, c, c.split("__")[0], s, f, list(w)) for i, (c, s, f, w) in enumerate(rules)]
    return local_table(
        spark, rows, "rule_order int, option_column string, category string, section string, field string, words array<string>"
    )


def map_predictions(values: DataFrame, rules: DataFrame, key: str | list[str]) -> DataFrame:
    """One 0/1/null prediction per (specimen, option) from a raw value per category.

    The first rule one of whose words occurs in the value wins; a value that matches no rule,
    or an empty one, gives null for the whole category. Rules are a short plan-time list, kept
    as one array per category.
    """
    key = names(key)
    per_category = rules.groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("rule_order", "option_column", "words"))).alias("rules")
    )
    text = F.col("_text")
    usable = (text != "") & ~text.isin(*fv.EMPTY_PREDICTIONS)
    hits = F.filter(F.col("rules"), lambda r: F.exists(r["words"], lambda w: F.contains(text, w)))
    chosen = F.when(usable & (F.size(hits) > 0), hits[0]["option_column"])
    return (
        values.withColumn("_text", F.lower(F.trim(F.coalesce(F.col("raw"), F.lit("")))))
        .join(per_category, "category")
        .withColumn("_chosen", chosen)
        .withColumn("_rule", F.explode("rules"))
        .select(
            *key, "category", "raw",
            F.col("_rule.option_column").alias("option_column"),
            F.when(F.col("_chosen").isNotNull(), (F.col("_chosen") == F.col("_rule.option_column")).cast("int")).alias("predicted"),
            F.contains(text, F.lit("not observed")).alias("not_observed"),
            F.array_join(F.array_sort(F.col("_rule.words")), "|").alias("match_rule"),
        )
    )


def attach_matrix(values: DataFrame, matrix: DataFrame, taxon: str, suffix: str = "") -> DataFrame:
    """Add ``options map<option_column, value>`` of the taxon and ``uncoded`` of the category.

    ``matrix`` is long: (taxon, option_column, value); an option that comes more than once has its
    largest value. Its flag columns are named ``<category>__uncoded``. A merged matrix names its
    columns with a ``suffix``, such as ``__consensus``: columns without it are left out, and the
    rest is used under the name before it. A category is uncoded by its flag when that is set, else
    when all its options are null. A row has as many entries as the matrix has columns. Joined
    before the options are unfolded, the values are shuffled once and narrow.
    """
    if suffix:
        name = F.col("option_column")
        matrix = matrix.where(name.endswith(suffix)).withColumn("option_column", F.substring(name, F.lit(1), F.length(name) - len(suffix)))
    matrix = matrix.groupBy(taxon, "option_column").agg(F.max("value").alias("value"))
    is_flag = F.col("option_column").endswith("__uncoded")
    category = F.when(~is_flag & F.col("value").isNotNull(), F.substring_index("option_column", "__", 1))
    rows = matrix.groupBy(taxon).agg(
        F.map_from_entries(F.collect_list(F.struct("option_column", "value"))).alias("options"),
        F.collect_set(category).alias("_coded"),
    )
    flag = F.try_element_at("options", F.concat("category", F.lit("__uncoded")))
    uncoded = F.coalesce(flag == 1, ~F.array_contains("_coded", F.col("category")), F.lit(True))
    return values.join(growing(rows), taxon, "left").withColumn("uncoded", uncoded).drop("_coded")


def _with_truth(predictions: DataFrame) -> DataFrame:
    truth = F.try_element_at("options", F.col("option_column")).cast("double")
    return predictions.withColumn("ground_truth", truth).drop("options")


def grade_traits(predictions: DataFrame) -> DataFrame:
    """Grade records per (specimen, option); predicted 0 emits nothing.

    ``predictions`` come from ``map_predictions`` on values with an attached matrix row.
    """
    gt, pred = F.col("ground_truth"), F.col("predicted")
    verdict = (
        F.when(F.col("uncoded") | gt.isNull(), "skipped_uncoded")
        .when(pred.isNull() & F.col("not_observed"), "skipped_not_observed")
        .when(pred.isNull(), "skipped_no_prediction")
        .when((pred == 1) & (gt == 1.0), "correct")
        .when(pred == 1, "incorrect")
    )
    records = _with_truth(predictions).withColumn("verdict", verdict)
    return records.where("verdict is not null").drop("uncoded", "not_observed")


def _verdict_counts() -> list[Column]:
    v = F.col("verdict")
    ok, bad = count_where(v == "correct"), count_where(v == "incorrect")
    return [
        ok.alias("n_correct"),
        bad.alias("n_incorrect"),
        count_where(v == "skipped_uncoded").alias("n_skipped_uncoded"),
        count_where(v == "skipped_no_prediction").alias("n_skipped_no_pred"),
        count_where(v == "skipped_not_observed").alias("n_not_observed"),
        (ok + bad).alias("n_graded"),
        ratio(ok, ok + bad).alias("accuracy"),
    ]


def option_accuracy(records: DataFrame, specimen: str, support: str = "graded_records") -> DataFrame:
    """Verdict counts, accuracy and binary metrics per option column.

    ``support="graded_records"`` counts truth 1 over graded records only (the behaviour to
    match; recall is then 1). ``"all_options"`` counts every record with truth 1.
    """
    graded = F.col("verdict").isin("correct", "incorrect")
    has = F.col("ground_truth") == 1.0
    per_specimen = records.groupBy("option_column", "category", specimen).agg(
        *[count_where(F.col("verdict") == v).alias(f"_{v}") for v in fv.VERDICTS],
        F.max((has & graded) if support == "graded_records" else has).alias("_support"),
    )
    s = {v: F.sum(f"_{v}") for v in fv.VERDICTS}
    out = per_specimen.groupBy("option_column", "category").agg(
        s["correct"].alias("n_correct"),
        s["incorrect"].alias("n_incorrect"),
        s["skipped_uncoded"].alias("n_skipped_uncoded"),
        s["skipped_no_prediction"].alias("n_skipped_no_pred"),
        s["skipped_not_observed"].alias("n_not_observed"),
        (s["correct"] + s["incorrect"]).alias("n_graded"),
        ratio(s["correct"], s["correct"] + s["incorrect"]).alias("accuracy"),
        count_where(F.col("_support")).alias("support"),
    )
    n = records.where(graded).agg(F.countDistinct(specimen)).scalar()
    return binary_metrics(out.withColumn("n_specimens", n), "n_correct", "n_incorrect", "support", "n_specimens")


def category_votes(records: DataFrame, by: str | list[str], specimen: str) -> DataFrame:
    """One verdict per specimen and category: the most informative of its records."""
    order = F.array(*[F.lit(v) for v in fv.VERDICTS])
    best = F.min(F.array_position(order, F.col("verdict")))
    return records.groupBy(*names(by), "category", specimen).agg(F.element_at(order, best.cast("int")).alias("verdict"))


def category_accuracy(records: DataFrame, specimen: str, by: str | list[str] = ()) -> DataFrame:
    """Votes counted per category (and per species with ``by``)."""
    return category_votes(records, by, specimen).groupBy(*names(by), "category").agg(*_verdict_counts())


def category_macro_f1(options: DataFrame) -> DataFrame:
    return options.groupBy("category").agg(F.avg("f1").alias("macro_f1"))


def species_consistency(records: DataFrame, species: str, specimen: str) -> DataFrame:
    """Share of specimens agreeing with the modal predicted option, per species and category.

    A specimen's prediction is its positive option; the mode's tie goes to the option seen
    first in ascending specimen order.
    """
    chosen = records.groupBy(species, "category", specimen).agg(
        F.min(F.when(F.col("predicted") == 1, F.col("option_column"))).alias("_pred")
    )
    counts = chosen.groupBy(species, "category", "_pred").agg(
        F.count(F.lit(1)).alias("_n"), F.min(specimen).alias("_first")
    )
    # max_by needs one descending and one ascending key: rank the first specimen by its order.
    top = counts.where("_pred is not null").groupBy(species, "category").agg(F.max("_n").alias("_top"))
    modal = (
        counts.where("_pred is not null")
        .join(top, [species, "category"])
        .where(F.col("_n") == F.col("_top"))
        .groupBy(species, "category")
        .agg(F.min_by("_pred", "_first").alias("mode_prediction"))
    )
    sizes = counts.groupBy(species, "category").agg(
        F.sum("_n").alias("n_specimens"),
        F.sum(F.when(F.col("_pred").isNotNull(), F.col("_n")).otherwise(0)).alias("n_with_predictions"),
        F.max(F.when(F.col("_pred").isNotNull(), F.col("_n"))).alias("n_agreeing"),
    )
    return (
        sizes.join(modal, [species, "category"], "left")
        .withColumn("n_agreeing", F.coalesce("n_agreeing", F.lit(0).cast("long")))
        .withColumn("agreement", ratio(F.col("n_agreeing"), F.col("n_with_predictions")))
    )


def diagnostic_cells(predictions: DataFrame) -> DataFrame:
    """Status of every (specimen, option) cell: tp, fp, fn, tn, uncoded or no_prediction."""
    gt, pred = F.col("ground_truth"), F.col("predicted")
    status = (
        F.when(F.col("uncoded") | gt.isNull(), "uncoded")
        .when(pred.isNull(), "no_prediction")
        .when((pred == 1) & (gt == 1), "tp")
        .when(pred == 1, "fp")
        .when(gt == 1, "fn")
        .otherwise("tn")
    )
    return _with_truth(predictions).withColumn("status", status)


# ---- scored ground truth -----------------------------------------------------------------


def unpivot_truth(wide: DataFrame, key: str, traits: list[str]) -> DataFrame:
    """Wide truth to (key, trait, truth, match_type); blank traits are absent."""
    cols = set(wide.columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("trait"),
                F.col(t).cast("string").alias("truth"),
                (F.coalesce(F.when(not_blank(F.col(f"{t}_match_type")), F.col(f"{t}_match_type")), F.lit("exact"))
                 if f"{t}_match_type" in cols else F.lit("exact")).alias("match_type"),
            )
            for t in traits
        ]
    )
    return wide.select(key, F.explode(rows).alias("r")).select(key, "r.*").where(not_blank(F.col("truth")))


def score_predictions(truth: DataFrame, predictions: DataFrame, keys: str | list[str]) -> DataFrame:
    """Truth drives the join: a missing prediction is an abstention."""
    joined = truth.join(predictions, names(keys), "left").withColumn(
        "prediction", F.coalesce("prediction", F.lit(""))
    )
    return joined.withColumn("result", classify_prediction(F.col("prediction"), F.col("truth")))


def _score_columns() -> list[Column]:
    r = F.col("result")
    ok = r.isin("exact_match", "parent_match")
    right, wrong, skip = count_where(ok), count_where(r == "mismatch"), count_where(r == "abstention")
    multi = (F.col("match_type") == "multi_label") & (r != "no_ground_truth")
    single = (F.col("match_type") != "multi_label") & (r != "no_ground_truth")
    return [
        count_where(r == "exact_match").alias("n_exact_match"),
        count_where(r == "parent_match").alias("n_parent_match"),
        wrong.alias("n_mismatch"),
        skip.alias("n_abstention"),
        count_where(r == "no_ground_truth").alias("n_no_gt"),
        right.alias("n_correct"),
        (right + wrong + skip).alias("n_scored"),
        ratio0(right, right + wrong).alias("accuracy"),
        ratio0(right, right + wrong + skip).alias("strict_accuracy"),
        ratio0(skip, right + wrong + skip).alias("abstention_rate"),
        count_where(single).alias("n_exact_gt"),
        count_where(multi).alias("n_multi_label_gt"),
        ratio0(count_where(single & ok), count_where(single)).alias("exact_gt_accuracy"),
        ratio0(count_where(multi & ok), count_where(multi)).alias("multi_label_gt_accuracy"),
    ]


def trait_scores(scored: DataFrame, by: str | list[str]) -> DataFrame:
    """Verdict counts, accuracy, strict accuracy and abstention rate per group."""
    return scored.groupBy(*names(by)).agg(*_score_columns())


def score_rollup(scored: DataFrame, model: str, trait: str, whole: str = "all") -> DataFrame:
    """Scores per (model, trait), per model and over everything, in one aggregate with grouping sets.

    ``whole`` names the level above: it stands in the trait, or in model and trait. A null model or
    trait in the data stays null.
    """
    sets = [[model, trait], [model], []]
    counted = scored.groupingSets(sets, model, trait).agg(*_score_columns(), F.grouping(model).alias("_m"), F.grouping(trait).alias("_t"))
    level = lambda c, g: F.when(F.col(g) == 1, whole).otherwise(F.col(c)).alias(c)
    rest = [c for c in counted.columns if c not in (model, trait, "_m", "_t")]
    return counted.select(level(model, "_m"), level(trait, "_t"), *rest)


def overall_scores(per_trait: DataFrame, by: str | list[str], legacy: bool = False) -> DataFrame:
    """Totals per model over traits.

    ``legacy`` adds abstentions a second time to the denominator and uses the scored count,
    abstentions included, for plain accuracy.
    """
    right, scored, skip = F.sum("n_correct"), F.sum("n_scored"), F.sum("n_abstention")
    answered = scored if legacy else scored - skip
    whole = scored + skip if legacy else scored
    return per_trait.groupBy(*names(by)).agg(
        ratio0(right, answered).alias("accuracy"),
        ratio0(right, whole).alias("strict_accuracy"),
        ratio0(skip, whole).alias("abstention_rate"),
        right.alias("n_correct"), scored.alias("n_scored"), skip.alias("n_abstain"),
    )


def specimen_scores(scored: DataFrame, specimen: str | list[str]) -> DataFrame:
    r = F.col("result")
    ok, bad = count_where(r.isin("exact_match", "parent_match")), count_where(r == "mismatch")
    return scored.groupBy(*names(specimen)).agg(
        ok.alias("traits_correct"), bad.alias("traits_incorrect"),
        count_where(r == "abstention").alias("traits_abstained"),
        count_where(r == "no_ground_truth").alias("traits_no_gt"),
        ratio0(ok, ok + bad).alias("accuracy"),
    )


def confusion_pairs(scored: DataFrame) -> DataFrame:
    """Predicted and actual label per scored row; abstentions and multi-label truth resolved."""
    pred = normalize_prediction(F.col("prediction"))
    label = F.when(is_abstention(pred), "[abstain]").otherwise(pred)
    values = truth_values(F.col("truth"))
    return scored.where(not_blank(F.col("truth"))).withColumn("pred_label", label).withColumn(
        "true_label", F.when(F.array_contains(values, F.col("pred_label")), F.col("pred_label")).otherwise(values[0])
    )


def multi_vs_single(truth: DataFrame, multi: DataFrame, single: DataFrame, key: str, pos: str) -> DataFrame:
    """Per trait: accuracy of pooled answers, single-image answers, their majority, consistency.

    Abstentions stay in the denominators of the accuracies, but not in mode or consistency.
    """
    from specgrade.operators.agreement import modal_values

    keys = [key, "trait"]
    right = F.col("result").isin("exact_match", "parent_match")
    pooled = score_predictions(truth, multi, keys).groupBy("trait").agg(
        F.count(F.lit(1)).alias("n_specimens"), count_where(right).alias("_multi")
    )
    shots = single.withColumn("_norm", normalize_prediction(F.col("prediction")))
    shots = shots.withColumn("_given", F.when(~is_abstention(F.col("_norm")), F.col("_norm")))
    # Combine equal answers first; only distinct answers meet the truth table.
    modes = modal_values(shots, keys, "_given", pos)
    answers = shots.groupBy(*keys, "_given").agg(F.count(F.lit(1)).alias("_n"))
    graded = truth.join(answers, keys).withColumn("result", classify_prediction(F.col("_given"), F.col("truth")))
    each = graded.groupBy("trait").agg(
        F.sum("_n").alias("_shots"), F.sum(F.when(right, F.col("_n")).otherwise(0)).alias("_single")
    )
    voted = truth.join(modes, keys).withColumn("result", classify_prediction(F.col("mode"), F.col("truth")))
    majority = voted.groupBy("trait").agg(
        count_where(right & F.col("mode").isNotNull()).alias("_major"), F.avg("consistency").alias("mean_consistency")
    )
    out = pooled.join(each, "trait", "left").join(majority, "trait", "left")
    acc = ratio0(F.col("_multi"), F.col("n_specimens"))
    one = F.coalesce(ratio0(F.col("_single"), F.col("_shots")), F.lit(0.0))
    return out.select(
        "trait", acc.alias("multi_accuracy"), one.alias("single_mean_accuracy"),
        F.coalesce(ratio0(F.col("_major"), F.col("n_specimens")), F.lit(0.0)).alias("majority_vote_accuracy"),
        F.coalesce("mean_consistency", F.lit(0.0)).alias("mean_consistency"),
        (acc - one).alias("resolution_effect"), "n_specimens",
    )


def partition_map(split: DataFrame, specimen: str, part: str = "split_part") -> DataFrame:
    """Partition per specimen; the later of train < val < test wins."""
    order = F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col(part))
    return split.groupBy(specimen).agg(F.max_by(part, order).alias(part))
