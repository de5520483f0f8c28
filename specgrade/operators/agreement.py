"""Modal values per specimen, pairing of value sources, agreement and triage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from specgrade.functions.columns import names, ratio
from specgrade.functions.stats import binomial_two_sided, chi_square_tail, corrected_chi_square
from specgrade.operators.classmetrics import kappa, pair_counts

# The number of discordant pairs from which the approximation is used.
EXACT_BELOW = 25
# Headroom limits (weak ceiling, small gap, dominant class).
WEAK_CEILING, SMALL_GAP, DOMINANT = 0.4, 0.05, 0.9


def value_counts(long: DataFrame, keys: str | list[str], value: str, pos: str) -> DataFrame:
    """(keys, value, n, first): how often each value occurs and where first, combined on the map side.

    Modes of any coarser grouping follow from this table, so it can be stored and shared.
    """
    return long.groupBy(*names(keys), value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))


def modal_counts(counts: DataFrame, keys: str | list[str], value: str) -> DataFrame:
    """Mode per group of a table of ``value_counts`` whose keys include ``keys``."""
    keys = names(keys)
    added = counts.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum("n").alias("_n"), F.min("first").alias("_first"))
    some = F.col("_v").isNotNull()
    best = F.when(some, F.struct(F.col("_n"), -F.col("_first")))
    return (
        added.groupBy(*keys)
        .agg(
            F.sum("_n").alias("n_views"),
            F.sum(F.when(some, F.col("_n")).otherwise(0)).alias("n_present"),
            F.max_by("_v", best).alias("mode"),
            F.max(best)["_n"].alias("n_mode"),
        )
        .withColumn("consistency", ratio(F.col("n_mode"), F.col("n_present")))
    )


def modal_values(long: DataFrame, keys: str | list[str], value: str, pos: str) -> DataFrame:
    """Mode per group ignoring nulls; ties go to the value seen first, then the smaller one.

    Combining aggregations only; a group may hold any share of the rows.
    """
    return modal_counts(value_counts(long, keys, value, pos), keys, value)


# ---- values of several (source, trait) cells side by side --------------------------------
#
# A wide row holds a token for each cell. The tokens of all cells are digits of one number, so a row
# takes part in a shuffle once and narrow, not once for each cell.

Cells = dict[tuple[str, str], list[str]]  # (source, trait) -> the tokens it may have


def cell_code(cells: Cells, columns: list[str]) -> Column:
    """One number of all cells of a row; digit 0 is a missing token."""
    if math.prod(len(tokens) + 1 for tokens in cells.values()) >= 1 << 63:
        raise ValueError("the cells have too many tokens for one number")
    out, place = F.lit(0).cast("long"), 1
    for tokens, column in zip(cells.values(), columns):
        digit = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in tokens]), F.col(column)), F.lit(0))
        out, place = out + digit * F.lit(place).cast("long"), place * (len(tokens) + 1)
    return out


# Rows that one task counts: its groups then fit its memory, whatever the size of the table.
ROWS_PER_TASK = 200_000


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def code_counts(rows: DataFrame, keys: str | list[str], pos: str, code: str = "code", parts: int | None = None) -> DataFrame:
    """(keys, code, n, first): equal rows of a reading task counted; a group has as many rows as codes and such tasks at most.

    The rows are dealt to ``parts`` tasks by the first key and the task that read them before they are counted. A map
    task would hold a buffer for nearly every row that it reads, and spill; a large group stays in as many pieces as
    tasks read it.
    """
    whole = dealt(rows.withColumn("_read", F.spark_partition_id()), parts, names(keys)[0], "_read")
    return whole.groupBy(*names(keys), "_read", code).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first")).drop("_read")


def tied_rank(rows: DataFrame, key: str, pos: str, rank: str, tied: str, parts: int | None = None) -> DataFrame:
    """Add the place of the first row with this ``pos`` in its group, and the number of rows that share it.

    Each group is numbered in one task; rows are shuffled and sorted once.
    """
    group = W.partitionBy(key).orderBy(pos)
    same = W.partitionBy(key, pos).orderBy(pos)
    return dealt(rows, parts, key).withColumn(rank, F.rank().over(group)).withColumn(tied, F.count(F.lit(1)).over(same))


def cell_modes(counts: DataFrame, cells: Cells, keys: str | list[str], deal: str, code: str = "code", only: str | None = None, parts: int | None = None) -> DataFrame:
    """Mode of every cell per group of ``code_counts``: keys and ``cells``, an array in the order of ``cells``.

    Its entries are (source, trait, n_views, n_present, token, n_mode); nulls are no values, ties go to the
    value seen first, then the smaller one. ``deal`` is the key that all rows are shuffled by, once, to ``parts``
    tasks; ``only`` keeps the cells of one source. The buffer of a group is as long as the vocabulary.
    """
    sums, entries, place = [F.sum("n").alias("_n")], [], 1
    for i, ((source, trait), tokens) in enumerate(cells.items()):
        digit = F.expr(f"{code} div {place}") % (len(tokens) + 1)
        place *= len(tokens) + 1
        if only and source != only:
            continue
        for j in range(len(tokens)):
            here = digit == j + 1
            sums += [F.sum(F.when(here, F.col("n"))).alias(f"_n{i}_{j}"), F.min(F.when(here, F.col("first"))).alias(f"_f{i}_{j}")]
        order = sorted(range(len(tokens)), key=lambda j: tokens[j])
        found = [
            F.when(F.col(f"_n{i}_{j}").isNotNull(), F.struct(F.col(f"_n{i}_{j}").alias("n"), (-F.col(f"_f{i}_{j}")).alias("f"), F.lit(-at).alias("at"), F.lit(tokens[j]).alias("token")))
            for at, j in enumerate(order)
        ]
        # greatest skips nulls, which stand for tokens that the group lacks.
        best = found[0] if len(found) == 1 else F.greatest(*found)
        present = sum((F.coalesce(F.col(f"_n{i}_{j}"), F.lit(0)) for j in range(len(tokens))), F.lit(0).cast("long"))
        entries.append(
            F.struct(
                F.lit(source).alias("source"), F.lit(trait).alias("trait"), F.col("_n").alias("n_views"), present.alias("n_present"),
                best["token"].alias("token"), best["n"].alias("n_mode"),
            )
        )
    grouped = dealt(counts.select(*names(keys), code, "n", "first"), parts, deal).groupBy(*names(keys)).agg(*sums)
    return grouped.select(*names(keys), F.array(*entries).alias("cells"))


def cell_pairs(modes: DataFrame, cells: Cells, axes: dict[str, tuple[str, str]], keys: str | list[str]) -> DataFrame:
    """Pairs of several source pairs from ``cell_modes``, unfolded without a shuffle; as ``pair_axes``."""
    at = {c: i for i, c in enumerate(cells)}
    traits = list(dict.fromkeys(trait for _, trait in cells))
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("axis"), F.lit(k).alias("trait"), F.col("cells")[at[a, k]]["token"].alias("value_a"), F.col("cells")[at[b, k]]["token"].alias("value_b"))
            for n, (a, b) in axes.items() for k in traits if (a, k) in at and (b, k) in at
        ]
    )
    out = modes.select(*names(keys), F.explode(rows).alias("p")).select(*names(keys), "p.*")
    return out.where("value_a is not null and value_b is not null").withColumn("agree", F.col("value_a") == F.col("value_b"))


def pair_sources(a: DataFrame, b: DataFrame, keys: str | list[str], value: str = "token") -> DataFrame:
    """Inner join of two value tables on specimen and trait; pairs with a null side drop out."""
    keys = names(keys)
    left = a.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value_a"))
    right = b.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value_b"))
    return left.join(right, keys).withColumn("agree", F.col("value_a") == F.col("value_b"))


def pair_axes(long: DataFrame, axes: dict[str, tuple[str, str]], keys: str | list[str], source: str = "source") -> DataFrame:
    """Pairs of several source pairs from one long table (specimen, trait, source, token).

    Values of a (specimen, trait) are laid side by side once and unfolded per axis: one
    shuffle instead of one join per axis.
    """
    wanted = sorted({s for pair in axes.values() for s in pair})
    wide = long.groupBy(*names(keys)).agg(
        *[F.max(F.when(F.col(source) == s, F.col("token"))).alias(f"_{i}") for i, s in enumerate(wanted)]
    )
    at = {s: F.col(f"_{i}") for i, s in enumerate(wanted)}
    rows = F.array(
        *[F.struct(F.lit(n).alias("axis"), at[p[0]].alias("value_a"), at[p[1]].alias("value_b")) for n, p in axes.items()]
    )
    out = wide.select(*names(keys), F.explode(rows).alias("p")).select(*names(keys), "p.*")
    return out.where("value_a is not null and value_b is not null").withColumn(
        "agree", F.col("value_a") == F.col("value_b")
    )


def agreement(pairs: DataFrame, by: str | list[str]) -> DataFrame:
    """n, agreements, rate and kappa per group of pairs."""
    return kappa(pair_counts(pairs, by, "value_a", "value_b"), by)


def macro_by_axis(per_trait: DataFrame, axis: str = "axis") -> DataFrame:
    """Macro mean of rate and kappa over traits with comparisons."""
    return per_trait.where("n_compared > 0").groupBy(axis).agg(
        F.count(F.lit(1)).alias("n_traits"),
        F.sum("n_compared").alias("total_compared"),
        F.avg("agreement_rate").alias("macro_agreement_rate"),
        F.avg("cohen_kappa").alias("macro_kappa"),
    )


def specimen_cells(model: DataFrame, rater_a: DataFrame, rater_b: DataFrame, keys: str | list[str], axis: tuple[str, str]) -> DataFrame:
    """Drill-down rows on the union of both sides of an axis, missing values kept.

    ``model``: keys, raw, token, is_blank; the raters: keys, token. ``axis`` names two of
    model, rater_a, rater_b.
    """
    keys = names(keys)
    m = model.select(*keys, F.col("raw").alias("model_raw"), F.col("token").alias("model"), "is_blank", F.lit(True).alias("_model"))
    a = rater_a.select(*keys, F.col("token").alias("rater_a"), F.lit(True).alias("_rater_a"))
    b = rater_b.select(*keys, F.col("token").alias("rater_b"), F.lit(True).alias("_rater_b"))
    joined = m.join(a, keys, "full_outer").join(b, keys, "full_outer")
    here = F.coalesce(F.col(f"_{axis[0]}"), F.col(f"_{axis[1]}"))
    counted = F.col(axis[0]).isNotNull() & F.col(axis[1]).isNotNull()
    dropped = F.col("model_raw").isNotNull() & ~F.coalesce("is_blank", F.lit(True)) & F.col("model").isNull()
    return joined.where(here).select(
        *keys, "model_raw", "model", "rater_a", "rater_b",
        dropped.alias("model_dropped"),
        counted.alias("counted"),
        (counted & (F.col(axis[0]) == F.col(axis[1]))).alias("agree"),
    )


def review_order(cells: DataFrame, *keys: str) -> DataFrame:
    """Dropped rows first, then disagreements, then by key."""
    lead = [F.col("model_dropped").desc()] if "model_dropped" in cells.columns else []
    return cells.orderBy(*lead, "agree", *keys)


def trait_comparison(cells: DataFrame, keys: str | list[str], model: str = "model_name") -> DataFrame:
    """One row per (trait, specimen) with a value per model; models are few, rows are many."""
    keys = names(keys)
    agrees = F.coalesce(F.col("model") == F.col("rater_a"), F.lit(False))
    return cells.groupBy(*keys).agg(
        F.max("rater_a").alias("rater_a"),
        F.max("rater_b").alias("rater_b"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(model, "model")))).alias("models"),
        F.min(agrees).alias("all_agree"),
        # A missing token counts as a value of its own.
        (F.countDistinct(F.coalesce(F.col("model"), F.lit("__missing__"))) > 1).alias("models_split"),
    )


def class_distribution(values: DataFrame, dimension: DataFrame, by: str | list[str] = (), value: str = "token") -> DataFrame:
    """Counts per canonical value, zero-filled over the vocabulary, with the majority share.

    ``dimension``: (trait, value) rows of the vocabulary.
    """
    by = names(by)
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, "trait", F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if by:
        groups = values.groupBy(*by, "trait").agg(F.count(F.lit(1)).alias("_x")).drop("_x")
        frame = groups.join(dimension, "trait")
    else:
        frame = dimension
    keys = [*by, "trait", "value"]
    return frame.join(counts, keys, "full_outer").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def majority_share(distribution: DataFrame, by: str | list[str]) -> DataFrame:
    return distribution.groupBy(*names(by)).agg(
        F.sum("n").alias("n_labelled"), ratio(F.max("n"), F.sum("n")).alias("majority")
    )


def triage(majority: Column, ceiling: Column, best: Column) -> Column:
    """undecidable / at_human_level / model_gap."""
    undecidable = majority.isNull() | (majority >= 1.0) | ceiling.isNull() | best.isNull()
    return F.when(undecidable, "undecidable").when(best >= ceiling, "at_human_level").otherwise("model_gap")


def undecidable_reason(majority: Column, ceiling: Column, best: Column) -> Column:
    return (
        F.when(majority.isNull(), "no gradable annotations")
        .when(majority >= 1.0, "single class")
        .when(best.isNull(), "no model predictions")
        .when(ceiling.isNull(), "no human ceiling")
        .otherwise("undecidable")
    )


def analyze_traits(majority: DataFrame, ceiling: DataFrame, scores: DataFrame) -> DataFrame:
    """Per trait: majority share, ceiling kappa, best condition by kappa, verdict.

    ``scores``: (trait, condition, cohen_kappa). On equal kappa the smaller condition name
    wins.
    """
    usable = scores.where("n_compared > 0 and cohen_kappa is not null")
    best = usable.groupBy("trait").agg(
        F.max("cohen_kappa").alias("best_kappa"), F.min_by("condition", F.struct(-F.col("cohen_kappa"), F.col("condition"))).alias("best_condition")
    )
    joined = majority.join(ceiling.select("trait", F.col("cohen_kappa").alias("ceiling_kappa")), "trait", "left").join(best, "trait", "left")
    m, c, b = F.col("majority"), F.col("ceiling_kappa"), F.col("best_kappa")
    verdict = triage(m, c, b)
    return joined.withColumn("verdict", verdict).withColumn(
        "reason", F.when(verdict == "undecidable", undecidable_reason(m, c, b))
    )


def rank_conditions(scores: DataFrame, analysis: DataFrame) -> DataFrame:
    """Mean kappa over decidable traits, wins and coverage per condition.

    Only conditions that answer at least half of the decidable traits are ranked.
    """
    decidable = analysis.where("verdict <> 'undecidable'")
    n = decidable.agg(F.count(F.lit(1))).scalar()
    answered = scores.where("n_compared > 0 and cohen_kappa is not null").join(decidable.select("trait", "best_condition", "ceiling_kappa"), "trait")
    return (
        answered.groupBy("condition")
        .agg(
            F.avg("cohen_kappa").alias("mean_kappa"),
            F.count(F.when(F.col("best_condition") == F.col("condition"), 1)).alias("n_best"),
            F.count(F.lit(1)).alias("n_answered"),
        )
        .withColumn("n_decidable", n)
        .where(F.col("n_answered") >= F.greatest(F.lit(1), F.floor(n / 2)))
    )


def mcnemar(paired: DataFrame, by: str | list[str], a: str, b: str, always_chi_square: bool = False) -> DataFrame:
    """Paired correctness: discordant counts, rate change, statistic and p-value.

    Default: null without discordant pairs, exact below 25 of them, else the corrected
    chi-square. ``always_chi_square``: 1.0 without discordant pairs, else chi-square.
    """
    one, two = F.col(a), F.col(b)
    counts = paired.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n_paired"),
        F.count(F.when(two & ~one, 1)).alias("b_only_correct"),
        F.count(F.when(one & ~two, 1)).alias("a_only_correct"),
        (F.avg(two.cast("int")) - F.avg(one.cast("int"))).alias("rate_delta"),
    )
    x, y = F.col("b_only_correct"), F.col("a_only_correct")
    stat = corrected_chi_square(x, y)
    tail = chi_square_tail(stat)
    if always_chi_square:
        p = F.when(x + y == 0, 1.0).otherwise(tail)
        stat = F.coalesce(stat, F.lit(0.0))
    else:
        p = F.when(x + y == 0, None).when(x + y < EXACT_BELOW, binomial_two_sided(x, y)).otherwise(tail)
    return counts.withColumn("n_discordant", x + y).withColumn("chi2", stat).withColumn("p_value", p)


def headroom(agreements: DataFrame, distribution: DataFrame, by: str = "trait") -> DataFrame:
    """GO / CAUTION / NO-GO from ceiling and baseline kappa and class balance.

    ``agreements``: (trait, axis in {ceiling, baseline}, cohen_kappa). ``distribution``:
    (trait, source, n) class counts of the human sources.
    """
    k = agreements.groupBy(by).agg(
        F.max(F.when(F.col("axis") == "ceiling", F.col("cohen_kappa"))).alias("ceiling_kappa"),
        F.max(F.when(F.col("axis") == "baseline", F.col("cohen_kappa"))).alias("baseline_kappa"),
    )
    lop = majority_share(distribution, [by, "source"]).groupBy(by).agg(
        F.count(F.when(F.col("majority") > DOMINANT, 1)).alias("n_dominant")
    )
    gap = F.col("ceiling_kappa") - F.col("baseline_kappa")
    weak = F.coalesce(F.col("ceiling_kappa") < WEAK_CEILING, F.lit(True))
    near = F.coalesce(gap < SMALL_GAP, F.lit(False))
    lopsided = F.coalesce(F.col("n_dominant") > 0, F.lit(False))
    reasons = F.filter(
        F.array(
            F.when(weak, "weak ceiling"), F.when(gap.isNotNull(), "gap measured"),
            F.when(near, "baseline near the ceiling"), F.when(lopsided, "one class dominates"),
        ),
        lambda r: r.isNotNull(),
    )
    return k.join(lop, by, "left").select(
        by, "ceiling_kappa", "baseline_kappa", gap.alias("gap"),
        F.when(near, "NO-GO").when(weak | lopsided, "CAUTION").otherwise("GO").alias("verdict"),
        reasons.alias("reasons"),
    )
