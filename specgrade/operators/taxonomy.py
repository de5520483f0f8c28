"""Label ids, taxonomy maps, synonym and strict id resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions.columns import names, not_blank
from specgrade.operators.ranking import ordered_rank


def label_ids(records: DataFrame, label: str, pos: str, by: str | list[str] = (), out: str = "label_id") -> DataFrame:
    """Integer ids per label in first-seen order (from 0), one row per label."""
    firsts = records.groupBy(*names(by), label).agg(F.min(pos).alias("first_pos"))
    ranked = ordered_rank(firsts, by, "first_pos", [F.col(label)], "_rank")
    return ranked.select(*names(by), label, "first_pos", (F.col("_rank") - 1).alias(out))


def encode(records: DataFrame, ids: DataFrame, label: str, by: str | list[str] = ()) -> DataFrame:
    """Attach label ids; Spark broadcasts the id table only while it is below its threshold."""
    return records.join(ids.drop("first_pos"), [*names(by), label])


def parent_map(records: DataFrame, pos: str) -> DataFrame:
    """genus -> family, species -> genus, species -> family; the last record wins."""
    links = F.array(
        *[
            F.struct(
                F.lit(c).alias("child_rank"), F.col(c).alias("child"),
                F.lit(p).alias("parent_rank"), F.col(p).alias("parent"),
            )
            for c, p in (("genus", "family"), ("species", "genus"), ("species", "family"))
        ]
    )
    rows = records.select(pos, F.explode(links).alias("l")).select(pos, "l.*")
    return rows.groupBy("child_rank", "child", "parent_rank").agg(F.max_by("parent", pos).alias("parent"))


def synonym_bridge(names_table: DataFrame, accepted: str, synonyms: str, final_name: str, pos: str) -> DataFrame:
    """Lower-case (accepted, synonym, method, priority) from the first row per accepted name.

    Listed synonyms come in order, then the final name when it is not listed already.
    """
    key = F.lower(F.trim(accepted))
    first = (
        names_table.where(not_blank(F.col(accepted)))
        .groupBy(key.alias("accepted"))
        .agg(
            F.min_by(F.coalesce(F.trim(synonyms), F.lit("")), pos).alias("syn"),
            F.min_by(F.lower(F.trim(F.coalesce(F.col(final_name), F.lit("")))), pos).alias("final"),
        )
    )
    listed = F.when(F.upper("syn") == "NA", F.array().cast("array<string>")).otherwise(
        F.transform(F.split("syn", ","), lambda s: F.lower(F.trim(s)))
    )
    kept = F.filter(listed, lambda s: (s != "") & (s != F.col("accepted")))
    with_final = F.when(
        (F.col("final") != "") & (F.col("final") != F.col("accepted")) & ~F.array_contains("kept", F.col("final")),
        F.concat("kept", F.array("final")),
    ).otherwise(F.col("kept"))
    bridge = first.withColumn("kept", kept).select(
        "accepted", F.posexplode(with_final).alias("priority", "synonym"), F.size("kept").alias("_n")
    )
    method = F.when(F.col("priority") < F.col("_n"), "synonym").otherwise("final_name")
    return bridge.select("accepted", "synonym", method.alias("match_method"), (F.col("priority") + 1).alias("priority"))


def match_names(wanted: DataFrame, name: str, reference: DataFrame, reference_name: str, bridge: DataFrame) -> DataFrame:
    """First match of each distinct name: direct, then synonyms in order. Adds match columns.

    Matching runs on distinct names, so a name shared by a third of the rows is resolved once.
    """
    known = reference.select(F.lower(F.trim(reference_name)).alias("_ref")).where(F.col("_ref") != "").distinct()
    distinct = wanted.select(F.lower(F.trim(name)).alias("_key")).distinct()
    direct = distinct.select("_key", F.col("_key").alias("_cand"), F.lit("direct").alias("_method"), F.lit(0).alias("_prio"))
    others = distinct.join(bridge, F.col("_key") == F.col("accepted")).select(
        "_key", F.col("synonym").alias("_cand"), F.col("match_method").alias("_method"), F.col("priority").alias("_prio")
    )
    best = (
        direct.unionByName(others)
        .join(known, F.col("_cand") == F.col("_ref"), "left_semi")
        .groupBy("_key")
        .agg(F.min_by(F.struct(F.col("_cand").alias("matched_name"), F.col("_method").alias("match_method")), "_prio").alias("_m"))
    )
    return wanted.withColumn("_key", F.lower(F.trim(name))).join(best, "_key", "left").select(
        *wanted.columns, "_m.matched_name", "_m.match_method"
    )


# Id prefixes that may be cut.
ID_PREFIXES = ("pp", "bar", "pea")


def id_aliases(catalog: DataFrame, id_col: str, code_col: str, pos: str) -> DataFrame:
    """alias -> catalog id: the id, the id without its prefix, and the species code.

    Later rows overwrite earlier ones for ids; a species code only fills a free alias, and the
    first row that brings it wins.
    """
    low = F.lower(F.trim(F.col(id_col).cast("string")))
    cut = (
        F.when(F.length(low) <= 3, None)
        .when(low.startswith("bar") | low.startswith("pea"), F.substring(low, 4, 1 << 20))
        .when(low.startswith("pp"), F.substring(low, 3, 1 << 20))
    )
    code = F.lower(F.trim(F.col(code_col).cast("string")))
    rows = catalog.select(
        F.col(id_col).alias("target"),
        F.col(pos).alias("_pos"),
        F.explode(
            F.array(
                F.struct(low.alias("alias"), F.lit(0).alias("step")),
                F.struct(cut.alias("alias"), F.lit(1).alias("step")),
                F.struct(code.alias("alias"), F.lit(2).alias("step")),
            )
        ).alias("a"),
    ).select("target", "_pos", "a.alias", "a.step").where("alias is not null")
    # An id entry always overwrites; the code entry stays only while no id entry exists.
    order = F.struct(
        (F.col("step") < 2).alias("is_id"),
        F.when(F.col("step") < 2, F.col("_pos")).otherwise(-F.col("_pos")).alias("p"),
        F.col("step"),
    )
    return rows.groupBy("alias").agg(F.max_by("target", order).alias("target"))


def resolve_ids(observed: DataFrame, observed_id: str, aliases: DataFrame) -> DataFrame:
    """Exact match on the lower-case id, else with ``. - _`` removed; nothing fuzzy."""
    distinct = observed.select(F.col(observed_id).alias("_id")).where("_id is not null").distinct().select(
        "_id", F.lower(F.trim("_id")).alias("_low"), F.translate(F.lower(F.trim("_id")), ".-_", "").alias("_clean")
    )
    exact = aliases.select(F.col("alias").alias("_low"), F.col("target").alias("_exact"))
    clean = aliases.select(F.col("alias").alias("_clean"), F.col("target").alias("_cleaned"))
    found = (
        distinct.join(exact, "_low", "left")
        .join(clean, "_clean", "left")
        .select(
            F.col("_id").alias(observed_id), F.coalesce("_exact", "_cleaned").alias("target"),
            F.when(F.col("_exact").isNotNull(), "exact")
            .when(F.col("_cleaned").isNotNull(), "punctuation")
            .otherwise("none")
            .alias("match"),
        )
    )
    # A null id matches nothing and keeps its row.
    return observed.join(found, observed_id, "left").withColumn("match", F.coalesce("match", F.lit("none")))


def compare_taxonomy(true_f: Column, true_g: Column, true_s: Column, pred_f: Column, pred_g: Column, pred_s: Column) -> Column:
    """Struct of booleans per rank; a one-word species answer is compared with the epithet."""

    def norm(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    words, truth = F.split(norm(pred_s), r"\s+"), F.split(norm(true_s), r"\s+")
    epithet = (F.size(words) == 1) & (F.size(truth) == 2) & pred_s.isNotNull() & (norm(pred_s) != "")
    return F.struct(
        (norm(pred_f) == norm(true_f)).alias("family_correct"),
        (norm(pred_g) == norm(true_g)).alias("genus_correct"),
        F.when(epithet, words[0] == F.try_element_at(truth, F.lit(2)))
        .otherwise(norm(pred_s) == norm(true_s))
        .alias("species_correct"),
    )
