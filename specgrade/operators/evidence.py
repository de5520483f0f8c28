"""Quality flags and the evidence text of each specimen.

The text of a specimen is built from bounded rows: its traits, its top-k predictions and hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from specgrade.functions import fixed_values as fv

UNCLEAR_LIMIT, MARGIN_LIMIT = 5, 0.1
PASSAGE_CHARS = 200
# Labels of the agreement signals.
SIGNAL_LABELS = {
    "strong": "STRONG CONVERGENCE", "moderate": "MODERATE CONVERGENCE",
    "rag_only": "Literature only", "visual_only": "Visual only",
}


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def quality_flags(specimens: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Add ``flags``. Reads n_values, n_unclear, top_score, margin, image_labels (array),
    hierarchy_note, gate_flags (array).

    ``margin`` is set for single-rank output only, so the margin flag never fires for
    multi-rank output; pass the margin of a rank to change that.
    """
    c = F.col
    labels = F.array_sort(F.array_distinct(c("image_labels")))
    warnings = F.array(
        F.when(
            c("n_unclear") >= UNCLEAR_LIMIT,
            F.format_string("Low morphological quality: %d of %d traits are unclear/not observed", c("n_unclear"), c("n_values")),
        ),
        F.when(
            c("top_score") < min_score,
            F.concat(
                F.lit("Low classification similarity: top prediction captures only "), percent(c("top_score")),
                F.lit(" of total similarity (threshold: "), percent(F.lit(min_score)), F.lit(")"),
            ),
        ),
        F.when(c("margin") < MARGIN_LIMIT, F.format_string("Low decision margin: %.3f between top-1 and top-2", c("margin"))),
        F.when(
            F.size(labels) > 1,
            F.concat(
                F.format_string("Per-image disagreement: images predict %d distinct labels (", F.size(labels)),
                F.array_join(labels, ", "), F.lit(")"),
            ),
        ),
        F.when(c("hierarchy_note").isNotNull(), F.concat(F.lit("Hierarchical inconsistency: "), c("hierarchy_note"))),
    )
    gate = F.transform(F.coalesce("gate_flags", F.array().cast("array<string>")), lambda g: F.concat(F.lit("Out-of-distribution warning: "), g))
    none = F.when((F.coalesce("n_values", F.lit(0)) == 0) & c("top_score").isNull(), F.lit("No evidence available from any stage"))
    flags = F.filter(F.concat(warnings, gate, F.array(none)), lambda f: f.isNotNull())
    return specimens.withColumn("flags", flags)


def unclear_counts(traits: DataFrame, key: str, value: str = "value") -> DataFrame:
    text = F.lower(F.trim(F.coalesce(F.col(value), F.lit(""))))
    return traits.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_values"), F.count(F.when(text.isin(*fv.UNINFORMATIVE), 1)).alias("n_unclear")
    )


def _section(rows: DataFrame, key: str, order: list[str], line: Column, out: str) -> DataFrame:
    entry = F.struct(*order, line.alias("_line"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_line"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias(out))


def trait_section(traits: DataFrame, key: str) -> DataFrame:
    """Traits: (key, section_no, section, field_no, field, value)."""
    title = F.initcap(F.translate(F.col("section"), "_", " "))
    label = F.initcap(F.translate(F.col("field"), "_", " "))
    head = F.when(F.col("field_no") == 1, F.concat(F.lit("\n### "), title, F.lit("\n\n"))).otherwise("")
    return _section(traits, key, ["section_no", "field_no"], F.concat(head, F.lit("- **"), label, F.lit("**: "), F.col("value")), "morphology")


def prediction_section(predictions: DataFrame, key: str) -> DataFrame:
    """Predictions: (key, rank_no, rank, rank_position, rank_value, softmax_score, l2_distance,
    cosine_similarity, margin)."""
    c = F.col
    head = F.when(
        c("rank_position") == 1,
        F.concat(F.lit("### "), F.initcap("rank"), F.lit("\n\nDecision margin: "), F.format_string("%.3f", c("margin")), F.lit("\n\n")),
    ).otherwise("")
    line = F.concat(
        head,
        F.format_string("- #%d: **%s** (similarity share: ", c("rank_position"), c("rank_value").cast("string")),
        percent(c("softmax_score")),
        F.format_string(") | L2: %.3f, cosine: %.3f", c("l2_distance"), c("cosine_similarity")),
    )
    return _section(predictions, key, ["rank_no", "rank_position"], line, "classification")


def literature_section(hits: DataFrame, key: str) -> DataFrame:
    """Hits: (key, pos, taxon, rank, score, description); the passage shows its first characters."""
    c = F.col
    line = F.concat(
        F.format_string("- **%s** (%s, similarity: %.2f)", c("taxon"), c("rank"), c("score")),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n  - "), F.substring("description", 1, PASSAGE_CHARS))).otherwise(""),
    )
    return _section(hits, key, ["pos"], line, "literature")


def signal_section(signals: DataFrame, key: str) -> DataFrame:
    """Signals: (key, taxon, signal, rag_score, visual_softmax_score), strongest first."""
    c = F.col
    order = F.array_position(F.array(*[F.lit(s) for s in SIGNAL_LABELS]), c("signal"))
    label = F.create_map(*[F.lit(x) for kv in SIGNAL_LABELS.items() for x in kv])[c("signal")]
    line = F.concat(
        F.format_string("- **%s** [%s] (RAG: %.2f, Visual: ", c("taxon"), label, c("rag_score")),
        percent(c("visual_softmax_score")), F.lit(")"),
    )
    return _section(signals.withColumn("_o", order), key, ["_o", "taxon"], line, "convergence")


def evidence_documents(specimens: DataFrame, key: str, morphology: DataFrame, classification: DataFrame, literature: DataFrame | None, convergence: DataFrame | None) -> DataFrame:
    """One text per specimen, sections in fixed order, with the fixed texts for empty ones."""
    out = specimens.select(key).join(morphology, key, "left").join(classification, key, "left")
    c = F.col

    def block(title: str, body: Column, empty: str, lead: str = "") -> Column:
        return F.when(body.isNull(), F.lit(f"{title}\n{empty}\n")).otherwise(F.concat(F.lit(f"{title}\n\n{lead}"), body, F.lit("\n")))

    parts = [
        F.lit("# Evidence Summary\n"),
        block("## Morphological Profile", c("morphology"), "No morphological data available."),
        block("## Visual Classification (Multi-Rank)", c("classification"), "No classification data available."),
    ]
    if literature is None:
        parts.append(F.lit("## Literature Evidence\nLiterature trait retrieval not available.\n"))
    else:
        out = out.join(literature, key, "left")
        parts.append(block("## Literature Evidence", c("literature"), "\nNo matching taxa found in literature.\n", "### Matching Taxa (by trait similarity)\n\n"))
    if convergence is None:
        parts.append(F.lit("## Convergence Analysis\nInsufficient data for convergence analysis.\n"))
    else:
        out = out.join(convergence, key, "left")
        parts.append(block("## Convergence Analysis", c("convergence"), "No cross-reference data available."))
    return out.select(key, F.concat_ws("\n", *parts).alias("evidence_document"))
