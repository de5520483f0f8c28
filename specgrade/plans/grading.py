"""Grading against matrices and scored truth.

Parts are taxa whose attributes form 0/1 option columns; an order line predicts the attributes
of its part. ``documents`` and ``labels`` give scored binary truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specgrade.functions.columns import growing
from specgrade.functions.text import classify_prediction, normalize_prediction, strip_justification
from specgrade.operators import classmetrics as cm, grading as gr, identification as idn, matrix as mx, reports, taxonomy as tx
from specgrade.plans.agreement import rounded
from specgrade.plans.registry import Tables, query
from specgrade.session import local_table, materialise
from specgrade.sources.tables import matrix_suffix

# Order of the lines of a part.
VIEW_POS = "(cast(l_linenumber as bigint) * 100000 + l_suppkey) * 10000000 + l_orderkey"

# ---- scored truth ------------------------------------------------------------------------

# Truth per part and trait, and raw predictions per line.
TRUTH = """truth AS (SELECT p_partkey, u.trait, u.truth, u.match_type FROM (SELECT p_partkey, unnest([
 {'trait': 'margin', 'truth': CASE WHEN p_size % 5 = 0 THEN 'entire | toothed' WHEN p_size % 5 = 1 THEN 'toothed' WHEN p_size % 5 = 2 THEN 'Entire' ELSE '' END, 'match_type': CASE WHEN p_size % 5 = 0 THEN 'multi_label' ELSE 'exact' END},
 {'trait': 'position', 'truth': CASE WHEN p_size % 2 = 0 THEN 'whorled' ELSE 'opposite' END, 'match_type': 'exact'}]) AS u FROM part) WHERE trim(u.truth) <> '')"""
PRED = """pred AS (SELECT l_partkey AS p_partkey, u.trait, arg_min(u.prediction, pos) AS prediction FROM (
 SELECT l_partkey, (l_linenumber::BIGINT * 100000 + l_suppkey) * 10000000 + l_orderkey AS pos, unnest([
 {'trait': 'margin', 'prediction': CASE WHEN l_quantity < 12 THEN 'Serrate (fine teeth).' WHEN l_quantity < 25 THEN ' ENTIRE. ' WHEN l_quantity < 40 THEN 'toothed' ELSE 'N/A (hidden)' END},
 {'trait': 'position', 'prediction': CASE WHEN l_discount < 0.04 THEN 'clustered' WHEN l_discount < 0.08 THEN 'opposite...' ELSE 'unclear' END}]) AS u FROM lineitem) GROUP BY ALL)"""
_NP = "trim(rtrim(regexp_replace(lower(trim({0})), '\\s*\\(.*$', ''), '.'))"
SCORED = f"""{TRUTH}, {PRED}, sc0 AS (SELECT t.*, coalesce(prediction, '') AS prediction, {_NP.format("coalesce(prediction, '')")} AS np,
 list_transform(string_split(truth, '|'), lambda v: lower(trim(v))) AS vals FROM truth t LEFT JOIN pred USING (p_partkey, trait)),
scored AS (SELECT *, CASE WHEN np IN ('unclear', 'not visible', 'cannot determine', 'n/a', 'na', '') THEN 'abstention' WHEN list_contains(vals, np) THEN 'exact_match'
 WHEN list_contains(vals, CASE np WHEN 'serrate' THEN 'toothed' WHEN 'clustered' THEN 'whorled' END) THEN 'parent_match' ELSE 'mismatch' END AS result FROM sc0)"""


def truth(t: Tables) -> DataFrame:
    m = F.col("p_size") % 5
    wide = t.part.select(
        "p_partkey",
        F.when(m == 0, "entire | toothed").when(m == 1, "toothed").when(m == 2, "Entire").otherwise("").alias("margin"),
        F.when(m == 0, "multi_label").alias("margin_match_type"),
        F.when(F.col("p_size") % 2 == 0, "whorled").otherwise("opposite").alias("position"),
    )
    return gr.unpivot_truth(wide, "p_partkey", ["margin", "position"])


def shot_rows(t: Tables) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    values = F.array(
        F.struct(F.lit("margin").alias("trait"), F.when(q < 12, "Serrate (fine teeth).").when(q < 25, " ENTIRE. ").when(q < 40, "toothed").otherwise("N/A (hidden)").alias("prediction")),
        F.struct(F.lit("position").alias("trait"), F.when(d < 0.04, "clustered").when(d < 0.08, "opposite...").otherwise("unclear").alias("prediction")),
    )
    pos = F.expr(VIEW_POS)
    lines = t.spread("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return lines.select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", pos.alias("pos"), F.explode(values).alias("u")).select(
        "p_partkey", "l_linenumber", "pos", "u.*"
    )


def predictions(t: Tables) -> DataFrame:
    return shot_rows(t).groupBy("p_partkey", "trait").agg(F.min_by("prediction", "pos").alias("prediction"))


def scored(t: Tables) -> DataFrame:
    return gr.score_predictions(truth(t), predictions(t), ["p_partkey", "trait"])


@query("truth_rows", "A10", f"WITH {TRUTH} SELECT p_partkey, trait, truth, match_type FROM truth")
def truth_rows(t: Tables) -> DataFrame:
    return truth(t)


@query(
    "prediction_rows",
    "A11 R8",
    f"WITH {PRED} SELECT p_partkey, trait, {_NP.format('prediction')} AS prediction, trim(regexp_replace(prediction, '\\s*\\(.*$', '')) AS stripped FROM pred",
)
def prediction_rows(t: Tables) -> DataFrame:
    p = F.col("prediction")
    return predictions(t).select("p_partkey", "trait", normalize_prediction(p).alias("prediction"), strip_justification(p).alias("stripped"))


@query("scored_predictions", "R9 J20", f"WITH {SCORED} SELECT p_partkey, trait, truth, prediction, result FROM scored")
def scored_predictions(t: Tables) -> DataFrame:
    return scored(t).select("p_partkey", "trait", "truth", "prediction", "result")


@query(
    "label_verdicts",
    "R9 A10 J20",
    """WITH tr AS (SELECT doc_id, 'quality' AS trait, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels),
p AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'unclear' WHEN n_chars % 2 = 0 THEN '1.' ELSE '0 (guess)' END AS prediction FROM documents)
SELECT trait, CASE WHEN prediction IS NULL OR prediction = 'unclear' THEN 'abstention' WHEN left(prediction, 1) = v::VARCHAR THEN 'exact_match' ELSE 'mismatch' END AS result, count(*) AS n
FROM tr LEFT JOIN p USING (doc_id) GROUP BY ALL""",
)
def label_verdicts(t: Tables) -> DataFrame:
    tr = gr.unpivot_truth(t.labels, "doc_id", ["quality", "toxic"])
    n = F.col("n_chars")
    guess = t.documents.select(
        "doc_id", F.when(n < 200, "unclear").when(n % 2 == 0, "1.").otherwise("0 (guess)").alias("prediction")
    )
    return gr.score_predictions(tr, guess, "doc_id").groupBy("trait", "result").agg(F.count(F.lit(1)).alias("n"))


_SCORES = """count(*) FILTER (result = 'exact_match') AS n_exact_match, count(*) FILTER (result = 'parent_match') AS n_parent_match, count(*) FILTER (result = 'mismatch') AS n_mismatch,
 count(*) FILTER (result = 'abstention') AS n_abstention, count(*) FILTER (result IN ('exact_match', 'parent_match')) AS n_correct, count(*) AS n_scored,
 coalesce(round(count(*) FILTER (result IN ('exact_match', 'parent_match')) / nullif(count(*) FILTER (result <> 'abstention'), 0), 4), 0) AS accuracy,
 round(count(*) FILTER (result IN ('exact_match', 'parent_match')) / count(*), 4) AS strict_accuracy, round(count(*) FILTER (result = 'abstention') / count(*), 4) AS abstention_rate"""


@query(
    "trait_scores",
    "D17",
    f"""WITH {SCORED} SELECT trait, {_SCORES}, count(*) FILTER (match_type = 'exact') AS n_exact_gt, count(*) FILTER (match_type = 'multi_label') AS n_multi_label_gt,
 coalesce(round(count(*) FILTER (match_type = 'multi_label' AND result IN ('exact_match', 'parent_match')) / nullif(count(*) FILTER (match_type = 'multi_label'), 0), 4), 0) AS multi_label_gt_accuracy
FROM scored GROUP BY trait""",
)
def trait_scores(t: Tables) -> DataFrame:
    return rounded(gr.trait_scores(scored(t), "trait"), 4).drop("n_no_gt", "exact_gt_accuracy")


MODELS = f"""{TRUTH}, mp AS (SELECT l_returnflag AS model, l_partkey AS p_partkey, u.trait, arg_min(u.prediction, pos) AS prediction FROM (
 SELECT l_returnflag, l_partkey, (l_linenumber::BIGINT * 100000 + l_suppkey) * 10000000 + l_orderkey AS pos, unnest([
 {{'trait': 'margin', 'prediction': CASE WHEN l_quantity < 12 THEN 'Serrate (fine teeth).' WHEN l_quantity < 25 THEN ' ENTIRE. ' WHEN l_quantity < 40 THEN 'toothed' ELSE 'N/A (hidden)' END}},
 {{'trait': 'position', 'prediction': CASE WHEN l_discount < 0.04 THEN 'clustered' WHEN l_discount < 0.08 THEN 'opposite...' ELSE 'unclear' END}}]) AS u FROM lineitem) GROUP BY ALL),
ms0 AS (SELECT model, t.*, {_NP.format('prediction')} AS np, list_transform(string_split(truth, '|'), lambda v: lower(trim(v))) AS vals FROM truth t JOIN mp USING (p_partkey, trait)),
ms AS (SELECT *, CASE WHEN np IN ('unclear', 'n/a') THEN 'abstention' WHEN list_contains(vals, np) THEN 'exact_match'
 WHEN list_contains(vals, CASE np WHEN 'serrate' THEN 'toothed' WHEN 'clustered' THEN 'whorled' END) THEN 'parent_match' ELSE 'mismatch' END AS result FROM ms0)"""


def model_scored(t: Tables) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    values = F.array(
        F.struct(F.lit("margin").alias("trait"), F.when(q < 12, "Serrate (fine teeth).").when(q < 25, " ENTIRE. ").when(q < 40, "toothed").otherwise("N/A (hidden)").alias("prediction")),
        F.struct(F.lit("position").alias("trait"), F.when(d < 0.04, "clustered").when(d < 0.08, "opposite...").otherwise("unclear").alias("prediction")),
    )
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("p_partkey"), F.expr(VIEW_POS).alias("pos"), F.explode(values).alias("u")
    )
    answers = rows.groupBy("model", "p_partkey", "u.trait").agg(F.min_by("u.prediction", "pos").alias("prediction"))
    return answers.join(growing(truth(t)), ["p_partkey", "trait"]).withColumn("result", classify_prediction(F.col("prediction"), F.col("truth")))


@query(
    "overall_scores",
    "D17",
    f"""WITH {MODELS}, ts AS (SELECT model, trait, {_SCORES} FROM ms GROUP BY ALL)
SELECT model, round(sum(n_correct) / (sum(n_scored) - sum(n_abstention)), 6) AS accuracy, round(sum(n_correct) / sum(n_scored), 6) AS strict_accuracy, round(sum(n_abstention) / sum(n_scored), 6) AS abstention_rate,
 sum(n_correct)::BIGINT AS n_correct, sum(n_scored)::BIGINT AS n_scored, sum(n_abstention)::BIGINT AS n_abstain FROM ts GROUP BY model""",
)
def overall_scores(t: Tables) -> DataFrame:
    return rounded(gr.overall_scores(gr.trait_scores(model_scored(t), ["model", "trait"]), "model"))


@query(
    "score_rollup",
    "D17",
    f"""WITH {MODELS} SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model, CASE WHEN grouping(trait) = 1 THEN 'all' ELSE trait END AS trait, {_SCORES}
FROM ms GROUP BY GROUPING SETS ((model, trait), (model), ())""",
)
def score_rollup(t: Tables) -> DataFrame:
    out = gr.score_rollup(model_scored(t), "model", "trait")
    return rounded(out, 4).drop("n_no_gt", "n_exact_gt", "n_multi_label_gt", "exact_gt_accuracy", "multi_label_gt_accuracy")


@query(
    "overall_scores_legacy",
    "D17",
    f"""WITH {MODELS}, ts AS (SELECT model, trait, {_SCORES} FROM ms GROUP BY ALL)
SELECT model, round(sum(n_correct) / sum(n_scored), 6) AS accuracy, round(sum(n_correct) / (sum(n_scored) + sum(n_abstention)), 6) AS strict_accuracy,
 round(sum(n_abstention) / (sum(n_scored) + sum(n_abstention)), 6) AS abstention_rate FROM ts GROUP BY model""",
)
def overall_scores_legacy(t: Tables) -> DataFrame:
    out = gr.overall_scores(gr.trait_scores(model_scored(t), ["model", "trait"]), "model", legacy=True)
    return rounded(out).select("model", "accuracy", "strict_accuracy", "abstention_rate")


@query(
    "model_extremes",
    "D38",
    f"""WITH {MODELS}, ts AS (SELECT model, trait, {_SCORES} FROM ms GROUP BY ALL)
SELECT model, trait, accuracy, accuracy = max(accuracy) OVER w AS is_best, accuracy = min(accuracy) OVER w AS is_worst,
 abstention_rate = min(abstention_rate) OVER w AS fewest_abstentions FROM ts WINDOW w AS (PARTITION BY trait)""",
)
def model_extremes(t: Tables) -> DataFrame:
    scores = rounded(gr.trait_scores(model_scored(t), ["model", "trait"]), 4).select("model", "trait", "accuracy", "abstention_rate")
    quiet = reports.flag_extremes(scores, "trait", "abstention_rate", low_is_good=True).select("model", "trait", F.col("is_best").alias("fewest_abstentions"))
    return reports.flag_extremes(scores, "trait", "accuracy").join(quiet, ["model", "trait"]).drop("abstention_rate")


@query(
    "hardest_specimens",
    "D40",
    f"""WITH {MODELS}, a AS (SELECT p_partkey, model, coalesce(count(*) FILTER (result IN ('exact_match', 'parent_match')) / nullif(count(*) FILTER (result <> 'abstention'), 0), 0) AS acc FROM ms GROUP BY ALL)
SELECT p_partkey, round(max(acc) FILTER (model = 'A'), 6) AS "A", round(max(acc) FILTER (model = 'N'), 6) AS "N", round(max(acc) FILTER (model = 'R'), 6) AS "R", round(avg(acc), 6) AS mean_accuracy FROM a GROUP BY 1 ORDER BY 5, 1""",
)
def hardest_specimens(t: Tables) -> DataFrame:
    per = gr.specimen_scores(model_scored(t), ["p_partkey", "model"])
    wide = per.groupBy("p_partkey").pivot("model", ["A", "N", "R"]).agg(F.max("accuracy"))
    mean = per.groupBy("p_partkey").agg(F.avg("accuracy").alias("mean_accuracy"))
    return rounded(wide.join(mean, "p_partkey")).orderBy("mean_accuracy", "p_partkey")


@query(
    "specimen_scores",
    "D18",
    f"""WITH {SCORED} SELECT p_partkey, count(*) FILTER (result IN ('exact_match', 'parent_match')) AS traits_correct, count(*) FILTER (result = 'mismatch') AS traits_incorrect,
 count(*) FILTER (result = 'abstention') AS traits_abstained, coalesce(round(count(*) FILTER (result IN ('exact_match', 'parent_match')) / nullif(count(*) FILTER (result <> 'abstention'), 0), 4), 0) AS accuracy,
 max(result) FILTER (trait = 'margin') AS margin, max(result) FILTER (trait = 'position') AS position FROM scored GROUP BY 1""",
)
def specimen_scores(t: Tables) -> DataFrame:
    rows = scored(t)
    detail = rows.groupBy("p_partkey").pivot("trait", ["margin", "position"]).agg(F.max("result"))
    return rounded(gr.specimen_scores(rows, "p_partkey"), 4).drop("traits_no_gt").join(detail, "p_partkey")


@query(
    "trait_confusion",
    "D7",
    f"""WITH {SCORED}, p AS (SELECT trait, CASE WHEN result = 'abstention' THEN '[abstain]' ELSE np END AS pl, CASE WHEN list_contains(vals, np) THEN np ELSE vals[1] END AS tl FROM scored),
l AS (SELECT trait, pl AS l FROM p UNION SELECT trait, tl FROM p)
SELECT a.trait, a.l AS true_label, b.l AS pred_label, (SELECT count(*) FROM p WHERE p.trait = a.trait AND tl = a.l AND pl = b.l) AS n FROM l a JOIN l b USING (trait)""",
)
def trait_confusion(t: Tables) -> DataFrame:
    return cm.confusion(gr.confusion_pairs(scored(t)), "true_label", "pred_label", "trait", dense=True)


@query(
    "class_confusion",
    "D7 D32",
    """WITH p AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_tax > 0.04 THEN 'R' ELSE 'A' END AS b FROM lineitem),
l AS (SELECT a AS l FROM p UNION SELECT b FROM p), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL)
SELECT x.l AS true_label, y.l AS pred_label, coalesce(n, 0) AS n FROM l x CROSS JOIN l y LEFT JOIN c ON a = x.l AND b = y.l""",
)
def class_confusion(t: Tables) -> DataFrame:
    return cm.confusion(flag_predictions(t), "truth", "guess", dense=True)


def flag_predictions(t: Tables) -> DataFrame:
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_tax") > 0.04, "R").otherwise("A")
    return t.lineitem.select(F.col("l_returnflag").alias("truth"), guess.alias("guess"), "l_suppkey", "l_quantity")


METRICS = """p AS (SELECT l_suppkey % 3 AS run, l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_tax > 0.04 THEN 'R' ELSE 'A' END AS b FROM lineitem),
l AS (SELECT run, a AS l FROM p UNION SELECT run, b FROM p),
c AS (SELECT l.run, l.l, count(*) FILTER (a = l.l) AS nt, count(*) FILTER (b = l.l) AS np, count(*) FILTER (a = l.l AND b = l.l) AS nb FROM l JOIN p USING (run) GROUP BY ALL),
m AS (SELECT *, coalesce(nb / nullif(np, 0), 0) AS pr, coalesce(nb / nullif(nt, 0), 0) AS rc, 2 * nb / (np + nt) AS f1 FROM c)"""


@query("class_metrics", "D5 D32", f"WITH {METRICS} SELECT run, l AS label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, nt AS support FROM m")
def class_metrics(t: Tables) -> DataFrame:
    rows = flag_predictions(t).withColumn("run", F.col("l_suppkey") % 3)
    return rounded(cm.per_class(rows, "truth", "guess", "run")).drop("n_both", "n_pred")


@query(
    "run_comparison",
    "D5",
    f"""WITH {METRICS} SELECT run, round(sum(nb) / sum(nt), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(2 * sum(nb) / (sum(nt) + sum(np)), 6) AS micro_f1,
 round(sum(f1 * nt) / sum(nt), 6) AS weighted_f1, sum(nt)::BIGINT AS num_samples, count(*) AS num_classes FROM m GROUP BY run""",
)
def run_comparison(t: Tables) -> DataFrame:
    rows = flag_predictions(t).withColumn("run", F.col("l_suppkey") % 3)
    return rounded(cm.summary(rows, "truth", "guess", "run")).select(
        "run", "accuracy", "macro_f1", "micro_f1", "weighted_f1", "num_samples", "num_classes"
    )


@query("label_support", "D32", "SELECT l_suppkey AS label, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, label")
def label_support(t: Tables) -> DataFrame:
    return reports.support_ranking(t.lineitem.select(F.col("l_suppkey").alias("label")), "label")


@query(
    "top_errors",
    "D32",
    """SELECT truth, guess, count(*) AS n FROM (SELECT l_returnflag AS truth, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_tax > 0.04 THEN 'R' ELSE 'A' END AS guess FROM lineitem)
WHERE truth <> guess GROUP BY ALL ORDER BY n DESC, truth, guess LIMIT 4""",
)
def top_errors(t: Tables) -> DataFrame:
    return reports.top_errors(flag_predictions(t), "truth", "guess", 4)


@query(
    "error_pattern",
    "D32",
    """WITH e AS (SELECT truth, guess, count(*) AS n FROM (SELECT l_returnflag AS truth, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_tax > 0.04 THEN 'R' ELSE 'A' END AS guess FROM lineitem)
WHERE truth <> guess GROUP BY ALL ORDER BY n DESC, truth, guess LIMIT 15), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, truth, guess) AS k FROM e)
SELECT CASE WHEN max(n) FILTER (k = 1) = max(n) FILTER (k = 2) THEN 'multiple pairs' ELSE max(truth || ' -> ' || guess) FILTER (k = 1) END AS pattern,
 (sum(n) FILTER (k <= 5))::BIGINT AS top5_errors FROM r""",
)
def error_pattern(t: Tables) -> DataFrame:
    return reports.error_pattern(reports.top_errors(flag_predictions(t), "truth", "guess", 15), "truth", "guess")


@query(
    "extreme_classes",
    "D32",
    """WITH p AS (SELECT l_partkey % 50 AS a, CASE WHEN l_tax < 0.03 THEN l_partkey % 50 ELSE l_suppkey % 50 END AS b FROM lineitem),
l AS (SELECT a AS l FROM p UNION SELECT b FROM p), t AS (SELECT a AS l, count(*) AS nt, count(*) FILTER (a = b) AS nb FROM p GROUP BY 1), g AS (SELECT b AS l, count(*) AS np FROM p GROUP BY 1),
m AS (SELECT l, round(2 * coalesce(nb, 0) / (coalesce(nt, 0) + coalesce(np, 0)), 6) AS f1 FROM l LEFT JOIN t USING (l) LEFT JOIN g USING (l))
SELECT l AS label, f1, 'best' AS side FROM (SELECT * FROM m ORDER BY f1 DESC, l LIMIT 3) UNION ALL SELECT l, f1, 'worst' FROM (SELECT * FROM m ORDER BY f1, l LIMIT 3)""",
)
def extreme_classes(t: Tables) -> DataFrame:
    a = F.col("l_partkey") % 50
    rows = t.lineitem.select(a.alias("truth"), F.when(F.col("l_tax") < 0.03, a).otherwise(F.col("l_suppkey") % 50).alias("guess"))
    classes = cm.per_class(rows, "truth", "guess").select("label", F.round("f1", 6).alias("f1"))
    return reports.extreme_classes(classes, "label", "f1", 3)


@query(
    "multi_vs_single",
    "D19",
    f"""WITH {SCORED}, multi AS (SELECT trait, count(*) AS n, count(*) FILTER (result IN ('exact_match', 'parent_match')) AS ok FROM scored GROUP BY trait),
s0 AS (SELECT l_partkey AS p_partkey, u.trait, (l_linenumber::BIGINT * 100000 + l_suppkey) * 10000000 + l_orderkey AS pos, {_NP.format('u.prediction')} AS np FROM (SELECT *, unnest([
 {{'trait': 'margin', 'prediction': CASE WHEN l_quantity < 12 THEN 'Serrate (fine teeth).' WHEN l_quantity < 25 THEN ' ENTIRE. ' WHEN l_quantity < 40 THEN 'toothed' ELSE 'N/A (hidden)' END}},
 {{'trait': 'position', 'prediction': CASE WHEN l_discount < 0.04 THEN 'clustered' WHEN l_discount < 0.08 THEN 'opposite...' ELSE 'unclear' END}}]) AS u FROM lineitem)),
s1 AS (SELECT s0.*, list_transform(string_split(truth, '|'), lambda v: lower(trim(v))) AS vals FROM s0 JOIN truth USING (p_partkey, trait)),
s2 AS (SELECT *, np NOT IN ('unclear', 'n/a') AS given, list_contains(vals, np) OR coalesce(list_contains(vals, CASE np WHEN 'serrate' THEN 'toothed' WHEN 'clustered' THEN 'whorled' END), false) AS ok FROM s1),
one AS (SELECT trait, count(*) AS shots, count(*) FILTER (given AND ok) AS ok FROM s2 GROUP BY trait),
md AS (SELECT trait, p_partkey, np, ok, n, sum(n) OVER (PARTITION BY trait, p_partkey) AS tot, row_number() OVER (PARTITION BY trait, p_partkey ORDER BY n DESC, f) AS r
  FROM (SELECT trait, p_partkey, np, bool_or(ok) AS ok, count(*) AS n, min(pos) AS f FROM s2 WHERE given GROUP BY ALL)),
mj AS (SELECT trait, count(*) FILTER (ok) AS major, avg(n / tot) AS cons FROM md WHERE r = 1 GROUP BY trait)
SELECT trait, round(multi.ok / n, 4) AS multi_accuracy, round(one.ok / shots, 4) AS single_mean_accuracy, round(major / n, 4) AS majority_vote_accuracy,
 round(cons, 4) AS mean_consistency, round(multi.ok / n - one.ok / shots, 4) AS resolution_effect, n AS n_specimens FROM multi JOIN one USING (trait) JOIN mj USING (trait)""",
)
def multi_vs_single(t: Tables) -> DataFrame:
    return rounded(gr.multi_vs_single(truth(t), predictions(t), shot_rows(t).drop("l_linenumber"), "p_partkey", "pos"), 4)


# ---- matrices ----------------------------------------------------------------------------

# Option columns of a part, by source: source one codes arrangement and latex, source two the
# same arrangement shifted. Values may be null.
OPTIONS = (
    ("leaf_arrangement__alternate", "leaf_arrangement", "p_size % 3 = 0", "p_size % 4 = 0"),
    ("leaf_arrangement__opposite", "leaf_arrangement", "p_size % 3 = 1 or p_size % 6 = 0", "p_size % 4 = 1"),
    ("leaf_arrangement__whorled_or_clustered", "leaf_arrangement", "p_size % 9 = 2", "p_size % 4 = 2"),
    ("latex__present", "latex", "p_partkey % 5 < 2", "p_partkey % 5 = 2"),
    ("latex__absent", "latex", "p_partkey % 5 = 3", "p_partkey % 5 = 3"),
)


def _matrix_sql() -> str:
    rows = []
    for i, source in enumerate(("one", "two")):
        entries = ", ".join(f"{{'option_column': '{o}', 'category': '{c}', 'value': ({e[i]})::INT}}" for o, c, *e in OPTIONS)
        keep = "" if i == 0 else " WHERE p_partkey % 3 <> 1"
        rows.append(f"SELECT '{source}' AS source, p_partkey AS taxon, unnest([{entries}]) AS u FROM part{keep}")
    return f"""opt AS (SELECT source, taxon, u.category, u.option_column, u.value FROM ({' UNION ALL '.join(rows)})),
mat AS (SELECT * FROM opt UNION ALL SELECT source, taxon, category, category || '__uncoded', (max(value) = 0)::INT FROM opt GROUP BY ALL)"""


MATRIX = _matrix_sql()


def matrix(t: Tables) -> DataFrame:
    """Long matrices of both sources, built from membership sets."""
    schema = local_table(t.spark, [(c, o) for o, c, *_ in OPTIONS], "category string, option_column string")
    out = None
    # A narrow table is one or two splits at any size; its rows unfold to many, so they are dealt out first.
    parts = t.part.select(F.col("p_partkey").alias("taxon"), "p_partkey", "p_size").repartition(t.parts("part", 20_000), "taxon")
    for i, source in enumerate(("one", "two")):
        species = parts
        species = species if i == 0 else species.where("p_partkey % 3 <> 1")
        held = F.array(*[F.when(F.expr(e[i]), F.lit(o)) for o, _, *e in OPTIONS])
        members = species.select("taxon", F.explode(F.array_compact(held)).alias("option_column"))
        long = mx.build_matrix(species.select("taxon"), members, schema, "taxon").withColumn("source", F.lit(source))
        out = long if out is None else out.unionByName(long)
    return out


@query("trait_matrix", "D27 A12", f"WITH {MATRIX} SELECT source, taxon, category, option_column, value FROM mat")
def trait_matrix(t: Tables) -> DataFrame:
    return matrix(t).select("source", "taxon", "category", "option_column", "value")


_WIDE = ", ".join(f"max(value) FILTER (option_column = '{o}' AND source = '{s}') AS \"{o}__{s}\"" for o, *_ in OPTIONS for s in ("one", "two"))


@query("merged_matrix", "J6", f"WITH {MATRIX} SELECT taxon, count(DISTINCT source) AS n_sources, {_WIDE} FROM mat GROUP BY taxon")
def merged_matrix(t: Tables) -> DataFrame:
    long = matrix(t)
    tagged = long.withColumn("option_column", F.concat_ws("__", "option_column", "source"))
    columns = [f"{o}__{s}" for o, *_ in OPTIONS for s in ("one", "two")]
    return mx.widen(tagged, "taxon", columns).join(mx.species_index(long, "taxon"), "taxon")


@query(
    "merge_report",
    "J6",
    f"WITH {MATRIX} SELECT source, count(DISTINCT taxon) AS n_taxa, count(DISTINCT option_column) AS n_columns FROM mat GROUP BY source",
)
def merge_report(t: Tables) -> DataFrame:
    return mx.merge_report(matrix(t), "taxon")


CONSENSUS = f"""{MATRIX}, off AS (SELECT source, taxon, category FROM mat WHERE option_column LIKE '%\\_\\_uncoded' ESCAPE '\\' AND value = 1),
con AS (SELECT o.taxon, o.category, o.option_column, CASE WHEN max(o.value) = 1 THEN 1 WHEN count(*) FILTER (off.taxon IS NULL) > 0 THEN 0 END AS consensus, count(*) AS n_sources
 FROM opt o LEFT JOIN off ON off.source = o.source AND off.taxon = o.taxon AND off.category = o.category GROUP BY ALL)"""


@query("consensus_matrix", "D26", f"WITH {CONSENSUS} SELECT taxon, category, option_column, consensus, n_sources FROM con")
def consensus_matrix(t: Tables) -> DataFrame:
    return mx.consensus(matrix(t), "taxon")


TOKENS = (
    ("position", "leaf_arrangement", "leaf_arrangement__alternate", "alternate"), ("position", "leaf_arrangement", "leaf_arrangement__opposite", "opposite"),
    ("position", "leaf_arrangement", "leaf_arrangement__whorled_or_clustered", "whorled"), ("latex", "latex", "latex__present", "present"), ("latex", "latex", "latex__absent", "absent"),
)
ALLOWED = f"""{MATRIX}, tk(trait, option_column, token) AS (VALUES {', '.join(f"('{a}', '{o}', '{k}')" for a, _, o, k in TOKENS)}),
allow AS (SELECT taxon, trait, CASE WHEN max(value) = 0 THEN NULL ELSE list_sort(list(token) FILTER (value = 1)) END AS allowed FROM opt JOIN tk USING (option_column) WHERE source = 'one' GROUP BY ALL)"""


def allowed(t: Tables) -> DataFrame:
    tokens = local_table(t.spark, list(TOKENS), "trait string, category string, option_column string, token string")
    return mx.allowed_values(matrix(t).where("source = 'one'"), "taxon", tokens)


@query("allowed_values", "J8", f"WITH {ALLOWED} SELECT taxon, trait, array_to_string(allowed, '|') AS allowed FROM allow")
def allowed_values(t: Tables) -> DataFrame:
    return allowed(t).withColumn("allowed", F.when(F.col("allowed").isNotNull(), F.array_join("allowed", "|")))


VALUES = """val AS (SELECT l_returnflag AS source, l_partkey AS taxon, l_orderkey AS specimen, u.trait, min(u.token) AS token FROM (SELECT *, unnest([
 {'trait': 'position', 'token': CASE WHEN l_quantity < 20 THEN 'alternate' WHEN l_quantity < 35 THEN 'opposite' WHEN l_quantity < 45 THEN 'whorled' END},
 {'trait': 'latex', 'token': CASE WHEN l_discount < 0.05 THEN 'present' ELSE 'absent' END}]) AS u FROM lineitem) GROUP BY ALL)"""


def trait_values(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    rows = F.array(
        F.struct(F.lit("position").alias("trait"), F.when(q < 20, "alternate").when(q < 35, "opposite").when(q < 45, "whorled").alias("token")),
        F.struct(F.lit("latex").alias("trait"), F.when(F.col("l_discount") < 0.05, "present").otherwise("absent").alias("token")),
    )
    return (
        t.spread("lineitem", "l_returnflag", "l_partkey", "l_orderkey", "l_quantity", "l_discount")
        .select(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("taxon"), F.col("l_orderkey").alias("specimen"), F.explode(rows).alias("u"))
        .groupBy("source", "taxon", "specimen", "u.trait")
        .agg(F.min("u.token").alias("token"))
    )


@query(
    "match_any_details",
    "J9",
    f"""WITH {ALLOWED}, {VALUES} SELECT source, trait, token, array_to_string(allowed, '|') AS allowed, list_contains(allowed, token) AS correct, count(*) AS n
FROM val JOIN allow USING (taxon, trait) WHERE token IS NOT NULL AND allowed IS NOT NULL GROUP BY ALL""",
)
def match_any_details(t: Tables) -> DataFrame:
    rows = mx.match_any(trait_values(t), allowed(t), ["taxon", "trait"]).withColumn("allowed", F.array_join("allowed", "|"))
    return rows.groupBy("source", "trait", "token", "allowed", "correct").agg(F.count(F.lit(1)).alias("n"))


def _match_any_sql() -> str:
    from specgrade.plans.agreement import kappa_sql

    return f"""WITH {ALLOWED}, {VALUES}, ma AS (SELECT source, trait, token AS value_a, allowed, allowed[1] AS value_b, list_contains(allowed, token) AS ok FROM val JOIN allow USING (taxon, trait)
 WHERE token IS NOT NULL AND allowed IS NOT NULL), {kappa_sql('(SELECT * FROM ma WHERE len(allowed) = 1)', 'source, trait')},
a AS (SELECT source, trait, count(*) AS n_compared, count(*) FILTER (ok) AS n_correct FROM ma GROUP BY ALL)
SELECT a.source, a.trait, a.n_compared, n_correct, round(n_correct / a.n_compared, 6) AS accuracy, coalesce(kap.n_compared, 0) AS n_kappa, round(cohen_kappa, 6) AS cohen_kappa FROM a LEFT JOIN kap USING (source, trait)"""


@query("match_any_accuracy", "D13", _match_any_sql())
def match_any_accuracy(t: Tables) -> DataFrame:
    return rounded(mx.match_any_accuracy(mx.match_any(trait_values(t), allowed(t), ["taxon", "trait"]), ["source", "trait"]))


# ---- graded records ----------------------------------------------------------------------

RAW_VALUES = """rawv AS MATERIALIZED (
 SELECT l_orderkey * 10 + l_linenumber AS specimen, min(l_partkey) AS taxon, 'leaf_arrangement' AS category, arg_min(CASE WHEN l_quantity < 15 THEN ' Alternate (spiral)'
  WHEN l_quantity < 30 THEN 'OPPOSITE' WHEN l_quantity < 35 THEN 'not observed' WHEN l_quantity < 40 THEN 'tufted' ELSE 'whorled or opposite' END, (l_partkey, l_suppkey, l_extendedprice)) AS raw FROM lineitem GROUP BY 1
 UNION ALL SELECT l_orderkey * 10 + l_linenumber, min(l_partkey), 'latex', arg_min(CASE WHEN l_tax < 0.03 THEN 'present' WHEN l_tax < 0.06 THEN 'absent' ELSE 'Not observed' END,
  (l_partkey, l_suppkey, l_extendedprice)) FROM lineitem GROUP BY 1)"""
GRADED = f"""{MATRIX}, {RAW_VALUES}, rule(o, option_column, category, word) AS (VALUES (0, 'leaf_arrangement__alternate', 'leaf_arrangement', 'alternate'), (1, 'leaf_arrangement__opposite', 'leaf_arrangement', 'opposite'),
 (2, 'leaf_arrangement__whorled_or_clustered', 'leaf_arrangement', 'whorled'), (3, 'latex__present', 'latex', 'present'), (4, 'latex__absent', 'latex', 'absent')),
hit AS MATERIALIZED (SELECT specimen, category, arg_min(option_column, o) AS chosen FROM rawv JOIN rule USING (category) WHERE lower(trim(raw)) NOT IN ('not observed', '') AND contains(lower(raw), word) GROUP BY ALL),
pr AS MATERIALIZED (SELECT v.specimen, v.taxon, v.category, r.option_column, CASE WHEN chosen IS NOT NULL THEN (chosen = r.option_column)::INT END AS predicted, contains(lower(raw), 'not observed') AS nobs
 FROM rawv v JOIN rule r USING (category) LEFT JOIN hit USING (specimen, category)),
unc AS MATERIALIZED (SELECT taxon, category, value = 1 AS uncoded FROM mat WHERE source = 'two' AND option_column = category || '__uncoded'),
rec0 AS (SELECT pr.*, m.value::DOUBLE AS ground_truth, coalesce(uncoded, true) AS uncoded FROM pr LEFT JOIN (SELECT * FROM opt WHERE source = 'two') m USING (taxon, option_column) LEFT JOIN unc ON unc.taxon = pr.taxon AND unc.category = pr.category),
rec AS MATERIALIZED (SELECT * FROM (SELECT *, CASE WHEN uncoded OR ground_truth IS NULL THEN 'skipped_uncoded' WHEN predicted IS NULL AND nobs THEN 'skipped_not_observed' WHEN predicted IS NULL THEN 'skipped_no_prediction'
 WHEN predicted = 1 AND ground_truth = 1 THEN 'correct' WHEN predicted = 1 THEN 'incorrect' END AS verdict FROM rec0) WHERE verdict IS NOT NULL)"""


def mapped(t: Tables, merged: bool = False) -> DataFrame:
    q, x = F.col("l_quantity"), F.col("l_tax")
    values = F.array(
        F.struct(
            F.lit("leaf_arrangement").alias("category"),
            F.when(q < 15, " Alternate (spiral)").when(q < 30, "OPPOSITE").when(q < 35, "not observed").when(q < 40, "tufted").otherwise("whorled or opposite").alias("raw"),
        ),
        F.struct(F.lit("latex").alias("category"), F.when(x < 0.03, "present").when(x < 0.06, "absent").otherwise("Not observed").alias("raw")),
    )
    raw = (
        t.spread("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax")
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("specimen"), "l_partkey", F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.explode(values).alias("u")
        )
        .groupBy("specimen", "u.category")
        .agg(F.min("l_partkey").alias("taxon"), F.min_by("u.raw", "pos").alias("raw"))
    )
    truth = matrix(t).where("source = 'two'")
    if merged:
        # A merged matrix: the columns of each source, here at odds, beside those of the consensus.
        apart = truth.withColumn("option_column", F.concat("option_column", F.lit("__one"))).withColumn("value", 1 - F.col("value"))
        truth = truth.withColumn("option_column", F.concat("option_column", F.lit("__consensus"))).unionByName(apart)
    coded = gr.attach_matrix(raw, truth, "taxon", matrix_suffix(["leaf_margin__entire__consensus"]) if merged else "")
    return gr.map_predictions(coded, gr.rule_table(t.spark), ["specimen", "taxon", "options", "uncoded"])


def graded(t: Tables) -> DataFrame:
    return gr.grade_traits(mapped(t))


@query(
    "option_predictions",
    "R10",
    f"WITH {GRADED} SELECT category, option_column, predicted, nobs AS not_observed, count(*) AS n FROM pr GROUP BY ALL",
)
def option_predictions(t: Tables) -> DataFrame:
    return mapped(t).groupBy("category", "option_column", "predicted", "not_observed").agg(F.count(F.lit(1)).alias("n"))


@query("graded_records", "J18", f"WITH {GRADED} SELECT specimen, taxon, option_column, category, ground_truth, predicted, verdict FROM rec")
def graded_records(t: Tables) -> DataFrame:
    return graded(t).select("specimen", "taxon", "option_column", "category", "ground_truth", "predicted", "verdict")


@query("graded_consensus", "J18 R24", f"WITH {GRADED} SELECT specimen, taxon, option_column, category, ground_truth, predicted, verdict FROM rec")
def graded_consensus(t: Tables) -> DataFrame:
    """Grades against the consensus columns of a merged matrix."""
    return gr.grade_traits(mapped(t, merged=True)).select("specimen", "taxon", "option_column", "category", "ground_truth", "predicted", "verdict")


_COUNTS = """count(*) FILTER (verdict = 'correct') AS n_correct, count(*) FILTER (verdict = 'incorrect') AS n_incorrect, count(*) FILTER (verdict = 'skipped_uncoded') AS n_skipped_uncoded,
 count(*) FILTER (verdict = 'skipped_no_prediction') AS n_skipped_no_pred, count(*) FILTER (verdict = 'skipped_not_observed') AS n_not_observed,
 count(*) FILTER (verdict IN ('correct', 'incorrect')) AS n_graded"""
OPTION_ACC = f"""oc AS (SELECT option_column, category, {_COUNTS}, count(DISTINCT specimen) FILTER (verdict IN ('correct', 'incorrect') AND ground_truth = 1) AS support FROM rec GROUP BY ALL),
oa AS (SELECT *, n_correct / nullif(n_graded, 0) AS accuracy, n_correct / nullif(n_graded, 0) AS precision, n_correct / nullif(support, 0) AS recall,
 support / (SELECT count(DISTINCT specimen) FROM rec WHERE verdict IN ('correct', 'incorrect')) AS prevalence FROM oc),
ob AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM oa)"""


@query(
    "option_accuracy",
    "D8",
    f"""WITH {GRADED}, {OPTION_ACC} SELECT option_column, category, n_correct, n_incorrect, n_skipped_uncoded, n_skipped_no_pred, n_not_observed, n_graded, round(accuracy, 6) AS accuracy, support,
 round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(prevalence, 6) AS prevalence FROM ob""",
)
def option_accuracy(t: Tables) -> DataFrame:
    return rounded(gr.option_accuracy(materialise(graded(t), "graded"), "specimen")).drop("n_specimens")


@query(
    "category_accuracy",
    "D9",
    f"""WITH {GRADED}, {OPTION_ACC}, v AS (SELECT category, specimen, ['correct', 'incorrect', 'skipped_not_observed', 'skipped_no_prediction', 'skipped_uncoded'][min(list_position(
 ['correct', 'incorrect', 'skipped_not_observed', 'skipped_no_prediction', 'skipped_uncoded'], verdict))] AS verdict FROM rec GROUP BY ALL),
c AS (SELECT category, {_COUNTS} FROM v GROUP BY category)
SELECT c.*, round(n_correct / nullif(n_graded, 0), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM ob WHERE ob.category = c.category) AS macro_f1 FROM c""",
)
def category_accuracy(t: Tables) -> DataFrame:
    rows = t.once("graded", lambda: graded(t))
    f1 = gr.category_macro_f1(gr.option_accuracy(rows, "specimen"))
    return rounded(gr.category_accuracy(rows, "specimen").join(f1, "category", "left"))


@query(
    "species_accuracy",
    "D9 D41",
    f"""WITH {GRADED}, v AS (SELECT taxon % 50 AS species, category, specimen, min(list_position(['correct', 'incorrect', 'skipped_not_observed', 'skipped_no_prediction', 'skipped_uncoded'], verdict)) AS b FROM rec GROUP BY ALL),
a AS (SELECT species, category, round(count(*) FILTER (b = 1) / nullif(count(*) FILTER (b <= 2), 0), 6) AS acc FROM v GROUP BY ALL)
SELECT species, max(acc) FILTER (category = 'latex') AS latex, max(acc) FILTER (category = 'leaf_arrangement') AS leaf_arrangement FROM a GROUP BY species""",
)
def species_accuracy(t: Tables) -> DataFrame:
    rows = t.shared("graded", lambda: graded(t)).withColumn("species", F.col("taxon") % 50)
    return mx.widen(rounded(gr.category_accuracy(rows, "specimen", "species")), "species", ["latex", "leaf_arrangement"], "category", "accuracy")


@query(
    "species_consistency",
    "D10",
    f"""WITH {GRADED}, ch AS (SELECT taxon % 50 AS species, category, specimen, min(option_column) FILTER (predicted = 1) AS p FROM rec GROUP BY ALL),
c AS (SELECT species, category, p, count(*) AS n, min(specimen) AS f FROM ch WHERE p IS NOT NULL GROUP BY ALL),
m AS (SELECT species, category, p AS mode_prediction, n AS n_agreeing FROM (SELECT *, row_number() OVER (PARTITION BY species, category ORDER BY n DESC, f) AS r FROM c) WHERE r = 1),
s AS (SELECT species, category, count(*) AS n_specimens, count(p) AS n_with_predictions FROM ch GROUP BY ALL)
SELECT species, category, n_specimens, n_with_predictions, mode_prediction, coalesce(n_agreeing, 0) AS n_agreeing, round(n_agreeing / nullif(n_with_predictions, 0), 6) AS agreement FROM s LEFT JOIN m USING (species, category)""",
)
def species_consistency(t: Tables) -> DataFrame:
    rows = graded(t).withColumn("species", F.col("taxon") % 50)
    return rounded(gr.species_consistency(rows, "species", "specimen"))


@query(
    "diagnostic_cells",
    "D37",
    f"""WITH {GRADED} SELECT category, option_column, CASE WHEN uncoded OR ground_truth IS NULL THEN 'uncoded' WHEN predicted IS NULL THEN 'no_prediction' WHEN predicted = 1 AND ground_truth = 1 THEN 'tp'
 WHEN predicted = 1 THEN 'fp' WHEN ground_truth = 1 THEN 'fn' ELSE 'tn' END AS status, count(*) AS n FROM rec0 GROUP BY ALL""",
)
def diagnostic_cells(t: Tables) -> DataFrame:
    cells = gr.diagnostic_cells(mapped(t))
    return cells.groupBy("category", "option_column", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "truth_shares",
    "D41",
    f"""WITH {GRADED} SELECT option_column, count(DISTINCT specimen) FILTER (ground_truth = 1) AS n, round(count(DISTINCT specimen) FILTER (ground_truth = 1) / count(DISTINCT specimen), 6) AS share FROM rec GROUP BY 1""",
)
def truth_shares(t: Tables) -> DataFrame:
    per = graded(t).groupBy("option_column", "specimen").agg(F.max((F.col("ground_truth") == 1).cast("int")).alias("one"))
    return rounded(reports.share_of_total(per, "option_column", F.count(F.when(F.col("one") == 1, 1)), F.count(F.lit(1))))


@query(
    "matrix_flavours",
    "R24",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'merged' WHEN p_size % 3 = 1 THEN 'cl' || p_partkey ELSE 'table' END AS label, CASE WHEN p_size % 3 = 0 THEN '__consensus' ELSE '' END AS suffix FROM part""",
)
def matrix_flavours(t: Tables) -> DataFrame:
    from specgrade.sources.tables import source_label

    m = F.col("p_size") % 3
    path = F.when(m == 0, F.concat(F.lit("/m/Merged_"), "p_partkey", F.lit(".csv"))).when(m == 1, F.concat(F.lit("/m/key_cl"), "p_partkey", F.lit("_trait.csv"))).otherwise("/m/table.csv")
    suffix = F.when(source_label(path) == "merged", matrix_suffix(["leaf_margin__entire__consensus"])).otherwise(matrix_suffix(["leaf_margin__entire"]))
    return t.part.select("p_partkey", source_label(path).alias("label"), suffix.alias("suffix"))


# ---- identification ----------------------------------------------------------------------

IDENT = """idr AS (SELECT o_orderkey, c_custkey::VARCHAR AS specimen_id, r_name AS true_family, n_name AS true_genus, n_name || ' ' || lower(c_mktsegment) AS true_species, lower(c_mktsegment) AS epithet,
 CASE WHEN o_orderkey % 7 = 0 THEN 'ASIA' ELSE ' ' || lower(r_name) END AS pred_family, CASE WHEN o_orderkey % 5 = 0 THEN 'NATION_1' WHEN o_orderkey % 11 = 0 THEN NULL ELSE n_name END AS pred_genus,
 CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment WHEN o_orderkey % 3 = 1 THEN n_name || ' ' || c_mktsegment ELSE 'NATION_2 building' END AS pred_species,
 o_orderstatus = 'P' AND o_orderkey % 4 = 0 AS stage_error, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS part
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cmp AS (SELECT *, coalesce(lower(trim(pred_family)), '') = lower(true_family) AS fo, coalesce(lower(trim(pred_genus)), '') = lower(true_genus) AS go,
 CASE WHEN NOT contains(trim(pred_species), ' ') THEN lower(trim(pred_species)) = epithet ELSE lower(trim(pred_species)) = lower(true_species) END AS so FROM idr)"""


def identifications(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    joined = (
        t.orders.join(growing(t.customer), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        "o_orderkey", F.col("c_custkey").cast("string").alias("specimen_id"),
        F.col("r_name").alias("true_family"), F.col("n_name").alias("true_genus"),
        F.concat_ws(" ", "n_name", F.lower("c_mktsegment")).alias("true_species"), F.lower("c_mktsegment").alias("epithet"),
        F.when(k % 7 == 0, "ASIA").otherwise(F.concat(F.lit(" "), F.lower("r_name"))).alias("pred_family"),
        F.when(k % 5 == 0, "NATION_1").when(k % 11 == 0, None).otherwise(F.col("n_name")).alias("pred_genus"),
        F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, F.concat_ws(" ", "n_name", "c_mktsegment")).otherwise("NATION_2 building").alias("pred_species"),
        ((F.col("o_orderstatus") == "P") & (k % 4 == 0)).alias("stage_error"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("part"),
    )


@query("compared_taxonomy", "R11", f"WITH {IDENT} SELECT o_orderkey, fo AS family_correct, go AS genus_correct, so AS species_correct FROM cmp")
def compared_taxonomy(t: Tables) -> DataFrame:
    c = F.col
    ok = tx.compare_taxonomy(c("true_family"), c("true_genus"), c("true_species"), c("pred_family"), c("pred_genus"), c("pred_species"))
    return identifications(t).select("o_orderkey", ok.alias("ok")).select("o_orderkey", "ok.*")


@query(
    "graded_identifications",
    "J19",
    f"""WITH {IDENT} SELECT o_orderkey, stage_error, CASE WHEN NOT stage_error THEN pred_genus END AS pred_genus, fo AND NOT stage_error AS family_correct,
 go AND NOT stage_error AS genus_correct, so AND NOT stage_error AS species_correct FROM cmp""",
)
def graded_identifications(t: Tables) -> DataFrame:
    return idn.grade_identification(identifications(t)).select(
        "o_orderkey", "stage_error", "pred_genus", "family_correct", "genus_correct", "species_correct"
    )


@query(
    "identification_metrics",
    "D11",
    f"""WITH {IDENT}, lg AS (SELECT part, 'family' AS rank, lower(true_family) AS a, coalesce(lower(trim(pred_family)), '') AS b, fo AS ok FROM cmp WHERE NOT stage_error
 UNION ALL SELECT part, 'genus', lower(true_genus), coalesce(lower(trim(pred_genus)), ''), go FROM cmp WHERE NOT stage_error
 UNION ALL SELECT part, 'species', lower(true_species), coalesce(lower(trim(pred_species)), ''), so FROM cmp WHERE NOT stage_error),
g AS (SELECT 'all' AS part_name, rank, a, b, ok FROM lg UNION ALL SELECT part, rank, a, b, ok FROM lg WHERE part IS NOT NULL),
l AS (SELECT part_name, rank, a AS l, 1 AS ta, 0 AS tb, (a = b)::INT AS tab FROM g UNION ALL SELECT part_name, rank, b, 0, 1, 0 FROM g),
c AS (SELECT part_name, rank, l, sum(ta) AS nt, sum(tb) AS np, sum(tab) AS nb FROM l GROUP BY ALL),
m AS (SELECT *, coalesce(nb / nullif(np, 0), 0) AS p, coalesce(nb / nullif(nt, 0), 0) AS r, 2 * nb / (np + nt) AS f FROM c),
s AS (SELECT part_name, rank, avg(f) AS mf, sum(f * nt) / sum(nt) AS wf, avg(p) AS mp, avg(r) AS mr, sum(p * nt) / sum(nt) AS wp, sum(r * nt) / sum(nt) AS wr FROM m GROUP BY ALL),
a AS (SELECT part_name, rank, avg(ok::INT) AS acc, count(*) AS n FROM g GROUP BY ALL),
e AS (SELECT 'all' AS part_name, count(*) FILTER (stage_error) AS e FROM cmp UNION ALL SELECT part, count(*) FILTER (stage_error) FROM cmp WHERE part IS NOT NULL GROUP BY 1)
SELECT part_name, rank, round(acc, 6) AS accuracy, n AS n_graded, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall,
 round(wp, 6) AS weighted_precision, round(wr, 6) AS weighted_recall, e AS n_stage_error FROM a JOIN s USING (part_name, rank) JOIN e USING (part_name)""",
)
def identification_metrics(t: Tables) -> DataFrame:
    return rounded(idn.identification_metrics(idn.grade_identification(identifications(t)), "part"))


CORR = """corr AS (SELECT specimen_id, rank, arg_max({'o': original, 'c': canonical, 'k': category}, pos) AS v FROM (
 SELECT o_custkey::VARCHAR AS specimen_id, CASE o_orderkey % 4 WHEN 0 THEN 'family' WHEN 1 THEN 'genus' WHEN 2 THEN 'species' ELSE 'subspecies' END AS rank, o_orderkey AS pos,
 CASE o_orderkey % 4 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'nation_1' ELSE 'NATION_2 building' END AS original, CASE o_orderkey % 4 WHEN 0 THEN r_name WHEN 1 THEN n_name ELSE lower(c_mktsegment) END AS canonical,
 CASE o_orderkey % 5 WHEN 0 THEN 'typo' WHEN 1 THEN 'variant' WHEN 2 THEN 'synonym' WHEN 3 THEN 'guess' ELSE 'typo' END AS category
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 WHERE rank <> 'subspecies' AND category <> 'guess' GROUP BY ALL)"""


def corrections(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    joined = (
        t.orders.join(growing(t.customer), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    m, c = k % 4, k % 5
    rows = joined.select(
        F.concat(F.lit(" "), "o_custkey").alias("specimen_id"),
        F.when(m == 0, "Family").when(m == 1, "genus").when(m == 2, "species ").otherwise("subspecies").alias("rank"),
        F.when(m == 0, "ASIA").when(m == 1, "nation_1").otherwise("NATION_2 building").alias("original"),
        F.when(m == 0, F.col("r_name")).when(m == 1, F.col("n_name")).otherwise(F.lower("c_mktsegment")).alias("canonical"),
        F.when(c == 1, "Variant").when(c == 2, "synonym").when(c == 3, "guess").otherwise("typo").alias("category"),
        k.alias("pos"),
    )
    return idn.corrections_table(rows, "pos")


@query(
    "corrections",
    "A16",
    f"WITH {CORR} SELECT specimen_id, rank, v.o AS original, v.c AS canonical, v.k AS category FROM corr",
)
def correction_rows(t: Tables) -> DataFrame:
    return corrections(t)


HUMAN = f"""{IDENT}, {CORR}, fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY specimen_id ORDER BY o_orderkey) AS rn FROM cmp) WHERE rn = 1),
hl AS (SELECT specimen_id, 'family' AS rank, fo AS raw, pred_family AS pred, true_family AS truth FROM fst UNION ALL SELECT specimen_id, 'genus', go, pred_genus, true_genus FROM fst
 UNION ALL SELECT specimen_id, 'species', so, pred_species, epithet FROM fst),
hg AS (SELECT hl.*, v.k AS category, NOT raw AND v IS NOT NULL AND lower(v.o) = coalesce(lower(trim(pred)), '') AND lower(v.c) = lower(truth) AS credit FROM hl LEFT JOIN corr USING (specimen_id, rank))"""


def human(t: Tables) -> DataFrame:
    rows = identifications(t).withColumn("anonymous_id", F.col("specimen_id")).withColumn("true_species", F.col("epithet"))
    return idn.human_identifications(rows, "o_orderkey")


@query(
    "credited_identifications",
    "J15",
    f"""WITH {HUMAN} SELECT specimen_id, rank, raw AS raw_correct, raw OR coalesce(credit, false) AS corrected, CASE WHEN credit THEN category END AS credited_category FROM hg""",
)
def credited_identifications(t: Tables) -> DataFrame:
    return idn.grade_with_corrections(human(t), corrections(t)).drop("anonymous_id")


@query(
    "identification_accuracy",
    "D12",
    f"""WITH {HUMAN} SELECT rank, count(*) AS n_graded, round(avg(raw::INT), 6) AS accuracy, round(avg((raw OR coalesce(credit, false))::INT), 6) AS corrected_accuracy,
 count(*) FILTER (credit AND category = 'typo') AS n_typo, count(*) FILTER (credit AND category = 'variant') AS n_variant, count(*) FILTER (credit AND category = 'synonym') AS n_synonym FROM hg GROUP BY rank""",
)
def identification_accuracy(t: Tables) -> DataFrame:
    return rounded(idn.identification_accuracy(idn.grade_with_corrections(human(t), corrections(t))))


@query(
    "stale_corrections",
    "J15",
    f"""WITH {HUMAN} SELECT specimen_id, rank, corr.v.k AS category FROM corr LEFT JOIN hl USING (specimen_id, rank) WHERE hl.specimen_id IS NULL OR lower(corr.v.o) <> coalesce(lower(trim(pred)), '')""",
)
def stale_corrections(t: Tables) -> DataFrame:
    firsts = human(t)
    originals = firsts.select(
        "specimen_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"pred_{r}").alias("pred")) for r in ("family", "genus", "species")])).alias("o")
    ).select("specimen_id", "o.*")
    return idn.stale_corrections(corrections(t), originals).select("specimen_id", "rank", "category")
