"""Runs and conditions: accuracy tables, completeness, resume, streams, stages, sinks.

Orders are results: the priority is the condition, the customer's taxonomy the truth.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from specgrade.functions.columns import growing
from specgrade.operators import conditions as cd, stages as st
from specgrade.operators.agreement import mcnemar
from specgrade.plans.agreement import rounded
from specgrade.plans.fewshot import CENTER_IMAGES, FIT, IMG, PARTS, SCORES, split_images
from specgrade.plans import grading  # noqa: F401  (defines tables of the report)
from specgrade.plans.registry import REGISTRY, Tables, query
from specgrade.session import new_path
from specgrade.sources.tables import read_condition_results, write_tables
from specgrade.streaming import progress as pg

# One result per (customer, condition): the latest order of the customer in that priority.
RES = """res AS (SELECT o_custkey AS specimen, o_orderpriority AS condition, r_name AS tf, n_name AS tg, n_name || ' ' || c_mktsegment AS ts, o_orderkey AS k,
 o_orderkey % 6 = 0 AS skipped, CASE WHEN o_orderkey % 9 = 0 THEN 'timeout' END AS err,
 CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ASIA' ELSE r_name END AS rf, CASE WHEN o_orderkey % 4 = 0 THEN 'nation_3' ELSE lower(n_name) END AS rg, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE n_name || ' ' || c_mktsegment END AS rs,
 CASE WHEN o_orderkey % 8 < 3 THEN NULL ELSE o_orderstatus END AS conf, o_orderkey % 10 = 0 AS vskip,
 CASE WHEN o_orderkey % 3 = 0 THEN [r_name, 'ASIA', 'EUROPE'] WHEN o_orderkey % 3 = 1 THEN ['AFRICA', 'AMERICA', r_name, 'x'] ELSE ['a', 'b', 'c', 'd', r_name] END AS vf
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM orders)
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE rn = 1),
fin AS (SELECT *, CASE WHEN NOT skipped AND err IS NULL AND rf <> '' THEN rf WHEN NOT vskip THEN vf[1] END AS final FROM res)"""


def results(t: Tables) -> DataFrame:
    return t.shared("results", lambda: latest_results(t))


def latest_results(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    latest = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("o")).select(
        "o_custkey", "o_orderpriority", "o.*"
    )
    rows = (
        latest.join(growing(t.customer), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    fam, gen, sp = F.col("r_name"), F.col("n_name"), F.concat_ws(" ", "n_name", "c_mktsegment")
    top = (
        F.when(k % 3 == 0, F.array(fam, F.lit("ASIA"), F.lit("EUROPE")))
        .when(k % 3 == 1, F.array(F.lit("AFRICA"), F.lit("AMERICA"), fam, F.lit("x")))
        .otherwise(F.array(*[F.lit(x) for x in "abcd"], fam))
    )
    return rows.select(
        F.col("o_custkey").alias("specimen_id"), F.col("o_orderpriority").alias("condition"), k.alias("k"),
        (k % 6 == 0).alias("reason_skipped"), F.when(k % 9 == 0, "timeout").alias("reason_error"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "ASIA").otherwise(fam).alias("reason_family"),
        F.when(k % 4 == 0, "nation_3").otherwise(F.lower(gen)).alias("reason_genus"),
        F.when(k % 3 != 0, sp).alias("reason_species"),
        F.when(k % 8 >= 3, F.col("o_orderstatus")).alias("confidence"),
        (k % 10 == 0).alias("visual_skipped"), top.alias("visual_family"),
        F.array(gen).alias("visual_genus"), F.array().cast("array<string>").alias("visual_species"),
        fam.alias("true_family"), gen.alias("true_genus"), sp.alias("true_species"),
    )


@query(
    "condition_accuracy",
    "D20",
    f"""WITH {RES} SELECT condition, round(count(*) FILTER (final = tf) / count(*), 6) AS final_top1, round(count(*) FILTER (vf[1] = tf) / count(*), 6) AS visual_top1,
 round(count(*) FILTER (list_position(vf, tf) <= 3) / count(*), 6) AS visual_top3, round(count(*) FILTER (list_contains(vf[:5], tf)) / count(*), 6) AS visual_top5, count(*) AS n FROM fin GROUP BY 1""",
)
def condition_accuracy(t: Tables) -> DataFrame:
    return rounded(cd.accuracy_by_condition(results(t)))


@query(
    "rank_accuracy",
    "D20",
    f"""WITH {RES}, p AS (SELECT *, CASE WHEN NOT skipped AND err IS NULL THEN rf ELSE vf[1] END AS pf, CASE WHEN NOT skipped AND err IS NULL THEN rg ELSE tg END AS pg, CASE WHEN NOT skipped AND err IS NULL THEN coalesce(rs, '') ELSE '' END AS ps FROM res)
SELECT condition, round(count(*) FILTER (lower(pf) = lower(tf)) / count(*), 6) AS family, round(count(*) FILTER (pg <> '' AND lower(pg) = lower(tg)) / count(*), 6) AS genus,
 round(count(*) FILTER (ps <> '' AND lower(ps) = lower(ts)) / count(*), 6) AS species, count(*) AS n FROM p GROUP BY 1""",
)
def rank_accuracy(t: Tables) -> DataFrame:
    return rounded(cd.accuracy_by_rank(results(t)))


CONDITIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "family_accuracy",
    "D20",
    f"WITH {RES} SELECT tf AS family, "
    + ", ".join(f"""round(avg(coalesce(final = tf, false)::INT) FILTER (condition = '{c}'), 6) AS "{c}\"""" for c in CONDITIONS)
    + " FROM fin GROUP BY 1",
)
def family_accuracy(t: Tables) -> DataFrame:
    return rounded(cd.accuracy_by_family(results(t), CONDITIONS))


@query(
    "confidence_distribution",
    "D23",
    f"WITH {RES} SELECT condition, coalesce(conf, 'unknown') AS confidence, count(*) AS n FROM res WHERE NOT skipped GROUP BY ALL",
)
def confidence_distribution(t: Tables) -> DataFrame:
    return cd.confidence_distribution(results(t))


PAIR = f"""{RES}, a AS (SELECT specimen, tf, final FROM fin WHERE condition = '1-URGENT'), b AS (SELECT specimen, final AS fb FROM fin WHERE condition = '2-HIGH'),
pr AS (SELECT specimen, tf, final AS pa, fb AS pb, coalesce(final = tf, false) AS ao, coalesce(fb = tf, false) AS bo FROM a JOIN b USING (specimen))"""


@query(
    "impact_cases",
    "J14",
    f"WITH {PAIR} SELECT specimen AS specimen_id, tf AS truth, pa AS pred_a, pb AS pred_b, CASE WHEN ao THEN 'helped' ELSE 'hurt' END AS effect FROM pr WHERE ao <> bo",
)
def impact_cases(t: Tables) -> DataFrame:
    return cd.impact_cases(cd.paired_correctness(results(t), "1-URGENT", "2-HIGH")).drop("a_correct", "b_correct")


@query(
    "condition_change",
    "D16",
    f"""WITH {PAIR}, m AS (SELECT count(*) AS n_paired, count(*) FILTER (bo AND NOT ao) AS x, count(*) FILTER (ao AND NOT bo) AS y FROM pr)
SELECT n_paired, x AS b_only_correct, y AS a_only_correct, x + y AS n_discordant, round(power(abs(x - y) - 1, 2)::DOUBLE / (x + y), 5) AS chi2 FROM m""",
)
def condition_change(t: Tables) -> DataFrame:
    paired = cd.paired_correctness(results(t), "1-URGENT", "2-HIGH")
    return mcnemar(paired, [], "a_correct", "b_correct", always_chi_square=True).select(
        "n_paired", "b_only_correct", "a_only_correct", "n_discordant", F.round("chi2", 5).alias("chi2")
    )


STATUS = """stt AS (SELECT event_type AS condition, event_id, CASE WHEN event_id % 11 = 0 THEN 'empty' WHEN event_id % 7 = 0 OR value > 60 THEN 'error' ELSE 'valid' END AS status FROM events)"""


def result_files(events: DataFrame) -> DataFrame:
    text = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 7 == 0, F.expr("left(props, 4)")).otherwise(F.col("props"))
    return events.select("event_id", "ts", F.col("event_type").alias("condition"), text.alias("content"), (F.col("value") > 60).alias("failed"))


def _completeness_sql(expected: int) -> str:
    return f"""WITH {STATUS} SELECT condition, count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'empty') AS n_empty,
 count(*) AS n_total, greatest(0, {expected} - count(*)) AS n_missing FROM stt GROUP BY 1 UNION ALL SELECT 'planned', 0, 0, 0, 0, {expected}"""


def planned(t: Tables) -> DataFrame:
    """The conditions of the run: those of the events, and one that has no output yet."""
    return t.events.select(F.col("event_type").alias("condition")).union(t.spark.range(1).select(F.lit("planned")))


@query("run_completeness", "D24", _completeness_sql(2000))
def run_completeness(t: Tables) -> DataFrame:
    return cd.completeness(cd.run_status(result_files(t.events), "content", "failed"), 2000, conditions=planned(t))


def event_stream(t: Tables) -> DataFrame:
    """The events as result files that arrive in several batches; a fifth of them comes twice."""
    events = t.events
    arriving = new_path(t.spark, "arriving")
    events.repartition(6, "event_id").write.parquet(arriving)
    events.where("event_id % 5 = 0").repartition(2).write.mode("append").parquet(arriving)
    return pg.result_stream(t.spark, arriving, events.schema, "*.parquet", files_per_trigger=3)


@query("stream_progress", "S1", _completeness_sql(2000))
def stream_progress(t: Tables) -> DataFrame:
    files = cd.run_status(result_files(event_stream(t)), "content", "failed")
    return pg.progress(files, 2000, ["condition"], "ts", ["event_id"], planned(t))


@query(
    "stream_grading",
    "S2",
    "SELECT event_type AS condition, count(*) AS n, count(*) FILTER (value > 20) AS n_correct FROM events WHERE event_id % 11 <> 0 GROUP BY 1",
)
def stream_grading(t: Tables) -> DataFrame:
    path, log = new_path(t.spark, "graded"), new_path(t.spark, "graded-log")

    def grade(batch: DataFrame) -> DataFrame:
        return batch.where("event_id % 11 <> 0").select("event_id", F.col("event_type").alias("condition"), (F.col("value") > 20).alias("correct"))

    # The second run finds every key graded and adds nothing.
    pg.grade_incrementally(event_stream(t), grade, ["event_id"], path, log)
    pg.grade_incrementally(event_stream(t), grade, ["event_id"], path, f"{log}-again")
    return t.spark.read.parquet(path).groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("n_correct")
    )


@query(
    "stream_grading_bounded",
    "S2",
    "SELECT event_type AS condition, count(*) AS n, count(*) FILTER (value > 20) AS n_correct FROM events GROUP BY 1",
)
def stream_grading_bounded(t: Tables) -> DataFrame:
    """State that forgets at once: every repeat is found in the stored output."""
    path, log = new_path(t.spark, "graded"), new_path(t.spark, "graded-log")

    def grade(batch: DataFrame) -> DataFrame:
        return batch.select("event_id", F.col("event_type").alias("condition"), (F.col("value") > 20).alias("correct"))

    pg.grade_incrementally(event_stream(t), grade, ["event_id"], path, log, remember="0 seconds")
    return t.spark.read.parquet(path).groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("n_correct")
    )


def ordered_stream(t: Tables) -> DataFrame:
    """The events in files of five days each, which arrive one after the other."""
    arriving = new_path(t.spark, "arriving")
    period = F.floor(F.date_diff(F.col("ts"), F.lit("2024-01-01")) / 5)
    first, last = t.events.agg(F.min(period), F.max(period)).first()
    for p in range(first or 0, (last if last is not None else -1) + 1):
        t.events.where(period == p).coalesce(1).write.mode("append").parquet(arriving)
    return pg.result_stream(t.spark, arriving, t.events.schema, "*.parquet", files_per_trigger=1)


@query(
    "stream_windows",
    "S1",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS condition, count(*) AS n FROM events
GROUP BY 1, 2 HAVING day + INTERVAL 1 day <= (SELECT max(ts) FROM events) - INTERVAL 2 day""",
)
def stream_windows(t: Tables) -> DataFrame:
    """Arrivals per day, final once no row of the day can come any more."""
    out, log = new_path(t.spark, "windows"), new_path(t.spark, "windows-log")
    rows = pg.windowed_progress(ordered_stream(t).withColumn("status", F.lit("arrived")), ["event_type"], "ts", "1 day", "2 days")
    pg.run_to(rows, out, log)
    return t.spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("day"), F.col("event_type").alias("condition"), "n")


@query(
    "stream_stalls",
    "S1",
    """WITH e AS (SELECT event_type || '-' || user_id % 40 AS condition, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 5 hour THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY event_type || '-' || user_id % 40 ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY condition ORDER BY ts) AS spell FROM e)
SELECT condition, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY condition, spell HAVING max(ts) + INTERVAL 5 hour <= (SELECT max(ts) FROM events) - INTERVAL 2 day""",
)
def stream_stalls(t: Tables) -> DataFrame:
    """Each time a user group fell silent for five hours in one kind of event."""
    rows = ordered_stream(t).withColumn("condition", F.concat_ws("-", "event_type", F.col("user_id") % 40))
    return pg.stalled(rows, "condition", "ts", 5 * 3_600_000, "2 days").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query(
    "pending_specimens",
    "J16",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')",
)
def pending_specimens(t: Tables) -> DataFrame:
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "N", "empty").otherwise("valid").alias("status"))
    return cd.pending(t.orders.select("o_orderkey"), done, "o_orderkey", "status")


@query(
    "stage_timings",
    "D42",
    """SELECT event_type AS stage, count(*) AS n, round(sum(value), 2) AS total_ms, round(avg(value), 4) AS mean_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms,
 count(*) FILTER (event_id % 10 = 0) AS n_skipped, count(*) FILTER (event_id % 7 = 0) AS n_error FROM events GROUP BY 1""",
)
def stage_timings(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"), (F.col("event_id") % 10 == 0).alias("skipped"),
        F.when(F.col("event_id") % 7 == 0, "failed").alias("error"),
    )
    out = cd.stage_timings(rows, "stage", "elapsed_ms")
    return out.withColumn("total_ms", F.round("total_ms", 2)).withColumn("mean_ms", F.round("mean_ms", 4)).withColumn("p95_ms", F.round("p95_ms", 4))


@query(
    "specimen_timings",
    "D42",
    "SELECT user_id, round(sum(value), 2) AS total_elapsed_ms, count(*) AS n_stages FROM events GROUP BY 1",
)
def specimen_timings(t: Tables) -> DataFrame:
    return cd.specimen_timings(t.events, "user_id", "value").withColumn("total_elapsed_ms", F.round("total_elapsed_ms", 2))


@query(
    "condition_documents",
    "A9 A8 A23",
    f"""WITH {RES} SELECT condition, count(*) AS n, count(DISTINCT specimen) AS n_specimens, count(*) FILTER (vf[1] = tf) AS n_visual, count(*) FILTER (skipped) AS n_skipped FROM res GROUP BY 1""",
)
def condition_documents(t: Tables) -> DataFrame:
    """Result documents written as JSON per condition folder and read back."""
    root = new_path(t.spark, "documents")
    ranked = F.create_map(F.lit("family"), F.transform("visual_family", lambda v, i: F.struct(v.alias("rank_value"), (i + 1).alias("rank_position"))))
    docs = results(t).select(
        "condition", F.col("specimen_id").cast("string").alias("specimen_id"),
        F.struct(F.col("true_family").alias("family")).alias("ground_truth"),
        F.struct(
            F.struct(F.col("reason_skipped").alias("skipped"), F.col("reason_error").alias("error")).alias("reasoning"),
            F.struct(F.col("visual_skipped").alias("skipped"), F.struct(ranked.alias("predictions_by_rank")).alias("data")).alias("classification"),
        ).alias("stages"),
    )
    for name in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        part = docs.where(F.col("condition") == name).drop("condition")
        part.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/condition_{name[0]}")
    named = F.element_at(F.create_map(*[F.lit(x) for n in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for x in (n[0], n)]), F.col("condition"))
    # The writer puts one document per line.
    flat = cd.flatten_results(read_condition_results(t.spark, root, multiline=False)).withColumn("condition", named)
    return flat.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("specimen_id").alias("n_specimens"),
        F.count(F.when(F.try_element_at("visual_family", F.lit(1)) == F.col("true_family"), 1)).alias("n_visual"),
        F.count(F.when(F.col("reason_skipped"), 1)).alias("n_skipped"),
    )


# The tables of a report: query, column that the check adds up, file format.
REPORT_TABLES = (
    ("condition_accuracy", "n", "csv"), ("rank_accuracy", "species", "json"), ("family_accuracy", "1-URGENT", "parquet"), ("confidence_distribution", "n", "csv"),
    ("impact_cases", "specimen_id", "json"), ("condition_change", "chi2", "csv"), ("run_completeness", "n_total", "json"), ("stage_timings", "mean_ms", "csv"),
    ("specimen_timings", "total_elapsed_ms", "parquet"), ("overall_scores", "accuracy", "json"), ("trait_scores", "accuracy", "csv"), ("identification_metrics", "macro_f1", "csv"),
    ("trait_agreement", "cohen_kappa", "json"), ("category_accuracy", "n_correct", "csv"), ("species_accuracy", "latex", "parquet"), ("class_metrics", "f1", "csv"),
    ("label_support", "n", "json"),
)
_REPORT = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS table_name, count(*) AS n_rows, sum("{column}"::DECIMAL(18, 6))::VARCHAR AS total FROM ({REGISTRY[name].sql})""" for name, column, _ in REPORT_TABLES
)


@query("result_tables", "A23", _REPORT)
def result_tables(t: Tables) -> DataFrame:
    """All named result tables written as CSV, JSON or Parquet, then read back with their types."""
    folder, out = new_path(t.spark, "tables"), None
    t.once("results", lambda: latest_results(t))  # six of the tables read it
    for name, column, fmt in REPORT_TABLES:
        table = REGISTRY[name].run(t)
        write_tables({name: table}, folder, fmt, digits=6)
        reader = t.spark.read.option("header", True).option("escape", '"') if fmt == "csv" else t.spark.read
        read = reader.format(fmt).schema(table.schema).load(f"{folder}/{name}")
        total = F.sum(F.col(f"`{column}`").cast("decimal(18,6)")).cast("string")
        row = read.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), total.alias("total"))
        out = row if out is None else out.union(row)
    return out


@query(
    "user_stages",
    "U2",
    """SELECT stage, count(*) AS n, count(*) FILTER (skipped) AS n_skipped, count(*) FILTER (error IS NOT NULL) AS n_error FROM (
 SELECT o_orderkey, 'morphology' AS stage, false AS skipped, CASE WHEN o_orderkey % 10 = 0 THEN 'bad image' END AS error FROM orders
 UNION ALL SELECT o_orderkey, 'retrieval', true, NULL FROM orders
 UNION ALL SELECT o_orderkey, 'reasoning', false, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' END FROM orders
 UNION ALL SELECT o_orderkey, 'report', false, 'missing' FROM orders) GROUP BY 1""",
)
def user_stages(t: Tables) -> DataFrame:
    def morphology(df: DataFrame) -> DataFrame:
        bad = F.col("o_orderkey") % 10 == 0
        return df.select(
            "o_orderkey", F.when(~bad, F.to_json(F.struct("o_orderstatus"))).alias("data"), F.when(bad, "bad image").alias("error"), F.lit(1.0).alias("elapsed_ms")
        )

    def reasoning(df: DataFrame) -> DataFrame:
        seen = F.try_element_at("stages", F.lit("morphology"))["data"]
        return df.select("o_orderkey", F.concat(F.lit("read "), seen).alias("data"), F.lit(None).cast("string").alias("error"), F.lit(2.0).alias("elapsed_ms"))

    steps = [
        st.Stage("morphology", morphology), st.Stage("retrieval", reasoning),
        st.Stage("reasoning", reasoning, needs=("morphology",)), st.Stage("report", reasoning, needs=("reasoning", "retrieval")),
    ]
    out = st.run_stages(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", steps, skip={"retrieval"})
    return st.stage_rows(out, "o_orderkey").groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("skipped"), 1)).alias("n_skipped"), F.count("error").alias("n_error")
    )


@query(
    "function_values",
    "U1",
    """SELECT o_orderkey, trait, CASE WHEN o_orderkey % 2 = 0 THEN upper(trait) ELSE trait || '-' || o_orderkey % 3 END AS token FROM orders, (SELECT unnest(['margin', 'latex']) AS trait)""",
)
def function_values(t: Tables) -> DataFrame:
    def value(key: pd.Series, trait: pd.Series) -> pd.Series:
        return trait.str.upper().where(key % 2 == 0, trait + "-" + (key % 3).astype(str))

    return st.values_from_function(t.orders.select("o_orderkey"), "o_orderkey", ["margin", "latex"], value)


@query(
    "table_function_values",
    "U1",
    """WITH x AS (SELECT l_orderkey, count(*) AS n, arg_max(l_returnflag, (l_quantity, -l_linenumber)) AS f, min(l_linenumber) FILTER (l_tax = 0) AS z FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'lines' AS trait, n::VARCHAR AS token FROM x UNION ALL SELECT l_orderkey, 'largest', f FROM x UNION ALL SELECT l_orderkey, 'untaxed', z::VARCHAR FROM x WHERE z IS NOT NULL""",
)
def table_function_values(t: Tables) -> DataFrame:
    def describe(rows):
        yield "lines", str(len(rows))
        yield "largest", max(rows, key=lambda r: (r.l_quantity, -r.l_linenumber)).l_returnflag
        free = [r.l_linenumber for r in rows if r.l_tax == 0]
        if free:
            yield "untaxed", str(free[0])

    # Several lines of an order may have one number and quantity; the one that the table holds first comes first.
    place = F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("place")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", place)
    return st.values_from_table_function(lines, "l_orderkey", describe, "place")


@query(
    "estimator_predictions",
    "U3",
    f"""WITH {IMG}, {PARTS}, {FIT.format(label='species')}, {CENTER_IMAGES.format(part='test')}, {SCORES}
SELECT qid AS vec_id, rec.species, lab AS prediction, round(p, 5) AS probability FROM rk JOIN rec ON rec.vec_id = qid WHERE pos = 1""",
)
def estimator_predictions(t: Tables) -> DataFrame:
    from specgrade.operators.estimator import CentroidClassifier

    split = split_images(t)
    model = CentroidClassifier(label="species", vector="embedding", key="vec_id").fit(split.where("split_part = 'train'"))
    return model.transform(split.where("split_part = 'test'")).select(
        "vec_id", "species", "prediction", F.round("probability", 5).alias("probability")
    )
