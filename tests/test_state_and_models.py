"""Stored models, cross-validation folds, the feature cache, table functions, episodes, keyed stream state."""

import random
from uuid import uuid4

import pytest
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from specgrade.operators import classmetrics as cm, grading as gr, splitting as sp, stages as st
from specgrade.operators.estimator import Accuracy, CentroidClassifier, CentroidModel, group_folds
from specgrade.sources.features import FeatureCache, validity
from specgrade.streaming import progress as pg


@pytest.fixture(scope="module")
def support(spark):
    rng = random.Random(4)
    rows = [(i, i // 3, "abc"[i % 3], [rng.gauss(i % 3 * 3, 0.3), rng.gauss(-(i % 3), 0.3), 1.0]) for i in range(90)]
    return spark.createDataFrame(rows, "record_id long, individual long, label string, embedding array<double>")


@pytest.mark.parametrize("centred", [True, False])
def test_model_survives_saving(support, tmp_path, centred):
    classifier = CentroidClassifier(centred=centred)
    model = classifier.fit(support)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = CentroidModel.load(str(tmp_path / "model"))
    order = lambda m: sorted(map(tuple, m.transform(support).select("record_id", "prediction", "probability").collect()))
    assert order(again) == order(model) == order(classifier.fit(support))
    assert (again.uid, again.getOrDefault("centred")) == (model.uid, centred)
    classifier.save(str(tmp_path / "classifier"))
    assert CentroidClassifier.load(str(tmp_path / "classifier")).getOrDefault("centred") is centred


def test_cross_validation_by_group(support):
    folded = group_folds(support, "individual", 3)
    assert folded.groupBy("individual").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert sorted(r[1] for r in folded.select("individual", "fold").distinct().groupBy("fold").count().collect()) == [10, 10, 10]
    classifier = CentroidClassifier()
    grid = ParamGridBuilder().addGrid(classifier.centred, [True, False]).build()
    found = CrossValidator(estimator=classifier, estimatorParamMaps=grid, evaluator=Accuracy(), numFolds=3, foldCol="fold").fit(folded)
    assert isinstance(found, CrossValidatorModel) and max(found.avgMetrics) > 0.9
    assert isinstance(found.bestModel, CentroidModel)


def test_cache_replaces_changed_rows_and_joins_without_shuffling_the_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(embedding=[[3.0, 4.0]] * len(pdf))

    name = f"cache_{uuid4().hex}"
    cache = FeatureCache(spark, name, str(tmp_path / name), ("path",), "path string, label string, embedding array<double>", 4)
    stamp = lambda rows: spark.createDataFrame(rows, "path string, label string, size long").withColumn("validity", validity("m", True, "label", "size")).drop("size")
    first = stamp([("a", "x", 1), ("b", "x", 1), ("b", "x", 1), (None, "x", 1)])
    cache.extend(first.where("path is not null"), embed)
    assert calls.value == 2
    cache.extend(first.where("path is not null"), embed)
    assert calls.value == 2
    changed = stamp([("a", "y", 1), ("b", "x", 2), ("c", None, 1)])
    cache.extend(changed, embed)
    assert calls.value == 5
    assert sorted(r["path"] for r in cache.lookup(changed).collect()) == ["a", "b", "c"]
    assert cache.lookup(first).where("path = 'b'").count() == 2
    assert cache.compacted(changed, name + "_new", str(tmp_path / (name + "_new"))).open().count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = cache.missing(changed)._jdf.queryExecution().sparkPlan()
    plan = cache.missing(changed)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cached = plan[plan.rindex("- Exchange") if "Bucketed: true" not in plan else plan.rindex("Sort ["):]
    assert "Bucketed: true" in plan and "Exchange" not in cached, plan


def test_table_function_sees_a_specimen_once(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None), (None, 1, "n")], "k long, pos int, v string").repartition(3)

    def describe(seen):
        yield "all", "".join(r.v or "-" for r in seen)
        if len(seen) > 1:
            yield "many", None

    got = st.values_from_table_function(rows, "k", describe, "pos").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "all", "ab"), (1, "many", None), (2, "all", "-"), (None, "all", "n")]
    assert st.values_from_table_function(rows.limit(0), "k", describe, "pos").collect() == []


def test_episodes_equal_a_full_ranking_and_cut_the_join(spark):
    df = spark.range(20_000).select(F.col("id").alias("record_id"), F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("label"))
    got = sp.sample_episodes(df, 12, n_way=3, k_shot=2, n_query=3)
    rows = [tuple(r) for r in df.collect()]
    by_label = {}
    for key, label in rows:
        by_label.setdefault(label, []).append(key)
    from hashlib import md5

    h = lambda *x: md5(":".join(map(str, x)).encode()).hexdigest()
    want = set()
    for e in range(12):
        ways = sorted(by_label, key=lambda c: (h(42, e, c), c))[:3]
        for c in ways:
            for pos, key in enumerate(sorted(by_label[c], key=lambda k: (h(42, e, k), k))[:5], 1):
                want.add((e, "support" if pos <= 2 else "query", c, key, pos))
    assert {tuple(r) for r in got.collect()} == want
    # 36 pairs want 5 rows each; the stored rows of the join are a few times that, not 12 x 15,000.
    stored = [f for f in got.inputFiles() if "/first-" in f]
    assert stored and spark.read.parquet(*stored).count() < 36 * 5 * 8


def test_short_episodes_are_topped_up(spark, monkeypatch):
    # A threshold that is far too low for all pairs: everything comes from the second pass.
    df = spark.range(3000).select(F.col("id").alias("record_id"), (F.col("id") % 3).cast("string").alias("label"))
    want = sorted(map(tuple, sp.sample_episodes(df, 4, k_shot=3, n_query=2).collect()))
    monkeypatch.setattr(sp, "EXTRA", -0.9)
    assert sorted(map(tuple, sp.sample_episodes(df, 4, k_shot=3, n_query=2).collect())) == want


def test_top_k_is_null_below_k_classes(spark):
    ranked = spark.createDataFrame([("m", 1, 1, "a", "a", 3), ("n", 2, 1, "b", "c", 6)], "by string, key int, pos int, guess string, truth string, classes int")
    got = {r["by"]: r["top5_accuracy"] for r in cm.top_k_accuracy(ranked, "key", "pos", "guess", "truth", 5, "by", F.col("classes")).collect()}
    assert got == {"m": None, "n": 0.0}
    assert cm.top_k_accuracy(ranked, "key", "pos", "guess", "truth", 5).first()[0] == 0.5


def test_score_rollup_has_one_exchange(spark):
    rows = [("m1", "t", "exact_match", "exact"), ("m1", "t", "mismatch", "exact"), ("m2", "u", "abstention", "exact"), (None, "t", "exact_match", "exact")]
    df = spark.createDataFrame(rows, "model string, trait string, result string, match_type string")
    out = gr.score_rollup(df, "model", "trait")
    got = {(r["model"], r["trait"]): (r["n_scored"], r["accuracy"]) for r in out.collect()}
    assert got == {("m1", "t"): (2, 0.5), ("m2", "u"): (1, 0.0), (None, "t"): (1, 1.0), ("m1", "all"): (2, 0.5), ("m2", "all"): (1, 0.0), (None, "all"): (1, 1.0), ("all", "all"): (4, 2 / 3)}
    plan = gr.score_rollup(df, "model", "trait")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Expand"), plan.count("Exchange")) == (1, 1)


def stream(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return pg.result_stream(spark, folder, spark.createDataFrame([], schema).schema, "*.parquet", files_per_trigger=1)


def test_bounded_state_counts_repeats_once_and_restarts(spark, tmp_path):
    schema = "key long, v string"
    folder, path, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    rows = stream(spark, folder, [[(1, "a"), (2, "b"), (2, "c")], [(1, "late"), (3, "d")]], schema)
    grade = lambda batch: batch
    pg.grade_incrementally(rows, grade, ["key"], path, log, remember="0 seconds")
    assert sorted(r["key"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    # A restart in mid-stream reads only what is new, and still knows what was graded.
    rows = stream(spark, folder, [[(2, "again"), (4, "e")]], schema)
    pg.grade_incrementally(rows, grade, ["key"], path, log, remember="0 seconds")
    assert sorted(r["key"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]
    # So does a run with a checkpoint of its own.
    pg.grade_incrementally(rows, grade, ["key"], path, log + "2", remember="1 day")
    assert spark.read.parquet(path).count() == 4


def test_stalls_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    events = [("a", 0), ("a", 30), ("b", 5), ("a", 200), ("b", 190), ("c", 600)]
    want = [("a", 30, 2), ("a", 200, 1), ("b", 5, 1), ("b", 190, 1)]
    for name, order in (("sorted", sorted(events, key=lambda e: e[1])), ("mixed", [events[i] for i in (3, 0, 4, 2, 1, 5)])):
        rows = stream(spark, str(tmp_path / name), [[(c, at(m))] for c, m in order], "condition string, ts string")
        got = pg.stalled(rows, "condition", "ts", 60 * 60_000, "200 minutes").collect()
        assert sorted((r["condition"], r["last_seen"].hour * 60 + r["last_seen"].minute, r["n"]) for r in got) == sorted(want), name


def test_tied_lines_go_by_their_place_in_the_table(spark, tmp_path):
    from specgrade.plans.conditions import table_function_values
    from specgrade.plans.registry import Tables

    rng, want = random.Random(8), {}
    for part in range(6):
        rows = [(rng.randrange(150), 1, float(rng.randrange(2)), 0.5, rng.choice("ANR")) for _ in range(400)]
        for order, _, quantity, _, flag in rows:
            if order not in want or quantity > want[order][0]:
                want[order] = (quantity, flag)
        lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string").coalesce(1)
        lines.write.parquet(str(tmp_path / "one"), mode="overwrite")
        file = next((tmp_path / "one").glob("*.parquet"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        (tmp_path / "lineitem.parquet" / f"part-{part}.parquet").write_bytes(file.read_bytes())
    got = table_function_values(Tables(spark, str(tmp_path))).where("trait = 'largest'").collect()
    assert {r.l_orderkey: r.token for r in got} == {k: flag for k, (_, flag) in want.items()}


def test_key_pages_are_parsed_in_pieces(spark):
    from specgrade.operators import answers as an

    n = 2 * an.PAGES_AT_ONCE + 7
    page = '<div id="key-taxa"><div class="family-div">F</div><div class="taxon-div"><a href="?taxon={0}"><i>T{0}</i></a></div></div>'
    pages = spark.createDataFrame([(i, page.format(i) if i % 5 else None, i * 2) for i in range(n)], "id long, html string, twice long").coalesce(1)
    got = an.parse_key_pages(pages).collect()
    assert [(r.id, r.twice, r.species_count, [tuple(t) for t in r.taxa]) for r in got] == [(i, i * 2, 0, [(1, i, f"T{i}", "F")] if i % 5 else []) for i in range(n)]
