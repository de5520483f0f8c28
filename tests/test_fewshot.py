import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgrade.functions.vectors import l2_normalize
from specgrade.operators import fewshot as fs, retrieval as rt
from specgrade.operators.estimator import CentroidClassifier

DIM = 48


@pytest.fixture(scope="module")
def separable(spark):
    """Three classes, each with its own block of ones, a little noise, unit length."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(30):
        v = rng.normal(0, 0.05, DIM)
        v[(i % 3) * 16 : (i % 3) * 16 + 16] += 1
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], i % 3))
    return spark.createDataFrame(rows, "record_id long, embedding array<float>, label int")


def brute(queries, items, k, metric="l2"):
    out = {}
    for qk, q in queries:
        scored = []
        for ik, x in items:
            d = float(np.linalg.norm(np.subtract(q, x)))
            scored.append((round(d, 12) if metric == "l2" else -round(float(np.dot(q, x)), 12), ik, d))
        scored.sort()
        out[qk] = ([s[1] for s in scored[:k]], sum(math.exp(-s[2]) for s in scored))
    return out


def test_classes_are_recovered_and_shares_sum_to_one(separable):
    means, centroids = fs.centered_centroids(separable)
    ranked = fs.classify(fs.center(separable, means), centroids, ["record_id", "label"], top_k=None)
    assert ranked.where("rank_position = 1 and rank_value <> label").count() == 0
    sums = ranked.groupBy("record_id").agg(F.sum("softmax_score").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_margin_is_the_gap_of_the_first_two_or_one(separable):
    means, centroids = fs.centered_centroids(separable)
    ranked = fs.classify(fs.center(separable, means), centroids, "record_id", top_k=2).orderBy("record_id", "rank_position").collect()
    assert ranked[0]["margin"] == pytest.approx(ranked[0]["softmax_score"] - ranked[1]["softmax_score"])
    one = fs.classify(fs.center(separable, means), centroids.where("label = 0"), "record_id", top_k=3)
    assert {r["margin"] for r in one.collect()} == {1.0}


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_blocked_scoring_equals_shipped_and_brute_force(separable, metric):
    vectors = [(r["record_id"], r["embedding"]) for r in separable.collect()]
    want = brute(vectors, vectors, 4, metric)
    items = separable.withColumnRenamed("record_id", "item")
    for options in ({}, {"ship_bytes": 0, "block_rows": 7}):
        got = fs.nearest_items(separable, items, 4, "record_id", "item", item_vector="embedding", metric=metric, **options)
        lists = {}
        for r in got.orderBy("record_id", "pos").collect():
            lists.setdefault(r["record_id"], []).append(r["item_item"])
            assert r["exp_sum"] == pytest.approx(want[r["record_id"]][1])
        assert lists == {k: v[0] for k, v in want.items()}


def test_blocked_scoring_keeps_models_apart(separable):
    both = separable.withColumn("rank", F.explode(F.array(F.lit("family"), F.lit("genus"))))
    means, centroids = fs.centered_centroids(both, "label", "rank")
    queries = fs.center(both, means, "rank")
    a = fs.classify(queries, centroids, "record_id", "label", "rank", 2)
    b = fs.classify(queries, centroids, "record_id", "label", "rank", 2, ship_bytes=0, block_rows=4)
    key = ["rank", "record_id", "rank_position", "rank_value"]
    assert a.select(key).exceptAll(b.select(key)).count() == 0 and b.count() == 120
    gap = a.join(b.select(*key, F.col("margin").alias("m2"), F.col("softmax_score").alias("s2")), key)
    assert gap.where("abs(softmax_score - s2) > 1e-9 or abs(margin - m2) > 1e-9").count() == 0


def test_k_is_clamped_and_zero_vectors_stay_zero(spark, separable):
    few = separable.limit(3)
    assert fs.nearest_items(few, few.withColumnRenamed("record_id", "i"), 9, "record_id", "i", item_vector="embedding").count() == 9
    zero = spark.sql("select array(0.0, 0.0) as v").select(l2_normalize(F.col("v")).alias("v")).first()["v"]
    assert zero == [0.0, 0.0]


def test_pooling_and_majority(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", 1), (1, [0.0, 1.0], "b", 2), (2, [2.0, 0.0], "b", 3)], "g int, embedding array<double>, label string, pos int")
    pooled = {r["g"]: r for r in fs.pool(df, "g").collect()}
    assert pooled[1]["embedding"] == pytest.approx([math.sqrt(0.5)] * 2) and pooled[1]["num_images"] == 2
    truth = {r["g"]: (r["label"], r["mixed_labels"]) for r in fs.majority_label(df, "g", "label", "pos").collect()}
    assert truth == {1: ("a", True), 2: ("b", False)}


def test_threshold_is_infinite_without_correct_rows(spark):
    df = spark.createDataFrame([("g", 1, 1, 0.5), ("g", 1, 1, 0.7), ("f", 1, 2, 0.1)], "rank string, rank_value int, truth int, l2_distance double")
    got = {r["rank"]: r["threshold"] for r in fs.calibrate_thresholds(df, "truth").collect()}
    assert got["g"] == pytest.approx(0.69) and math.isinf(got["f"])
    gate = fs.distance_gate(df, fs.calibrate_thresholds(df, "truth")).where("rank = 'g'").orderBy("l2_distance").collect()
    assert [g["flag"] for g in gate] == [None, "g_distance_exceeds_threshold"]


def test_hierarchy_notes(spark):
    top = spark.createDataFrame([("s", "family", "F1"), ("s", "genus", "G2"), ("s", "species", "unknown")], "key string, rank string, rank_value string")
    links = spark.createDataFrame([("genus", "G2", "family", "F2")], "child_rank string, child string, parent_rank string, parent string")
    out = fs.hierarchy_consistency(top, links, "key").first()
    assert not out["consistent"] and out["species_genus_agree"] and out["species_family_agree"]
    assert out["notes"] == ["Genus 'G2' belongs to family 'F2', but family classifier predicted 'F1'"]


def test_estimator(separable):
    model = CentroidClassifier().fit(separable)
    assert model.transform(separable).where("prediction <> label").count() == 0
    assert model.probabilities(separable).count() == 90


def test_search_applies_the_minimum_after_the_cut(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "taxon string, embedding array<double>")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "q int, embedding array<double>")
    got = [(r["item_taxon"], round(r["score"], 3)) for r in rt.search(query, index, "q", "taxon", 2, 0.9).collect()]
    assert got == [("a", 1.0)]


def test_cross_reference_signals(spark):
    hits = spark.createDataFrame([(1, t, s) for t, s in [("Fab", 0.6), ("fab", 0.2), ("Mor", 0.4), ("A", 0.1), ("B", 0.2), ("C", 0.3), ("D", 0.35)]], "k int, taxon string, score double")
    preds = spark.createDataFrame([(1, "FAB", 0.5), (1, "mor", 0.9), (1, "Z", 0.1)], "k int, rank_value string, softmax_score double")
    got = {r["taxon"]: r["signal"] for r in rt.cross_reference(hits, preds, "k").collect()}
    assert got == {"Fab": "strong", "Mor": "moderate", "D": "rag_only", "C": "rag_only", "B": "rag_only", "Z": "visual_only"}


def test_retrieval_quality_counts_empty_results(spark):
    specimens = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    hits = spark.createDataFrame([(1, 2, True), (1, 5, True), (2, 1, False)], "k int, pos int, ok boolean")
    got = rt.retrieval_quality(hits, specimens, "k", "pos", F.col("ok")).first()
    assert got["n"] == 3 and got["mrr"] == pytest.approx(0.5 / 3) and got["recall_at_1"] == 0 and got["recall_at_3"] == pytest.approx(1 / 3)
