import pytest
from pyspark.sql import functions as F

from specgrade.operators import splitting as sp


@pytest.fixture(scope="module")
def records(spark):
    """3 families x 10 individuals x 5 images."""
    return spark.range(150).select(
        F.col("id").alias("record_id"),
        F.concat(F.lit("ind"), F.floor(F.col("id") / 5)).alias("individual_id"),
        F.element_at(F.array(F.lit("Fabaceae"), F.lit("Meliaceae"), F.lit("Moraceae")), (F.floor(F.col("id") / 50) + 1).cast("int")).alias("label"),
    )


def test_no_individual_is_in_two_parts(records):
    split = sp.group_split(records)
    assert split.groupBy("individual_id").agg(F.countDistinct("split_part").alias("n")).where("n > 1").count() == 0
    assert split.count() == 150 and split.select("record_id").distinct().count() == 150


def test_sizes_round_up_twice(spark):
    """2,112 individuals give 1,478 / 317 / 317."""
    df = spark.range(2112).select(F.col("id").cast("string").alias("individual_id"))
    sizes = {r[0]: r[1] for r in sp.group_split(df).groupBy("split_part").count().collect()}
    assert sizes == {"train": 1478, "val": 317, "test": 317}


def test_split_is_reproducible_and_depends_on_the_seed(records):
    a, b = sp.group_split(records, seeds=1), sp.group_split(records.repartition(7), seeds=1)
    assert a.exceptAll(b).count() == 0
    both = sp.group_split(records, seeds=[1, 2])
    assert both.count() == 300
    assert both.groupBy("individual_id").agg(F.countDistinct("split_part").alias("n")).where("n > 1").count() > 0


def test_bad_input_is_an_error(spark, records):
    with pytest.raises(ValueError):
        sp.group_split(records, train=0.5)
    with pytest.raises(Exception, match="individual id"):
        sp.group_split(records.withColumn("individual_id", F.lit(" "))).collect()


def test_hash_split_keeps_individuals_together(records):
    split = sp.hash_split(records)
    assert split.groupBy("individual_id").agg(F.countDistinct("split_part").alias("n")).where("n > 1").count() == 0


def test_stratified_shares(records):
    out = sp.stratified_split(records)
    counts = {(r[0], r[1]): r[2] for r in out.groupBy("label", "split_part").count().collect()}
    sizes = {p: sum(n for (_, q), n in counts.items() if q == p) for p in sp.PARTITIONS}
    assert sizes == {"train": 104, "val": 23, "test": 23}
    assert all(7 <= n <= 8 for (_, p), n in counts.items() if p != "train")
    assert sp.under_sampled_classes(records.limit(5), "label").count() == 1


def test_support_set_and_its_error(records):
    top = sp.support_set(records, 4)
    assert {r[1] for r in top.groupBy("label").count().collect()} == {4}
    with pytest.raises(Exception, match="too few"):
        sp.support_set(records, 51).collect()


def test_episodes(records):
    ep = sp.sample_episodes(records, 6, n_way=2, k_shot=3, n_query=4)
    shape = {tuple(r)[1:] for r in ep.groupBy("episode", "label", "role").count().select("episode", "role", "count").collect()}
    assert shape == {("support", 3), ("query", 4)}
    assert {r[1] for r in ep.groupBy("episode").agg(F.countDistinct("label")).collect()} == {2}
    assert ep.groupBy("episode", "record_id").count().where("count > 1").count() == 0
    with pytest.raises(Exception, match="too few"):
        sp.sample_episodes(records, 2, k_shot=40, n_query=20).collect()


def test_individuals_are_drawn_from_test_or_val_only(records):
    split = sp.group_split(records)
    one = sp.sample_individual(split, "test", 3).first()[0]
    assert split.where(F.col("individual_id") == one).first()["split_part"] == "test"
    with pytest.raises(ValueError):
        sp.sample_individual(split, "train")


def test_statistics_and_feasibility(spark):
    df = spark.createDataFrame([("a", "train")] * 6 + [("b", "train")] * 3 + [("b", "test")], "label string, split_part string")
    s = {r["split_part"]: r for r in sp.class_statistics(df).collect()}
    assert (s["train"]["min_samples"], s["train"]["median_samples"], s["train"]["std_samples"]) == (3, 4.5, 1.5)
    assert sp.feasible_shots(df).first()["recommended"] == [1]
    assert [r["valid"] for r in sp.shot_feasibility(df, [1, 3, 5]).orderBy("k").collect()] == [True, True, False]
    assert [r["label"] for r in sp.small_classes(df).collect()] == ["b"]


def test_shard_takes_every_nth(spark):
    got = [r[0] for r in sp.shard(spark.range(20), "id", 2, 6).orderBy("id").collect()]
    assert got == [2, 8, 14]
